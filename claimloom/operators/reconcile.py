"""Reported against derived amounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.numbers import additional_value, availability, decimal_amount
from claimloom.schema import MoneyColumn

EXACT = "decimal(38,10)"


def money_facts(rows: DataFrame, keep: Sequence[str], columns: Sequence[MoneyColumn], strict: bool = False) -> DataFrame:
    """One row per claim and amount column, missing amounts included.

    Each money column is read under its header name from the ``row`` map.
    """
    entries = []
    for column in columns:
        raw = F.col("row")[column.header]
        parsed = decimal_amount(raw)
        entries.append(
            F.struct(
                F.lit(column.metric).alias("metric"),
                F.lit(column.header).alias("source_field"),
                F.lit(column.position).cast("bigint").alias("source_column"),
                raw.alias("raw_value"),
                parsed.alias("parsed_value"),
                availability(parsed, raw, strict).alias("availability"),
            )
        )
    return rows.select(*keep, F.inline(F.array(*entries)))


def _status(missing: Column, exact: Column, tolerated: Column) -> Column:
    return (
        F.when(missing, "missing_component")
        .when(exact, "exact_match")
        .when(tolerated, "tolerance_match")
        .otherwise("mismatch")
    )


def reconcile_strict(initial: Column, current: Column, source: Column) -> Column:
    """{value, status, difference} on decimals: exact, within one cent, or mismatch.

    A missing source amount gives a mismatch with no difference.
    """
    value = additional_value(initial, current)
    difference = value - source
    missing = initial.isNull() | current.isNull()
    cent = F.lit("0.01").cast("decimal(3,2)")
    status = _status(missing, difference == 0, F.abs(difference) <= cent)
    return F.struct(
        value.cast(EXACT).alias("value"), status.alias("status"), difference.cast(EXACT).alias("difference")
    )


def reconcile_audit(
    initial: Column, current: Column, source: Column, exact_below: float = 0.005, tolerance: float = 1.0
) -> Column:
    """Status on doubles, as the audit rates it: any missing amount counts as missing."""
    difference = F.abs(additional_value(initial, current) - source)
    missing = initial.isNull() | current.isNull() | source.isNull()
    return _status(missing, difference < F.lit(exact_below), difference <= F.lit(tolerance))
