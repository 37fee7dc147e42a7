"""The trust envelope that goes with every metric value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.numbers import half_up
from claimloom.schema import GRADE_CUTS


def coverage_percent(numerator: Column, denominator: Column) -> Column:
    """Whole percent, halves upward; zero when the denominator is zero."""
    ratio = F.coalesce(numerator, F.lit(0)).cast("double") / denominator.cast("double") * F.lit(100.0)
    return F.when(denominator != 0, half_up(ratio)).otherwise(F.lit(0)).cast("bigint")


def grade(coverage: Column, cuts: Sequence[tuple[int, str]] = GRADE_CUTS, lowest: str = "D") -> Column:
    result = F.lit(None).cast("string")
    for floor, letter in sorted(cuts):
        result = F.when(coverage >= floor, F.lit(letter)).otherwise(F.coalesce(result, F.lit(lowest)))
    return result


def metric_row(
    name: str,
    value: Column,
    numerator: Column,
    denominator: Column,
    explanation: str,
    drill_down: Mapping[str, str] | None = None,
    status: str = "measured",
    minimum_coverage: int | None = None,
    cuts: Sequence[tuple[int, str]] = GRADE_CUTS,
) -> Column:
    """One metric as a struct.

    Below ``minimum_coverage`` the value is withheld and the status says so;
    a missing value is never shown as zero.
    """
    coverage = coverage_percent(numerator, denominator)
    shown = value.cast("double")
    if minimum_coverage is not None:
        shown = F.when(coverage >= minimum_coverage, shown)
    pairs = [F.lit(text) for item in (drill_down or {}).items() for text in item]
    drill = F.create_map(*pairs) if pairs else F.create_map()
    return F.struct(
        F.lit(name).alias("metric"),
        shown.alias("value"),
        numerator.cast("bigint").alias("numerator"),
        denominator.cast("bigint").alias("denominator"),
        coverage.alias("coverage_percent"),
        grade(coverage, cuts).alias("grade"),
        F.when(shown.isNull(), F.lit("unavailable")).otherwise(F.lit(status)).alias("status"),
        F.lit(explanation).alias("explanation"),
        drill.cast("map<string,string>").alias("drill_down"),
    )
