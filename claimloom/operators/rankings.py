"""Ranked and per-dimension frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.envelope import coverage_percent, grade
from claimloom.functions.numbers import percent_of
from claimloom.operators.distributed import OrderKey, indexed_position, order_index
from claimloom.operators.filters import ClaimFilter, filter_claims, is_closed, usable_amount
from claimloom.operators.metrics import mean_of, metric_totals
from claimloom.session import kept


def _dimension_order(dimension: DataFrame) -> str:
    return "ordinal" if "ordinal" in dimension.columns else "id"


def carrier_mix(claims: DataFrame, carriers: DataFrame) -> DataFrame:
    """Files per carrier and their share of all selected files, largest first.

    Carriers without files are left out; files of an unknown carrier stay in
    the total. The position window runs over one row per carrier.
    """
    counts = claims.groupBy("carrier_id").agg(F.count("*").alias("files"))
    total = counts.agg(F.sum("files")).scalar()
    tie = _dimension_order(carriers)
    named = counts.join(carriers.withColumnRenamed("id", "carrier_id"), "carrier_id")
    tie = "carrier_id" if tie == "id" else tie
    position = F.row_number().over(Window.orderBy(F.desc("files"), F.asc(tie)))
    return named.select(
        F.col("carrier_id").alias("id"),
        "name",
        "files",
        percent_of(F.col("files"), total).alias("share_percent"),
        position.cast("bigint").alias("position"),
    )


def carrier_scorecard(claims: DataFrame, carriers: DataFrame) -> DataFrame:
    """Mean value, mean cycle and coverage with grade for every carrier with files."""
    totals = metric_totals(claims, ["carrier_id"])
    coverage = coverage_percent(F.col("usable"), F.col("files"))
    return totals.join(carriers.withColumnRenamed("id", "carrier_id"), "carrier_id").select(
        F.col("carrier_id").alias("id"),
        "name",
        "files",
        mean_of("gain_sum", "gain_n").alias("mean_additional_value"),
        mean_of("cycle_sum", "cycle_n").alias("mean_cycle_days"),
        percent_of(F.col("usable"), F.col("files")).alias("coverage_value"),
        coverage.alias("coverage_percent"),
        grade(coverage).alias("grade"),
    )


def contractor_totals(claims: DataFrame, contractors: DataFrame) -> DataFrame:
    """Per contractor with files: files, closed files, recovered value, close rate.

    The recovered value is zero when no amount is usable; ``usable_count`` tells
    the two cases apart.
    """
    gain = usable_amount("additional_rcv")
    totals = claims.groupBy("contractor_id").agg(
        F.count("*").alias("files"),
        F.count_if(is_closed()).alias("closed"),
        F.coalesce(F.sum(gain), F.lit(0)).alias("recovered"),
        F.count(gain).alias("usable_count"),
    )
    return totals.join(contractors.withColumnRenamed("id", "contractor_id"), "contractor_id").withColumn(
        "close_rate", percent_of(F.col("closed"), F.col("files"))
    )


def contractor_ranking(claims: DataFrame, contractors: DataFrame) -> DataFrame:
    """Contractors by recovered value, with position and share of the largest value.

    There may be many contractors, so the totals are kept once and numbered by
    ranges of their order.
    """
    tie = _dimension_order(contractors)
    totals = kept(contractor_totals(claims, contractors), "totals")
    order = [OrderKey(F.col("recovered"), descending=True), OrderKey(F.col("contractor_id" if tie == "id" else tie))]
    placed = indexed_position(totals, order_index(totals, order))
    best = placed.agg(F.greatest(F.max("recovered").cast("double"), F.lit(1.0))).scalar()
    return placed.withColumn("percent_of_largest", F.col("recovered").cast("double") / best * 100.0)


def quarter_trend(claims: DataFrame, quarters: DataFrame, chosen: ClaimFilter) -> DataFrame:
    """Files per listed quarter, zero included, under all other filters."""
    counts = (
        filter_claims(claims, chosen.with_quarter("all"))
        .groupBy(F.col("source_quarter").alias("quarter"))
        .agg(F.count("*").alias("files"))
    )
    return quarters.join(counts, "quarter", "left").withColumn("files", F.coalesce("files", F.lit(0)))


def prior_quarters(quarters: DataFrame) -> DataFrame:
    """Each listed quarter with the one before it; one row per calendar quarter."""
    return quarters.withColumn("prior_quarter", F.lag("quarter").over(Window.orderBy("ordinal")))


def share_of_largest(df: DataFrame, value: str, out: str) -> DataFrame:
    """Percentage of the largest value; the largest counts as at least one."""
    best = df.agg(F.greatest(F.max(value).cast("double"), F.lit(1.0))).scalar()
    return df.withColumn(out, F.col(value).cast("double") / best * 100.0)


def counts_by(df: DataFrame, columns: Sequence[str], out: str = "rows") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(out))


def most_frequent(df: DataFrame, column: str, tie: Column | None = None) -> DataFrame:
    """The value with the most rows; ties go to the smallest ``tie`` (default: the value)."""
    counts = df.groupBy(column).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), tie if tie is not None else F.asc(column)).limit(1)


def only_in_first(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """Distinct values of the first frame that the second lacks."""
    values = first.select(column).where(F.col(column).isNotNull()).distinct()
    return values.join(second.select(column).distinct(), column, "left_anti")
