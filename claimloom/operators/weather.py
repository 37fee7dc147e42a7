"""Matches between claims and weather events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.intervals import join_days, levels_for


def selected_matches(matches: DataFrame, claims: DataFrame) -> DataFrame:
    """Matches of the selected claims."""
    return matches.join(claims.select(F.col("id").alias("claim_id")), "claim_id", "left_semi")


def event_rollup(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches and mean confidence per event; events without a match stay."""
    counted = matches.groupBy(F.col("weather_event_id").alias("id")).agg(
        F.count("*").alias("matches"),
        F.sum(F.col("confidence").cast("decimal(20,6)")).alias("_sum"),
    )
    mean = F.when(F.col("matches") > 0, F.col("_sum").cast("double") / F.col("matches").cast("double"))
    return (
        events.join(counted, "id", "left")
        .withColumn("matches", F.coalesce("matches", F.lit(0)))
        .withColumn("mean_confidence", mean)
        .drop("_sum")
    )


def match_events(claims: DataFrame, events: DataFrame, window_days: int, prefix_length: int = 2) -> DataFrame:
    """Claims whose state, ZIP prefix and loss date agree with an event.

    The event's area is unrolled to (state, prefix), and its days are cut into
    aligned blocks, so the match is an equi-join instead of a range join. The
    catalogue has states × prefixes × 2 log2(2·window+1) rows per event at most;
    Spark broadcasts it only while its size allows.
    """
    areas = (
        events.select("id", "occurred_at", F.explode(F.array_distinct("states")).alias("state"), "zip_prefixes")
        .select("id", "occurred_at", "state", F.explode(F.array_distinct("zip_prefixes")).alias("_prefix"))
        .withColumnRenamed("id", "weather_event_id")
        .withColumns({"_from": F.date_sub("occurred_at", window_days), "_to": F.date_add("occurred_at", window_days)})
    )
    located = claims.select(
        F.col("id").alias("claim_id"),
        "state",
        F.substring("zip_code", 1, prefix_length).alias("_prefix"),
        F.col("opened_at").alias("_day"),
    )
    gap = F.abs(F.date_diff("_day", "occurred_at"))
    closeness = (F.lit(1) - gap.cast("decimal(10,0)") / F.lit(window_days + 1)).cast("decimal(7,4)")
    met = join_days(areas, located, ["state", "_prefix"], "_from", "_to", "_day", levels_for(2 * window_days + 1))
    return met.select(
        "claim_id", "weather_event_id", gap.cast("bigint").alias("gap_days"), closeness.alias("confidence")
    )
