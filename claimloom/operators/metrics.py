"""Dashboard metrics, each with its trust envelope."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.dates import cycle_days, days_since
from claimloom.functions.envelope import metric_row
from claimloom.functions.numbers import percent_of
from claimloom.operators.distributed import BLOCK_ROWS, carry_last, exact_median
from claimloom.operators.filters import is_active, is_closed, is_usable, usable_amount
from claimloom.schema import AGE_BUCKETS

SCOPE = "_scope"


def _aggregates() -> list[Column]:
    """Every sum and count the panel needs, all in one pass over the claims."""
    gain = usable_amount("additional_rcv")
    fee = usable_amount("service_fee")
    cycle = cycle_days(F.col("opened_at"), F.col("closed_at"))
    return [
        F.count("*").alias("files"),
        F.count_if(F.col("service_type") == "estimate_only").alias("estimate_only"),
        F.count_if(F.col("service_type") == "claim_handling").alias("claim_handling"),
        F.count_if(is_active()).alias("active"),
        F.count_if(is_closed()).alias("closed"),
        F.count_if(is_usable()).alias("usable"),
        F.sum(gain).alias("gain_sum"),
        F.count(gain).alias("gain_n"),
        F.sum(fee).alias("fee_sum"),
        F.count(fee).alias("fee_n"),
        F.sum(cycle).alias("cycle_sum"),
        F.count(cycle).alias("cycle_n"),
    ]


def metric_totals(claims: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Sums and counts per group; without a group always exactly one row."""
    if group:
        return claims.groupBy(*group).agg(*_aggregates())
    return claims.agg(*_aggregates())


def mean_of(total: str, count: str) -> Column:
    return F.when(F.col(count) > 0, F.col(total).cast("double") / F.col(count).cast("double"))


def _panel_rows(with_medians: bool, minimum_coverage: int | None) -> list[Column]:
    files = F.col("files")

    def row(name: str, value: Column, part: str, why: str, drill: dict[str, str] | None = None) -> Column:
        return metric_row(name, value, F.col(part), files, why, drill, minimum_coverage=minimum_coverage)

    rows = [
        row("total_files", files, "files", "Number of selected files."),
        row("estimate_only_files", F.col("estimate_only"), "estimate_only", "Files whose service is an estimate.",
            {"service_type": "estimate_only"}),
        row("claim_handling_files", F.col("claim_handling"), "claim_handling", "Files with full claim handling.",
            {"service_type": "claim_handling"}),
        row("active_inventory", F.col("active"), "active", "Files in any status but closed."),
        row("closed_files", F.col("closed"), "closed", "Files in status closed, with or without a closing date."),
        row("additional_value", F.col("gain_sum"), "gain_n", "Total additional value of files with usable amounts."),
        row("mean_additional_value", mean_of("gain_sum", "gain_n"), "gain_n",
            "Average additional value of files with usable amounts."),
        row("fee_revenue", F.col("fee_sum"), "fee_n", "Total service fee of files with usable amounts."),
        row("mean_cycle_days", mean_of("cycle_sum", "cycle_n"), "cycle_n", "Average days from opening to closing."),
        row("financial_coverage", percent_of(F.col("usable"), files), "usable",
            "Percentage of files with usable amounts."),
    ]
    if with_medians:
        rows += [
            row("median_additional_value", F.col("gain_median"), "gain_n",
                "Middle additional value of files with usable amounts."),
            row("median_cycle_days", F.col("cycle_median"), "cycle_n", "Middle number of days from opening to closing."),
        ]
    return rows


def _with_medians(claims: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    """Both medians from one frame of (group, measure, value)."""
    keys = group or [SCOPE]
    if not group:
        claims, totals = claims.withColumn(SCOPE, F.lit(0)), totals.withColumn(SCOPE, F.lit(0))
    gain = usable_amount("additional_rcv")
    cycle = cycle_days(F.col("opened_at"), F.col("closed_at"))
    measures = F.array(
        F.struct(F.lit("gain").alias("measure"), gain.cast("decimal(38,10)").alias("value")),
        F.struct(F.lit("cycle").alias("measure"), cycle.cast("decimal(38,10)").alias("value")),
    )
    tall = claims.select(*keys, F.inline(measures))
    medians = exact_median(tall, [*keys, "measure"], "value", "median")
    wide = medians.groupBy(*keys).agg(
        F.max(F.when(F.col("measure") == "gain", F.col("median"))).alias("gain_median"),
        F.max(F.when(F.col("measure") == "cycle", F.col("median"))).alias("cycle_median"),
    )
    return totals.join(wide, keys, "left")


def metric_panel(
    claims: DataFrame,
    group: Sequence[str] = (),
    with_medians: bool = True,
    minimum_coverage: int | None = None,
) -> DataFrame:
    """One row per metric (and group): value plus envelope."""
    group = list(group)
    totals = metric_totals(claims, group)
    if with_medians:
        totals = _with_medians(claims, totals, group)
    return totals.select(*group, F.inline(F.array(*_panel_rows(with_medians, minimum_coverage))))


def update_gaps(updates: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Days between each update and the one stored before it, never below zero.

    ``updates`` has (claim_id, position, at); the stored position decides the
    neighbour, not the time.
    """
    previous = carry_last(updates, ["claim_id"], "position", {"previous_at": F.col("at")}, block_rows, inclusive=False)
    return previous.where(F.col("previous_at").isNotNull()).withColumn(
        "gap_days", days_since(F.col("previous_at"), F.col("at"))
    )


def update_frequency(claims: DataFrame, updates: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Average gap between the stored updates of active files, as one metric row.

    The denominator is the number of active files while the numerator counts
    gaps, so the coverage may pass 100.
    """
    active = claims.where(is_active()).select(F.col("id").alias("claim_id"))
    gaps = (
        update_gaps(updates, block_rows)
        .groupBy("claim_id")
        .agg(F.sum("gap_days").alias("days"), F.count("*").alias("gaps"))
        .join(active, "claim_id", "left_semi")
        .agg(F.sum("days").alias("days"), F.sum("gaps").alias("gaps"))
        .withColumn(SCOPE, F.lit(0))
    )
    files = active.agg(F.count("*").alias("files")).withColumn(SCOPE, F.lit(0))
    both = files.join(gaps, SCOPE, "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    row = metric_row(
        "update_frequency", mean_of("days", "gaps"), F.col("gaps"), F.col("files"),
        "Average days between stored updates of active files.",
    )
    return both.select(F.inline(F.array(row)))


def nested_update_frequency(claims: DataFrame) -> DataFrame:
    """The same for claims that carry their updates as an array: no shuffle of rows."""
    at = F.col("updates.at")
    gaps = F.when(
        F.size(at) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(at) - 1), lambda i: days_since(F.element_at(at, i), F.element_at(at, i + 1))
        ),
    )
    per_file = claims.where(is_active()).select(
        F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap).alias("days"),
        F.coalesce(F.size(gaps), F.lit(0)).alias("gaps"),
    )
    totals = per_file.agg(
        F.count("*").alias("files"),
        F.sum("days").alias("days"),
        F.coalesce(F.sum(F.when(F.col("gaps") > 0, F.col("gaps"))), F.lit(0)).alias("gaps"),
    )
    row = metric_row(
        "update_frequency", mean_of("days", "gaps"), F.col("gaps"), F.col("files"),
        "Average days between stored updates of active files.",
    )
    return totals.select(F.inline(F.array(row)))


def last_update(updates: DataFrame) -> DataFrame:
    return updates.groupBy("claim_id").agg(F.max("at").alias("last_update_at"))


def days_since_last_update(claims: DataFrame, updates: DataFrame, as_of: str | date) -> DataFrame:
    """Days since the newest update of each claim; NULL for a claim without updates."""
    newest = last_update(updates).withColumnRenamed("claim_id", "id")
    return claims.join(newest, "id", "left").withColumn(
        "days_since_last_update", days_since(F.col("last_update_at"), F.lit(as_of).cast("date"))
    )


def ageing_buckets(claims: DataFrame, as_of: str | date, upper_bound: int | None = None) -> DataFrame:
    """Active files by age; all buckets are present, with their share of the largest.

    The last bucket is open; it ends at ``upper_bound`` days when one is given. A file opened after ``as_of`` has age zero.
    """
    edges = [list(edge) for edge in AGE_BUCKETS]
    if upper_bound is not None:
        edges[-1][2] = upper_bound
    age = days_since(F.col("opened_at"), F.lit(as_of).cast("date"))
    counts = [
        F.count_if(is_active() & (age >= low) & (F.lit(True) if high is None else age <= high)).alias(label)
        for label, low, high in edges
    ]
    totals = claims.agg(*counts)
    largest = F.greatest(F.lit(1), *[F.col(f"`{label}`") for label, _, _ in edges])
    rows = [
        F.struct(
            F.lit(ordinal).cast("bigint").alias("ordinal"),
            F.lit(label).alias("bucket"),
            F.col(f"`{label}`").alias("files"),
            (F.col(f"`{label}`").cast("double") / largest.cast("double") * 100.0).alias("percent_of_largest"),
        )
        for ordinal, (label, _, _) in enumerate(edges, 1)
    ]
    return totals.select(F.inline(F.array(*rows)))


def report_index(claims: DataFrame) -> DataFrame:
    """Scope and coverage figures of the four standing reports."""
    totals = metric_totals(claims)
    files = F.col("files")
    rows = [
        F.struct(
            F.lit(ordinal).cast("bigint").alias("ordinal"),
            F.lit(report).alias("report"),
            F.lit(measure).alias("scope_measure"),
            value.cast("double").alias("scope_value"),
            percent_of(F.col(part), files).alias("coverage_value"),
        )
        for ordinal, (report, measure, value, part) in enumerate(
            (
                ("executive", "files", files, "usable"),
                ("additional_value", "additional_value", F.col("gain_sum"), "gain_n"),
                ("throughput", "mean_cycle_days", mean_of("cycle_sum", "cycle_n"), "cycle_n"),
                ("weather", "files", files, "files"),
            ),
            1,
        )
    ]
    return totals.select(F.inline(F.array(*rows)))
