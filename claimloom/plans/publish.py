"""Published read views, the live summary and claim details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.numbers import percent_of
from claimloom.functions.text import join_key
from claimloom.operators.explorer import updates_in_order
from claimloom.operators.filters import find_by_id, is_captured_fact
from claimloom.operators.joins import claim_list

# fixed values: the columns each published view may show
PUBLISHED_COLUMNS = {
    "organizations": ("organization_id", "organization_type", "display_name"),
    "claims": (
        "claim_id", "source_system", "item_id", "display_name", "raw_status", "normalized_status", "lifecycle_state",
        "contractor_id", "carrier_id", "assigned_date", "closed_date", "status_change_date", "service_type",
        "property_type", "source_row_id",
    ),
    "claim_financial_facts": (
        "claim_id", "source_field_name", "normalized_metric_name", "parsed_numeric_value",
        "source_availability_status", "source_sheet", "source_row", "source_column", "transformation_version",
    ),
    "claim_derived_metrics": (
        "claim_id", "metric_name", "metric_version", "calculated_value", "source_comparison_value",
        "reconciliation_status", "difference", "confidence",
    ),
    "claim_updates": (
        "post_id", "claim_id", "update_body", "blank_body", "duplicate_body", "source_timestamp_raw",
        "parsed_timestamp", "timezone_status", "author_name", "source_sheet", "source_row",
    ),
    "source_rows": ("source_row_id", "physical_row"),
}


def published(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Approved columns only, and only updates that belong to a known claim."""
    views = {}
    for name, columns in PUBLISHED_COLUMNS.items():
        rows = tables[name]
        if name == "claim_updates":
            rows = rows.where(F.col("claim_id").isNotNull() & ~F.col("unmatched_source"))
        views[name] = rows.select(*columns)
    return views


def financial_sums(facts: DataFrame) -> DataFrame:
    """Sum, available and total rows of each metric; the sum is zero when nothing is captured."""
    captured = is_captured_fact()
    return facts.groupBy("normalized_metric_name").agg(
        F.coalesce(F.sum(F.when(captured, F.col("parsed_numeric_value"))), F.lit(0)).alias("value"),
        F.count_if(captured).alias("available"),
        F.count("*").alias("total"),
    )


def live_summary(claims: DataFrame, facts: DataFrame, derived: DataFrame) -> DataFrame:
    """Nine labelled metrics in one row per metric; empty without claims.

    The reconciled figure sums the derived metric itself, and every availability
    is counted from the data.
    """
    counts = claims.agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("raw_status") == "Complete").alias("complete"),
        F.count_if(F.col("raw_status") == "Closed").alias("closed"),
    ).withColumn("_k", F.lit(1))
    captured = is_captured_fact()
    metrics = ("initial_rcv", "current_rcv", "additional_secured", "client_fee")

    def of(metric: str) -> Column:
        return F.col("normalized_metric_name") == metric

    sums = facts.where(F.col("normalized_metric_name").isin(*metrics)).agg(
        *[
            column
            for m in metrics
            for column in (
                F.coalesce(F.sum(F.when(of(m) & captured, F.col("parsed_numeric_value"))), F.lit(0)).alias(m),
                F.count_if(of(m) & captured).alias(f"{m}_available"),
                F.count_if(of(m)).alias(f"{m}_total"),
            )
        ]
    ).withColumn("_k", F.lit(1))
    calculated = derived.agg(
        F.coalesce(F.sum("calculated_value"), F.lit(0)).alias("calculated"),
        F.count("calculated_value").alias("calculated_available"),
        F.count("*").alias("calculated_total"),
    ).withColumn("_k", F.lit(1))

    def row(
        ordinal: int, key: str, value: Column, shape: str, available: Column, total: Column, confidence: str,
        kind: str = "source_provided",
    ) -> Column:
        return F.struct(
            F.lit(ordinal).cast("bigint").alias("ordinal"),
            F.lit(key).alias("metric"),
            value.cast("double").alias("value"),
            F.lit(shape).alias("format"),
            available.cast("bigint").alias("available"),
            total.cast("bigint").alias("total"),
            F.lit(confidence).alias("confidence"),
            F.lit(kind).alias("kind"),
        )

    claims_n = F.col("claims")

    def money(ordinal: int, metric: str, confidence: str) -> Column:
        return row(
            ordinal, metric, F.col(metric), "currency", F.col(f"{metric}_available"), F.col(f"{metric}_total"), confidence
        )

    coverage = F.coalesce(percent_of(F.col("initial_rcv_available"), F.col("initial_rcv_total")), F.lit(0.0))
    rows = [
        row(1, "claims", claims_n, "count", claims_n, claims_n, "A"),
        row(2, "complete", F.col("complete"), "count", claims_n, claims_n, "A"),
        row(3, "closed", F.col("closed"), "count", claims_n, claims_n, "A"),
        money(4, "initial_rcv", "B"),
        money(5, "current_rcv", "A"),
        money(6, "additional_secured", "B"),
        row(7, "calculated_additional", F.col("calculated"), "currency", F.col("calculated_available"),
            F.col("calculated_total"), "A", "derived"),
        money(8, "client_fee", "B"),
        row(9, "financial_coverage", coverage, "percent", F.col("initial_rcv_available"), F.col("initial_rcv_total"), "A"),
    ]
    joined = counts.join(sums, "_k").join(calculated, "_k").where(claims_n > 0)
    return joined.select(F.inline(F.array(*rows)))


def require_claims(summary: DataFrame) -> DataFrame:
    """Raise when the summary is empty because no claim was imported."""
    if not summary.take(1):
        raise ValueError("no claims are available")
    return summary


def published_claim_list(tables: dict[str, DataFrame]) -> DataFrame:
    """Claim list by item id, compared as text."""
    rows = claim_list(tables["claims"], tables["organizations"], tables["source_rows"])
    return rows.select(
        "claim_id", "item_id", "display_name", "raw_status", "normalized_status", "contractor", "carrier", "source_row"
    ).orderBy("item_id")


def claim_details(tables: dict[str, DataFrame]) -> DataFrame:
    """All claims with facts and derived metrics nested.

    Both lists are bounded: one entry per metric and job. Updates are not
    nested, because one claim may have any number of them; see
    ``claim_detail_updates``.
    """
    base = claim_list(tables["claims"], tables["organizations"], tables["source_rows"])
    facts = tables["claim_financial_facts"].groupBy(join_key("claim_id").alias("_claim")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "source_column", "normalized_metric_name", "source_field_name", "parsed_numeric_value",
                    "source_availability_status",
                )
            )
        ).alias("financial_facts")
    )
    derived = tables["claim_derived_metrics"].groupBy(join_key("claim_id").alias("_claim")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "metric_name", "metric_version", "calculated_value", "source_comparison_value",
                    "reconciliation_status", "difference",
                )
            )
        ).alias("derived_metrics")
    )
    keyed = base.withColumn("_claim", join_key("claim_id"))
    return keyed.join(facts, "_claim", "left").join(derived, "_claim", "left").drop("_claim")


def claim_detail(tables: dict[str, DataFrame], claim_id: str) -> DataFrame:
    """The same for one claim. The id reaches every scan before the joins."""
    one = dict(tables)
    for name in ("claims", "claim_financial_facts", "claim_derived_metrics"):
        one[name] = find_by_id(tables[name], "claim_id", claim_id)
    return claim_details(one)


def claim_detail_updates(tables: dict[str, DataFrame], claim_id: str) -> DataFrame:
    """Updates of one claim, newest first."""
    return updates_in_order(published(tables)["claim_updates"].where(F.col("claim_id") == claim_id))
