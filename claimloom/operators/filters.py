"""Filters and predicates over claims and published rows."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.schema import EXTREME_PERCENTAGE, USABLE_FINANCIAL_STATUSES


@dataclass(frozen=True)
class ClaimFilter:
    """Seven optional conditions; an empty one does not filter."""

    quarter: str = ""
    start_date: str | date = ""
    end_date: str | date = ""
    contractor_id: str = ""
    carrier_id: str = ""
    state: str = ""
    service_type: str = ""

    def with_quarter(self, quarter: str) -> ClaimFilter:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        values["quarter"] = quarter
        return ClaimFilter(**values)


def filter_claims(claims: DataFrame, chosen: ClaimFilter) -> DataFrame:
    """Apply the non-empty conditions; both ends of the date range are inclusive."""
    result = claims
    if chosen.quarter and chosen.quarter != "all":
        result = result.where(F.col("source_quarter") == chosen.quarter)
    if chosen.start_date:
        result = result.where(F.col("opened_at") >= F.lit(chosen.start_date).cast("date"))
    if chosen.end_date:
        result = result.where(F.col("opened_at") <= F.lit(chosen.end_date).cast("date"))
    for column in ("contractor_id", "carrier_id", "state", "service_type"):
        wanted = getattr(chosen, column)
        if wanted:
            result = result.where(F.col(column) == wanted)
    return result


def is_usable(status: str = "financial_status") -> Column:
    return F.col(status).isin(*USABLE_FINANCIAL_STATUSES)


def usable_amount(column: str, status: str = "financial_status") -> Column:
    """The amount where its file has usable financial data, else NULL."""
    return F.when(is_usable(status) & F.col(column).isNotNull(), F.col(column))


def usable_values(claims: DataFrame, column: str) -> DataFrame:
    return claims.select("id", usable_amount(column).alias("value")).where(F.col("value").isNotNull())


def is_active(status: str = "status") -> Column:
    return F.col(status) != "closed"


def is_closed(status: str = "status") -> Column:
    return F.col(status) == "closed"


def is_captured_fact() -> Column:
    """Published fact rows that count: captured, with a value."""
    return (F.col("source_availability_status") == "captured") & F.col("parsed_numeric_value").isNotNull()


def is_extreme(percentage: str, limit: int = EXTREME_PERCENTAGE) -> Column:
    return F.col(percentage) >= limit


def closes_before_assigned(assigned: str, closed: str) -> Column:
    return F.col(closed) < F.col(assigned)


def count_impossible_dates(claims: DataFrame, assigned: str, closed: str) -> DataFrame:
    return claims.agg(F.count_if(closes_before_assigned(assigned, closed)).alias("assigned_after_closed"))


def search_claims(
    claims: DataFrame,
    contractors: DataFrame,
    carriers: DataFrame,
    text: str = "",
    status: str = "",
    financial_status: str = "",
) -> DataFrame:
    """Claims with their dimension names, kept when every given condition holds.

    The text is looked for in claim number, contractor and carrier name. A
    missing name adds nothing to the searched text.
    """
    rows = claims
    if status:
        rows = rows.where(F.col("status") == status)
    if financial_status:
        rows = rows.where(F.col("financial_status") == financial_status)
    named = rows.join(
        contractors.select(F.col("id").alias("contractor_id"), F.col("name").alias("contractor")),
        "contractor_id",
        "left",
    ).join(carriers.select(F.col("id").alias("carrier_id"), F.col("name").alias("carrier")), "carrier_id", "left")
    if text:
        haystack = F.lower(F.concat_ws(" ", "claim_number", "contractor", "carrier"))
        named = named.where(F.contains(haystack, F.lit(text.lower())))
    return named


def search_published_claims(
    claims: DataFrame, text: str = "", raw_status: str = "", contractor: str = "", carrier: str = ""
) -> DataFrame:
    """The same for the published claim list, over display name and item id."""
    rows = claims
    for column, wanted in (("raw_status", raw_status), ("contractor", contractor), ("carrier", carrier)):
        if wanted:
            rows = rows.where(F.col(column) == wanted)
    if text:
        haystack = F.lower(F.concat_ws(" ", "display_name", "item_id"))
        rows = rows.where(F.contains(haystack, F.lit(text.lower())))
    return rows


def find_by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """Point lookup; an unknown key gives an empty frame."""
    return df.where(F.col(key) == value)


def drop_empty(ranked: DataFrame, count: str) -> DataFrame:
    return ranked.where(F.col(count) > 0)
