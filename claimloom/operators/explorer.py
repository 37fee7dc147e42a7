"""Sorting, paging and picker values of the claim lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.distributed import RANGE_ROWS, OrderKey, order_index, ordered_slice
from claimloom.session import kept


def text_order(column: str, descending: bool = False, tie: Sequence[str] = ("id",)) -> list[OrderKey]:
    """Locale-aware text order of any column: NULL as empty, ties in key order."""
    text = F.collate(F.coalesce(F.col(column).cast("string"), F.lit("")), "UNICODE")
    return [OrderKey(text, descending), *[OrderKey(F.col(c)) for c in tie]]


def typed_order(column: str, descending: bool = False, tie: Sequence[str] = ("id",)) -> list[OrderKey]:
    """Order by the column's own type, NULL last."""
    return [OrderKey(F.col(column), descending, nulls_last=True), *[OrderKey(F.col(c)) for c in tie]]


def sort_rows(rows: DataFrame, order: Sequence[OrderKey]) -> DataFrame:
    return rows.orderBy(*[key.sort() for key in order])


def page_slice(rows: DataFrame, order: Sequence[OrderKey], page: int, size: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One page of the ordered rows; a page past the end gives the last one.

    An index of the order says which ranges hold the page; only their rows are
    sorted, so a deep page costs no more than the first, and no page passes
    through the driver.
    """
    # counting, sampling, cutting and the page all read them: whatever makes the rows runs once
    rows = kept(rows, "page-rows")
    index = order_index(rows, order, range_rows)
    pages = max(1, -(-index.total // size))
    current = min(page, pages)
    return (
        ordered_slice(rows, index, (current - 1) * size, size)
        .withColumn("page", F.lit(current).cast("bigint"))
        .withColumn("pages", F.lit(pages).cast("bigint"))
    )


def picker_values(rows: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values for a picker, missing ones left out."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def updates_in_order(updates: DataFrame) -> DataFrame:
    """Newest first, undated last, later source rows first."""
    return updates.orderBy(F.col("parsed_timestamp").desc_nulls_last(), F.desc("source_row"))
