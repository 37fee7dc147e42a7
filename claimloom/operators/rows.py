"""Row classes of a hierarchical sheet and the parents that position implies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import clean_text
from claimloom.operators.distributed import BLOCK_ROWS, carry_last
from claimloom.schema import SUBITEM_LABEL


def row_class(item_id: Column, name: Column, label: str = SUBITEM_LABEL) -> Column:
    """Claim when there is an item id, header when the name is the label, else detail."""
    return (
        F.when(clean_text(item_id).isNotNull(), "claim")
        .when(clean_text(name) == label, "subitem_header")
        .otherwise("subitem_detail")
    )


def audit_row_class(item_id: Column, name: Column, label: str = SUBITEM_LABEL) -> Column:
    """The audit's reading: a detail row needs blank id and blank name."""
    return (
        F.when(clean_text(item_id).isNotNull(), "claim")
        .when(clean_text(name) == label, "subitem_header")
        .when(clean_text(name).isNull(), "subitem_detail")
        .otherwise("unclassified")
    )


def with_row_class(rows: DataFrame, item_id: Column, name: Column) -> DataFrame:
    """Add item id and class, both from the row itself."""
    return rows.withColumn("source_item_id", clean_text(item_id)).withColumn("row_class", row_class(item_id, name))


def with_parents(
    classed: DataFrame,
    group: Sequence[str] = ("file_name", "sheet"),
    order: str = "physical_row",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the parent claim and, for details, the header row they stand under.

    The parent is the last claim at or above a row; a header counts only until
    the next claim starts.
    """
    is_claim = F.col("row_class") == "claim"
    filled = carry_last(
        classed,
        group,
        order,
        {
            "_claim": F.when(is_claim, F.struct(F.col(order).alias("at"), F.col("source_item_id").alias("id"))),
            "_header": F.when(F.col("row_class") == "subitem_header", F.col(order)),
        },
        block_rows,
    )
    below_claim = F.coalesce(F.col("_header") > F.col("_claim.at"), F.lit(True))
    return filled.select(
        *classed.columns,
        F.when(~is_claim, F.col("_claim.id")).alias("parent_item_id"),
        F.when((F.col("row_class") == "subitem_detail") & below_claim, F.col("_header")).alias("header_row"),
    )


def row_structure(rows: DataFrame, item_id: Column, name: Column, label: str = SUBITEM_LABEL) -> DataFrame:
    """Rows per audit class and whether the classes add up to all rows."""
    classed = rows.select(
        audit_row_class(item_id, name, label).alias("_class"), (clean_text(name) == label).alias("_labelled")
    )
    totals = classed.agg(
        F.count("*").alias("physical_rows"),
        F.count_if(F.col("_class") == "claim").alias("claim_rows"),
        F.count_if(F.col("_labelled")).alias("header_rows"),
        F.count_if(F.col("_class") == "subitem_detail").alias("detail_rows"),
    )
    added = F.col("claim_rows") + F.col("header_rows") + F.col("detail_rows")
    return totals.withColumn("reconciles", F.col("physical_rows") == added)
