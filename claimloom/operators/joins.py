"""Lookups between updates, claims, organizations and source rows.

The looked-up side always has one row per key. A key that holds a large share
of the other side makes one shuffle partition large; the session's adaptive
skew join cuts such a partition into pieces, and a looked-up side below Spark's
broadcast threshold is not shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import join_key


def mark_matched(updates: DataFrame, claims: DataFrame, key: str = "item_id") -> DataFrame:
    """Flag updates whose item id is a known claim id; a missing id is unmatched."""
    known = claims.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    marked = updates.join(known, key, "left")
    return marked.withColumn("matched", F.col("_known").isNotNull()).drop("_known")


def lookup_claim(updates: DataFrame, claims: DataFrame, key: str = "item_id") -> DataFrame:
    """Add the claim id (NULL when unknown); ``claims`` has one row per item id."""
    return updates.join(claims.select(key, "claim_id"), key, "left")


def resolve_source_row(staged: DataFrame, worksheets: DataFrame, source_rows: DataFrame) -> DataFrame:
    """Replace (file, sheet, physical row) by the stored source row's id.

    Both lookups are unique by key.
    """
    sheets = worksheets.select("file_name", "sheet", "worksheet_id")
    rows = source_rows.select("worksheet_id", "physical_row", "source_row_id")
    return staged.join(sheets, ["file_name", "sheet"]).join(rows, ["worksheet_id", "physical_row"])


def unmatched_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct non-null ids of the left frame that the right frame lacks."""
    ids = left.select(key).where(F.col(key).isNotNull()).distinct()
    return ids.join(right.select(key).distinct(), key, "left_anti")


def orphan_counts(updates: DataFrame, claims: DataFrame, key: str = "item_id") -> DataFrame:
    """Orphan rows and ids of the updates, and claims no update refers to.

    Updates are counted per id first, so no id brings more than one row into
    the join.
    """
    referred = updates.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    known = claims.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    both = referred.join(known, key, "full_outer")
    orphan = F.col("_known").isNull()
    return both.agg(
        F.coalesce(F.sum(F.when(orphan, F.col("_rows"))), F.lit(0)).alias("orphan_update_rows"),
        F.count_if(orphan).alias("orphan_item_ids"),
        F.count_if(F.col("_rows").isNull()).alias("claims_without_updates"),
    )


def claim_list(claims: DataFrame, organizations: DataFrame, source_rows: DataFrame) -> DataFrame:
    """Claims with contractor and carrier name and their source row number.

    The joins meet by the MD5 of the ids, so ids that no later step reads are not shuffled.
    """
    names = organizations.select(join_key("organization_id").alias("_id"), "display_name")
    contractor = names.select(F.col("_id").alias("_contractor"), F.col("display_name").alias("contractor"))
    carrier = names.select(F.col("_id").alias("_carrier"), F.col("display_name").alias("carrier"))
    rows = source_rows.select(join_key("source_row_id").alias("_row"), F.col("physical_row").alias("source_row"))
    keyed = claims.withColumns(
        {"_row": join_key("source_row_id"), "_contractor": join_key("contractor_id"), "_carrier": join_key("carrier_id")}
    )
    return (
        keyed.join(rows, "_row").drop("_row")
        .join(contractor, "_contractor", "left").drop("_contractor")
        .join(carrier, "_carrier", "left").drop("_carrier")
    )


def reply_threads(posts: DataFrame) -> DataFrame:
    """Each post with its parent inside the same item; ``orphan_reply`` when the parent is missing.

    A parent post that repeats counts once, with the author that comes first by name.
    """
    parents = (
        posts.select("item_id", F.col("post_id").alias("parent_post_id"), "author")
        .dropna("any", subset=["item_id", "parent_post_id"])
        .groupBy("item_id", "parent_post_id")
        .agg(F.min("author").alias("parent_author"), F.lit(True).alias("_found"))
    )
    joined = posts.join(parents, ["item_id", "parent_post_id"], "left")
    return joined.withColumn(
        "thread_role",
        F.when(F.col("parent_post_id").isNull(), "root").when(F.col("_found"), "reply").otherwise("orphan_reply"),
    ).drop("_found")


def duplicate_bodies(updates: DataFrame, fingerprint: str = "body_fingerprint") -> DataFrame:
    """Fingerprints that occur more than once, with their row count."""
    return (
        updates.where(F.col(fingerprint).isNotNull())
        .groupBy(fingerprint)
        .agg(F.count("*").alias("body_rows"))
        .where(F.col("body_rows") > 1)
    )


def mark_duplicate_bodies(updates: DataFrame, fingerprint: str = "body_fingerprint") -> DataFrame:
    """Flag updates whose body occurs more than once."""
    repeated = duplicate_bodies(updates, fingerprint).select(fingerprint, F.lit(True).alias("_repeated"))
    marked = updates.join(repeated, fingerprint, "left")
    return marked.withColumn("duplicate_body", F.coalesce("_repeated", F.lit(False))).drop("_repeated")


def duplicate_body_surplus(updates: DataFrame, fingerprint: str = "body_fingerprint") -> DataFrame:
    return duplicate_bodies(updates, fingerprint).agg(
        F.coalesce(F.sum(F.col("body_rows") - 1), F.lit(0)).alias("duplicate_body_surplus")
    )


