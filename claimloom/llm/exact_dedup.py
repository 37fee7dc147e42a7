"""Exact deduplication: groups by a 128-bit content hash, told apart by their bytes.

Texts are compared without the characters blank, tab, line feed, vertical tab,
form feed and carriage return. Hash and text together are the grouping key, so
each class of a hash is one byte sequence; equal texts of a task meet before
the shuffle, and a group of any size arrives as one row per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.store import fresh, stored
from claimloom.operators.distributed import top_per_group


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text.cast("binary")))


def duplicate_groups(
    docs: DataFrame, hashed: Callable[[Column], Column] = content_hash, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All rows of ``docs`` with their group: adds keep_id, group_size, kept and text_sha256 in a struct column.

    The struct is named ``_group`` (or that with underscores, if taken) and is
    the last column. The row with the most code points in the original text
    stays, then the one with the smallest id; a missing id is larger than any
    other. Empty and missing texts are equal. Rows that repeat id and text are
    marked alike. An empty table gives an empty result.

    ``hashed`` may be any hash: where one value covers several texts, the
    members are matched by the text itself.
    """
    h, body, group, found, sha = (fresh(docs, name) for name in ("_hash", "_body", "_group", "_found", "_sha256"))
    norm = normalised(F.col(text))
    order = F.struct(
        (-F.length(F.coalesce(F.col(text), F.lit("")))).alias("a"), F.col(doc_id).isNull().alias("b"), F.col(doc_id).alias("c")
    )
    classes = (
        docs.select(norm.alias(body), order.alias("o"))
        .select(hashed(F.col(body)).alias(h), body, "o")
        .groupBy(h, body)
        .agg(F.min("o").alias("o"), F.count("*").alias("n"))
    )
    # one narrow row per hash; the texts of a hash that covers several are kept
    per_hash = classes.groupBy(h).agg(F.count("*").alias("classes"), F.min("o").alias("o"), F.sum("n").alias("n"))
    per_hash = stored(per_hash, "hash-groups")

    def decided(rows: DataFrame, best: Column, size: Column) -> DataFrame:
        keep = best["c"]
        fields = F.struct(
            keep.alias("keep_id"),
            size.alias("group_size"),
            F.col(doc_id).eqNullSafe(keep).alias("kept"),
            F.col(sha).alias("text_sha256"),
        )
        return rows.select(*[F.col(c) for c in docs.columns], fields.alias(group))

    # both digests are taken before the join, so a caller who wants no text moves none
    keyed = docs.withColumn(h, hashed(norm)).withColumn(sha, F.sha2(norm.cast("binary"), 256))
    single = per_hash.where("classes = 1").select(h, F.struct("o", "n").alias(found))
    out = decided(keyed.join(single, h), F.col(f"{found}.o"), F.col(f"{found}.n"))
    collided = per_hash.where("classes > 1").select(h)
    if collided.isEmpty():
        return out
    texts = classes.join(collided, h, "left_semi").select(h, body, F.struct("o", "n").alias(found))
    rest = decided(keyed.withColumn(body, norm).join(texts, [h, body]), F.col(f"{found}.o"), F.col(f"{found}.n"))
    return out.unionByName(rest)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, one of each group, with the columns of ``docs``; of rows that repeat an id, the longest text."""
    group = fresh(docs, "_group")
    marked = duplicate_groups(docs, doc_id=doc_id, text=text).where(F.col(f"{group}.kept"))
    sha = F.col(f"{group}.text_sha256")
    alone = marked.where(F.col(f"{group}.group_size") == 1)
    # only here can rows repeat both id and normalised text
    shared = marked.where(F.col(f"{group}.group_size") > 1).withColumn(fresh(marked, "_sha"), sha)
    once = top_per_group(shared, [doc_id, shared.columns[-1]], [F.length(text).desc_nulls_last(), F.col(text)], 1)
    return alone.select(*docs.columns).unionByName(once.select(*docs.columns))
