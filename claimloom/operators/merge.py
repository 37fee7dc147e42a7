"""Keyed writes without MERGE: upsert, insert-if-absent and the append-only check.

Each function returns a frame; the caller writes it as a new version or appends
it. Target tables hold one row per key, and a source batch is reduced to one
row per key by map-side aggregation before it meets the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: str = "last") -> DataFrame:
    """First or last row of each key in ``order``."""
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    # columns that no later step reads are not shuffled, and a task hands on one row per key at most
    ranked = Window.partitionBy(*keys).orderBy(*[c.desc() if keep == "last" else c.asc() for c in order])
    placed = df.withColumn("_nth_of_key", F.row_number().over(ranked)).where(F.col("_nth_of_key") == 1)
    return placed.drop("_nth_of_key")


def with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is complete; only these can be written by key."""
    return df.dropna("any", subset=list(keys))


def without_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that a keyed write refuses, because a part of their key is missing."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return df.where(missing)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    replace: Sequence[str],
    order: Sequence[Column] = (),
    keep_if_missing: Sequence[str] = (),
) -> DataFrame:
    """Whole target after the merge.

    A known key takes only the ``replace`` columns from the source; a new key is
    inserted. With ``order`` the batch's last row per key wins, without it the
    batch must already be unique. Of the ``replace`` columns those in
    ``keep_if_missing`` stay as stored where the source has no value. Rows with
    a missing key are refused (``without_key`` names them). Target and batch
    meet in one full join, so each is shuffled once.
    """
    keys = list(keys)
    source = with_key(source, keys)
    batch = one_per_key(source, keys, order) if order else source
    batch = batch.select(*target.columns)
    incoming = batch.select(*keys, F.lit(True).alias("_given"), *[F.col(c).alias(f"_new_{c}") for c in target.columns if c not in keys])
    met = target.withColumn("_known", F.lit(True)).join(incoming, keys, "full_outer")

    def taken(c: str) -> Column:
        new = F.col(f"_new_{c}")
        if c not in replace:
            return F.when(F.col("_known").isNull(), new).otherwise(F.col(c))
        return F.coalesce(new, F.col(c)) if c in keep_if_missing else F.when(F.col("_given"), new).otherwise(F.col(c))

    return met.select(*[F.col(c) if c in keys else taken(c).alias(c) for c in target.columns])


def insert_if_absent(
    target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()
) -> DataFrame:
    """Only the rows to append: first row of each key the target lacks; rows with a missing key are refused."""
    keys = list(keys)
    source = with_key(source, keys)
    batch = one_per_key(source, keys, order, keep="first") if order else source
    return batch.select(*target.columns).join(target.select(*keys), keys, "left_anti").select(*target.columns)


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append-only check: keys of ``before`` that are gone or altered in ``after``."""
    keys = list(keys)

    def hashed(df: DataFrame, out: str) -> DataFrame:
        rest = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(before.columns) if c not in keys]
        return df.select(*keys, F.sha2(F.concat_ws("\u001f", *rest), 256).alias(out))

    joined = hashed(before, "hash_before").join(hashed(after, "hash_after"), keys, "left")
    return joined.where(~F.col("hash_before").eqNullSafe(F.col("hash_after")))


def row_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one version has more often than the other, with the surplus.

    Each version is read once: equal rows are counted with opposite signs.
    """
    columns = sorted(before.columns)

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256)).alias("_hash"), F.lit(sign).alias("_sign"))

    both = signed(before, -1).unionByName(signed(after, 1))
    counted = both.groupBy("_hash").agg(F.sum("_sign").alias("surplus")).where(F.col("surplus") != 0)
    return counted.select(F.lower(F.hex("_hash")).alias("row_hash"), "surplus")
