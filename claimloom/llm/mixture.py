"""Mixing sources to target weights.

Words are summed per source, targets are filled up by weight under a ceiling of
``most`` times the source's size, and every document is taken floor(rate) times
plus once more with the probability of the fraction, drawn from a hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.store import WORD, fresh, stored
from claimloom.operators.distributed import global_position

DRAW_BITS = 52


def size_of(text: Column) -> Column:
    """Number of words; 0 for a missing text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on id and seed alone."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("double") / F.lit(2.0**DRAW_BITS)


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size) with target added; weights repeat over sources by code point, a missing source last.

    The targets share the sum of all sizes by weight. None is above ``most``
    times its source's size; what a source can't take goes to the others by
    weight. Every round is one aggregate over the sources that fixes at least
    one more of them at its ceiling, or the last.
    """
    ranked = global_position(sizes, [F.col("source").isNull(), F.col("source")], "_position")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stored(
        ranked.select(
            "source", "source_size",
            F.element_at(cycle, ((F.col("_position") - 1) % len(weights) + 1).cast("int")).alias("_weight"),
            (F.col("source_size") * F.lit(float(most))).alias("_ceiling"),
        ),
        "mixture-sources",
    )
    level, last = -1.0, None
    while last is None or level > last:
        last = level
        full = F.col("_ceiling") < F.lit(level) * F.col("_weight")
        total, fixed, open_weight = weighed.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("_ceiling")).otherwise(0.0)), F.sum(F.when(~full, F.col("_weight")))
        ).first()
        if not total or not open_weight:
            break
        level = max(last, (total - fixed) / open_weight)
    target = F.least(F.col("_ceiling"), F.lit(max(level, 0.0)) * F.col("_weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def mixture_plan(
    docs: DataFrame,
    weights: Sequence[float],
    most: float = 3.0,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` with a last struct column ``_mix``: size, source_size, target, copies.

    A document without words has size 0 and no copies. A missing source is a
    source of its own. Rows that repeat an id get the same draw. An empty table
    gives an empty result.
    """
    mix, found = fresh(docs, "_mix"), fresh(docs, "_found")
    sizes = docs.select(F.col(source).alias("source"), size_of(F.col(text)).alias("_size")).groupBy("source").agg(
        F.sum("_size").alias("source_size")
    )
    targets = source_targets(sizes, weights, most).select(F.struct("source", "source_size", "target").alias(found))
    # each source once on the right; Spark splits or broadcasts by measured sizes
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    right = targets.withColumn("_k_", F.coalesce(F.concat(F.lit("="), F.col(f"{found}.source")), F.lit("")))
    key = fresh(docs, "_source_key")
    joined = docs.withColumn(key, name).join(right.withColumnRenamed("_k_", key), key)
    size = size_of(F.col(text))
    rate = F.when(F.col(f"{found}.source_size") > 0, F.col(f"{found}.target") / F.col(f"{found}.source_size")).otherwise(0.0)
    copies = F.floor(rate) + (draw(F.col(doc_id), seed) < rate - F.floor(rate)).cast("long")
    return joined.select(
        *[F.col(c) for c in docs.columns],
        F.struct(
            size.alias("size"),
            F.col(f"{found}.source_size").alias("source_size"),
            F.col(f"{found}.target").alias("target"),
            F.when(size > 0, copies).otherwise(F.lit(0)).cast("long").alias("copies"),
        ).alias(mix),
    )


def mixed(docs: DataFrame, weights: Sequence[float], most: float = 3.0, seed: int = 0) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of ``docs``."""
    mix = fresh(docs, "_mix")
    plan = mixture_plan(docs, weights, most, seed).where(F.col(f"{mix}.copies") > 0)
    return plan.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(f"{mix}.copies").cast("int"))).alias(mix)).select(
        *docs.columns
    )
