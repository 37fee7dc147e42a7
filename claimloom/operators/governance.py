"""Quality rules, exclusions, lineage and source authority.

These follow written definitions; nothing in the reference system executes them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import ensure_checkpoint_dir, kept


@dataclass(frozen=True)
class QualityRule:
    """A named condition that marks a row as violating."""

    rule_id: str
    severity: str
    field: str
    violated: Column
    version: str = "1"


def rule_violations(rows: DataFrame, entity: str, key: str, rules: Sequence[QualityRule]) -> DataFrame:
    """One row per entity and violated rule, all rules in one pass."""
    entries = [
        F.when(
            F.coalesce(rule.violated, F.lit(False)),
            F.struct(
                F.lit(rule.rule_id).alias("rule_id"),
                F.lit(rule.version).alias("rule_version"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.field).alias("field"),
                F.sha2(F.coalesce(F.col(rule.field).cast("string"), F.lit("")), 256).alias("observed_fingerprint"),
            ),
        )
        for rule in rules
    ]
    fired = F.filter(F.array(*entries), lambda entry: entry.isNotNull())
    return rows.select(
        F.lit(entity).alias("entity"),
        F.col(key).cast("string").alias("entity_id"),
        F.inline(fired),
        F.lit("open").alias("state"),
    )


def exclusion_counts(rows: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Rows per exclusion reason; the first reason that holds counts, else ``eligible``."""
    label = F.lit("eligible")
    for name, condition in reversed(list(reasons.items())):
        label = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(label)
    return rows.groupBy(label.alias("reason")).agg(F.count("*").alias("rows"))


def trace(start: DataFrame, edges: DataFrame, most_steps: int | None = None, backward: bool = False) -> DataFrame:
    """All nodes reachable from ``start``, with the fewest steps to each.

    ``edges`` has (parent, child), ``start`` has (node). Round k knows the nodes
    within 2^k steps and the jumps of exactly 2^k steps, and joins the two; jumps
    are doubled by joining them with themselves. So a lineage of n steps takes
    log2(n) rounds, and loops end: it is over when a round adds no node. A
    lineage higher than ``most_steps`` is an error, never cut.
    """
    near, far = ("child", "parent") if backward else ("parent", "child")
    jumps = kept(edges.select(F.col(near).alias("node"), F.col(far).alias("_next")).dropna().distinct(), "jumps")
    reached = kept(start.select("node").distinct().withColumn("steps", F.lit(0).cast("bigint")), "reached")
    known, length = reached.count(), 1
    while True:
        ahead = reached.join(jumps, "node").select(F.col("_next").alias("node"), (F.col("steps") + length).alias("steps"))
        reached = kept(reached.unionByName(ahead).groupBy("node").agg(F.min("steps").alias("steps")), "reached")
        now = reached.agg(F.count("*"), F.max("steps")).first()
        if most_steps is not None and (now[1] or 0) > most_steps:
            raise ValueError(f"the lineage goes on after {most_steps} steps")
        if now[0] == known:
            return reached
        on = jumps.select(F.col("node").alias("_next"), F.col("_next").alias("_after"))
        jumps = kept(jumps.join(on, "_next").select("node", F.col("_after").alias("_next")).distinct(), "jumps")
        known, length = now[0], 2 * length


def cycle_members(organizations: DataFrame) -> DataFrame:
    """(id) of every organization that is its own ancestor, over cycles of any length.

    Every round doubles the length of the jumps. When they are longer than any
    chain can be, a jump that still ends somewhere ends inside a cycle, and every
    member of a cycle is the end of some jump.
    """
    ensure_checkpoint_dir(organizations.sparkSession)
    ids = organizations.select(F.col("id").alias("_at")).dropna().distinct()
    jumps = organizations.select("id", F.col("parent_id").alias("_at")).dropna().join(ids, "_at", "left_semi").checkpoint()
    for _ in range(ids.count().bit_length()):
        on = jumps.select(F.col("id").alias("_at"), F.col("_at").alias("_next"))
        jumps = jumps.join(on, "_at").select("id", F.col("_next").alias("_at")).checkpoint()
    return jumps.select(F.col("_at").alias("id")).distinct()


def parent_violations(organizations: DataFrame) -> DataFrame:
    """Organizations whose parent is missing, in another tenant, or part of a cycle with them.

    ``organizations`` has (id, parent_id, tenant_id), one row per id.
    """
    parents = organizations.select(F.col("id").alias("parent_id"), F.col("tenant_id").alias("_tenant"), F.lit(True).alias("_there"))
    cycles = cycle_members(organizations).withColumn("_cycle", F.lit(True))
    walk = organizations.join(parents, "parent_id", "left").join(cycles, "id", "left")
    flags = {
        "missing_parent": F.col("parent_id").isNotNull() & F.col("_there").isNull(),
        "other_tenant": F.coalesce(F.col("_tenant") != F.col("tenant_id"), F.lit(False)),
        "cycle": F.coalesce("_cycle", F.lit(False)),
    }
    found = walk.select("id", "parent_id", "tenant_id", *[c.alias(n) for n, c in flags.items()])
    return found.where(F.col("missing_parent") | F.col("other_tenant") | F.col("cycle"))


def resolve_authority(
    values: DataFrame, authority: DataFrame, keys: Sequence[str] = ("entity_id", "field")
) -> DataFrame:
    """Winning value per entity and field by rank of its source, never by time.

    ``values`` has (entity_id, field, source, value); ``authority`` has (field,
    source, rank). ``conflict`` says that another source holds a different
    value; the losing rows stay in ``values``. A source without a rank cannot win.
    """
    ranked = values.join(authority, ["field", "source"], "left")
    chosen = ranked.groupBy(*keys).agg(
        F.min_by(F.struct("source", "value"), F.when(F.col("rank").isNotNull(), F.struct("rank", "source", "value"))).alias(
            "_win"
        ),
        F.min("value").alias("_low"),
        F.max("value").alias("_high"),
        F.count("value").alias("candidates"),
    )
    return chosen.select(
        *keys,
        F.col("_win.source").alias("source"),
        F.col("_win.value").alias("value"),
        "candidates",
        (F.col("_low") != F.col("_high")).alias("conflict"),
    )
