"""Connected components of an edge table by alternating star contraction.

Every step is a minimum per node and a join; nothing but the number of changed
rows reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.store import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: each node hands its larger neighbours to its smallest; small star: the others."""
    if large:
        around = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; the root is the smallest node of its component.

    ``edges`` has (u, v) of one orderable type. Loops, repeated and reversed
    edges are allowed. Runs until a round changes nothing.
    """
    links = stored(edges.select("u", "v").where("u <> v").distinct(), "links")
    before = None
    while True:
        links = stored(_star(_star(links, True), False), "links")
        # a star forest is stable: every node hangs on its root, and no root hangs on another
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
