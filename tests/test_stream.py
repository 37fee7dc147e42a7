"""Landing-folder ingestion equals one batch read, also when posts come again."""

from pyspark.sql import functions as F

from claimloom.schema import GRID
from claimloom.streaming.landing import keyed_append, landing_stream, run_available, run_refused, run_stateful


def posts(rows):
    return [("f", "updates", n, [post, body]) for n, post, body in rows]


def unpack(grid):
    return grid.select(F.get("cells", F.lit(0)).alias("post_id"), F.get("cells", F.lit(1)).alias("body"), "physical_row")


def test_stream_equals_batch(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("landing", "table", "checkpoint"))
    order = [F.col("physical_row")]

    def deliver(rows):
        spark.createDataFrame(posts(rows), GRID).coalesce(1).write.mode("append").parquet(landing)
        run_available(landing_stream(spark, landing), unpack, ["post_id"], order, table, checkpoint).awaitTermination()

    deliver([(1, "a", "first"), (2, "b", "x"), (3, "a", "again")])
    deliver([(4, "b", "changed"), (5, "c", "late")])
    deliver([(6, "c", "later"), (7, "d", "new")])
    stored = {r.post_id: r.body for r in spark.read.parquet(table).collect()}
    assert stored == {"a": "first", "b": "x", "c": "late", "d": "new"}
    whole = unpack(spark.read.schema(GRID).parquet(landing)).groupBy("post_id").agg(F.min_by("body", "physical_row").alias("body"))
    assert {r.post_id: r.body for r in whole.collect()} == stored


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    table = str(tmp_path / "table")
    write = keyed_append(["post_id"], [F.col("physical_row")], table)
    batch = unpack(spark.createDataFrame(posts([(1, "a", "x"), (2, "b", "y")]), GRID))
    write(batch, 0)
    write(batch, 0)
    write(unpack(spark.createDataFrame(posts([(3, "b", "z"), (4, "c", "w")]), GRID)), 1)
    assert sorted((r.post_id, r.body) for r in spark.read.parquet(table).collect()) == [("a", "x"), ("b", "y"), ("c", "w")]


def test_state_store_settles_posts_like_one_batch(spark, tmp_path):
    landing, table, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    columns = {"post_id": F.get("cells", F.lit(0)), "body": F.get("cells", F.lit(1)), "physical_row": F.col("physical_row")}

    def deliver(rows):
        spark.createDataFrame(posts(rows), GRID).coalesce(1).write.mode("append").parquet(landing)
        run_stateful(spark, landing, GRID, columns, ["post_id"], ["physical_row"], table, state).awaitTermination()

    deliver([(4, "a", "second"), (3, "a", "first"), (5, "b", "x"), (6, None, "no key")])
    deliver([(1, "a", "late, with a smaller row"), (7, "c", "new"), (8, "c", "again")])
    deliver([(9, "b", "late"), (10, "a", "late")])
    deliver([(11, "d", "last")])
    stored = {(r.post_id, r.body, r.batch) for r in spark.read.parquet(table).collect()}
    assert stored == {("a", "first", 0), ("b", "x", 0), ("c", "new", 1), ("d", "last", 3)}
    # the stored table is never read: what was stored may be gone, and known keys stay known
    run_stateful(spark, landing, GRID, columns, ["post_id"], ["physical_row"], table, state).awaitTermination()
    assert spark.read.parquet(table).count() == 4
    run_refused(spark, landing, GRID, columns, ["post_id"], f"{table}_refused", f"{state}_refused").awaitTermination()
    assert [r.body for r in spark.read.parquet(f"{table}_refused").collect()] == ["no key"]
