"""Steps that must not build their input again, meet every bound, or shuffle what nobody reads."""

import os
import random
import time

from pyspark.sql import functions as F

from claimloom.functions.numbers import accounting_number
from claimloom.operators import explorer, governance, profile
from claimloom.operators.distributed import OrderKey, order_index
from claimloom.operators.merge import one_per_key, upsert
from claimloom.plans import publish
from claimloom.plans.ingest import parse_import
from claimloom.session import shuffles_removed
from claimloom.sources import buckets
from claimloom.sources.buckets import BucketTable
from workload.views import ARCHIVE_HEADERS, LAYOUT, UPDATE_HEADERS


def counted(spark, column):
    """The column behind a step that counts how often it is worked out."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def through(value):
        seen.add(1)
        return value

    return through(column), seen


def test_ranges_of_many_bounds_equal_a_full_count(spark):
    rng = random.Random(3)
    values = [None if rng.random() < 0.05 else rng.randrange(3000) for _ in range(6000)]
    rows = spark.createDataFrame(list(zip(values, range(6000))), "v bigint, id bigint")
    order = [OrderKey(F.col("v"), descending=True, nulls_last=True), OrderKey(F.col("id"))]
    index = order_index(rows, order, range_rows=12)
    assert len(index.bounds) > 256
    place = lambda v, i: (v is None, -(v or 0), i)
    bounds = [place(*b) for b in index.bounds]
    low, high = len(bounds) // 3, len(bounds) // 2
    got = rows.select("v", "id", index.range_of().alias("r"), index.within(low, high).alias("inside")).collect()
    for r in got:
        want = sum(place(r.v, r.id) > b for b in bounds)
        assert (r.r, r.inside) == (want, low <= want <= high)
    assert index.total == 6000


def test_a_page_builds_its_rows_once(spark):
    value, seen = counted(spark, F.col("id").cast("string"))
    rows = spark.range(400).select(F.col("id"), value.alias("name"))
    page = explorer.page_slice(rows, explorer.text_order("name"), page=3, size=10, range_rows=40)
    assert [r.position for r in page.collect()] == list(range(21, 31))
    assert seen.value == 400


def test_lineage_reads_its_edges_once(spark):
    child, seen = counted(spark, (F.col("id") + 1).cast("string"))
    edges = spark.range(20).select(F.col("id").cast("string").alias("parent"), child.alias("child"))
    found = governance.trace(spark.createDataFrame([("0",)], "node string"), edges)
    assert {r.node: r.steps for r in found.collect()} == {str(i): i for i in range(21)}
    assert seen.value <= 40  # dropna looks at the edge once more


def test_an_import_builds_its_cells_once(spark):
    item, post = ARCHIVE_HEADERS.index("Item ID (auto generated)"), UPDATE_HEADERS.index("Post ID")
    archive = [[f"{k}" if c == item else None for c in range(len(ARCHIVE_HEADERS))] for k in range(30)]
    updates = [[f"P{k}" if c == post else None for c in range(len(UPDATE_HEADERS))] for k in range(20)]
    sheets = [(LAYOUT.archive_sheet, LAYOUT.archive_header_row, [list(ARCHIVE_HEADERS), *archive])]
    sheets.append((LAYOUT.updates_sheet, LAYOUT.updates_header_row, [list(UPDATE_HEADERS), *updates]))
    rows = [("f", sheet, first + n, cells) for sheet, first, lines in sheets for n, cells in enumerate(lines)]
    name, seen = counted(spark, F.col("file_name"))
    schema = "file_name string, sheet string, physical_row bigint, cells array<string>"
    found = parse_import(spark.createDataFrame(rows, schema).withColumn("file_name", name), LAYOUT)
    assert (found.claims.count(), found.updates.count(), found.source_rows.count()) == (30, 20, 50)
    assert seen.value == len(rows)


def test_amount_parsing_does_not_repeat_the_cell(spark):
    assert str(accounting_number(F.col("the_cell"))).count("the_cell") <= 4
    cells = ["(5.00)", "$ 1,234.50", "12%", "1e5", "1e999", "(-1e999)", "abc", "NaN", "Infinity", "1d", "", " ( 7 ) ", "(", "()", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(accounting_number(F.col("c"))).collect()]
    assert got == [-5.0, 1234.5, 12.0, 1e5, None, None, None, None, None, None, None, -7.0, None, None, None]


def test_values_of_a_column_do_not_meet_in_one_task(spark):
    rows = spark.range(50).select(
        *[(F.col("id") % n).cast("string").alias(c) for n, c in ((1, "file_name"), (2, "sheet"))], (F.col("id") % 2).alias("position"), F.col("id").alias("physical_row"),
        F.col("id").cast("string").alias("raw"), F.col("id").cast("string").alias("value"), F.lit("text").alias("cell_type"),
    )
    # a frame whose size Spark does not know
    headers = rows.groupBy("file_name", "sheet", "position").agg(F.max(F.lit("Fee amount")).alias("internal"))
    named = profile._parsed(profile.value_counts(rows), headers)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = named._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert named.count() == 50


def test_one_per_key_leaves_unread_columns_alone(spark):
    rows = spark.range(30).select((F.col("id") % 4).alias("k"), F.col("id").alias("at"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("wide"))
    last = one_per_key(rows, ["k"], [F.col("at")])
    assert "wide" not in last.select("k", "at")._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: (r.at, len(r.wide)) for r in last.collect()} == {0: (28, 28), 1: (29, 29), 2: (26, 26), 3: (27, 27)}
    nothing = spark.createDataFrame([(1, None), (1, 5)], "k int, at int")
    assert [one_per_key(nothing, ["k"], [F.col("at")], keep=e).first().at for e in ("first", "last")] == [None, 5]


def test_a_merge_leaves_no_batch_behind(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "id bigint, name string", ["id"], 4)
    rows = spark.range(20).select("id", F.lit("a").alias("name"))
    for replace in (None, None, ["name"]):
        table.merge(rows, replace)
    assert not os.listdir(tmp_path / "t" / "staged")
    assert (table.version(), table.read().count()) == (1, 20)


def unbroadcast(spark, frame):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def listed(spark):
    claims = spark.createDataFrame(
        [("c1", "1", "k1", "r1", "s1"), ("c2", "2", None, None, "s2"), ("c3", "3", "k9", "r1", "s3"), ("c4", "4", "k1", "r1", None)],
        "claim_id string, item_id string, contractor_id string, carrier_id string, source_row_id string",
    ).withColumns({c: F.lit("x") for c in ("display_name", "raw_status", "normalized_status")})
    names = spark.createDataFrame([("k1", "Kate"), ("r1", "Rail"), (None, "Nobody")], "organization_id string, display_name string")
    rows = spark.createDataFrame([("s1", 7), ("s2", 8), ("s2", 9), (None, 1)], "source_row_id string, physical_row bigint")
    facts = spark.createDataFrame([("c1", 2), ("c1", 1), (None, 3)], "claim_id string, source_column bigint").withColumns(
        {c: F.lit("f") for c in ("normalized_metric_name", "source_field_name", "parsed_numeric_value", "source_availability_status")}
    )
    derived = spark.createDataFrame([("c2", "m"), (None, "n")], "claim_id string, metric_name string").withColumns(
        {c: F.lit("d") for c in ("metric_version", "calculated_value", "source_comparison_value", "reconciliation_status", "difference")}
    )
    return {"claims": claims, "organizations": names, "source_rows": rows, "claim_financial_facts": facts, "claim_derived_metrics": derived}


def test_a_claim_list_shuffles_no_ids_that_nobody_reads(spark):
    found = publish.published_claim_list(listed(spark))
    rows = [tuple(r[c] for c in ("claim_id", "contractor", "carrier", "source_row")) for r in found.collect()]
    assert sorted(rows, key=str) == [("c1", "Kate", "Rail", 7), ("c2", None, None, 8), ("c2", None, None, 9)]
    plan = unbroadcast(spark, found)
    assert "hashpartitioning(_row" in plan
    for name in ("source_row_id", "contractor_id", "carrier_id"):
        assert f"hashpartitioning({name}" not in plan


def test_claim_details_meet_by_short_keys(spark):
    found = publish.claim_details(listed(spark))
    by = {(r.claim_id, r.source_row): r for r in found.collect()}
    assert set(by) == {("c1", 7), ("c2", 8), ("c2", 9)}
    assert [f.source_column for f in by["c1", 7].financial_facts] == [1, 2] and by["c1", 7].derived_metrics is None
    assert by["c2", 8].financial_facts is None and [d.metric_name for d in by["c2", 9].derived_metrics] == ["m"]
    assert "hashpartitioning(claim_id" not in unbroadcast(spark, found.select("item_id", "financial_facts", "derived_metrics"))


def test_an_upsert_shuffles_each_side_once(spark):
    target = spark.createDataFrame([(1, "a", "p", "q"), (2, "b", "r", "s"), (None, "n", "t", "u")], "k int, name string, link string, fixed string")
    batch = spark.createDataFrame([(2, "B", None, "z"), (3, "C", None, "y"), (None, "N", "v", "w"), (2, "B2", "l", "x")], target.schema)
    after = upsert(target, batch, ["k"], ["name", "link"], keep_if_missing=["link"])
    # a batch that is not unique by key gives a row per match, as it did
    assert sorted(after.collect(), key=str) == sorted(
        [(1, "a", "p", "q"), (2, "B", "r", "s"), (2, "B2", "l", "s"), (3, "C", None, "y"), (None, "n", "t", "u")], key=str
    )
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    everything = upsert(target.where(F.lit(False)), batch, ["k"], ["name", "link"])
    assert "Join " not in everything._jdf.queryExecution().optimizedPlan().toString() and everything.count() == 3


def test_shuffle_files_go_with_the_query_inside(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {b.toString() for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllBlocks()) if b.isShuffle()}

    there = files()
    with shuffles_removed(spark):
        assert spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count().where("count > 0").count() == 7
    for _ in range(50):
        if not files() - there:
            break
        time.sleep(0.1)
    assert not files() - there
    assert spark.conf.get(setting, None) == before


def test_a_first_import_joins_nothing(spark, tmp_path, monkeypatch):
    joined = []
    monkeypatch.setattr(buckets, "upsert", lambda *a, **b: joined.append(1) or upsert(*a, **b))
    stored = BucketTable(spark, str(tmp_path / "t"), "id bigint, name string", ["id"], 4)
    stored.merge(spark.range(20).select("id", F.lit("a").alias("name")), ["name"])
    assert not joined and stored.read().count() == 20
    stored.merge(spark.range(3).select("id", F.lit("b").alias("name")), ["name"])
    assert joined and {r.id: r.name for r in stored.read().collect()} == {k: "b" if k < 3 else "a" for k in range(20)}
