"""Block-wise helpers against brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from claimloom.operators import explorer
from claimloom.operators.distributed import (
    OrderKey,
    carry_last,
    exact_median,
    global_position,
    indexed_position,
    middle_brackets,
    order_index,
    ordered_slice,
    running_number,
    top_per_group,
)


def sample(seed, rows=400):
    rng = random.Random(seed)
    # one group holds most rows; gaps in the order leave empty blocks
    orders = sorted(rng.sample(range(5000), rows))
    return [("hot" if rng.random() < 0.7 else rng.choice("abc"), o, rng.choice([None, None, rng.randint(0, 9)])) for o in orders]


def test_carry_last_in_all_directions(spark):
    data = sample(1)
    df = spark.createDataFrame(data, "g string, o long, v long")
    for inclusive in (True, False):
        for backward in (False, True):
            got = {
                (r.g, r.o): r.c
                for r in carry_last(df, ["g"], "o", {"c": F.col("v")}, 64, inclusive, backward).collect()
            }
            for g in {row[0] for row in data}:
                seen = None
                for _, o, v in sorted((r for r in data if r[0] == g), key=lambda r: -r[1] if backward else r[1]):
                    if inclusive and v is not None:
                        seen = v
                    assert got[(g, o)] == seen
                    if v is not None:
                        seen = v


def test_running_number(spark):
    data = sample(2)
    df = spark.createDataFrame(data, "g string, o long, v long")
    got = {(r.g, r.o): r.n for r in running_number(df, ["g"], "o", "n", 100).collect()}
    for g in {row[0] for row in data}:
        for n, (_, o, _) in enumerate(sorted(r for r in data if r[0] == g), 1):
            assert got[(g, o)] == n


def test_exact_median_is_exact(spark):
    rng = random.Random(3)
    data = [(rng.choice("abcd"), rng.choice([None, round(rng.uniform(-50, 50), 2), 7.0])) for _ in range(500)]
    data += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.m, r.value_count) for r in exact_median(df, ["g"], "v", "m", 5.0).collect()}
    for g in "abcd":
        present = [v for k, v in data if k == g and v is not None]
        assert got[g] == (statistics.median(present), len(present))
    assert got["one"] == (4.0, 1) and got["two"] == (1.5, 2) and "none" not in got


def test_global_position_counts_every_row_once(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([0, 0, 0, rng.randint(1, 50)])) for i in range(1000)]
    df = spark.createDataFrame(data, "id long, v long").repartition(7)
    got = {r.id: r.position for r in global_position(df, [F.desc("v"), F.asc("id")]).collect()}
    expected = {i: n for n, (i, _) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), 1)}
    assert got == expected


def test_top_per_group(spark):
    df = spark.createDataFrame(sample(5), "g string, o long, v long")
    got = top_per_group(df, ["g"], [F.asc("o")], 3).groupBy("g").count().collect()
    assert {r["count"] for r in got} == {3}


def test_cycles_of_any_length_and_long_lineage(spark):
    from claimloom.operators.governance import parent_violations, trace

    rows = [(i, (i + 1) % 12, "t") for i in range(12)] + [(100 + i, 100 + i + 1 if i < 20 else None, "t") for i in range(21)]
    rows += [(200, 3, "t"), (201, 999, "t"), (202, 100, "u")]
    found = {r.id: (r.missing_parent, r.other_tenant, r.cycle) for r in parent_violations(spark.createDataFrame(rows, "id long, parent_id long, tenant_id string")).collect()}
    assert found == {**{i: (False, False, True) for i in range(12)}, 201: (True, False, False), 202: (False, True, False)}
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 5)], "parent long, child long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.steps for r in trace(start, edges).collect()} == {i: i for i in range(21)}
    with pytest.raises(ValueError, match="goes on"):
        trace(start, edges, most_steps=4)


@pytest.mark.parametrize("most", [3, 40, 100_000])
def test_median_by_narrowing(spark, most):
    rng = random.Random(8)
    data = [("wide", rng.uniform(0, 1)) for _ in range(400)] + [("far", 10.0 ** rng.randint(-30, 30)) for _ in range(301)]
    data += [("even", float(n)) for n in range(200)] + [("same", 2.0)] * 50 + [("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.m, r.value_count) for r in exact_median(df, ["g"], "v", "m", most=most).collect()}
    for g in ("wide", "far", "even", "same"):
        present = [v for k, v in data if k == g]
        assert got[g] == (statistics.median(present), len(present)), g
    assert "none" not in got
    whole = exact_median(df, [], "v", "m", most=most).first()
    assert whole.m == statistics.median([v for _, v in data if v is not None])


def test_a_million_values_in_one_bin_are_narrowed(spark):
    freq = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.col("id") / 1e6).alias("v"), F.lit(1).cast("long").alias("_n"))
    left = middle_brackets(freq, ["g"], "v", 20_000).first()
    # what one task ranks, against 10^6 in a bin of fixed width
    assert left["_values"] <= 20_000
    assert freq.where((F.col("v") >= left["_from"]) & (F.col("v") <= left["_to"])).count() == left["_values"]
    assert left["_below"] < 500_000 <= left["_below"] + left["_values"]


def test_order_index_pages_and_positions(spark):
    rng = random.Random(9)
    data = [(i, rng.choice([None, "ä", "a", "b", "Z", ""]), rng.choice([None, rng.randint(1, 9)])) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, t string, v long").repartition(5)
    for order, key in (
        ([OrderKey(F.col("v"), True, True), OrderKey(F.col("id"))], lambda r: (r[2] is None, -(r[2] or 0), r[0])),
        ([OrderKey(F.col("v")), OrderKey(F.col("id"), True)], lambda r: (r[2] is not None, r[2] or 0, -r[0])),
    ):
        index = order_index(df, order, 150)
        assert index.total == 2000 and len(index.sizes) > 5 and max(index.sizes) < 600
        expected = [r[0] for r in sorted(data, key=key)]
        assert [r.id for r in indexed_position(df, index).orderBy("position").collect()] == expected
        for first, count in ((0, 10), (155, 300), (1990, 10), (1995, 50)):
            rows = ordered_slice(df, index, first, count).orderBy("position").collect()
            assert [r.id for r in rows] == expected[first : first + count]
            assert [r.position for r in rows] == list(range(first + 1, first + 1 + len(rows)))
    # only the rows of the page's ranges are sorted
    low, high, _ = index.ranges(155, 454)
    assert df.where(index.range_of().between(low, high)).count() == sum(index.sizes[low : high + 1]) < 1200
    assert order_index(df.where("false"), order, 150).total == 0


def test_pages_in_text_order(spark):
    data = [(i, t) for i, t in enumerate(["b", "Ä", "a", None, "Z", "ä", "B", ""] * 40)]
    df = spark.createDataFrame(data, "id long, t string")
    whole = [r.id for r in explorer.sort_rows(df, explorer.text_order("t")).collect()]
    for page in (1, 3, 10, 99):
        rows = explorer.page_slice(df, explorer.text_order("t"), page, 32, range_rows=25).orderBy("position").collect()
        assert [r.id for r in rows] == whole[32 * (min(page, 10) - 1) :][:32]
        assert {(r.page, r.pages) for r in rows} == {(min(page, 10), 10)}
    assert explorer.page_slice(df.where("false"), explorer.text_order("t"), 2, 5).collect() == []
