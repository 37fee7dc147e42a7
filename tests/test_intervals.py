"""Interval joins by aligned blocks, and scans over order numbers far apart, against brute force."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from claimloom.operators import distributed
from claimloom.operators.distributed import carry_last, running_number
from claimloom.operators.intervals import day_blocks, join_days, levels_for, range_blocks

DAY = date(2000, 1, 1)


def days_of(rng, n, spread):
    return [DAY + timedelta(days=rng.randint(-spread, spread)) for _ in range(n)]


@pytest.mark.parametrize(("span", "levels"), [(3650, None), (40, None), (900, 5)])
def test_ranges_meet_their_days_once(spark, span, levels):
    rng = random.Random(span)
    ranges = [(n, rng.choice("ab"), s, s + timedelta(days=rng.randint(-2, span))) for n, s in enumerate(days_of(rng, 60, 4000))]
    ranges += [(900, "a", None, DAY), (901, "a", DAY, None), (902, "a", DAY, DAY)]
    days = [(n, rng.choice(["a", "b", None]), d) for n, d in enumerate(days_of(rng, 300, 6000))] + [(800, "a", None), (801, "a", DAY)]
    found = join_days(
        spark.createDataFrame(ranges, "r long, g string, s date, e date"), spark.createDataFrame(days, "d long, g string, day date"),
        ["g"], "s", "e", "day", levels or levels_for(span + 1),
    )
    expected = sorted((r, d) for r, g, s, e in ranges for d, h, at in days if g == h and s and e and at and s <= at <= e)
    assert sorted((x.r, x.d) for x in found.collect()) == expected


def test_a_ten_year_window_makes_few_blocks(spark):
    rows = spark.range(3000).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("s"))
    levels = levels_for(3650)
    sizes = rows.select(F.size(range_blocks(F.col("s"), F.date_add("s", 3649), levels)).alias("n"), F.size(day_blocks(F.col("s"), levels)).alias("m"))
    most = sizes.agg(F.max("n"), F.max("m")).first()
    # against 3,650 rows, one per day
    assert most[0] <= 2 * levels and most[1] == levels == 12


def test_scan_over_numbers_a_million_apart(spark):
    data = [("hot", n * 1_000_000 + 17, n % 5 if n % 7 == 0 else None) for n in range(3000)] + [("few", -3, 1), ("few", 9 * 10**15, None)]
    df = spark.createDataFrame(data, "g string, o long, v long")
    last = {(r.g, r.o): r.last for r in carry_last(df, ["g"], "o", {"last": F.col("v")}, 100).collect()}
    after = {(r.g, r.o): r.next for r in carry_last(df, ["g"], "o", {"next": F.col("v")}, 100, inclusive=False, backward=True).collect()}
    nth = {(r.g, r.o): r.n for r in running_number(df, ["g"], "o", "n", 100).collect()}
    for g in ("hot", "few"):
        rows = sorted(r for r in data if r[0] == g)
        seen = None
        for n, (_, o, v) in enumerate(rows):
            seen = v if v is not None else seen
            assert last[(g, o)] == seen and nth[(g, o)] == n + 1
            assert after[(g, o)] == next((w for _, _, w in rows[n + 1 :] if w is not None), None)


def test_windows_of_a_scan_stay_small(spark):
    """Every block holds one row, so blocks themselves have to be summed up in blocks."""
    rows = spark.range(200_000).select(F.lit("hot").alias("g"), (F.col("id") * 1_000_000).alias("o"))
    blocks = rows.select("g", F.expr("o div 65536").alias("b"))
    upper = blocks.groupBy("g", F.shiftright("b", distributed._UPPER_BITS).alias("u")).count()
    most = upper.agg(F.max("count"), F.count("*")).first()
    assert most[0] < 5_000 and most[1] < 5_000  # a window inside an upper block, and the one over upper blocks
