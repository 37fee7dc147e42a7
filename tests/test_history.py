"""Late rows spliced into stored ranges, and lineage over long chains, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import governance
from claimloom.operators.governance import trace
from claimloom.operators.lifecycle import spliced_ranges
from claimloom.sources.buckets import BucketTable

SCHEMA = "key string, who string, start timestamp_ntz, stop timestamp_ntz"


def full(log):
    """Ranges of the whole log: the last arrival per key and start, each until the next start."""
    known = {}
    for n, (key, who, start) in enumerate(log):
        known[(key, start)] = who
    out = []
    for key in {k for k, _ in known}:
        starts = sorted(s for k, s in known if k == key)
        out += [(key, known[(key, s)], s, e) for s, e in zip(starts, [*starts[1:], None])]
    return sorted(out, key=str)


def test_splicing_equals_the_full_log(spark, tmp_path):
    rng = random.Random(5)
    log = [(rng.choice(["hot"] * 4 + ["a", "b"]), f"w{n}", rng.randint(0, 80)) for n in range(160)] + [(None, "lost", 3)]
    rng.shuffle(log)
    table = BucketTable(spark, str(tmp_path / "t"), SCHEMA, ["key", "start"], 4)
    stamp = F.timestamp_seconds(F.col("s") * 3600).cast("timestamp_ntz")
    for at in (0, 60, 61, 110):
        upto = {0: 60, 60: 61, 61: 110, 110: len(log)}[at]
        rows = [(k, w, s, n) for n, (k, w, s) in enumerate(log) if at <= n < upto]
        arriving = spark.createDataFrame(rows, "key string, who string, s long, n long").select("key", "who", stamp.alias("start"), "n")
        changed = spliced_ranges(table.read(), arriving, ["key"], "start", "stop", [F.col("n")], block_rows=8)
        if at == 60 and log[60][0] is not None:
            # one late row changes itself and at most the range that it closes
            assert changed.count() <= 2
        table.merge(changed, ["who", "stop"])
    hours = [((F.unix_micros(F.col(c).cast("timestamp")) / 3.6e9).cast("long")).alias(c) for c in ("start", "stop")]
    found = sorted((tuple(r) for r in table.read().select("key", "who", *hours).collect()), key=str)
    assert found == full([e for e in log if e[0] is not None])


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    edges = [(str(n), str(n + 1)) for n in range(1000)] + [("0", "500"), ("1000", "3"), ("x", "y")]
    rounds = []
    held = governance.kept
    monkeypatch.setattr(governance, "kept", lambda df, name: rounds.append(name) or held(df, name))
    found = trace(spark.createDataFrame([("0",)], "node string"), spark.createDataFrame(edges, "parent string, child string"))
    steps = {r.node: r.steps for r in found.collect()}
    assert steps == {str(n): min(n, n - 499 if n >= 500 else n) for n in range(1001)}
    assert rounds.count("jumps") <= 12
    with pytest.raises(ValueError):
        trace(spark.createDataFrame([("0",)], "node string"), spark.createDataFrame(edges, "parent string, child string"), most_steps=400)
