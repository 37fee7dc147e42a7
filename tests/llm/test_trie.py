"""The burst trie against a plain trie of Python tuples."""

import hashlib
import random
import zlib

import pytest

from claimloom.llm import trie


def brute(rows, family=5, cycle=9):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % cycle
        base = c - (c % family if c >= 0 else -(-c % family))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(len(m) == len(node) + 1 for m in below),
            sum(not any(k[: len(m)] == m and len(k) == len(m) + 1 for k in below) for m in below),
            sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
            hashlib.sha256(",".join(map(str, sorted(c for c in convs if whole[c] == node))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(rng, n):
    texts = ["hi", "", None, "wörld", "yes", "no"]
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        shape = rng.choice(["copy", "chain", "free"])
        length = rng.choice([1, 2, 5, 12])
        for t in range(length):
            if shape == "copy":
                rows.append((c, t, "user", "same"))
            elif shape == "chain":
                rows.append((c, t, "a", "deep" if t < 9 else rng.choice(texts)))
            else:
                rows.append((c, rng.choice([None, t, t]), rng.choice(["user", None, "a"]), rng.choice(texts)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most", [1, 12, 100_000])
def test_nodes_equal_brute_force(spark, most):
    rng = random.Random(most)
    rows = rows_of(rng, 90) + [(None, 0, "user", "nobody")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", Depth string, n_convs int").repartition(5)
    found = trie.nodes(frame, most=most).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_long_shared_beginning_takes_few_rounds(spark, monkeypatch):
    rows = [(5 * c, t, "u", f"{t}" if t < 60 else f"{c}-{t}") for c in range(4) for t in range(63)]
    # all but the first 60 turns differ; families hold one conversation each
    rounds = []
    held = trie._beginnings
    monkeypatch.setattr(trie, "_beginnings", lambda at, upto: rounds.append((at, upto)) or held(at, upto))
    found = trie.nodes(spark.createDataFrame(rows, SCHEMA), most=30).collect()
    assert len(rounds) <= 7
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_single_conversation_and_empty_table(spark):
    rows = [(3, t, "u", str(t)) for t in range(20)]
    found = trie.nodes(spark.createDataFrame(rows, SCHEMA), most=5).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)
    assert trie.nodes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_turnless_conversation_is_a_member_of_the_root(spark):
    # 8 takes 8 turns of 5, which is absent, and has one of its own
    lonely = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    found = trie.nodes(spark.createDataFrame([(lonely, 0, "u", "x")], SCHEMA)).collect()
    assert [tuple(r) for r in found] == brute([(lonely, 0, "u", "x")])
    assert found[0].depth == 0 and found[0].n_convs == 1
