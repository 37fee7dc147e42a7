"""What the language model's predictors see of a word, and its words themselves."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm import lm


def test_long_contexts_tell_words_with_equal_ends_apart():
    words = [b"xxabcd", b"yyabcd", b"xxxxxxefghij", b"yyyyxxefghij"]
    _, owner, hashed = lm.contexts_of(words)
    closing = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    seen = hashed[:, closing]
    same = [[bool(row[0] == row[1]), bool(row[2] == row[3])] for row in seen]
    assert lm.CONTEXTS == (1, 2, 3, 4, 6, 12)
    assert same == [[True, True]] * 4 + [[False, True], [False, False]]


ODD = ["  The the\tcat\x0bsat ", "", None, " \n", "".join(f"a{chr(c)}" for c in range(400)), "\u3000x\u0085 \u2028 \u00c9A", "the END the", "the END the"]


def plain_words(text):
    lowered = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return [*re.findall(rb"[^\x20\x09-\x0D]+", lowered), lm.END]


def test_words_of_a_batch_are_those_of_the_texts_one_by_one():
    for texts in (ODD, ODD[5:], [None], []):
        distinct, codes, owner = lm.coded_words(pa.array(texts, pa.string()))
        names = distinct.to_pylist()
        assert len(set(names)) == len(names)
        for k, text in enumerate(texts):
            assert Counter(names[c] for c in codes[owner == k]) == Counter(plain_words(text))


def test_words_are_counted_over_slices_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(lm, "TEXT_AT_ONCE", 20)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id bigint, text string").coalesce(1)
    words, tokens, distinct = lm.counted_words(docs, F.col("doc_id") != 5)
    taught = Counter(w for k, t in enumerate(ODD) if k != 5 for w in plain_words(t))
    assert {bytes(r.word): r.c for r in words.collect() if r.c} == taught
    assert (tokens, distinct) == (taught.total(), len(taught))
    assert {bytes(r.word) for r in words.collect()} == {w for t in ODD for w in plain_words(t)}


def test_contexts_reach_over_the_words_before():
    words = [b"the", b"cat", b"sat", lm.END, b"sat", b"cat", lm.END]
    flat, owner, hashed = lm.contexts_of(words, np.array([0, 0, 0, 0, 1, 1, 1]))
    running, sizes = lm.running_texts(pa.array([" The\tcat sat\n", "sat  cat"]))
    assert flat.tobytes() == running.tobytes() == b"the cat sat \nsat cat \n" and sizes.tolist() == [13, 9]
    # the last letter of cat: three bytes back are equal, four and more are not
    first, second = (np.flatnonzero(owner == w)[2] for w in (1, 5))
    assert [bool(a == b) for a, b in zip(hashed[:, first], hashed[:, second])] == [True, True, True, False, False, False]
    # a stretch sees the bytes before it, and a text nothing of the one before
    at = lm.places(sizes)
    assert (lm.context_hashes(flat, at, 7, 20) == hashed[:, 7:20]).all()
    assert (lm.contexts_of(words[4:])[2][:, :3] == hashed[:, 13:16]).all()


def test_order_of_words_counts(spark):
    taught = [(k, "one two three four five six") for k in range(40)] + [(100 + k, f"odd{k} seven") for k in range(40)]
    docs = spark.createDataFrame([*taught, (900, "one two three four five six"), (901, "six four two five three one")], "doc_id bigint, text string")
    by = {r.doc_id: r for r in lm.scored(docs, F.col("doc_id") < 900).collect()}
    assert by[900].base_score == by[901].base_score
    assert by[900].score > by[901].score + 1


def plain_bits(data, taught, weights, refinement):
    """Bits of a text by the definition, byte by byte, with counts of what follows each context as long as no two share a slot."""
    before = lambda t, i, n: tuple(t[i - b] + 1 if i >= b else 0 for b in range(1, n + 1))
    follow = [Counter() for _ in lm.CONTEXTS]
    for t in taught:
        for i, symbol in enumerate(t):
            for k, n in enumerate(lm.CONTEXTS):
                follow[k][before(t, i, n), symbol] += 1
    seen = [{c for c, _ in f} for f in follow]
    total = 0.0
    for i, symbol in enumerate(data):
        known = [before(data, i, n) in seen[k] for k, n in enumerate(lm.CONTEXTS)]
        for d in range(8):
            x = []
            for k, n in enumerate(lm.CONTEXTS):
                ends = Counter()
                for (c, s), times in follow[k].items():
                    if c == before(data, i, n) and s >> (8 - d) == symbol >> (8 - d):
                        ends[s >> (7 - d) & 1] += times
                x.append(np.clip(np.rint(np.log((ends[1] + lm.PRIOR) / (ends[0] + lm.PRIOR)) * lm.SCALE), -127, 127) / lm.SCALE if known[k] else 0.0)
            gate = lm.LEVELS * d + sum(known)
            z = float(weights[gate] @ np.array(x))
            z = 0.5 * (z + refinement[gate, int(np.clip(np.rint(2 * z) + lm.BUCKETS // 2, 0, lm.BUCKETS - 1))])
            total += np.log2(1 + np.exp(-z if symbol >> (7 - d) & 1 else z))
    return total


def test_bits_are_those_of_the_definition(spark, monkeypatch):
    monkeypatch.setattr(lm, "CODED_AT_ONCE", 16)
    monkeypatch.setattr(lm, "PRICED_AT_ONCE", 5)
    taught = ["a cat sat", "a dog sat down", None, "the cat"]
    tables = lm.bit_tables(spark.createDataFrame([(t,) for t in taught], "text string").coalesce(2))
    rng = np.random.default_rng(5)
    weights = lm.first_weights() + rng.normal(0, 0.05, lm.first_weights().shape)
    refinement = lm.first_refinement() + rng.normal(0, 0.1, lm.first_refinement().shape)
    closed = lambda t: b" ".join([*(t or "").encode().split(), b"\n"])
    new = "a cat sat down here"
    bits, sizes = lm.token_bits(pa.array([new]), tables, weights, refinement)
    assert (len(bits), sizes.tolist()) == (6, [len(closed(new))])
    assert abs(bits.sum() - plain_bits(closed(new), [closed(t) for t in taught], weights, refinement)) < 1e-3
