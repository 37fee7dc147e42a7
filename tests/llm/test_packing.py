"""Packing: every id once, limits kept, no padding but at the end, equal to the library's ids."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimloom.llm import packing
from claimloom.llm.words import Remembered, WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, limits, prompts=None):
    """Every piece lies where it says and holds the library's ids; every sequence keeps its limits."""
    own = Tokenizer.from_file(PATH)

    def ids_of(text):
        return own.encode(text or "", add_special_tokens=False).ids

    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for doc_id, found in docs.items():
        head = ids_of(prompts[doc_id]) if prompts else []
        expected = np.array(head + ids_of(texts[doc_id]) + [1], dtype="<u4")
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length == len(r.ids) // 4 > 0 and r.doc_tokens == len(expected)
            assert bytes(r.ids) == expected[at : at + r.length].tobytes()
            free = max(0, len(head) - at)
            assert r.loss_tokens == max(0, r.length - max(1, min(free, r.length)))
            at += r.length
        assert at == len(expected)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == limits.tokens or at & (at - 1) == 0 and at < limits.tokens
        assert len(found) <= limits.segments and sum(r.loss_tokens for r in found) <= limits.loss_tokens
    return sequences


def sample_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["Hello,", "wörld", "it's", "we'll", "<|endoftext|>", "ÉCOLE", "áb", "x1y22", "...", "日本語", "tail end", "́odd", "İst"]
    return {k: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 700]))) for k in range(n)}


def test_packs_every_id_once(spark):
    texts = {**sample_texts(300), 1000: None, 1001: "", 1002: "long word " * 9000}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, Start string").repartition(3)
    limits = packing.Limits()
    sequences = check(packing.packed(docs, PATH, 1, limits).collect(), texts, limits)
    short = [s for s in sequences.values() if sum(r.length for r in s) < limits.tokens]
    assert len(short) <= 3 * 11  # the end of each task only


def test_keeps_all_three_limits_at_once(spark):
    texts = sample_texts(200, 5)
    prompts = {k: v for k, v in zip(texts, reversed(texts.values()))}
    docs = spark.createDataFrame([(k, v, prompts[k]) for k, v in texts.items()], "doc_id long, text string, ask string")
    for limits in (packing.Limits(256, 4, 100), packing.Limits(64, 1, 64), packing.Limits(100, 50, 1)):
        check(packing.packed(docs, PATH, 1, limits, "ask").collect(), texts, limits, prompts)


def test_odd_ids_and_empty_table(spark):
    docs = spark.createDataFrame([("a", "one two"), ("a", "three"), (None, "four")], "doc_id string, text string")
    rows = packing.packed(docs, PATH, 1).collect()
    assert sorted((r.doc_id or "", r.doc_tokens) for r in rows if r.start == 0) == [("", 2), ("a", 2), ("a", 3)]
    assert packing.packed(docs.where(F.lit(False)), PATH, 1).collect() == []
    with pytest.raises(ValueError):
        packing.Limits(tokens=0)


def test_waiting_pieces_are_bounded():
    packer = packing.Packer(packing.Limits())
    rng = np.random.default_rng(1)
    placed = 0
    for k in range(9000):
        for pieces in packer.add(packing.Piece(k, 0, 0, np.full(int(rng.integers(1, 1500)), k, dtype=np.uint32))):
            placed += sum(len(p.ids) for p in pieces)
        assert len(packer.waiting) <= packing.WAITING_PIECES + 1 and packer.tokens == sum(len(p.ids) for p in packer.waiting)
    rest = list(packer.fill())
    assert not packer.waiting and packer.tokens == 0 and rest


def test_word_encoder_equals_the_library_and_forgets_rare_parts():
    encoder, own = WordEncoder(PATH), Tokenizer.from_file(PATH)
    encoder.parts = Remembered(encoder._learn, most=6)
    texts = [t for t in sample_texts(120, 9).values()] + [None, "", " \t\n", "a\x1cb\x85c", "ß ÀÖ ÿ! ÿ?!"]
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        ids, sizes = encoder.encode(pa.array(part, pa.string()))
        expected = [own.encode(t or "", add_special_tokens=False).ids for t in part]
        assert ids.tolist() == [i for e in expected for i in e] and sizes.tolist() == list(map(len, expected))
