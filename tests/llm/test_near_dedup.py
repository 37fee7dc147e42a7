"""Near copies at and around a similarity of 0.8, against brute force."""

import itertools
import random

import numpy as np

from claimloom.llm import simhash


def text_pair(rng, similarity, size):
    """Two texts of words that occur once, whose sets of five-word shingles have about this similarity; and the exact figure."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(size + 4)]
    new = round(size * (1 - similarity) / (1 + similarity))
    other = words[new:] + [f"x{rng.randrange(10**9)}" for _ in range(new)]
    return " ".join(words), " ".join(other), exact(" ".join(words), " ".join(other))


def exact(left, right):
    a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (left, right))
    return len(a & b) / len(a | b)


def test_every_pair_at_the_similarity_shares_a_key():
    rng = random.Random(4)
    near = 0
    for n in range(300):
        size = rng.choice([5, 9, 30, 120, 500])
        texts = text_pair(rng, rng.uniform(0.78, 0.86), size)
        sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts[:2]]
        # some shingles of either text are common ones
        common = np.sort(np.array(rng.sample(sets[n % 2].tolist(), len(sets[n % 2]) // 3), dtype=np.uint64))
        shared = np.intersect1d(*[simhash.prefix_keys(s, common, 0.8) for s in sets])
        if texts[2] >= 0.8:
            near += 1
            assert len(shared), texts
    assert near > 100


def test_near_dedup_equals_exact_components(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for n in range(120):
        texts += text_pair(rng, 0.70 + n % 26 / 100, rng.choice([5, 9, 60, 300]))[:2]
    # one line over and over, and different rests: equal by votes that count repeats, far apart as sets
    line = " ".join(f"again{k}" for k in range(12)) + " "
    texts += [line * 40 + " ".join(f"rest{n}x{k}" for k in range(60)) for n in range(6)]
    # a family whose neighbours are near and whose ends are not, longer than a block
    words = [f"chain{k}" for k in range(200)]
    texts += [" ".join(words[k : k + 100]) for k in range(0, 100, 5)]
    texts += [texts[0].upper(), "", None, "four words are short", "Four words are short"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    monkeypatch.setattr(simhash, "COMPARED", 7)
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_near_dedup_looks_up_positional_bytes_and_counts_them(spark, monkeypatch):
    calls, lists = [], simhash.linked_lists

    def watched(keys, prints, size, max_bits, min_shared=0):
        edges = lists(keys, prints, size, max_bits, min_shared)
        calls.append((dict(keys.dtypes)["key"], size, max_bits, min_shared, {frozenset(r) for r in edges.collect()}))
        return edges

    monkeypatch.setattr(simhash, "linked_lists", watched)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(900)]
    texts = [" ".join(words), " ".join([*words, "more"]), *text_pair(rng, 0.82, 300)[:2]]
    kept = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    index, rest = calls
    assert index[:4] == ("binary", 8, 4, 4) and rest[:2] == ("bigint", 128) and rest[3] >= 4
    # the pair that the index has joined is not looked up again; the one further apart is
    assert len(rest[4]) == 1 and not index[4] & rest[4]


def test_the_count_filter_of_wide_prints_loses_no_pair_at_the_similarity():
    rng = random.Random(6)
    flip = 1.25 * np.arccos(1.6 / 1.8) / np.pi
    least = simhash.least_shared(128, flip)
    prints = []
    for _ in range(300):
        left, right, similarity = text_pair(rng, rng.uniform(0.78, 0.86), rng.choice([5, 9, 30, 120, 500]))
        a, b = (np.frombuffer(simhash.print_of(np.unique(simhash.shingle_hashes(t, 5)), 16), dtype=np.uint8) for t in (left, right))
        prints.append(a)
        assert similarity < 0.8 or simhash.tally(b[None], a)[0] >= least
    strangers = [int(simhash.tally(b[None], a)[0]) for a, b in itertools.combinations(prints[:60], 2)]
    assert sum(n >= least for n in strangers) < 0.01 * len(strangers)


def test_ids_joined_before_are_not_compared_again(spark):
    prints = spark.createDataFrame([(k, bytes(8)) for k in range(5)], "id bigint, print binary")
    keys = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (2, 0, 2), (3, 3, 2), (4, 3, 2)], "id bigint, root bigint, key bigint")
    edges = [tuple(sorted(r)) for r in simhash.linked_lists(keys, prints, 8, 4, 4).collect()]
    assert len(edges) == 1 and edges[0][0] == 2 and edges[0][1] in (3, 4)
