"""The count filter of the SimHash index, and rows that repeat an id in exact dedup."""

import itertools

import numpy as np

from claimloom.llm import exact_dedup, simhash


def test_the_count_filter_rejects_pairs_of_a_list_before_their_bits_are_compared():
    rng = np.random.default_rng(3)
    sets = simhash.covering_sets(8, 4)
    prints = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    # a list of the index: prints that share three positional bytes, some of them near one another
    prints[:, list(sets[0])] = prints[0, list(sets[0])]
    for k in range(0, 300, 2):
        prints[k + 1] = prints[k]
        prints[k + 1, k % 8] ^= 1 << (k % 7)
    pairs = list(itertools.combinations(range(600), 2))
    kept = rejected = 0
    linked = set()
    for i, j in pairs:
        shared = int(simhash.tally(prints[j : j + 1], prints[i])[0])
        near = int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= 4
        kept, rejected = kept + (shared >= 4), rejected + (shared < 4)
        # four differing bits leave four bytes equal, so the filter loses no link
        assert not near or shared >= 4
        if near:
            linked.add((i, j))
    assert rejected > 0.9 * len(pairs) and kept >= len(linked) >= 150
    found = simhash._forest(prints[:600], np.zeros(600, dtype=np.int64), True, 4, 4)
    assert {tuple(sorted(p)) for p in found} <= linked and len(found) >= 150


def test_of_rows_that_repeat_an_id_the_longest_text_stays(spark):
    rows = [(1, "a b"), (1, "a   b"), (2, "ab"), (3, "x"), (3, "x"), (3, None), (None, "y  z"), (None, "yz")]
    left = exact_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, left)) == sorted(str(r) for r in spark.createDataFrame(
        [(1, "a   b"), (3, "x"), (3, None), (None, "y  z")], "doc_id long, text string").collect())
