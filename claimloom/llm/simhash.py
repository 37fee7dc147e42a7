"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint is read as bytes at fixed positions. Two fingerprints that differ
in few bits share many positional bytes, so pairs are looked up by sets of
positional bytes, kept where the number of shared bytes reaches the guaranteed
minimum, and verified by their differing bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.components import components
from claimloom.llm.store import fresh, stored

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
SLICE = 1 << 16  # shingles whose bits are counted at a time
COMPARED, COMPARED_SHINGLES = 256, 1 << 20  # members, and shingles, of a block of sets compared in one task
SAMPLE = 16  # one text in so many is read for common shingles
SAMPLE_ROWS = 4  # texts of the sample a common shingle occurs in
COMMON = 500_000  # common shingles known to every task at most
POSTING = 2048  # fingerprints of a posting list compared in one task at most, twice over


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``width`` words, A-Z lowered; of all words if there are fewer, of none without words."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = [0], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts))


def print_of(hashes: np.ndarray, words64: int = 1) -> bytes:
    """``words64`` * 8 bytes, the most significant bit first; all zero without hashes.

    A bit is set if more than half of the hashes have it. The first 64 bits
    come from the hash; each further 64 bits mix it with another odd constant.
    """
    votes = np.zeros(64 * words64, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        h = hashes[at : at + SLICE]
        for k in range(words64):
            bits = np.unpackbits(_remixed(h, k).astype(">u8").view(np.uint8)).reshape(-1, 64)
            votes[64 * k : 64 * k + 64] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes)).tobytes()


def fingerprint(text: str | None, width: int, words64: int = 1) -> bytes:
    """The print of a text's shingles, repeats included; all zero for a text without words."""
    return print_of(shingle_hashes(text, width), words64)


def _remixed(h: np.ndarray, k: int) -> np.ndarray:
    if k == 0:
        return h
    x = h * np.uint64(2 * k + 1) + np.uint64(k)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def prints_of(docs: DataFrame, width: int, words64: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print) of every row of ``docs``, stored, so that no text is read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t.as_py(), width, words64) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "print"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return stored(docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, print binary"), "prints")


def covering_sets(positions: int, shared: int) -> list[tuple[int, ...]]:
    """Triples of positions such that any ``shared`` (4 or more) positions hold one of them whole.

    The positions are dealt round a ring of three; a triple counts if it lies in
    one part, or two of it in a part and one in the next. Any four positions
    hold such a triple, so looking up these triples loses no pair.
    """
    if shared < 4:
        raise ValueError("the triples cover sets of four positions or more")
    chosen = []
    for triple in combinations(range(positions), 3):
        a, b, c = sorted(p % 3 for p in triple)
        if a == c or (a, b, c) in ((0, 0, 1), (1, 1, 2), (0, 2, 2)):
            chosen.append(triple)
    return chosen


def _posting_keys(prints: str, sets: Sequence[Sequence[int]]) -> Column:
    entries = []
    for number, chosen in enumerate(sets):
        at = [F.substring(F.col(prints), p + 1, 1) for p in chosen]
        entries.append(F.concat(F.lit(bytes([number])), *at))
    return F.array(*entries)


def tally(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many bytes each print shares with ``one`` at the same positions."""
    return (prints == one).sum(axis=1)


def least_shared(size: int, flip: float) -> int:
    """How many of ``size`` positional bytes two prints share at least, all but once in ten million pairs, if a bit differs with ``flip``."""
    equal = (1 - flip) ** 8
    n, below = 0, (1 - equal) ** size
    while below < 1e-7:
        n += 1
        below += comb(size, n) * equal**n * (1 - equal) ** (size - n)
    return n


def _forest(
    prints: np.ndarray, blocks: np.ndarray, own: bool, min_shared: int, max_bits: int, group: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Linked pairs of one posting list, only those that join something not yet joined.

    ``prints`` is (n, bytes). Shared positional bytes are counted for every pair,
    pairs below ``min_shared`` go, and the bits of the others are compared. With ``own`` false only pairs of different blocks
    are compared, as another task compares the blocks themselves. Equal numbers in ``group`` are joined before.
    """
    n = len(prints)
    group = np.arange(n) if group is None else np.unique(group, return_inverse=True)[1]
    out = []
    wide = prints.view(np.uint64)
    for i in range(n - 1):
        # only what isn't joined with i yet can add an edge
        rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if not own:
            rest = rest[blocks[rest] != blocks[i]]
        if not rest.size:
            continue
        if min_shared:
            # the count filter: the key holds three equal bytes, a link needs more
            rest = rest[tally(prints[rest], prints[i]) >= min_shared]
        bits = np.bitwise_count(wide[rest] ^ wide[i]).sum(axis=1, dtype=np.int64)
        for j in rest[bits <= max_bits].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((i, j))
    return out


def linked(
    prints: DataFrame, size: int, max_bits: int, min_shared: int, sets: Sequence[Sequence[int]]
) -> DataFrame:
    """Edges (u, v) between ids of ``prints`` that connect all fingerprints within ``max_bits``.

    ``prints`` is a stored frame of (id, print), one row per fingerprint of
    ``size`` bytes.
    """
    keys = prints.select("id", F.explode(_posting_keys("print", sets)).alias("key"))
    return linked_lists(keys, prints, size, max_bits, min_shared)


def linked_lists(keys: DataFrame, prints: DataFrame, size: int, max_bits: int, min_shared: int = 0) -> DataFrame:
    """Edges (u, v) that connect all ids within ``max_bits`` that share a key of ``keys``, (id, key).

    The index holds ids alone; fingerprints join the lists that
    have two members or more. Each list is reduced to a spanning forest of its
    links, so a list of n similar fingerprints gives at most n - 1 edges and no
    connection is lost. Lists longer than ``POSTING`` are cut into blocks, and
    pairs of blocks are compared by different tasks. With a column ``root`` in
    ``keys``, ids of one root are joined before: they are not compared, and a
    list of one root is not read.
    """
    joined = ["root"] if "root" in keys.columns else []
    groups = [F.min(c) != F.max(c) for c in joined] or [F.count("*") > 1]
    lengths = keys.groupBy("key").agg(F.count("*").alias("n"), groups[0].alias("_apart")).where("_apart").select("key", "n")
    live = keys.join(lengths, "key").withColumn("cut", F.ceil(F.col("n") / POSTING).cast("int"))
    block = F.pmod(F.xxhash64("id"), F.col("cut")).cast("int")
    placed = live.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    lists = placed.join(prints, "id").groupBy(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    ).agg(F.collect_list(F.struct("id", "print", "block", *joined)).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left: list[int] = []
            right: list[int] = []
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                members = row["members"]
                if len(members) < 2:
                    continue
                raw = b"".join([m["print"] for m in members])
                found = _forest(
                    np.frombuffer(raw, dtype=np.uint8).reshape(len(members), size),
                    np.array([m["block"] for m in members]),
                    row["low"] == row["high"],
                    min_shared,
                    max_bits,
                    np.array([m["root"] for m in members]) if joined else None,
                )
                left += [members[i]["id"] for i, _ in found]
                right += [members[j]["id"] for _, j in found]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return lists.select("low", "high", "members").mapInArrow(run, "u bigint, v bigint").distinct()


def print_components(
    prints: DataFrame,
    size: int = 8,
    max_bits: int = 4,
    min_shared: int | None = None,
    sets: Sequence[Sequence[int]] | None = None,
) -> DataFrame:
    """(print, component_id): per distinct fingerprint the smallest doc_id reachable over links.

    Fingerprints of ``size`` bytes link at ``max_bits`` differing bits or fewer;
    equal ones are one node. By default ``min_shared`` is the number of bytes
    that so few bits can't touch, and the index covers every set of so many
    bytes, so no link is lost. A missing id never names a component while it
    holds another. An empty table gives an empty result.
    """
    if min_shared is None:
        min_shared = size - max_bits
    if sets is None:
        sets = covering_sets(size, min_shared)
    first = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    # stored, so the numbers stay what they are
    classes = stored(first.withColumn("id", F.monotonically_increasing_id()), "print-classes")
    roots = components(linked(classes.select("id", "print"), size, max_bits, min_shared, sets))
    labelled = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return labelled.join(least, "root").select("print", "component_id")


def index_links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (u, v) that connect all ids of ``prints``, (id, print of 8 bytes), within ``max_bits``; ids with equal prints too."""
    classes = stored(prints.groupBy("print").agg(F.min("id").alias("rep")), "index-prints")
    alike = prints.join(classes, "print").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    least = 8 - max_bits
    return linked(classes.select(F.col("rep").alias("id"), "print"), 8, max_bits, least, covering_sets(8, least)).unionByName(alike)


def near_classes(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``, over 64 bits and without loss.

    Texts without words have fingerprint zero and are linked like any other;
    repeated rows fall into one component.
    """
    prints = prints_of(docs, width)
    found = prints.join(print_components(prints, 8, max_bits), "print")
    return found.select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def common_shingles(docs: DataFrame, width: int, text: str = "text") -> np.ndarray:
    """Sorted hashes of shingles that often occur, by a sample of the texts.

    They only put the shingles of a text in order. Any order finds the same
    pairs; one with common shingles last keeps the lists of the index short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.unique(shingle_hashes(t.as_py(), width)) for t in batch.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    sample = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0)
    counted = sample.mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_ROWS)
    often = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toArrow().column(0).to_numpy()
    return np.sort(often.astype(np.int64).view(np.uint64))


def prefix_keys(shingles: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, sorted and distinct, in the order all sets share: rare before common, then by hash.

    Sets of Jaccard similarity ``similarity`` or more have at least that share
    of each set in common, so both hold a shared one among their first ones:
    no pair is lost.
    """
    n = len(shingles)
    if not n:
        return shingles
    often = np.zeros(n, dtype=bool)
    if len(common):
        often = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
    ordered = np.concatenate((shingles[~often], shingles[often]))
    return ordered[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def indexed_sets(docs: DataFrame, width: int, words64: int, similarity: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (id, doc_id, content, digest, size, print, keys) of every row of ``docs``; ``id`` numbers the rows.

    ``digest`` tells sets of shingles apart, ``content`` is a hash of the text.
    The print is that of the distinct shingles, so repeats have no weight.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([print_of(s, words64) for s in sets], pa.binary()),
                    pa.array([prefix_keys(s, common, similarity).view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "content", "digest", "size", "print", "keys"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    found = docs.select(doc_id, F.xxhash64(text).alias("content"), text).mapInArrow(
        run, f"doc_id {kind}, content bigint, digest binary, size bigint, print binary, keys array<bigint>"
    )
    return stored(found.withColumn("id", F.monotonically_increasing_id()), "shingle-sets")


def _exact_forest(sets: list[np.ndarray], blocks: np.ndarray, own: bool, similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets of Jaccard ``similarity`` or more, only those that join something not yet joined; ``own`` as in ``_forest``."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(codes, kind="stable")]
    starts = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(names)))))
    group = np.arange(n)
    out = []
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if not own:
            rest = rest[blocks[rest] != blocks[i]]
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]) - 1e-9]
        if not rest.size:
            continue
        inside = codes[ends[i] - sizes[i] : ends[i]]
        held = starts[inside + 1] - starts[inside]
        places = np.arange(held.sum()) + np.repeat(starts[inside] - np.cumsum(held) + held, held)
        shared = np.bincount(holders[places], minlength=n)[rest]
        for j in rest[shared >= similarity * (sizes[i] + sizes[rest] - shared) - 1e-9].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((i, j))
    return out


def verified(members: DataFrame, docs: DataFrame, width: int, similarity: float, text: str = "text") -> DataFrame:
    """Edges (u, v) that connect all ids of one root whose shingle sets have Jaccard ``similarity`` or more.

    ``members`` is a stored frame of (id, root, content, digest, size). Texts are
    found by ``content`` and told apart by ``digest``. A root's members are cut into blocks
    of bounded length, and pairs of blocks are compared by different tasks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in batch.column(0)[at : at + 256]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(xxhash.xxh128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"]
                )

    wanted = members.select(F.col("content").alias("_content")).distinct()
    texts = docs.select(text).join(wanted, F.xxhash64(text) == F.col("_content"), "left_semi")
    sets = texts.mapInArrow(read, "digest binary, shingles binary").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    pieces = F.greatest(F.ceil(F.count("*") / COMPARED), F.ceil(F.sum("size") / COMPARED_SHINGLES)).cast("int")
    cuts = members.groupBy("root").agg(pieces.alias("cut"))
    placed = members.join(cuts, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int"))
    dealt = placed.join(sets, "digest").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    lists = dealt.groupBy("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(
        F.collect_list(F.struct("id", "block", "shingles")).alias("members")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left: list[int] = []
            right: list[int] = []
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = row["members"]
                held = [np.frombuffer(m["shingles"], dtype=np.uint64) for m in found]
                blocks = np.array([m["block"] for m in found])
                pairs = _exact_forest(held, blocks, row["low"] == row["high"], similarity)
                left += [found[i]["id"] for i, _ in pairs]
                right += [found[j]["id"] for _, j in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return lists.select("low", "high", "members").mapInArrow(compare, "u bigint, v bigint").distinct()


def one_of_each(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, words64: int = 16, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the smallest id stays.

    Two documents are linked if their sets of distinct shingles have Jaccard
    ``similarity`` or more. The byte-position index joins groups of what is
    within four of the fingerprint's first 64 bits: triples of positional bytes
    as keys, the count filter, the bits. Pairs further apart have no guaranteed
    bytes to look up; of those, every pair shares one of its first shingles
    (``prefix_keys``). Lists of such shingles that hold one group alone are
    dropped; in the others, pairs of two groups pass the count filter over all
    positional bytes (``least_shared``) and may differ in a quarter of the
    bits: at 0.8 and 1,024 bits a quarter is five standard deviations or more
    above what is to be expected, even of sets of four and five shingles. Inside
    each group the sets themselves are compared. Rows that share an
    id are one document. A row without id stays. Texts without words are equal.
    """
    size = 8 * words64
    cosine = 2 * similarity / (1 + similarity)
    # further apart than a quarter where lower similarities are asked for
    flip = np.arccos(cosine) / np.pi
    max_bits = 2 * size + max(0, int(flip * 8 * size) - int(0.15 * 8 * size))
    # bits of the smallest sets differ up to a quarter more often
    min_shared = least_shared(size, min(0.5, 1.25 * flip))
    sets = indexed_sets(docs, width, words64, similarity, doc_id, text)
    classes = stored(sets.groupBy("digest").agg(F.min("id").alias("id"), F.min("doc_id").alias("first")), "set-classes")
    distinct = sets.join(classes.select("id"), "id", "left_semi")
    near = components(index_links(distinct.select("id", F.substring("print", 1, 8).alias("print"))))
    found = near.select(F.col("node").alias("id"), "root")
    placed = distinct.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    keys = placed.select("id", "root", F.explode("keys").alias("key"))
    further = linked_lists(keys, distinct.select("id", "print"), size, max_bits, min_shared)
    loose = components(further.unionByName(found.select(F.col("id").alias("u"), F.col("root").alias("v"))))
    members = loose.withColumnRenamed("node", "id").join(sets.select("id", "content", "digest", "size"), "id")
    roots = components(verified(stored(members, "loose-groups"), docs, width, similarity, text))
    labelled = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least_ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = labelled.join(least_ids, "root").select("digest", "component_id")
    named = sets.select("doc_id", "digest").join(groups, "digest")
    dropped = named.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id"))
    first = named.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id"))
    # an id that stays in one component stays whole
    gone = dropped.join(first, "_id", "left_anti").distinct().withColumnRenamed("_id", fresh(docs, "_gone"))
    return docs.join(gone, F.col(doc_id) == F.col(gone.columns[0]), "left_anti")
