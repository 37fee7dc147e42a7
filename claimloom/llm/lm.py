"""Language-model scoring by online logistic context mixing, and a unigram base score.

A text is a row of words, each closed by a blank, and an end mark. The bits of
every byte are predicted by several contexts (the last 1 to 12 bytes of the text, over the
bounds of its words, hashed, with a check against strangers in a slot); a mixer adds up their log-odds with weights chosen by a gate, and a
second table, chosen by the mixed log-odds, refines the result. Weights and
refinement adapt online while the training texts pass by. Scores are total bits.

A last weight joins the bits of each word where it stands with the words' own frequencies.

Contexts reach into the words before, so the bits of a word depend on where it
stands: every byte of every text is predicted in its place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.store import by_bytes, stored
from claimloom.session import shuffles_removed

END = b"\n"  # no word holds it

CONTEXTS = (1, 2, 3, 4, 6, 12)  # bytes of the text that a predictor sees
SLOT_BITS = 15  # slots of a context's table: the bound of what is broadcast
CONTEXT_BLOCK = 256  # slots that one row of the collected model holds
COUNT_TASKS = 24  # that sum up the counts of all blocks
SCALE = 16.0  # log-odds are kept in 1/16
PRIOR = 0.4  # added to both counts of a bit
LEVELS = len(CONTEXTS) + 1
GATES = 8 * LEVELS  # bit of the byte, times how many contexts are known
BUCKETS = 33  # of the mixed log-odds, half a unit wide
RATE = 0.2
AT_ONCE = 1 << 13  # bytes between two updates of the weights
FREQUENT = 200_000  # words kept in every task; the rest is joined
DISCOUNT = 0.5  # taken off a word's count, for words not seen
SHARES = tuple(round(0.05 * k, 2) for k in range(20))  # what the words' frequencies may weigh
PRICED_AT_ONCE = 1 << 16  # bytes whose bits are worked out together
CODED_AT_ONCE = 1 << 19  # bytes whose contexts are hashed together
TEXT_AT_ONCE = 1 << 23  # bytes of text whose words are told apart together


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in them, text of each word): runs of no white space, A-Z lowered.

    The end mark is the last distinct word, and every text, missing ones too, ends in it. Words are in the order of the texts.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().cast(pa.binary()).dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    # white space at either end of a text leaves an empty word there
    empty = distinct.index(pa.scalar(b"", pa.binary())).as_py()
    if empty >= 0:
        owner, codes = owner[codes != empty], codes[codes != empty]
        distinct = pa.concat_arrays([distinct[:empty], distinct[empty + 1 :]])
        codes -= codes > empty
    distinct = pa.concat_arrays([distinct, pa.array([END], pa.binary())])
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    return distinct, np.insert(codes, ends, len(distinct) - 1), np.insert(owner, ends, np.arange(len(texts)))


# --- counting ------------------------------------------------------------------


def held(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored; the shuffle files of its making go at once."""
    with shuffles_removed(df.sparkSession):
        return stored(df, name)


def half_of(text: str) -> Column:
    """0 or 1 by a hash of the text, so that repeated texts stand in one half."""
    return F.pmod(F.xxhash64(text), F.lit(2))


def counted_words(docs: DataFrame, trains: Column, text: str = "text") -> tuple[DataFrame, int, int]:
    """Stored (word, c, a) of every word of ``docs``; tokens and distinct tokens of the training rows.

    ``c`` counts in training rows, ``a`` in about half of them by a hash of the
    text. Each row ends in one end token, which counts like a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, [0], TEXT_AT_ONCE):
                names, codes, owner = coded_words(some.column(0))
                # rows of the first half, of the second, and held-out ones, whose words count 0
                part = some.column(1).to_numpy()[owner]
                halves = [codes[part == k] for k in range(3)]
                first, second = (np.bincount(half, minlength=len(names)) for half in halves[:2])
                # the online weights follow the rows, so their order is part of the result: that of a set, part by part
                number = {w: k for k, w in enumerate(names.to_pylist())}
                words = list(number)
                met = [dict.fromkeys([words[k] for k in pa.array(half).unique().to_pylist()]) for half in halves]
                order = np.array([number[w] for w in met[0].keys() | met[1].keys() | met[2].keys()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(order)), pa.array((first + second)[order]), pa.array(first[order])], ["word", "c", "a"]
                )

    part = F.when(trains, half_of(text)).otherwise(2).cast("int")
    partial = docs.select(text, part.alias("_part")).mapInArrow(run, "word binary, c bigint, a bigint")
    words = held(partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a")), "words")
    tokens, distinct = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    return words, int(tokens or 0), int(distinct or 0)


# --- contexts and predictors -----------------------------------------------------


def running_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of them in each text): A-Z lowered, every word closed by one blank, an end mark."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    joined = pc.binary_join(words, " ")
    closing = pc.if_else(pc.equal(joined, ""), END.decode(), " " + END.decode())
    closed = pc.binary_join_element_wise(joined, closing, "")
    return np.frombuffer(b"".join(closed.cast(pa.binary()).to_pylist()), dtype=np.uint8), pc.binary_length(closed).to_numpy().astype(np.int64)


def places(sizes: np.ndarray) -> np.ndarray:
    """Bytes of its text before each byte, as far as a context reaches."""
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.minimum(at, max(CONTEXTS)).astype(np.uint8)


def context_hashes(flat: np.ndarray, at: np.ndarray, first: int, upto: int) -> np.ndarray:
    """Hash of each context with check bits, for some bytes; a context ends at the first byte of the text only."""
    longest = max(CONTEXTS)
    symbols = np.zeros(upto - first + longest, dtype=np.uint32)
    begin = max(0, first - longest)
    symbols[longest - (first - begin) :] = flat[begin:upto]
    symbols[longest - (first - begin) :] += np.uint32(1)
    hashed = np.empty((len(CONTEXTS), upto - first), dtype=np.uint32)
    h = np.full(upto - first, 0x811C9DC5, dtype=np.uint32)
    here = at[first:upto]
    for back in range(1, longest + 1):
        # a place before the text is one more symbol
        earlier = symbols[longest - back : longest - back + len(here)] * (here >= back)
        h = (h ^ earlier * np.uint32(0x9E3779B1)) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        if back in CONTEXTS:
            hashed[CONTEXTS.index(back)] = h * np.uint32(0x85EBCA6B) >> np.uint32(24 - SLOT_BITS)
    return hashed


def contexts_of(words: list[bytes], texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word of each, hash of each context with check bits): words closed by a blank, the end mark bare.

    ``texts`` has the number of the text that each word stands in, in order, and
    contexts reach over all its words; without it every word is a text of its own.
    """
    units = [w if w == END else w + b" " for w in words]
    sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    flat = np.frombuffer(b"".join(units), dtype=np.uint8)
    whole = sizes if texts is None else np.bincount(texts, weights=sizes).astype(np.int64)
    return flat, np.repeat(np.arange(len(units)), sizes), context_hashes(flat, places(whole), 0, len(flat))


def coded_stretches(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, hash of each context) of all texts, stretch by stretch."""
    flat, sizes = running_texts(texts)
    at = places(sizes)
    for first in range(0, len(flat), CODED_AT_ONCE):
        upto = min(first + CODED_AT_ONCE, len(flat))
        yield flat[first:upto], context_hashes(flat, at, first, upto)


_BLOCK = CONTEXT_BLOCK * 256  # counts that a block has
_BLOCKS = (1 << SLOT_BITS) // CONTEXT_BLOCK
_COUNTS = "context int, block int, place binary, n binary"


def block_sums(texts: DataFrame, keys: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """(context, block, place, n) with the number of bytes at each place of each block, summed over a task's texts.

    ``keys`` gives a context's number and places for bytes and hashes. A task holds one count per place, whatever it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # low 16 bits of the counts, and what they have carried over
        counts = np.zeros((len(CONTEXTS), _BLOCKS * _BLOCK), dtype=np.uint16)
        carried: list[Counter] = [Counter() for _ in CONTEXTS]
        for batch in batches:
            for some in by_bytes(batch, [0], TEXT_AT_ONCE):
                for flat, hashed in coded_stretches(some.column(0)):
                    for k, key in keys(flat, hashed):
                        found, times = np.unique(key, return_counts=True)
                        times += counts[k][found]
                        counts[k][found] = times & 0xFFFF
                        over = times >> 16
                        carried[k].update({int(found[j]): int(over[j]) for j in np.flatnonzero(over)})
        for k in range(len(CONTEXTS)):
            for block in range(_BLOCKS):
                part = counts[k, block * _BLOCK : (block + 1) * _BLOCK].astype(np.uint32)
                for key, over in carried[k].items():
                    if key // _BLOCK == block:
                        part[key % _BLOCK] += np.uint32(over << 16)
                found = np.flatnonzero(part)
                if len(found):
                    row = [found.astype("<u2").tobytes()], [part[found].astype("<u4").tobytes()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([block], pa.int32()), *(pa.array(c, pa.binary()) for c in row)],
                        ["context", "block", "place", "n"],
                    )

    return texts.mapInArrow(run, _COUNTS)


def per_block(sums: DataFrame, made: Callable[[int, int, np.ndarray], tuple[bytes, ...]], columns: Sequence[str]) -> DataFrame:
    """(context, block, columns): what ``made`` gives for the counts of each block, added up row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, block, place, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, block) not in totals:
                    totals[k, block] = np.zeros(_BLOCK, dtype=np.int64)
                totals[k, block][np.frombuffer(place, dtype="<u2")] += np.frombuffer(n, dtype="<u4")
        for (k, block), total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([block], pa.int32()), *(pa.array([c], pa.binary()) for c in made(k, block, total))],
                ["context", "block", *columns],
            )

    schema = ", ".join(["context int, block int", *(f"{c} binary" for c in columns)])
    return sums.repartition(COUNT_TASKS, "context", "block").mapInArrow(run, schema)


def bit_tables(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of a 1, in 1/16 as int8, at (context, slot * 256 + node of the bit tree), and the check of each slot.

    Counted over every byte of ``texts``, its first column. A slot belongs to the
    context that occurs most there: the first pass finds it, the second counts
    the bytes that follow it. Blocks of slots are summed by the executors; the
    driver receives as many bytes as the tables have, whatever the corpus.
    """
    context = texts.sparkSession.sparkContext

    def slots(flat: np.ndarray, hashed: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(len(CONTEXTS)):
            yield k, hashed[k]

    def owners(_k: int, _block: int, total: np.ndarray) -> tuple[bytes, ...]:
        by_check = total.reshape(CONTEXT_BLOCK, 256)
        return (np.where(by_check.any(axis=1), by_check.argmax(axis=1), -1).astype("<i2").tobytes(),)

    checks = np.full((len(CONTEXTS), 1 << SLOT_BITS), -1, dtype=np.int16)
    for row in held(per_block(block_sums(texts, slots), owners, ["checks"]), "slot-owners").toLocalIterator():
        checks[row.context, row.block * CONTEXT_BLOCK : (row.block + 1) * CONTEXT_BLOCK] = np.frombuffer(row.checks, dtype="<i2")
    shared = context.broadcast(checks)

    def symbols(flat: np.ndarray, hashed: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(len(CONTEXTS)):
            slot = hashed[k] >> np.uint32(8)
            own = shared.value[k].take(slot) == (hashed[k] & np.uint32(255))
            yield k, (slot << np.uint32(8) | flat)[own]

    def log_odds(_k: int, _block: int, total: np.ndarray) -> tuple[bytes, ...]:
        out = np.zeros((CONTEXT_BLOCK, 256), dtype=np.int8)
        for d in range(8):
            sides = total.reshape(CONTEXT_BLOCK, 1 << d, 2, -1).sum(axis=3)
            found = np.log((sides[:, :, 1] + PRIOR) / (sides[:, :, 0] + PRIOR))
            out[:, 1 << d : 2 << d] = np.clip(np.rint(found * SCALE), -127, 127)
        return (out.tobytes(),)

    odds = np.zeros((len(CONTEXTS), 1 << SLOT_BITS, 256), dtype=np.int8)
    for row in held(per_block(block_sums(texts, symbols), log_odds, ["odds"]), "bit-tables").toLocalIterator():
        part = slice(row.block * CONTEXT_BLOCK, (row.block + 1) * CONTEXT_BLOCK)
        odds[row.context, part] = np.frombuffer(row.odds, dtype=np.int8).reshape(-1, 256)
    shared.unpersist()
    return odds.reshape(len(CONTEXTS), -1), checks


# --- mixing --------------------------------------------------------------------


def first_weights() -> np.ndarray:
    return np.full((GATES, len(CONTEXTS)), 0.35)


def first_refinement() -> np.ndarray:
    """(gate, bucket) log-odds; at the start each bucket's own."""
    return np.tile((np.arange(BUCKETS) - BUCKETS // 2) / 2.0, (GATES, 1))


def bit_inputs(model: tuple[np.ndarray, np.ndarray], flat: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, Iterator[tuple]]:
    """Order of the bytes by the set of their known contexts, level of each, the sets' (level, range), and an iterator over the 8 bits.

    Per bit: (predictors (context, byte) in log-odds, bit), bytes in that order; an unknown context says nothing and is not
    looked up. The gate of bit d and level l, the number of known contexts, is LEVELS * d + l.
    """
    odds, checks = model
    slot = (hashed >> np.uint32(8)).astype(np.int64)
    met = np.zeros(len(flat), dtype=np.uint8)
    for k in range(len(CONTEXTS)):
        met |= (checks[k].take(slot[k]) == (hashed[k] & np.uint32(255))).astype(np.uint8) << np.uint8(k)
    order = np.argsort(met, kind="stable")
    sets, begins = np.unique(met[order], return_index=True)
    parts = [slice(a, b) for a, b in zip(begins, [*begins[1:], len(flat)])]
    levels = [int(m).bit_count() for m in sets]
    level = np.repeat(np.array(levels, dtype=np.int64), [p.stop - p.start for p in parts])
    reads = []
    for k in range(len(CONTEXTS)):
        for m, part in zip(sets, parts):
            if m >> k & 1:
                if reads and reads[-1][0] == k and reads[-1][1].stop == part.start:
                    reads[-1] = k, slice(reads[-1][1].start, part.stop)
                else:
                    reads.append((k, part))
    reads = [(k, part, slot[k, order[part]] << 8) for k, part in reads]

    def bits() -> Iterator[tuple]:
        symbols = flat[order].astype(np.int64)
        x = np.zeros((len(CONTEXTS), len(flat)), dtype=np.float32)
        for d in range(8):
            node = (1 << d) | symbols >> (8 - d)
            for k, part, base in reads:
                np.multiply(odds[k].take(base + node[part]), np.float32(1 / SCALE), out=x[k, part])
            yield x, (symbols >> (7 - d) & 1).astype(np.float32)

    return order, level, list(zip(levels, parts)), bits()


def mixed(x: np.ndarray, weights: np.ndarray, bit: int, parts: list) -> np.ndarray:
    """The mixer's log-odds of bytes in the order of their contexts."""
    z = np.empty(x.shape[1], dtype=np.float32)
    for level, part in parts:
        z[part] = weights[LEVELS * bit + level].astype(np.float32) @ x[:, part]
    return z


def refined(z: np.ndarray, gate: np.ndarray, refinement: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final log-odds, half from the mixer and half from its bucket's record; and the bucket."""
    bucket = np.clip(np.rint(2 * z) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)
    return (z + refinement.ravel().take(gate * BUCKETS + bucket)) / 2, bucket


def adapted(texts: DataFrame, tables: object) -> tuple[np.ndarray, np.ndarray]:
    """Weights and refinement learned online over the texts of the second half, as the first half predicts them.

    So no text predicts itself. Every task starts from equal weights and follows the gradient of the coding
    cost, one step per stretch of bytes; the tasks' weights are averaged by the
    bits they have seen. The refinement is the record, per gate and bucket, of
    how often the bit was 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_tables, plain = tables.value, first_refinement()
        weights, seen = first_weights(), np.zeros(GATES)
        ones, all_bits = np.zeros(GATES * BUCKETS), np.zeros(GATES * BUCKETS)
        for batch in batches:
            for some in by_bytes(batch, [0], TEXT_AT_ONCE):
                for flat, hashed in coded_stretches(some.column(0)):
                    for at in range(0, len(flat), AT_ONCE):
                        part = slice(at, at + AT_ONCE)
                        _, level, parts, bits = bit_inputs(known_tables, flat[part], hashed[:, part])
                        mass = np.bincount(level, minlength=LEVELS)
                        for d, (x, bit) in enumerate(bits):
                            z = mixed(x, weights, d, parts)
                            error = bit - 1 / (1 + np.exp(-np.clip(z, -80, 80)))
                            for g, own in parts:
                                weights[LEVELS * d + g] += RATE * (x[:, own] @ error[own]) / mass[g]
                            gate = LEVELS * d + level
                            seen[LEVELS * d : LEVELS * (d + 1)] += mass
                            cell = gate * BUCKETS + refined(z, gate, plain)[1]
                            ones += np.bincount(cell, weights=bit, minlength=GATES * BUCKETS)
                            all_bits += np.bincount(cell, minlength=GATES * BUCKETS)
        rows = [("w", g * len(CONTEXTS) + k, weights[g, k] * seen[g], seen[g]) for g in range(GATES) for k in range(len(CONTEXTS))]
        rows += [("r", c, ones[c], all_bits[c]) for c in np.flatnonzero(all_bits).tolist()]
        kinds, cells, sums, sizes = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds), pa.array(cells, pa.int64()), pa.array(sums, pa.float64()), pa.array(sizes, pa.float64())],
            ["kind", "place", "total", "size"],
        )

    partial = texts.mapInArrow(run, "kind string, place bigint, total double, size double")
    # a few hundred rows, whatever the corpus
    sums = partial.groupBy("kind", "place").agg(F.sum("total").alias("total"), F.sum("size").alias("size")).collect()
    weights, refinement = first_weights(), first_refinement()
    for row in sums:
        if row.kind == "w" and row.size > 0:
            weights[divmod(row.place, len(CONTEXTS))] = row.total / row.size
        elif row.kind == "r" and row.size > 0:
            gate, bucket = divmod(row.place, BUCKETS)
            # the bucket's own log-odds count like a few bits
            own = 1 / (1 + np.exp(-refinement[gate, bucket]))
            p = (row.total + 16 * own) / (row.size + 16)
            refinement[gate, bucket] = np.clip(np.log(p / (1 - p)) if 0 < p < 1 else 12 * np.sign(p - 0.5), -12, 12)
    return weights, refinement


def byte_bits(flat: np.ndarray, hashed: np.ndarray, tables: tuple[np.ndarray, np.ndarray], weights: np.ndarray, refinement: np.ndarray) -> np.ndarray:
    """Bits of each byte."""
    cost, records = np.empty(len(flat)), refinement.astype(np.float32)
    for at in range(0, len(flat), PRICED_AT_ONCE):
        part = slice(at, at + PRICED_AT_ONCE)
        order, level, parts, bits = bit_inputs(tables, flat[part], hashed[:, part])
        odds = np.ones(len(order))
        for d, (x, bit) in enumerate(bits):
            z, _ = refined(mixed(x, weights, d, parts), LEVELS * d + level, records)
            z *= 1 - 2 * bit
            odds *= 1 + np.exp(np.clip(z, -80, 80, out=z), out=z)
        cost[at + order] = np.log2(odds)
    return cost


def word_bits(words: list[bytes], tables: tuple[np.ndarray, np.ndarray], weights: np.ndarray, refinement: np.ndarray) -> np.ndarray:
    """Bits of each word with its closing byte, at the beginning of a text."""
    flat, owner, hashed = contexts_of(words)
    return np.bincount(owner, weights=byte_bits(flat, hashed, tables, weights, refinement), minlength=len(words))


def token_bits(texts: pa.Array, tables: tuple[np.ndarray, np.ndarray], weights: np.ndarray, refinement: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each token where it stands, bytes of each text); tokens as in ``coded_words``."""
    flat, sizes = running_texts(texts)
    at, cost = places(sizes), np.empty(len(flat))
    for first in range(0, len(flat), CODED_AT_ONCE):
        upto = min(first + CODED_AT_ONCE, len(flat))
        cost[first:upto] = byte_bits(flat[first:upto], context_hashes(flat, at, first, upto), tables, weights, refinement)
    closing = np.flatnonzero((flat == 32) | (flat == END[0]))
    return np.add.reduceat(cost, np.concatenate(([0], closing[:-1] + 1))) if len(flat) else cost, sizes


def joined_bits(bits: np.ndarray, count: np.ndarray, total: float, share: float) -> np.ndarray:
    """Bits of words under ``share`` of their discounted frequency and the rest of the bit model."""
    frequency = np.maximum(count - DISCOUNT, 0) / max(total, 1.0)
    return -np.log2(share * frequency + (1 - share) * np.exp2(-np.minimum(bits, 1000.0)) + 1e-320) + np.maximum(bits - 1000.0, 0)


def frequency_share(texts: DataFrame, words: DataFrame, often: object, tables: object, weights: np.ndarray, refinement: np.ndarray, total: float) -> float:
    """The share that costs least over the texts of the second half, with the frequencies of the first.

    Tokens of frequent words are priced where they stand; the others meet their counts by a join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _, first = often.value
        costs = np.zeros(len(SHARES))
        for batch in batches:
            for some in by_bytes(batch, [0], TEXT_AT_ONCE):
                names, codes, _ = coded_words(some.column(0))
                bits, _ = token_bits(some.column(0), tables.value, weights, refinement)
                place = pc.fill_null(pc.index_in(names, found), -1).to_numpy().astype(np.int64)[codes]
                known = place >= 0
                costs += [float(joined_bits(bits[known], first[place[known]], total, share).sum()) for share in SHARES]
                rare = pa.array(codes[~known])
                yield pa.RecordBatch.from_arrays(
                    [names.take(rare), pa.array(bits[~known]), pa.nulls(len(rare), pa.int64()), pa.nulls(len(rare), pa.float64())], _PRICED
                )
        n = len(SHARES)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64()), pa.array(range(n), pa.int64()), pa.array(costs)], _PRICED)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = np.zeros(len(SHARES))
        for batch in batches:
            bits, count = (c.to_numpy() for c in batch.columns)
            costs += [float(joined_bits(bits, count, total, share).sum()) for share in SHARES]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(SHARES)), pa.int64()), pa.array(costs)], ["k", "cost"])

    priced = held(texts.mapInArrow(run, "word binary, bits double, k bigint, cost double"), "priced-words")
    rare = priced.where("word IS NOT NULL").join(words, "word").select("bits", "a").mapInArrow(price, "k bigint, cost double")
    costs = priced.where("word IS NULL").select("k", "cost").unionByName(rare).groupBy("k").agg(F.sum("cost").alias("cost")).collect()
    return SHARES[min(costs, key=lambda r: (r.cost, r.k)).k] if costs and any(r.cost for r in costs) else 0.0


_PRICED = ["word", "bits", "k", "cost"]


# --- scoring -------------------------------------------------------------------


def scored(docs: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Learns from the rows for which ``trains`` holds. A missing or empty text is
    the end token alone. Without training rows all counts are 0 and every bit
    costs one bit. Repeated rows are scored alike.
    """
    context = docs.sparkSession.sparkContext
    words, tokens, distinct = counted_words(docs, trains, text)
    frequent = words.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    often = context.broadcast((frequent.column("word").combine_chunks(), *(frequent.column(c).to_numpy() for c in ("c", "a"))))
    taught = docs.where(trains).select(text)
    halves = [taught.where(half_of(text) == k) for k in (0, 1)]
    half = context.broadcast(bit_tables(halves[0]))
    weights, refinement = adapted(halves[1], half)
    first_tokens = float(words.agg(F.sum("a")).first()[0] or 0)
    share = frequency_share(halves[1], words, often, half, weights, refinement, first_tokens)
    half.unpersist()
    tables = context.broadcast(bit_tables(taught))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with the sums over frequent words, and a row per other word in it."""
        from pyspark import TaskContext

        found, counts, _ = often.value
        logs = np.log10(counts + 1.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in by_bytes(batch, [1], TEXT_AT_ONCE):
                n = some.num_rows
                names, codes, owner = coded_words(some.column(1))
                bits, sizes = token_bits(some.column(1), tables.value, weights, refinement)
                place = pc.fill_null(pc.index_in(names, found), -1).to_numpy().astype(np.int64)[codes]
                known = place >= 0
                at, of, rare = place[known], owner[known], np.flatnonzero(~known)
                priced = joined_bits(bits[known], counts[at], float(tokens), share)
                none = pa.nulls(len(rare), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + owner[rare]), pa.nulls(len(rare), some.column(0).type), names.take(pa.array(codes[rare])),
                        none, none, none.cast(pa.float64()), pa.array(bits[rare]), none,
                    ],
                    _SUMS,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)), some.column(0), pa.nulls(n, pa.binary()),
                        pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(of[counts[at] > 0], minlength=n)),
                        pa.array(np.bincount(of, logs[at], n)), pa.array(np.bincount(of, priced, n)), pa.array(sizes),
                    ],
                    _SUMS,
                )
                row += n

    kind = docs.schema[doc_id].dataType.simpleString()
    sums = held(
        docs.select(doc_id, text).mapInArrow(
            add, f"row bigint, doc_id {kind}, word binary, n_tokens bigint, n_known bigint, logs double, bits double, size bigint"
        ),
        "text-sums",
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, c, bits = batch.columns
            yield pa.RecordBatch.from_arrays(
                [row, c, pa.array(joined_bits(bits.to_numpy(), c.to_numpy(), float(tokens), share))], ["row", "c", "bits"]
            )

    rare = sums.where("word IS NOT NULL").select("row", "word", "bits").join(words, "word").select("row", "c", "bits")
    rest = rare.mapInArrow(joined, "row bigint, c bigint, bits double").groupBy("row").agg(
        F.count_if(F.col("c") > 0).alias("_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("_logs"), F.sum("bits").alias("_bits")
    )
    whole = sums.where("word IS NULL").drop("word").join(rest, "row", "left")
    total = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    bits = total("bits", "_bits")
    return whole.select(
        F.col("doc_id").alias(doc_id),
        "n_tokens",
        total("n_known", "_known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (total("logs", "_logs") - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"),
        (-bits * F.lit(float(np.log10(2)))).alias("score"),
        (bits / F.col("size")).alias("bits_per_byte"),
    )


_SUMS = ["row", "doc_id", "word", "n_tokens", "n_known", "logs", "bits", "size"]
