"""Packing examples into training sequences under several limits at once.

A sequence takes at most so many tokens, segments and loss-bearing tokens. Each
open sequence is filled by the dot-product heuristic: of the waiting pieces that
fit, the one whose needs point most in the direction of what is left. Where none
fits, the best piece is cut to the room that is left. A sequence that stays
short is cut back to a power of two, at which sequences need no padding.

Every task packs its own rows with a bounded number of waiting pieces, so no
text is moved between executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from claimloom.llm.store import by_bytes
from claimloom.llm.words import word_encoder

PART_BYTES = 4 << 20  # of text encoded at a time, exceeded only by a single longer text
WAITING_PIECES = 2048
WAITING_TOKENS = 1 << 21
_LOCAL_BITS = 40  # a sequence's number within its task


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2047

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("every limit has to be 1 at least")


@dataclass
class Piece:
    """A stretch of one example; its first ``free`` tokens bear no loss."""

    doc: int
    start: int
    free: int
    ids: np.ndarray

    def loss(self) -> int:
        return loss_of(len(self.ids), self.free)

    def cut(self, at: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc, self.start, min(self.free, at), self.ids[:at])
        return head, Piece(self.doc, self.start + at, max(0, self.free - at), self.ids[at:])


def loss_of(length: int, free: int) -> int:
    """Loss-bearing tokens: neither prompt nor the first of a piece, which nothing precedes."""
    return max(0, length - max(1, free))


def longest(room: int, loss_room: int, free: int) -> int:
    """The longest piece with ``free`` leading tokens that a room takes."""
    return min(room, max(1, free) + loss_room)


@dataclass
class Packer:
    """Waiting pieces and the sequences that they fill."""

    limits: Limits
    waiting: list[Piece] = field(default_factory=list)
    tokens: int = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Full sequences of a long example go at once; the rest waits."""
        limit = self.limits
        while len(piece.ids) > (most := longest(limit.tokens, limit.loss_tokens, piece.free)):
            head, piece = piece.cut(most)
            if most == limit.tokens:
                yield [head]
            else:
                self._wait(head)
        if len(piece.ids) == limit.tokens:
            yield [piece]
        else:
            self._wait(piece)
        if len(self.waiting) > WAITING_PIECES or self.tokens > WAITING_TOKENS:
            yield from self.fill(WAITING_PIECES // 2, WAITING_TOKENS // 2)

    def _wait(self, piece: Piece) -> None:
        # a copy, so that the ids of a whole batch aren't held for one piece
        self.waiting.append(Piece(piece.doc, piece.start, piece.free, piece.ids.copy()))
        self.tokens += len(piece.ids)

    def fill(self, pieces: int = 0, tokens: int = 0) -> Iterator[list[Piece]]:
        """Sequences until no more than so many pieces and tokens wait."""
        while len(self.waiting) > pieces or self.tokens > tokens:
            yield from self._sequences(pieces, tokens)

    def _sequences(self, pieces: int, tokens: int) -> Iterator[list[Piece]]:
        limit = self.limits
        caps = np.array([limit.tokens, limit.segments, limit.loss_tokens], dtype=np.int64)
        pool, self.waiting = self.waiting, []
        sizes = np.array([len(p.ids) for p in pool], dtype=np.int64)
        needs = np.stack([sizes, np.ones_like(sizes), np.array([p.loss() for p in pool], dtype=np.int64)], axis=1)
        shares = needs / caps
        weights = shares.mean(axis=0)  # a scarce kind of room counts more
        free = np.array([p.free for p in pool], dtype=np.int64)
        there = np.ones(len(pool), dtype=bool)
        left = len(pool)
        while left and (left > pieces or self.tokens > tokens):
            room, filled = caps.copy(), []
            while left and room[0] and room[1]:
                value = shares @ (weights * room / caps)
                fits = there & (needs <= room).all(axis=1)
                if fits.any():
                    best = int(np.argmax(np.where(fits, value, -1.0)))
                    filled.append(pool[best])
                    room -= needs[best]
                    there[best] = False
                    left -= 1
                    continue
                # without room for loss only prompts can be cut, else single tokens would be cut off
                open_to = there & ((free > 1) | (room[2] > 0))
                if not open_to.any():
                    break
                best = int(np.argmax(np.where(open_to, value, -1.0)))
                head, rest = pool[best].cut(longest(int(room[0]), int(room[2]), int(free[best])))
                filled.append(head)
                room -= np.array([len(head.ids), 1, head.loss()])
                pool[best], free[best] = rest, rest.free
                needs[best] = len(rest.ids), 1, rest.loss()
                shares[best] = needs[best] / caps
            size = int(caps[0] - room[0])
            if size < limit.tokens and size & (size - 1):
                for rest in shorten(filled, size - (1 << size.bit_length() - 1)):
                    self.waiting.append(rest)
            self.tokens -= sum(len(p.ids) for p in filled)
            yield filled
        self.waiting += [p for k, p in enumerate(pool) if there[k]]


def shorten(pieces: list[Piece], surplus: int) -> list[Piece]:
    """Takes the last ``surplus`` tokens off a sequence and returns them as pieces."""
    off = []
    while surplus:
        last = pieces.pop()
        if len(last.ids) <= surplus:
            off.append(last)
        else:
            head, rest = last.cut(len(last.ids) - surplus)
            pieces.append(head)
            off.append(rest)
        surplus -= len(off[-1].ids)
    return off


def packed(docs: DataFrame, vocabulary: str, end_id: int, limits: Limits = Limits(), prompt: str | None = None) -> DataFrame:
    """The pieces of all sequences: doc_id, start, length, ids, doc_tokens, loss_tokens, sequence_id, offset.

    An example is the ids of its ``prompt`` column, where one is named, those of
    its text, and the end id. ``ids`` are little-endian uint32, ``start`` counts
    the example's ids before the piece, ``offset`` those of the sequence, and
    pieces stand without gaps from offset 0. The length of a sequence is
    ``limits.tokens`` or a power of two.

    A missing or empty text has the end id alone. Rows that repeat an id, or have
    none, are examples of their own. An example longer than a sequence is cut
    into full ones and a rest. Other columns are ignored. An empty table gives no
    rows. Sequence numbers are unique, and the same for the same partitions.
    """
    columns = ["doc_id", "text", *([prompt] if prompt else [])]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        packer = Packer(limits)
        number = TaskContext.get().partitionId() << _LOCAL_BITS
        names: dict[int, tuple] = {}  # of waiting examples: id, tokens, tokens not packed yet
        count = 0

        def rows(sequences: Iterator[list[Piece]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for group in _some(sequences, 64):
                made: dict[str, list] = {c: [] for c in _COLUMNS}
                for pieces in group:
                    offset = 0
                    for piece in pieces:
                        doc_id, tokens, left = names[piece.doc]
                        n = len(piece.ids)
                        values = (doc_id, piece.start, n, piece.ids.astype("<u4").tobytes(), tokens, piece.loss(), number, offset)
                        for column, value in zip(made.values(), values):
                            column.append(value)
                        offset += n
                        if left == n:
                            del names[piece.doc]
                        else:
                            names[piece.doc] = (doc_id, tokens, left - n)
                    number += 1
                types = [id_type, *_TYPES]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made.values(), types)], _COLUMNS)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in by_bytes(batch, [1, *([2] if prompt else [])], PART_BYTES):
                ids, sizes = encoder.encode(part.column(1))
                before, ahead = encoder.encode(part.column(2)) if prompt else (ids[:0], np.zeros_like(sizes))
                ends, heads = np.cumsum(sizes), np.cumsum(ahead)
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    free = int(ahead[k])
                    own = np.concatenate(
                        (before[heads[k] - free : heads[k]], ids[ends[k] - sizes[k] : ends[k]], np.array([end_id], dtype=np.uint32))
                    )
                    names[count] = (doc_id, len(own), len(own))
                    yield from rows(packer.add(Piece(count, 0, free, own)), id_type)
                    count += 1
        if id_type is not None:
            yield from rows(packer.fill(), id_type)

    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(*columns).mapInArrow(run, schema)


_COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _some(sequences: Iterator[list[Piece]], most: int) -> Iterator[list[list[Piece]]]:
    group: list[list[Piece]] = []
    for pieces in sequences:
        group.append(pieces)
        if len(group) == most:
            yield group
            group = []
    if group:
        yield group
