"""Token ids in binary files: frequency-ranked, in a byte-aligned variable-length code.

A file is a row of blocks. Each block has a fixed header, the number of ids per
document, the control bytes (two bits per id: its length in bytes less one) and
the data bytes. Decoding looks the lengths of four ids up by control byte and
gathers all ids of a block at once.

Documents are spread by ranges of their ids, and the shards are numbered in
that order, so the files hold the documents in ascending order.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.memo import Remembered, laid_out
from claimloom.llm.store import by_bytes, shared_folder, shards, stored
from claimloom.llm.worker import held

BLOCK_IDS = 1 << 18  # ids per block, exceeded only by a single longer document
FILE_BLOCKS = 16  # blocks per file
SHARD_BYTES = 16 << 20
PART_BYTES = 8 << 20  # of text encoded at a time, exceeded only by a single longer text

MAGIC = b"TIDS"
# magic, payload bytes, first id's position, documents, ids
_HEADER = "<4sQQQQ"

# texts that are encoded whole: with the cutting mark, the marks of special tokens, or line feeds that may be one token
_APART = r"\x00|<\||\n\n"


# --- tokenizing ----------------------------------------------------------------


class Encoder:
    """Ids of texts; equal pieces of text are encoded once and remembered from task to task.

    The vocabulary's own pre-tokenizer begins a new token before a blank and
    around a line feed that stand alone between other characters, so the ids of
    a text are the ids of the pieces between them in a row. Arrow cuts the texts, and
    the pieces into letters and marks; only distinct parts meet Python. A text with other white space, or
    with the marks of special tokens, is encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()
        self.parts = Remembered(self._learn)

    def _ids(self, token: str) -> list[int]:
        """Ids of one pre-token, which is plain text."""
        spelled = token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.tokenizer.model.tokenize(spelled)]

    def _learn(self, new: list[str]) -> tuple[list[int], list[int]]:
        """Ids of parts: letters or marks alone are one pre-token, all else goes to the tokenizer; ``_ODD`` where the text counts as a whole."""
        ids: list[int] = []
        sizes: list[int] = []
        one_token, own_ids = _ONE_TOKEN.fullmatch, self._ids
        for part in new:
            before = len(ids)
            if one_token(part):
                ids += own_ids(part)
            elif not part:
                pass
            elif part != "\n" and (not part.strip() or _INNER.search(part) is not None):
                ids.append(_ODD)
            else:
                ids += self.tokenizer.encode(part, add_special_tokens=False).ids
            sizes.append(len(ids) - before)
        return ids, sizes

    def _codes(self, parts: pa.Array) -> np.ndarray:
        coded = parts.dictionary_encode()
        places = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        return self.parts.known(distinct, np.bincount(places, minlength=len(distinct)))[places]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has; a missing text has none."""
        self.parts.make_room()
        whole = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        marked = pc.match_substring_regex(whole, _APART)
        cut = pc.replace_substring(pc.replace_substring(pc.if_else(marked, "", whole), " ", "\0 "), "\n", "\0\n\0")
        pieces = pc.split_pattern(cut, "\0")
        coded = pieces.flatten().dictionary_encode()
        split = pc.extract_regex(coded.dictionary, _SIMPLE)
        first = pc.coalesce(pc.struct_field(split, 0), coded.dictionary)
        marks = pc.fill_null(pc.struct_field(split, 1), "")
        codes = np.stack([self._codes(first), self._codes(marks)], axis=1).ravel()
        piece_ids, piece_edges = laid_out(self.parts.starts, self.parts.ids, codes)
        ids, total = laid_out(piece_edges[::2], piece_ids, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        edges = pieces.offsets.to_numpy()
        ends = total[edges - edges[0]]
        counts = np.diff(ends)
        odd = np.searchsorted(ends, np.flatnonzero(ids == _ODD), side="right") - 1
        apart = np.union1d(odd, np.flatnonzero(marked.to_numpy(zero_copy_only=False)))
        if not apart.size:
            return ids, counts
        parts, at = [], 0
        for k in apart.tolist():
            own = np.array(self.tokenizer.encode(whole[k].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            parts += [ids[at : ends[k]], own]
            at, counts[k] = ends[k + 1], len(own)
        return np.concatenate([*parts, ids[at:]]), counts


_ODD = (1 << 32) - 1
# white space after the first character, or at its place if it is no blank
_INNER = re.compile(r"(?<=.)\s|^[^\S ]", re.DOTALL)
# Latin letters after a blank or none, and then marks that make one pre-token
_SIMPLE = r"^(?P<letters> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?|]*)$"
_ONE_TOKEN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,;:!?|]+")


def byte_alphabet() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest is counted on from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(0x100 + n) for n, b in enumerate(rest)}}


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stored blocks (shard, block, before, doc_ids, counts, ids) in ascending order of doc_id.

    ``ids`` are little-endian uint32, or uint16 where the vocabulary allows it
    (``wide`` says which). ``before`` counts the ids of the shard's earlier blocks. A missing text is
    empty and has the end id alone; a missing doc_id comes first; repeated rows
    stand side by side.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    ranged = docs.select("doc_id", "text").repartitionByRange(shards(docs.sparkSession, total, shard_bytes), F.col("doc_id").asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = _encoder(vocabulary)
        kind = "<u4" if max(encoder.tokenizer.get_vocab_size(), end_id) >= 1 << 16 else "<u2"
        state = {"block": 0, "before": 0}

        def emit(names: list, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(
                [{
                    "shard": shard, "block": state["block"], "before": state["before"], "doc_ids": names,
                    "counts": counts.tolist(), "ids": ids.astype(kind).tobytes(), "wide": kind == "<u4",
                }],
                _BLOCK_SCHEMA,
            )
            state["block"] += 1
            state["before"] += len(ids)
            return out

        for batch in batches:
            for part in by_bytes(batch, [1], PART_BYTES):
                ids, counts = encoder.encode(part.column(1))
                ids, counts, names = np.insert(ids, np.cumsum(counts), end_id), counts + 1, part.column(0).to_pylist()
                ends = np.cumsum(counts)
                at = done = 0
                while at < len(names):
                    upto = max(at + 1, int(np.searchsorted(ends, done + BLOCK_IDS, side="right")))
                    yield emit(names[at:upto], counts[at:upto], ids[done : ends[upto - 1]])
                    at, done = upto, int(ends[upto - 1])

    return stored(
        ordered.mapInArrow(run, "shard int, block int, before bigint, doc_ids array<bigint>, counts array<bigint>, ids binary, wide boolean"),
        "token-blocks",
    )


_BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())), ("ids", pa.binary()), ("wide", pa.bool_()),
])


def _encoder(path: str) -> Encoder:
    return held("pieces", path, lambda: Encoder(path))


# --- the code ------------------------------------------------------------------

_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def pack(values: np.ndarray) -> bytes:
    """Control bytes, then data bytes; four ids to a control byte, the last filled up with zeros."""
    v = np.zeros(-(-len(values) // 4) * 4, dtype="<u4")
    v[: len(values)] = values
    sizes = 1 + (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    codes = (sizes - 1).reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) < sizes[:, None]
    return control.astype(np.uint8).tobytes() + v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(data: bytes | memoryview, count: int) -> np.ndarray:
    groups = -(-count // 4)
    raw = np.frombuffer(data, dtype=np.uint8)
    sizes = _LENGTHS[raw[:groups]].ravel()
    used = np.arange(4, dtype=np.uint8) < sizes[:, None]
    out = np.zeros((4 * groups, 4), dtype=np.uint8)
    out[used] = raw[groups : groups + int(sizes.sum(dtype=np.int64))]
    return out.view("<u4").ravel()[:count]


# --- files ---------------------------------------------------------------------


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """``path``/ids has the files, ``path``/ranks the id of every rank, most frequent first."""
    spark = docs.sparkSession
    blocks = token_blocks(docs, vocabulary, end_id)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids, wide in zip(batch.column(0), batch.column(1)):
                counts = np.bincount(np.frombuffer(ids.as_py(), dtype="<u4" if wide.as_py() else "<u2"))
                if len(counts) > len(seen):
                    seen = np.pad(seen, (0, len(counts) - len(seen)))
                seen[: len(counts)] += counts
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], ["id", "n"])

    counted = blocks.select("ids", "wide").mapInArrow(tally, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # as many rows as the vocabulary has at most, whatever the corpus
    ranked = [r[0] for r in counted.orderBy(F.desc("n"), "id").select("id").collect()]
    spark.createDataFrame(list(enumerate(ranked)), "rank bigint, id bigint").write.parquet(f"{path}/ranks")
    # one row per shard, hence bounded by the number of partitions
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("offset"))
    shared = spark.sparkContext.broadcast(np.array(ranked, dtype=np.int64))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value
        rank_of = np.zeros(int(ids_of.max()) + 1 if len(ids_of) else 0, dtype=np.uint32)
        rank_of[ids_of] = np.arange(len(ids_of), dtype=np.uint32)
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row = one.to_pylist()[0]
                ids = np.frombuffer(row["ids"], dtype="<u4" if row["wide"] else "<u2")
                names = [_NO_ID if d is None else d for d in row["doc_ids"]]
                body = np.array(names, dtype="<i8").tobytes() + np.array(row["counts"], dtype="<u4").tobytes() + pack(rank_of[ids])
                head = struct.pack(_HEADER, MAGIC, len(body), row["before"] + row["offset"], len(row["doc_ids"]), len(ids))
                yield pa.RecordBatch.from_arrays(
                    [one.column("shard"), one.column("block"), pa.array([head + body], pa.binary())], ["shard", "block", "value"]
                )

    coded = blocks.join(F.broadcast(offsets), "shard").select("shard", "block", "before", "offset", "doc_ids", "counts", "ids", "wide").mapInArrow(
        code, "shard int, block int, value binary"
    )
    # the text writer copies the bytes of a row and adds a line feed; blocks know their length and skip it
    plain = coded.select(F.col("value").cast("string").alias("value"))
    plain.write.option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/ids")


_NO_ID = -(1 << 63)


def parse_blocks(data: memoryview) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, doc_ids, counts, ranks) of every block of a file."""
    at = 0
    while at < len(data):
        magic, size, start, docs, ids = struct.unpack_from(_HEADER, data, at)
        if magic != MAGIC:
            raise ValueError(f"no block at {at}")
        at += struct.calcsize(_HEADER)
        names = np.frombuffer(data, "<i8", docs, at)
        counts = np.frombuffer(data, "<u4", docs, at + 8 * docs)
        yield start, names, counts, unpack(data[at + 12 * docs : at + size], ids)
        at += size + 1


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; ids are little-endian uint32."""
    ranks = table_of_ranks(spark, path)
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = shared.value
        for batch in batches:
            for content in batch.column(0):
                for start, names, counts, coded in parse_blocks(memoryview(content.as_buffer())):
                    ids = id_of[coded].astype("<u4")
                    ends = np.cumsum(counts, dtype=np.int64)
                    raw = memoryview(ids.tobytes())
                    values = [bytes(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if d == _NO_ID else d for d in names.tolist()], pa.int64()),
                            pa.array(start + ends - counts, pa.int64()),
                            pa.array(values, pa.binary()),
                        ],
                        ["doc_id", "start", "ids"],
                    )

    files = spark.read.format("binaryFile").load(f"{path}/ids").select("content")
    return files.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def table_of_ranks(spark: SparkSession, path: str) -> np.ndarray:
    """The id of every rank; bounded by the vocabulary."""
    rows = spark.read.schema("rank bigint, id bigint").parquet(f"{path}/ranks").collect()
    out = np.zeros(len(rows), dtype=np.uint32)
    for rank, ident in rows:
        out[rank] = ident
    return out


def encoded(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes the files of ``docs`` to the shared folder and reads them back."""
    path = shared_folder(spark, "token-files")
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(spark, path)
