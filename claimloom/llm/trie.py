"""A burst trie over conversations: every shared beginning is one node.

Turns are known by the hash of role and text, so a conversation is a path of
turn ids. Equal paths are counted as one. A container holds the paths below one
node; a container with too many turns bursts: its node becomes a trie head, and
its paths go to containers by their next turn id. One round bursts several
levels, twice as many as the round before, so a long beginning that many paths
share takes few rounds. The containers that stay are sorted and swept into nodes,
each by one task; heads add up what is below them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.store import stored

CONTAINER_TURNS = 20_000  # a container with more turns bursts, unless it holds a single path
ID_BLOCK = 4096  # conversation ids joined into one row
ROWS = 2048  # rows per batch that a task gives out

_ID = 16  # bytes of a turn id and of a key


def key_of(path: bytes) -> bytes:
    return hashlib.blake2b(path, digest_size=_ID).digest()


def prefix_keys(path: bytes, first: int, last: int) -> list[bytes]:
    """The keys of the beginnings of ``first`` to ``last`` turns."""
    running = hashlib.blake2b(path[: _ID * first], digest_size=_ID)
    keys = [running.digest()]
    for place in range(first, last):
        running.update(path[_ID * place : _ID * (place + 1)])
        keys.append(running.copy().digest())
    return keys


def _rows(made: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, closed early where they grow large."""
    held: list[tuple] = []
    size = 0
    for row in made:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) == ROWS or size > 4 << 20:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _mapped(df: DataFrame, each: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema) -> DataFrame:
    """``each`` takes the rows of a partition in order, and gives rows of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(each(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), schema)

    return df.mapInArrow(run, ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema))


_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}

# --- paths -----------------------------------------------------------------------

_PATH = pa.schema([("conv_id", pa.int64()), ("path_key", pa.binary()), ("path", pa.binary()), ("sizes", pa.binary())])


def kept_turns(conv_id: int, cycle: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % cycle


def paths(conversations: DataFrame, family: int = 5, cycle: int = 9) -> DataFrame:
    """(conv_id, path_key, path, sizes) of every rebuilt conversation.

    ``path`` is its turn ids in a row, ``sizes`` the bytes of its texts as
    little-endian int32. Turns of a family of conversations meet in one task in
    order, the base first, and are read one after the other.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        base.cast("bigint").alias("base"), F.col("conv_id").cast("bigint").alias("conv_id"), "turn", turn_id().alias("id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"),
    )
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "id"]
    together = turns.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "id", "bytes")

    def rebuild(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, begun, head = None, None, []
        own: list[tuple] = []

        def done() -> Iterator[tuple]:
            h = kept_turns(now, cycle)
            whole = (own if now == begun else head)[:h] + own[h:]
            path = b"".join(t for t, _ in whole)
            yield now, key_of(path), path, np.array([s for _, s in whole], dtype="<i4").tobytes()

        for base_id, conv_id, turn, size in rows:
            if now is not None and conv_id != now:
                if now == begun:
                    head = own[: cycle - 1]
                yield from done()
                own = []
            if base_id != begun:
                begun, head = base_id, []
            now = conv_id
            own.append((turn, size))
        if now is not None:
            yield from done()

    return _mapped(together, rebuild, _PATH)


def turn_id() -> Column:
    """Hash of role and text, a missing one as empty; the length of the role keeps them apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


_BLOCK = pa.schema([("path_key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_GROUP = pa.schema([("path_key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])


def equal_paths(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, n, ends_sha256, path, sizes) of every distinct path; ``conv_id`` is the smallest of its n members.

    Members are spread by path and id, so the members of one path may lie in any
    number of tasks; each joins its ids into blocks, and one task hashes the
    blocks of a path in order, without holding them.
    """

    def joined(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, ids = None, []
        for key, conv_id in rows:
            if ids and (key != now or len(ids) == ID_BLOCK):
                yield now, ids[0], len(ids), ",".join(map(str, ids)).encode()
                ids = []
            now = key
            ids.append(conv_id)
        if ids:
            yield now, ids[0], len(ids), ",".join(map(str, ids)).encode()

    def hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, first, n, running = None, None, 0, None
        for key, conv_id, size, ids in rows:
            if key != now:
                if now is not None:
                    yield now, first, n, running.hexdigest()
                now, first, n, running = key, conv_id, 0, hashlib.sha256()
            else:
                running.update(b",")
            n += size
            running.update(ids)
        if now is not None:
            yield now, first, n, running.hexdigest()

    members = rebuilt.select("path_key", "conv_id").repartitionByRange("path_key", "conv_id").sortWithinPartitions("path_key", "conv_id")
    blocks = _mapped(members, joined, _BLOCK).repartition("path_key").sortWithinPartitions("path_key", "conv_id")
    groups = _mapped(blocks, hashed, _GROUP).select("conv_id", "n", "ends_sha256")
    return groups.join(rebuilt.select("conv_id", "path", "sizes"), "conv_id")


# --- bursting --------------------------------------------------------------------

_NEAR = pa.schema([
    ("conv_id", pa.int64()), ("n", pa.int64()), ("turns", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()),
    ("parent", pa.binary()), ("last", pa.int64()),
])


def burst(distinct: DataFrame, most: int = CONTAINER_TURNS) -> tuple[DataFrame, DataFrame]:
    """Where each path leaves the heads, and the heads.

    The first frame has (conv_id, depth): the depth of the container's node, or
    none for a path that ends at a head. The second has (key, parent, depth,
    last, n_convs, conv_id).
    """
    spark = distinct.sparkSession
    turns = (F.octet_length("path") / _ID).cast("bigint")
    whole = distinct.agg(F.sum(turns + 1), F.count("*"), F.sum("n"), F.min("conv_id")).first()
    heads = spark.createDataFrame([], "key binary, parent binary, depth bigint, last bigint, n_convs bigint, conv_id bigint")
    if whole[1] <= 1 or whole[0] <= most:
        return distinct.select("conv_id", F.lit(0).cast("bigint").alias("depth")), heads
    heads = spark.createDataFrame([(key_of(b""), None, 0, 0, whole[2], whole[3])], heads.schema)
    active = distinct.select("conv_id", "n", "path", "sizes")
    left = active.where(F.octet_length("path") == 0).select("conv_id", F.lit(None).cast("bigint").alias("depth"))
    active = active.where(F.octet_length("path") > 0)
    at, step = 0, 1
    while True:
        near = stored(_mapped(active, _beginnings(at, at + step), _NEAR), "beginnings")
        sums = near.groupBy("key", "parent", "depth", "last").agg(
            F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count("*").alias("paths"),
            F.sum(F.col("turns") - F.col("depth") + 1).alias("held"),
        )
        large = stored(sums.where((F.col("held") > most) & (F.col("paths") > 1)).select(heads.columns), "heads")
        met = near.join(large.select("key", F.lit(True).alias("is_head")), "key", "left")
        state = stored(
            met.groupBy("conv_id", "turns").agg(F.min(F.when(F.col("is_head").isNull(), F.col("depth"))).alias("depth")), "bursts"
        )
        settled = F.col("depth").isNotNull() | (F.col("turns") <= at + step)
        left = left.unionByName(state.where(settled).select("conv_id", "depth"))
        heads = heads.unionByName(large)
        rest = state.where(~settled).select("conv_id")
        if rest.isEmpty():
            return left, heads
        active = stored(active.join(rest, "conv_id", "left_semi"), "paths")
        at, step = at + step, 2 * step


def _beginnings(at: int, upto: int) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, n, path, sizes in rows:
            turns = len(path) // _ID
            lengths = np.frombuffer(sizes, dtype="<i4")
            keys = prefix_keys(path, at, min(upto, turns))
            for place in range(at + 1, min(upto, turns) + 1):
                yield conv_id, n, turns, place, keys[place - at], keys[place - at - 1], int(lengths[place - 1])

    return run


# --- sweeping --------------------------------------------------------------------


@dataclass
class Node:
    """A node on the way to the path being read, and its finished children."""

    depth: int
    last: int
    n_convs: int = 0
    conv_id: int | None = None
    n_leaves: int = 0
    saved: int = 0
    ends: str = hashlib.sha256(b"").hexdigest()
    children: list[tuple] = field(default_factory=list)

    def meet(self, conv_id: int, n: int) -> None:
        self.n_convs += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)

    def row(self) -> tuple:
        """conv_id, depth, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; call once, when nothing more comes."""
        self.saved += (self.n_convs - 1) * self.last
        self.n_leaves = self.n_leaves or 1
        return self.conv_id, self.depth, self.n_convs, len(self.children), self.n_leaves, self.saved, self.ends


_NODE = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("parent_conv_id", pa.int64()), ("parent", pa.binary()),
    ("prefix", pa.binary()),
])


def shared(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with."""
    low, high = 0, min(len(a), len(b)) // _ID
    while low < high:
        middle = (low + high + 1) // 2
        if a[_ID * low : _ID * middle] == b[_ID * low : _ID * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def swept(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of containers: rows (container, path, depth, conv_id, n, ends, sizes) sorted by container and path."""
    now, before = None, b""
    stack: list[Node] = []

    def close(upto: int) -> Iterator[tuple]:
        """Finishes the nodes beyond depth ``upto``; a finished node names its children's parent."""
        while stack and stack[-1].depth > upto:
            node = stack.pop()
            own = node.row()
            for child in node.children:
                yield *child, node.conv_id, None, None
            if stack:
                above = stack[-1]
                above.meet(node.conv_id, node.n_convs)
                above.n_leaves += node.n_leaves
                above.saved += node.saved
                above.children.append(own)
            else:
                prefix = before[: _ID * node.depth]
                yield *own, None, key_of(prefix[:-_ID]) if node.depth else None, prefix

    for container, path, depth, conv_id, n, ends, sizes in rows:
        lengths = np.frombuffer(sizes, dtype="<i4")
        if container != now:
            yield from close(-1)
            now = container
            stack.append(Node(depth, int(lengths[depth - 1]) if depth else 0))
        else:
            yield from close(shared(before, path))
        for place in range(stack[-1].depth + 1, len(path) // _ID + 1):
            stack.append(Node(place, int(lengths[place - 1])))
        stack[-1].meet(conv_id, n)
        stack[-1].ends = ends
        before = path
    yield from close(-1)


_CONTAINED = pa.schema([
    ("container", pa.binary()), ("path", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()),
    ("ends_sha256", pa.string()), ("sizes", pa.binary()),
])


def _contained(rows: Iterator[tuple]) -> Iterator[tuple]:
    for path, depth, conv_id, n, ends, sizes in rows:
        yield key_of(path[: _ID * depth]), path, depth, conv_id, n, ends, sizes


_BELOW = pa.schema([("key", pa.binary()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def _below(rows: Iterator[tuple]) -> Iterator[tuple]:
    """What a node gives to itself and the nodes above it, of those that are heads."""
    for prefix, upto, n_leaves, saved in rows:
        for key in prefix_keys(prefix, 0, upto):
            yield key, n_leaves, saved


def nodes(conversations: DataFrame, family: int = 5, cycle: int = 9, most: int = CONTAINER_TURNS) -> DataFrame:
    """Every node of the trie of rebuilt conversations.

    Conversation c begins with the first h turns of conversation c - c % family,
    where h is crc32(decimal c) % cycle, and goes on with its own turns after its
    first h. Turns stand in the order of their number, a missing one first; turns
    of equal number in the order of their hashes. A missing role or text is
    empty. Rows without a conv_id belong to no conversation and are left out; a
    table without conversations has no nodes. Other columns are ignored.

    conv_id: smallest member; depth; parent_conv_id: that of the parent, none for
    the root; n_convs: members; n_children; n_leaves and saved_tokens: over the
    subtree; ends_sha256: of the members that end at the node.
    """
    rebuilt = stored(paths(conversations.select("conv_id", "turn", "role", "text"), family, cycle), "rebuilt")
    distinct = stored(equal_paths(rebuilt), "paths")
    left, heads = burst(distinct, most)
    left, heads = stored(left, "left"), stored(heads, "heads")
    placed = distinct.join(left, "conv_id")
    inside = _mapped(
        placed.where("depth IS NOT NULL").select("path", "depth", "conv_id", "n", "ends_sha256", "sizes"), _contained, _CONTAINED
    )
    ordered = inside.repartition("container").sortWithinPartitions("container", "path")
    found = stored(_mapped(ordered, swept, _NODE), "nodes")

    tops = found.where("parent IS NOT NULL")
    beginning = F.expr(f"substring(path, 1, cast({_ID} * depth as int))")
    own = heads.join(distinct.select("conv_id", "path"), "conv_id").select(
        beginning.alias("prefix"), "depth", F.lit(0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("last")).alias("saved_tokens")
    )
    given = tops.select("prefix", (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens").unionByName(own)
    sums = _mapped(given, _below, _BELOW).groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    children = tops.select("parent").unionByName(heads.where("parent IS NOT NULL").select("parent")).groupBy("parent").agg(
        F.count("*").alias("n_children")
    )
    ending = _mapped(placed.where("depth IS NULL").select("path", "ends_sha256"), _ending, _ENDING)
    above = heads.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    upper = (
        heads.join(sums, "key").join(children.withColumnRenamed("parent", "key"), "key").join(ending, "key", "left").join(above, "parent", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return (
        found.where("parent IS NULL").select(columns)
        .unionByName(tops.drop("parent_conv_id").join(above, "parent", "left").select(columns))
        .unionByName(upper.select(columns))
    )


_ENDING = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _ending(rows: Iterator[tuple]) -> Iterator[tuple]:
    for path, ends in rows:
        yield key_of(path), ends
