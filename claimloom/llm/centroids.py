"""Centroid clustering of integer vectors with Orchard search for the nearest centroid.

Every centroid keeps the others sorted by their distance from it. A search walks
the list of its current centroid, jumps to the list of a closer one as soon as it
meets it, never measures a centroid twice, and stops at the first entry that lies
strictly beyond twice the current distance, which by the triangle inequality no
nearest centroid can. All arithmetic is on whole numbers, so the result is exact.

The searches of a batch run side by side. Tasks send one sum per centroid and
batch; only the centroids (their number times the dimensions) meet the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.store import stored

BATCH = 4096  # vectors searched side by side
# within it squared distances of up to 2**9 components fit into 64 bits
LARGEST = 1 << 26


@dataclass(frozen=True)
class Orchard:
    """Centroids with each one's sorted list of the others, and the squared distances along it."""

    centroids: np.ndarray
    lists: np.ndarray
    gaps: np.ndarray

    @staticmethod
    def plant(centroids: np.ndarray) -> Orchard:
        apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        k = len(centroids)
        order = np.argsort(apart, axis=1, kind="stable")
        # a centroid is no entry of its own list, also where another one equals it
        lists = order[order != np.arange(k)[:, None]].reshape(k, max(0, k - 1))
        return Orchard(centroids, lists, np.take_along_axis(apart, lists, axis=1))

    def search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each vector (of equally near ones the smallest number), squared distance, measurements."""
        n, k = len(vectors), len(self.centroids)
        now = np.zeros(n, dtype=np.int64)
        best = _squared(vectors, self.centroids[now])
        place = np.zeros(n, dtype=np.int64)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        active = np.arange(n)
        measured = n
        while active.size and k > 1:
            inside = place[active] < k - 1
            active = active[inside]
            here, at = now[active], place[active]
            # squared: beyond twice the distance is beyond four times its square
            near = self.gaps[here, at] <= 4 * best[active]
            active = active[near]
            other = self.lists[here[near], at[near]]
            place[active] += 1
            fresh = ~seen[active, other]
            rows, other = active[fresh], other[fresh]
            seen[rows, other] = True
            measured += len(rows)
            found = _squared(vectors[rows], self.centroids[other])
            closer = (found < best[rows]) | ((found == best[rows]) & (other < now[rows]))
            jump = rows[closer]
            now[jump], best[jump], place[jump] = other[closer], found[closer], 0
        return now, best, measured


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def whole_vectors(column: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the lists of a column that holds lists of ``dimensions`` numbers alone."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    whole = np.floor(scale * flat)
    if whole.size and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST}: its squared distances don't fit into 64 bits")
    return whole.astype(np.int64)


def usable(vectors: DataFrame, name: str, dimensions: int) -> DataFrame:
    """Rows whose vector has exactly so many components, none missing, NaN or infinite."""
    good = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.where((F.size(name) == dimensions) & good)


def _first_centroids(kept: DataFrame, name: str, seed: int, k: int, dimensions: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id, in that order; at most k rows reach the driver."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(mark.alias("mark"), name).orderBy("mark", name).limit(k).collect()
    floors = [[math.floor(scale * float(x)) for x in row[1]] for row in rows]
    if any(abs(x) > LARGEST for row in floors for x in row):
        raise ValueError(f"a component is beyond {LARGEST}: its squared distances don't fit into 64 bits")
    return np.array(floors, dtype=np.int64).reshape(-1, dimensions)


def _sums(kept: DataFrame, name: str, orchard: Orchard, dimensions: int, scale: int) -> DataFrame:
    """(cluster, n, sums) of every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(orchard.centroids)
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for batch in batches:
            whole = whole_vectors(batch.column(0), dimensions, scale)
            for at in range(0, len(whole), BATCH):
                part = whole[at : at + BATCH]
                nearest = orchard.search(part)[0]
                order = np.argsort(nearest, kind="stable")
                met, first, each = np.unique(nearest[order], return_index=True, return_counts=True)
                counts[met] += each
                sums[met] += np.add.reduceat(part[order], first, axis=0)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there), pa.array(counts[there]), pa.array(sums[there].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    return kept.select(name).mapInArrow(run, "cluster bigint, n bigint, sums array<bigint>")


def moved(kept: DataFrame, name: str, centroids: np.ndarray, dimensions: int, scale: int) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors; one without vectors stays."""
    partial = _sums(kept, name, Orchard.plant(centroids), dimensions, scale)
    total = partial.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dimensions)]
    )
    after = centroids.copy()
    for row in total.collect():  # one row per centroid
        after[row[0]] = [int(s) // row[1] for s in row[2:]]
    return after


def clustered(
    vectors: DataFrame, name: str, k: int, rounds: int, seed: int, dimensions: int = 64, scale: int = 64
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector, stored, and the final centroids.

    Centroids start as the k vectors with the smallest sha256 of ``seed:vec_id``
    (equal ids by their vectors, a missing id as empty text). Vectors of another
    length, or with a missing or infinite component, are left out. With fewer
    than k vectors there are as many centroids as vectors; equal centroids all
    stay, and the smaller number gets the vectors. An empty table gives no rows.
    Components beyond 2**26 after scaling raise an error, because distances would
    not fit. Other columns are ignored.
    """
    kept = usable(vectors.select("vec_id", name), name, dimensions)
    centroids = _first_centroids(kept, name, seed, k, dimensions, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, name, centroids, dimensions, scale)
    orchard = Orchard.plant(centroids)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = whole_vectors(batch.column(1), dimensions, scale)
            for at in range(0, len(whole), BATCH):
                part = whole[at : at + BATCH]
                nearest, squared, _ = orchard.search(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(nearest.astype(np.int32)), pa.array(squared)],
                    ["vec_id", "cluster", "distance"],
                )

    return stored(kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), "clusters"), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256 to the rows of ``clustered``."""
    spark = found.sparkSession
    # one row per centroid
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digests = [(c, n, sum(sums.values()), centroid_digest(centroids[c])) for c, n in sorted(sums.items())]
    known = spark.createDataFrame(digests, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
