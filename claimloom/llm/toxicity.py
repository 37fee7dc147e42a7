"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and word beginnings that labelled rows show to go
with one label. The examples are kept in an inverted index cut into blocks, with
the largest weight of each term in each block; a text visits blocks in the order
of their upper bounds and stops when no block can improve its neighbours, so the
neighbours are exact. They vote by similarity, and a logistic curve fitted on the
examples, each without itself, turns votes into probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.store import crc32_of, fresh, stored
from claimloom.operators.distributed import top_per_group

EXAMPLES = 4000  # labelled examples kept per label at most: the bound of the fitted model
TERMS = 20_000  # terms kept at most, by strength
STRENGTH = 15.0  # least log-likelihood ratio of a term
LIFT = 12.0  # how many times more often a term must occur under one label than under the other
LEAST_ROWS = 5  # labelled rows a term must occur in
FAMILIES = 8  # kinds of toxic rows, told apart by a shingle, that a toxic term must occur in; at most a quarter of all kinds
NEIGHBOURS = 9
BLOCK = 64
DOUBT = 0.1  # similarity that an imagined neighbour of the base rate adds to every vote
BEGINNINGS = (4, 5, 6, 7)
MEMO = 500_000

_WORD = re.compile(r"\w+")


def terms_of(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings, which stand for its family."""
    return (word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n])


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class ToxicityModel:
    """Vocabulary, inverted index of the examples, and the calibration."""

    terms: dict[str, int]
    idf: np.ndarray
    starts: np.ndarray  # postings of term t: starts[t] to starts[t + 1]
    example: np.ndarray
    weight: np.ndarray
    block_starts: np.ndarray  # block entries of term t
    block: np.ndarray
    block_max: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    base: float
    slope: float
    offset: float


def labelled_ids(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, y), one row per labelled id; of repeated labels the largest counts."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def family_bit(words: list[str]) -> int:
    """One of 64 bits, by the smallest crc32 of three words in a row.

    Near copies mostly share it, so a group of copies sets few bits, and words
    that only such a group holds don't pass for signs of a label.
    """
    least = min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))), default=0)
    bit = (least * 2654435761 & 0xFFFFFFFF) >> 26
    return (1 << bit) - (1 << 64 if bit == 63 else 0)


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean, families): labelled rows of each kind that hold the term, added up in tasks first.

    The empty term, which no text holds, stands for the families of all toxic rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        bits: dict[str, int] = {}

        def emit() -> pa.RecordBatch:
            names = list(sums[1].keys() | sums[0].keys())
            out = [pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in (sums[1], sums[0])]]
            out.append(pa.array([bits.get(n, 0) for n in names], pa.int64()))
            for held in (*sums, bits):
                held.clear()
            return pa.RecordBatch.from_arrays(out, ["term", "toxic", "clean", "families"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                found = {t for w in set(words) for t in terms_of(w)}
                toxic = y.as_py() > 0
                sums[toxic].update(found)
                if toxic:
                    bit = family_bit(words)
                    sums[1][_ALL] += 0
                    bits[_ALL] = bits.get(_ALL, 0) | bit
                    for term in found:
                        bits[term] = bits.get(term, 0) | bit
                if len(sums[0]) + len(sums[1]) > MEMO:
                    yield emit()
        yield emit()

    counted = rows.select("text", "y").mapInArrow(run, "term string, toxic bigint, clean bigint, families bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("families").alias("families"))


_ALL = ""


def chosen_terms(counts: DataFrame, toxic: int, clean: int) -> list[tuple[str, int]]:
    """(term, rows) of the strongest terms, at most ``TERMS`` of them."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n1, n0 = float(toxic), float(clean)

    def part(seen: Column, size: float, whole: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (whole * F.lit(size / (n1 + n0))))).otherwise(0.0)

    held, rest = a + b, F.lit(n1 + n0) - a - b
    strength = 2 * (part(a, n1, held) + part(b, n0, held) + part(F.lit(n1) - a, n1, rest) + part(F.lit(n0) - b, n0, rest))
    lift = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    strong = (held >= LEAST_ROWS) & ((lift >= LIFT) | (lift <= 1 / LIFT)) & (strength >= STRENGTH)
    columns = ["term", held.cast("long").alias("rows"), strength.alias("strength"), F.bit_count("families").alias("families")]
    found = stored(counts.where(strong | (F.col("term") == _ALL)).select(*columns, (lift >= LIFT).alias("is_toxic")), "terms")
    kinds = found.where(F.col("term") == _ALL).select("families").first()
    least = max(1, min(FAMILIES, (kinds[0] if kinds else 0) // 4))
    telling = (F.col("term") != _ALL) & (~F.col("is_toxic") | (F.col("families") >= least))
    return [(r.term, r.rows) for r in found.where(telling).orderBy(F.desc("strength"), "term").limit(TERMS).collect()]


class _Vectors(dict):
    """word -> numbers of its terms in the vocabulary."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        found = tuple([self.terms[t] for t in terms_of(word) if t in self.terms])
        self[word] = found
        return found


def vector(text: str | None, known: _Vectors, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and weights of unit length: (1 + log tf) * idf. Both empty without a known term."""
    hits = [t for w in words_of(text) for t in known[w]]
    if not hits:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    numbers, tf = np.unique(np.array(hits, dtype=np.int64), return_counts=True)
    weight = (1 + np.log(tf)) * idf[numbers]
    return numbers, weight / np.sqrt((weight * weight).sum())


def nearest(
    model: ToxicityModel, numbers: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1
) -> tuple[np.ndarray, np.ndarray]:
    """Examples and cosines of the ``k`` nearest with a cosine above 0, nearest first, ties to the smaller number."""
    blocks = -(-len(model.labels) // BLOCK)
    bound = np.zeros(blocks)
    for t, w in zip(numbers.tolist(), weights.tolist()):
        part = slice(model.block_starts[t], model.block_starts[t + 1])
        bound[model.block[part]] += w * model.block_max[part]
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    best, score = np.zeros(0, dtype=np.int64), np.zeros(0)
    at, step = 0, 4
    while at < len(order):
        if len(best) >= k and bound[order[at]] < score[k - 1] - 1e-12:
            break
        visit = order[at : at + step]
        at, step = at + step, step * 2
        inside = np.zeros(blocks, dtype=bool)
        inside[visit] = True
        cosine = np.zeros(len(model.labels))
        for t, w in zip(numbers.tolist(), weights.tolist()):
            part = slice(model.starts[t], model.starts[t + 1])
            who = model.example[part]
            here = inside[who // BLOCK]
            cosine[who[here]] += w * model.weight[part][here]
        if without >= 0:
            cosine[without] = 0
        new = np.flatnonzero(cosine > 0)
        best, score = np.concatenate((best, new)), np.concatenate((score, cosine[new]))
        rank = np.lexsort((best, -score))[:k]
        best, score = best[rank], score[rank]
    return best, score


def vote(model: ToxicityModel, found: np.ndarray, cosine: np.ndarray) -> float:
    return float(((cosine * model.labels[found]).sum() + DOUBT * model.base) / (cosine.sum() + DOUBT))


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def calibrated(model: ToxicityModel, value: float) -> float:
    return float(1 / (1 + np.exp(-(model.slope * _logit(value) + model.offset))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve, targets drawn in a little from 0 and 1."""
    sums = [max(float(weight[y == v].sum()), 1e-9) for v in (0, 1)]
    target = np.where(y > 0, (sums[1] + 1) / (sums[1] + 2), 1 / (sums[0] + 2))
    beta = np.array([1.0, 0.0])
    data = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
        gradient = data.T @ (weight * (target - p)) - np.array([1e-3 * (beta[0] - 1), 0])
        hessian = (data * (weight * p * (1 - p))[:, None]).T @ data + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    """Index and calibration from the labelled rows of ``docs``.

    Terms are counted over all of them; the examples are ``EXAMPLES`` rows per
    label, those whose ids have the smallest crc32. Without labelled rows every
    score is 0; with one label alone every score is that label's rate.
    """
    known = labelled_ids(labels, label)
    ids = stored(docs.select("doc_id").join(known, "doc_id"), "labelled-ids")
    sizes = {r.y > 0: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    # the labels grow with the documents, so both are dealt by id, whatever their size
    rows = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id")
    strong = chosen_terms(term_counts(rows), toxic, clean) if toxic and clean else []
    terms = {term: i for i, (term, _) in enumerate(strong)}
    idf = np.log((toxic + clean + 1) / (np.array([n for _, n in strong], dtype=np.float64) + 1)) + 1
    shared = docs.sparkSession.sparkContext.broadcast((terms, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = shared.value
        known = _Vectors(terms)
        for batch in batches:
            made = [vector(t.as_py(), known, idf) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([n.tolist() for n, _ in made], pa.list_(pa.int64())),
                    pa.array([w.tolist() for _, w in made], pa.list_(pa.float64())),
                ],
                ["doc_id", "y", "numbers", "weights"],
            )

    # ids alone are ranked; at most twice ``EXAMPLES`` of them, so they may be broadcast
    picked = top_per_group(ids.distinct(), ["y"], [crc32_of(), F.col("doc_id")], EXAMPLES).drop("_rank")
    examples = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")
    vectors = examples.mapInArrow(run, "doc_id bigint, y int, numbers array<bigint>, weights array<double>")
    found = sorted(vectors.collect(), key=lambda r: (r.y, len(r.numbers) and r.numbers[0], r.doc_id)) if strong else []
    return _indexed(found, terms, idf, toxic, clean)


def _indexed(found: list, terms: dict[str, int], idf: np.ndarray, toxic: int, clean: int) -> ToxicityModel:
    size = len(terms)
    numbers = np.array([t for r in found for t in r.numbers], dtype=np.int64)
    weights = np.array([w for r in found for w in r.weights], dtype=np.float64)
    example = np.repeat(np.arange(len(found)), [len(r.numbers) for r in found]) if found else np.zeros(0, dtype=np.int64)
    order = np.lexsort((example, numbers))
    numbers, weights, example = numbers[order], weights[order], example[order]
    key, first = np.unique(numbers * (len(found) // BLOCK + 1) + example // BLOCK, return_index=True)
    most = np.maximum.reduceat(weights, first) if len(first) else np.zeros(0)
    labels = np.array([float(r.y > 0) for r in found])
    parts = dict(
        terms=terms, idf=idf,
        starts=np.searchsorted(numbers, np.arange(size + 1)), example=example, weight=weights,
        block_starts=np.searchsorted(numbers[first], np.arange(size + 1)), block=(example // BLOCK)[first], block_max=most,
        labels=labels, ids=np.array([r.doc_id for r in found], dtype=np.int64), base=toxic / max(toxic + clean, 1),
    )
    plain = ToxicityModel(**parts, slope=1.0, offset=0.0)
    if not found or labels.min() == labels.max():
        return plain
    votes = np.array(
        [vote(plain, *nearest(plain, np.array(r.numbers, dtype=np.int64), np.array(r.weights), without=i)) for i, r in enumerate(found)]
    )
    # each example stands for as many labelled rows as its label has per example
    share = np.where(labels > 0, toxic / max(labels.sum(), 1), clean / max((1 - labels).sum(), 1))
    slope, offset = _logistic(_logit(votes), labels, share)
    return ToxicityModel(**parts, slope=slope, offset=offset)


def scored(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, evidence: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with a last struct column ``_toxicity``: score, predicted, evidence.

    ``evidence`` lists the nearest examples: id, label, cosine. Missing and empty
    texts, and those without a known term, have no neighbours and get the score
    of the base rate. Repeated rows are scored alike.
    """
    out = fresh(docs, "_toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    at = docs.columns.index(text)
    kind = pa.struct([
        ("score", pa.float64()), ("predicted", pa.int32()),
        ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))),
    ])

    def judge(value: str | None, known: _Vectors, model: ToxicityModel) -> dict:
        found, cosine = nearest(model, *vector(value, known, model.idf))
        score = calibrated(model, vote(model, found, cosine)) if len(found) else model.base
        near = [
            {"doc_id": int(model.ids[e]), "label": int(model.labels[e]), "cosine": float(c)}
            for e, c in zip(found[:evidence].tolist(), cosine[:evidence].tolist())
        ]
        return {"score": score, "predicted": int(score >= threshold), "evidence": near}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(**shared.value)
        known = _Vectors(model.terms)
        for batch in batches:
            found = [judge(t.as_py(), known, model) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, out])

    empty = F.lit(None).cast("struct<score: double, predicted: int, evidence: array<struct<doc_id: bigint, label: int, cosine: double>>>")
    return docs.mapInArrow(run, docs.select("*", empty.alias(out)).schema)
