"""Language identification by error-correcting output codes over hashed character n-grams.

Every language has a codeword; one binary classifier per bit says which side of
the bit a text is on. A text goes to the language whose codeword loses least,
each bit weighted by how well it separates its two sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 13
ORDERS = 3
EXHAUSTIVE = 7  # languages up to which all splits into two sides are bits
AT_ONCE = 64  # documents of one feature matrix
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """(languages, bits) of -1 and 1, rows far apart, no bit constant or repeated.

    Few languages take every split into two sides; more take seeded random bits,
    the best of several draws by least distance.
    """
    if languages < 2:
        return np.zeros((languages, 0), dtype=np.int64)
    if languages <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (languages - 1))
        bits = (splits[None, :] >> np.arange(languages)[:, None] & 1) * 2 - 1
        return bits.astype(np.int64)
    width = 10 * int(np.ceil(np.log2(languages)))
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(20):
        code = rng.integers(0, 2, (languages, width)) * 2 - 1
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(languages, dtype=int) * width
        if apart.min() > least and (np.abs(code.sum(axis=0)) < languages).all():
            best, least = code, apart.min()
    return best


def slots_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of lower-cased texts: (number of text, slot) of each, whole texts."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    sizes = np.array([len(p) for p in points], dtype=np.int64)
    flat = np.concatenate(points) if points else np.zeros(0, dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # code points to the text's end
    h = np.zeros(len(flat), dtype=np.uint32)
    who, what = [], []
    for order in range(ORDERS):
        shifted = flat[order:]
        h = h[: len(shifted)] * np.uint32(0x01000193) + shifted * np.uint32(0x9E3779B1) + np.uint32(order + 1)
        whole = left[: len(h)] > order
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        who.append(owner[: len(h)][whole])
        what.append((mixed >> np.uint32(19)).astype(np.int64)[whole])
    return np.concatenate(who), np.concatenate(what)


def histograms(texts: list[str]) -> np.ndarray:
    """(texts, SLOTS) shares of each slot among a text's n-grams."""
    who, what = slots_of(texts)
    counts = np.bincount(who * SLOTS + what, minlength=len(texts) * SLOTS).reshape(len(texts), SLOTS).astype(np.float64)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, their codewords, and per bit: slot weights, offset, scale and vote weight."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    half: np.ndarray
    votes: np.ndarray


def tallied(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, slot, n): n-grams of every row with a language and a text, summed in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), AT_ONCE):
                some = names[at : at + AT_ONCE]
                who, what = slots_of(texts[at : at + AT_ONCE])
                kinds = sorted(set(some))
                code = np.array([kinds.index(n) for n in some], dtype=np.int64)
                counts = np.bincount(code[who] * SLOTS + what, minlength=len(kinds) * SLOTS).reshape(-1, SLOTS)
                for k, name in enumerate(kinds):
                    sums[name] = sums.get(name, 0) + counts[k]
        for name, counts in sums.items():
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(there), pa.string()), pa.array(there), pa.array(counts[there])], ["lang", "slot", "n"]
            )

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), text)
    return rows.mapInArrow(run, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", smoothing: float = 1e-6) -> LanguageModel:
    """Classifiers from all rows of ``docs`` that have a language.

    The driver gets one count per language and slot, whatever the number of
    documents. Every language weighs the same on its side of a bit.
    """
    counts = tallied(docs, lang, text).toArrow()
    names = counts.column("lang").to_pylist()
    languages = tuple(sorted(set(names)))
    number = {name: k for k, name in enumerate(languages)}
    share = np.zeros((len(languages), SLOTS))
    share[[number[n] for n in names], counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1.0)
    code = codewords(len(languages))
    bits = code.shape[1]
    weights, middle, half = np.zeros((SLOTS, bits)), np.zeros(bits), np.ones(bits)
    for b in range(bits):
        one, other = share[code[:, b] > 0], share[code[:, b] < 0]
        weights[:, b] = np.log((one.mean(axis=0) + smoothing) / (other.mean(axis=0) + smoothing))
        low, high = (one @ weights[:, b]).min(), (other @ weights[:, b]).max()
        middle[b], half[b] = (low + high) / 2, max((low - high) / 2, 1e-6)
    return LanguageModel(languages, code, weights, middle, half, half / half.sum() if bits else half)


def decode(model: LanguageModel, texts: list[str], margin: float = 0.1) -> list[tuple[str, float, bool]]:
    """(language, score, ambiguous) of texts with letters.

    The score is the share of the best language when losses are turned into
    likelihoods; ``ambiguous`` says that the runner-up is within ``margin``.
    """
    if len(model.languages) < 2:
        return [(model.languages[0], 1.0, False) if model.languages else (UNDETERMINED, 0.0, True)] * len(texts)
    margins = np.clip((histograms(texts) @ model.weights - model.middle) / model.half, -3, 3)
    losses = (np.logaddexp(0, -2 * margins[:, None, :] * model.code[None, :, :]) * model.votes).sum(axis=2)
    # eight is the sharpness at which one whole bit of loss decides
    likely = np.exp(-8 * (losses - losses.min(axis=1, keepdims=True)))
    likely /= likely.sum(axis=1, keepdims=True)
    best = losses.argmin(axis=1)
    ranked = np.sort(likely, axis=1)
    close = ranked[:, -1] - ranked[:, -2] < margin
    return [(model.languages[k], float(likely[i, k]), bool(close[i])) for i, k in enumerate(best)]


def identified(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row of ``docs``.

    A text that is missing or has no letter is ``und`` with score 0. Ties go to
    the language that comes first by name. Repeated rows are decided alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LanguageModel(**shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, False)] * len(texts)
            there = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
            for at in range(0, len(there), AT_ONCE):
                some = there[at : at + AT_ONCE]
                for i, found in zip(some, decode(known, [texts[i] for i in some])):
                    out[i] = found
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                [doc_id, "lang_pred", "score", "ambiguous"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, lang_pred string, score double, ambiguous boolean")

