"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps one bit per failed
rule and the measurements. Policies are sets of rules with a version, applied to
the stored bits, and ablations are bit operations over counted masks, so that a
new policy never reads a text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger and the condition, over the measures, under which it is set."""

    bit: int
    name: str
    fails: str


# integer comparisons, so that every engine decides alike
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "short_words", "10 * word_chars < 15 * n_words"),
    Rule(3, "long_words", "word_chars > 25 * n_words"),
    Rule(4, "many_symbols", "4 * n_symbols > n_words"),
    Rule(5, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
)

# a policy is the set of rules that reject
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": tuple(rule.name for rule in RULES)}


def mask_of(policy: str) -> int:
    names = POLICIES[policy]
    return sum(1 << rule.bit for rule in RULES if rule.name in names)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text.

    Words become numbers; ranks of pairs, of pairs of pairs and so on stand for
    windows of 2, 4, 8 words, so windows are compared exactly in memory that is
    proportional to the text.
    """
    n = len(words)
    if n <= window:
        return 0
    known: dict[str, int] = {}
    ranks = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    width = 1
    while width < window:
        step = min(width, window - width)
        top = int(ranks.max()) + 1
        pairs = ranks[: n - width - step + 1] * top + ranks[step : step + n - width - step + 1]
        _, ranks = np.unique(pairs, return_inverse=True)
        width += step
        if int(ranks.max()) + 1 == ranks.size:
            return 0
    repeated = np.bincount(ranks)[ranks] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: repeated.size] += repeated
    edge[window : window + repeated.size] -= repeated
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``; a missing text counts as empty."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    words = _WORD.findall(text)
    symbols = sum(text.count(s) for s in SYMBOLS)
    lines = duplicates = 0
    seen: set[str] = set()
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            if line in seen:
                duplicates += 1
            seen.add(line)
    return (len(words), sum(map(len, words)), symbols, lines, duplicates, repeated_words(words))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the measures of every row of ``docs``; repeated rows are measured alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*found)) if found else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], [doc_id, *MEASURES]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = ", ".join([f"`{doc_id}` {kind}", *[f"{m} bigint" for m in MEASURES]])
    return docs.select(doc_id, text).mapInArrow(run, schema)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, measures and ``fail_bits``: one bit per failed rule, each rule evaluated once.

    A document without words fails ``few_words`` and no other rule. An empty
    table gives an empty ledger.
    """
    bits = None
    for rule in RULES:
        bit = F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured(docs, doc_id, text).withColumn("fail_bits", bits.cast("long"))


def judged(rows: DataFrame, policy: str, out: str = "kept") -> DataFrame:
    """The ledger with the verdict of one policy: no bit of its mask is set."""
    return rows.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects.

    Equal masks are counted first (at most 2^rules rows), so every count is a
    bit operation on a few masks.
    """
    mask = F.lit(mask_of(policy)).cast("long")
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    entries = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
            for r in RULES
            if r.name in POLICIES[policy]
        ]
    )
    each = masks.select("bits", "n", F.inline(entries))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
    )
