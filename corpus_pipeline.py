"""A training-corpus pipeline over ``documents``: each stage is one operator, and its decisions take effect."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import exact_dedup, mixture, pieces, simhash, toxicity
from claimloom.llm.queries import MIX_SEED, MOST, WEIGHTS
from claimloom.llm.store import crc32_of, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; one document in three teaches nothing, as in the query."""
    model = toxicity.fit(docs.where(crc32_of() % 3 != 1), table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model)
    return found.where(F.col(f"{found.columns[-1]}.predicted") == 0).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, over five words and a Jaccard similarity of 0.8 or more."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixture.mixed(docs, WEIGHTS, MOST, MIX_SEED)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, number of ids, score, and whether decoding restores the text; a row for every row of the mix."""
    found = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "score", "restored")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixture", mix_sources),
    ("sentencepiece", encode_pieces),
]

# no SQL says what a trained classifier and a fingerprint decide; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
