"""Small shared pieces: reading tables, stored intermediate frames, fresh column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.session import ensure_checkpoint_dir

# the word of all contracts: a run of characters other than blank and \t\n\v\f\r
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def shards(spark: SparkSession, total: int, each: int) -> int:
    """How many pieces of about ``each`` a total makes, at least one."""
    return max(1, -(-int(total or 0) // each))


def by_bytes(batch: pa.RecordBatch, texts: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with so many bytes of text at most, or a single row."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto
