"""Repeated bounded ingestion from a landing folder.

New grid files are read with the available-now trigger, and late rows are taken
in whenever they arrive, so no watermark is needed. Posts seen before are settled
either against the stored table (``run_available``), which reads all stored keys
for every batch, or by Spark's state store (``run_stateful``), which touches the
keys of the batch only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from claimloom.operators.merge import insert_if_absent, one_per_key, with_key, without_key
from claimloom.schema import GRID


def landing_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(GRID).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def keyed_append(keys: Sequence[str], order: Sequence[Column], table: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: first row per key of the batch, unless the table has the key.

    Each batch owns the folder of its number and overwrites only that, so a
    batch that is run again after a failure adds nothing twice. Rows with a
    missing key go to the folder ``<table>_refused``, in the same way.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = _stored(spark, table)
        if stored is None:
            fresh = one_per_key(with_key(batch, keys), keys, order, keep="first")
        else:
            earlier = stored.where(F.col("batch") != number).drop("batch")
            fresh = insert_if_absent(earlier, batch, keys, order)
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")
        without_key(batch, keys).write.mode("overwrite").parquet(f"{table}_refused/batch={number}")

    return write


def run_available(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    order: Sequence[Column],
    table: str,
    checkpoint: str,
) -> StreamingQuery:
    """Process everything in the landing folder, then stop."""
    writer = keyed_append(keys, order, table)
    return (
        stream.writeStream.foreachBatch(lambda batch, number: writer(transform(batch), number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_sightings(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key that a batch holds: where its first row ever stands, and whether this batch brought it.

    ``rows`` is a stream with the keys, the columns of ``order`` and ``_file``.
    Of the first batch that has a key, the row that is first in ``order`` counts.
    The state per key is that place alone, not the row: all rows of a batch carry
    the batch's time, which a repeated batch has again, so a key is new exactly
    if its first and its latest time are the same.
    """
    timed = with_key(rows, keys).withColumn("_at", F.current_timestamp())
    sight = timed.groupBy(*keys).agg(F.min(F.struct("_at", *order, "_file")).alias("_first"), F.max("_at").alias("_latest"))
    places = [F.col(f"_first.{c}").alias(c) for c in (*order, "_file")]
    return sight.select(*keys, *places, (F.col("_first._at") == F.col("_latest")).alias("is_new"))


def run_stateful(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    columns: Mapping[str, Column],
    keys: Sequence[str],
    order: Sequence[str],
    table: str,
    checkpoint: str,
    fmt: str = "parquet",
    max_files: int = 1000,
) -> StreamingQuery:
    """Takes in the first row of every key in the landing folder, then stops; run again, it goes on.

    ``columns`` are worked out from a landed row; ``keys`` and ``order`` name some
    of them, and ``order`` tells the rows of a file apart. Keys that were seen are
    kept in the state store for ever, spread over the tasks; set the RocksDB
    provider (``ROCKSDB``) where they exceed the executors' memory. Each batch
    reads its own files once more for the rows whose keys are new, never the
    stored table, and owns the folder of its number, so a batch that is run again
    adds nothing twice. Rows with a missing key are refused (``run_refused``).
    """
    named = [value.alias(name) for name, value in columns.items()]
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(landing)
    sight = first_sightings(stream.select(*named, F.col("_metadata.file_path").alias("_file")), keys, order)

    def write(batch: DataFrame, number: int) -> None:
        # written first, because a batch's state may be worked out only once
        places = f"{table}_places/batch={number}"
        batch.where("is_new").drop("is_new").write.mode("overwrite").parquet(places)
        new = spark.read.schema(batch.drop("is_new").schema).parquet(places)
        files = [r[0] for r in new.select("_file").distinct().collect()]  # ``max_files`` at most
        if not files:
            return
        landed = spark.read.schema(schema).format(fmt).load(files).select(*named, F.col("_metadata.file_path").alias("_file"))
        taken = landed.join(new, [*keys, *order, "_file"], "left_semi").dropDuplicates([*keys])
        taken.drop("_file").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        sight.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_refused(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    columns: Mapping[str, Column],
    keys: Sequence[str],
    table: str,
    checkpoint: str,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Appends the rows that ``run_stateful`` refuses to ``table``, then stops."""
    stream = spark.readStream.schema(schema).format(fmt).load(landing).select(*[value.alias(name) for name, value in columns.items()])
    return (
        without_key(stream, keys).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
