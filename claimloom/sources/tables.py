"""Table reads and writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.distributed import RANGE_ROWS, OrderIndex, OrderKey, global_position, indexed_position, order_index, ordered_slice
from claimloom.schema import BATCH_SIZES


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = (),
    where: Column | None = None,
    order: Sequence[Column] = (),
    limit: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Read with predicate, projection, order and limit; the first two reach the scan."""
    df = spark.read.format(fmt).load(path)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    if order:
        df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def write_version(df: DataFrame, root: str, name: str, version: str, max_rows: int = 5_000_000) -> str:
    """Write a table into a version folder of its own; earlier versions stay readable.

    A retried job overwrites only its own folder. The job ledger says which
    version readers take.
    """
    path = f"{root}/{name}/version={version}"
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(path)
    return path


def read_version(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/version={version}")


def append_by_job(df: DataFrame, path: str, job: str = "import_job_id") -> None:
    """Append-only write: a job owns its partition, so writing it again repeats nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(job).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON with its keys in alphabetical order."""
    report.select(*sorted(report.columns)).coalesce(1).write.mode("overwrite").json(path)


def batch_count(counts: DataFrame, sizes: Mapping[str, int] = BATCH_SIZES) -> DataFrame:
    """Batches an import needs: full and partial batches per phase plus the finalizer.

    ``counts`` has (phase, rows).
    """
    needed = F.lit(None).cast("bigint")
    for phase, size in sizes.items():
        needed = F.when(F.col("phase") == phase, F.ceil(F.col("rows") / F.lit(size))).otherwise(needed)
    return counts.agg((F.coalesce(F.sum(needed), F.lit(0)) + 1).alias("batch_count"))


def batch_plan(
    rows: DataFrame, order: Sequence[Column | OrderKey], phase: str, sizes: Mapping[str, int] = BATCH_SIZES, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Batch number of every row, counted in a total order.

    An order of ``OrderKey`` is numbered by its ranges, without a sort of the
    whole table; one of plain columns by a spread sort that is kept.
    """
    if all(isinstance(key, OrderKey) for key in order):
        placed = indexed_position(rows, order_index(rows, order, range_rows), "ordinal")
    else:
        placed = global_position(rows, order, out="ordinal")
    return placed.withColumn("phase", F.lit(phase)).withColumn(
        "batch", F.ceil(F.col("ordinal") / F.lit(sizes[phase])).cast("bigint")
    )


def read_batch(rows: DataFrame, index: OrderIndex, batch: int, size: int) -> DataFrame:
    """The rows of one batch, counted from 1, with their position; sorts the ranges of this batch only."""
    return ordered_slice(rows, index, (batch - 1) * size, size)


def batch_summary(planned: DataFrame) -> DataFrame:
    """Offset and size of each batch."""
    return planned.groupBy("phase", "batch").agg(
        (F.min("ordinal") - 1).alias("batch_offset"), F.count("*").alias("batch_size")
    )
