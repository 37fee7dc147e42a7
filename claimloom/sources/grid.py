"""Exported sheet grids: reading, checking, naming and unrolling their cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import NOT_BLANK, clean_text, norm_text
from claimloom.operators.distributed import running_number
from claimloom.session import kept
from claimloom.schema import GRID

SHEET = ["file_name", "sheet"]


def read_grid(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a grid export (Parquet, ORC or JSON lines) with a fixed schema."""
    return spark.read.schema(GRID).format(fmt).load(path)


def artifact_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every artifact file below ``path``, computed by the executors."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), "length", F.sha2("content", 256).alias("sha256"))


def check_artifacts(found: DataFrame, manifest: DataFrame, allow_mismatch: bool = False) -> DataFrame:
    """Compare hashes with the manifest (file_name, expected_sha256).

    A file that differs or is not listed is refused, unless ``allow_mismatch``.
    """
    same = F.col("sha256").eqNullSafe(F.col("expected_sha256"))
    return found.join(manifest, "file_name", "left").select(
        "file_name",
        "sha256",
        "expected_sha256",
        same.alias("matches"),
        (same | F.lit(allow_mismatch)).alias("accepted"),
    )


def artifacts_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Hashes taken before and after a run, with one verdict per file."""
    earlier = before.select("file_name", F.col("sha256").alias("sha256_before"))
    later = after.select("file_name", F.col("sha256").alias("sha256_after"))
    return earlier.join(later, "file_name", "full_outer").withColumn(
        "unchanged", F.col("sha256_before").eqNullSafe(F.col("sha256_after"))
    )


def sheet_extents(grid: DataFrame) -> DataFrame:
    return grid.groupBy(*SHEET).agg(
        F.max("physical_row").alias("last_row"), F.max(F.size("cells")).cast("bigint").alias("columns")
    )


def shape_gate(grid: DataFrame, expected: DataFrame) -> DataFrame:
    """Extents of each sheet against (sheet, expected_last_row, expected_columns).

    A sheet missing on either side fails.
    """
    return sheet_extents(grid).join(expected, "sheet", "full_outer").select(
        "sheet",
        "last_row",
        "columns",
        "expected_last_row",
        "expected_columns",
        (
            F.col("last_row").eqNullSafe(F.col("expected_last_row"))
            & F.col("columns").eqNullSafe(F.col("expected_columns"))
        ).alias("passes"),
    )


def _header_row(header_rows: Mapping[str, int]) -> Column:
    """Header row number of a row's sheet; NULL for a sheet that is not listed."""
    number = F.lit(None).cast("bigint")
    for sheet, row in header_rows.items():
        number = F.when(F.col("sheet") == sheet, F.lit(row)).otherwise(number)
    return number


def header_cells(grid: DataFrame, header_rows: Mapping[str, int]) -> DataFrame:
    """Header cells as (file, sheet, position from 1, cell); ``header_rows`` maps sheet to row."""
    wanted = F.lit(False)
    for sheet, row in header_rows.items():
        wanted = wanted | ((F.col("sheet") == sheet) & (F.col("physical_row") == row))
    heads = grid.where(wanted)
    return heads.select(*SHEET, F.posexplode("cells").alias("_at", "cell")).select(
        *SHEET, (F.col("_at") + 1).cast("bigint").alias("position"), "cell"
    )


def positional_headers(cells: DataFrame, group: Sequence[str] = SHEET) -> DataFrame:
    """Internal names: a repeat gets its position, a blank header a placeholder."""
    placeholder = F.concat(F.lit("unnamed_column_"), F.col("position").cast("string"))
    named = cells.select(*group, "position", F.coalesce(clean_text(F.col("cell")), placeholder).alias("raw"))
    first = named.groupBy(*group, "raw").agg(F.min("position").alias("_first"))
    suffixed = F.concat("raw", F.lit("__column_"), F.col("position").cast("string"))
    internal = F.when(F.col("position") == F.col("_first"), F.col("raw")).otherwise(suffixed)
    return named.join(first, [*group, "raw"]).select(*group, "position", "raw", internal.alias("internal"))


def ordinal_headers(cells: DataFrame, group: Sequence[str] = SHEET) -> DataFrame:
    """The profiler's names: a repeat gets its running number."""
    placeholder = F.concat(F.lit("Unnamed_"), F.col("position").cast("string"))
    named = cells.select(*group, "position", F.coalesce(clean_text(F.col("cell")), placeholder).alias("raw"))
    counted = running_number(named, [*group, "raw"], "position", "_nth")
    suffixed = F.concat("raw", F.lit("__"), F.col("_nth").cast("string"))
    internal = F.when(F.col("_nth") == 1, F.col("raw")).otherwise(suffixed)
    return counted.select(*group, "position", "raw", internal.alias("internal"))


def repeated_headers(headers: DataFrame, group: Sequence[str] = SHEET) -> DataFrame:
    return (
        headers.groupBy(*group, "raw")
        .agg(F.count("*").alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


def held_headers(headers: DataFrame) -> DataFrame:
    """Header names written once to the shared folder, so that no later step reads the sheets for them."""
    return kept(headers, "headers")


def header_maps(headers: DataFrame, group: Sequence[str] = SHEET) -> DataFrame:
    """One row per sheet with its names in column order (at most one sheet width)."""
    entry = F.struct("position", "raw", "internal")
    return headers.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("header_map"))


def data_rows(grid: DataFrame, header_rows: Mapping[str, int]) -> DataFrame:
    """Rows below the header of their sheet."""
    return grid.where(F.col("physical_row") > _header_row(header_rows))


def has_content(cells: str = "cells") -> Column:
    """True when any cell holds a character that is not blank."""
    return F.concat_ws("", cells).rlike(NOT_BLANK)


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    return rows.where(has_content())


def named_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells as a map from internal header name to cell, one map per row."""
    maps = header_maps(headers).select(*SHEET, F.col("header_map.internal").alias("_names"))
    padded = F.transform("_names", lambda _, i: F.get(F.col("cells"), i))
    fitted = F.when(F.size("cells") == F.size("_names"), F.col("cells")).otherwise(padded)
    return rows.join(maps, SHEET).withColumn("row", F.map_from_arrays("_names", fitted)).drop("_names")


def unrolled_cells(rows: DataFrame) -> DataFrame:
    """One row per cell; ``value`` is the trimmed text, ``raw`` the cell itself.

    Rows may carry ``cell_types``: the kind each cell had in its workbook.
    """
    kinds = F.col("cell_types") if "cell_types" in rows.columns else F.lit(None).cast("array<string>")
    zipped = rows.select(*SHEET, "physical_row", F.posexplode("cells").alias("_at", "raw"), kinds.alias("_kinds"))
    return zipped.select(
        *SHEET,
        "physical_row",
        (F.col("_at") + 1).cast("bigint").alias("position"),
        "raw",
        norm_text(F.col("raw")).alias("value"),
        F.coalesce(F.get("_kinds", F.col("_at")), F.lit("text")).alias("cell_type"),
    )
