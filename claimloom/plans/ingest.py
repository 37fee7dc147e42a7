"""From exported grids to parsed claims, subitems and updates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.dates import claim_date, update_time
from claimloom.functions.numbers import availability, decimal_amount
from claimloom.functions.text import body_fingerprint, clean_text, status_key
from claimloom.operators.distributed import BLOCK_ROWS
from claimloom.operators.joins import mark_duplicate_bodies, mark_matched
from claimloom.operators.reconcile import reconcile_strict
from claimloom.operators.rows import with_parents, with_row_class
from claimloom.schema import SheetLayout
from claimloom.session import kept
from claimloom.sources.grid import data_rows, header_cells, header_maps, held_headers, named_rows, positional_headers


@dataclass
class ParsedImport:
    """The frames of one parsed import."""

    headers: DataFrame
    header_maps: DataFrame
    source_rows: DataFrame
    claims: DataFrame
    subitem_headers: DataFrame
    subitem_details: DataFrame
    updates: DataFrame


def parse_claims(claim_rows: DataFrame, layout: SheetLayout, strict: bool = False) -> DataFrame:
    """Claim rows with normalised values, amounts and reconciliation."""

    def cell(header: str) -> Column:
        return F.col("row")[header]

    parsed = claim_rows.select(
        "file_name",
        "sheet",
        F.col("physical_row").alias("source_row"),
        F.col("source_item_id").alias("item_id"),
        clean_text(cell(layout.name)).alias("display_name"),
        clean_text(cell(layout.status)).alias("raw_status"),
        status_key(cell(layout.status)).alias("normalized_status"),
        clean_text(cell(layout.contractor)).alias("contractor"),
        clean_text(cell(layout.carrier)).alias("carrier"),
        clean_text(cell(layout.claim_handler)).alias("claim_handler"),
        clean_text(cell(layout.admin)).alias("admin"),
        clean_text(cell(layout.adjuster)).alias("adjuster"),
        *[claim_date(cell(name)).alias(f"date_{i}") for i, name in enumerate(layout.dates)],
        *[cell(m.header).alias(f"raw_{m.metric}") for m in layout.money],
        *[decimal_amount(cell(m.header)).alias(m.metric) for m in layout.money],
        "row",
    )
    checked = parsed.withColumn(
        "_check", reconcile_strict(F.col("initial_rcv"), F.col("current_rcv"), F.col("additional_secured"))
    )
    return checked.select(
        *parsed.columns,
        *[
            availability(F.col(m.metric), F.col(f"raw_{m.metric}"), strict).alias(f"availability_{m.metric}")
            for m in layout.money
        ],
        F.col("_check.value").alias("calculated_additional"),
        F.col("_check.status").alias("reconciliation_status"),
        F.col("_check.difference").alias("difference"),
    )


def parse_updates(update_rows: DataFrame, layout: SheetLayout) -> DataFrame:
    """Update rows with trimmed body, fingerprint and naive time."""

    def cell(header: str) -> Column:
        return F.col("row")[header]

    time = update_time(cell(layout.update_created))
    body = cell(layout.update_body)
    return update_rows.select(
        "file_name",
        "sheet",
        F.col("physical_row").alias("source_row"),
        clean_text(cell(layout.post_id)).alias("post_id"),
        clean_text(cell(layout.update_item_id)).alias("item_id"),
        clean_text(cell(layout.parent_post_id)).alias("parent_post_id"),
        clean_text(body).alias("body"),
        clean_text(body).isNull().alias("blank_body"),
        body_fingerprint(body).alias("body_fingerprint"),
        time["raw"].alias("timestamp_raw"),
        time["parsed"].alias("timestamp_parsed"),
        time["state"].alias("timestamp_state"),
        clean_text(cell(layout.update_author)).alias("author"),
        "row",
    )


def parse_import(grid: DataFrame, layout: SheetLayout, block_rows: int = BLOCK_ROWS) -> ParsedImport:
    """Parse the archive and update sheets of a grid.

    The grid is written once to the shared folder, so that neither its filters nor
    its many readers build the cells again; the header names, one row per column,
    are read and kept at once. Everything else stays a plan. Only the subitem frames need the order of the rows; claims
    and updates are read row by row.
    """
    grid = kept(grid, "grid")
    header_rows = layout.header_rows
    headers = held_headers(positional_headers(header_cells(grid, header_rows)))
    named = named_rows(data_rows(grid, header_rows), headers)
    archive = with_row_class(
        named.where(F.col("sheet") == layout.archive_sheet), F.col("row")[layout.item_id], F.col("row")[layout.name]
    )
    placed = with_parents(archive, block_rows=block_rows)
    update_rows = named.where(F.col("sheet") == layout.updates_sheet)
    claims = parse_claims(archive.where(F.col("row_class") == "claim"), layout)
    # matched last, as promotion looks the same item ids up again
    updates = mark_matched(mark_duplicate_bodies(parse_updates(update_rows, layout)), claims)

    def subitems(kind: str, *extra: str) -> DataFrame:
        return placed.where(F.col("row_class") == kind).select(
            "file_name", "sheet", F.col("physical_row").alias("source_row"), "parent_item_id", *extra, "row"
        )

    source_rows = archive.select("file_name", "sheet", "physical_row", "row_class", "source_item_id", "row").unionByName(
        update_rows.select(
            "file_name",
            "sheet",
            "physical_row",
            F.lit("update").alias("row_class"),
            clean_text(F.col("row")[layout.update_item_id]).alias("source_item_id"),
            "row",
        )
    )
    return ParsedImport(
        headers=headers,
        header_maps=header_maps(headers),
        source_rows=source_rows,
        claims=claims,
        subitem_headers=subitems("subitem_header"),
        subitem_details=subitems("subitem_detail", "header_row"),
        updates=updates,
    )
