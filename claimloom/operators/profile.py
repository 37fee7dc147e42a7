"""Column, key and date profiles of sheet rows.

Cells are unrolled to (column, value) and counted once per distinct value; the
kind, number and date of a value are then worked out per distinct value, not
per row. No list of values is built before its length is known to be small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.dates import profile_date, serial_day
from claimloom.functions.numbers import accounting_number
from claimloom.functions.text import has_term, identity_key, norm_text, redact_example, sensitivity_class
from claimloom.operators.distributed import exact_median, top_per_group
from claimloom.schema import (
    DATE_TERMS,
    FINANCIAL_TERMS,
    KEYWORD_FAMILIES,
    SENSITIVE_TERMS,
    SYSTEM_UPDATE_TOKENS,
)
from claimloom.session import kept
from claimloom.sources.grid import SHEET, has_content

COLUMN = [*SHEET, "position"]
LONG_VALUE = 128
KINDS = ("boolean", "date", "number", "date_string", "numeric_text", "text")


def _names(headers: DataFrame) -> DataFrame:
    """Header names, one row per column of a sheet; joined by broadcast, so that no column's values meet in one task."""
    return F.broadcast(headers.select(*COLUMN, F.col("internal").alias("header")))


def share_percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals; zero when there are no rows."""
    ratio = F.lit(100.0) * part.cast("double") / whole.cast("double")
    return F.coalesce(F.when(whole > 0, F.bround(ratio, 2)), F.lit(0.0))


def value_counts(cells: DataFrame) -> DataFrame:
    """Rows per column, value and cell type, with the first row each occurs in.

    A value of more than ``LONG_VALUE`` characters, which is neither number nor
    date, is represented by its digest, so that whole texts are not shuffled.
    """
    only_blanks = (F.col("value") == "") & (F.coalesce(F.col("raw"), F.lit("")) != "")
    digest = F.concat(F.lit("\u0000"), F.sha2(F.col("value").cast("binary"), 256))
    short = F.when(F.length("value") <= LONG_VALUE, F.col("value")).otherwise(digest)
    narrow = cells.select(*COLUMN, "physical_row", short.alias("value"), "cell_type", only_blanks.alias("_blank"))
    return narrow.groupBy(*COLUMN, "value", "cell_type").agg(
        F.count("*").alias("n"),
        F.min("physical_row").alias("first_row"),
        F.count_if("_blank").alias("whitespace_only"),
    )


def _day_of(value: Column, cell_type: Column) -> Column:
    """Date of a cell: any text format, or the serial number of a number cell."""
    serial = F.when(cell_type == "number", serial_day(value.try_cast("double")))
    return F.coalesce(profile_date(value), serial)


def _parsed(counts: DataFrame, headers: DataFrame) -> DataFrame:
    header = F.col("header")
    value = F.when(F.col("value") != "", F.col("value"))
    dated = has_term(header, DATE_TERMS)
    financial = has_term(header, FINANCIAL_TERMS)
    named = counts.join(_names(headers), COLUMN)
    # each value is parsed only below a header that asks for it
    parsed = named.select(
        "*",
        financial.alias("financial"),
        F.when(financial & (F.col("cell_type") != "boolean"), accounting_number(value)).alias("number"),
        F.when(dated, _day_of(value, F.col("cell_type"))).alias("day"),
    )
    kind = (
        F.when(F.col("value") == "", F.lit(None).cast("string"))
        .when(F.col("cell_type").isin("boolean", "date", "number"), F.col("cell_type"))
        .when(F.col("day").isNotNull(), "date_string")
        .when(F.col("number").isNotNull(), "numeric_text")
        .otherwise("text")
    )
    return parsed.select("*", kind.alias("kind"))


def _majority_kind() -> Column:
    """Kind with the most cells; among equals the one that occurs first."""
    ranked = [
        F.when(
            F.col(f"_{k}") > 0,
            F.struct((-F.col(f"_{k}")).alias("rank"), F.col(f"_{k}_first").alias("first"), F.lit(k).alias("kind")),
        )
        for k in KINDS
    ]
    return F.coalesce(F.array_min(F.array(*ranked))["kind"], F.lit("empty"))


def column_profile(rows: DataFrame, cells: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per column: fill, distinct values, kind, range and sensitivity.

    ``rows`` and ``cells`` hold the non-blank data rows. Numbers set the range
    of a money column, else dates set it.
    """
    parsed = _parsed(value_counts(cells), headers)
    n = F.col("n")
    kind_counts = [
        c
        for k in KINDS
        for c in (
            F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(f"_{k}"),
            F.min(F.when(F.col("kind") == k, F.col("first_row"))).alias(f"_{k}_first"),
        )
    ]
    malformed = F.when((F.col("kind") == "text") & F.col("financial"), n)
    per_column = parsed.groupBy(*COLUMN, "header").agg(
        F.coalesce(F.sum(F.when(F.col("value") != "", n)), F.lit(0)).alias("nonblank_count"),
        F.count_distinct(F.when(F.col("value") != "", F.col("value"))).alias("distinct_count"),
        F.sum("whitespace_only").alias("whitespace_only_count"),
        F.coalesce(F.sum(malformed), F.lit(0)).alias("malformed_count"),
        F.min("number").alias("_min_n"),
        F.max("number").alias("_max_n"),
        F.min("day").alias("_min_d"),
        F.max("day").alias("_max_d"),
        *kind_counts,
    )
    totals = rows.groupBy(*SHEET).agg(F.count("*").alias("_rows"))
    kinds_present = F.lit(0)
    for k in KINDS:
        kinds_present = kinds_present + F.when(F.col(f"_{k}") > 0, 1).otherwise(0)
    return per_column.join(totals, SHEET).select(
        *COLUMN,
        "header",
        _majority_kind().alias("inferred_type"),
        "nonblank_count",
        share_percent(F.col("nonblank_count"), F.col("_rows")).alias("coverage_percent"),
        "distinct_count",
        "whitespace_only_count",
        F.greatest(F.lit(0), kinds_present - 1).cast("bigint").alias("mixed_type_count"),
        "malformed_count",
        F.col("nonblank_count").alias("static_value_count"),
        F.col("_min_n").alias("minimum_number"),
        F.col("_max_n").alias("maximum_number"),
        F.when(F.col("_min_n").isNull(), F.col("_min_d")).alias("minimum_date"),
        F.when(F.col("_min_n").isNull(), F.col("_max_d")).alias("maximum_date"),
        sensitivity_class(F.col("header")).alias("sensitivity"),
    )


def example_values(cells: DataFrame, headers: DataFrame, limit: int = 3) -> DataFrame:
    """First non-blank values per column in row order, masked where sensitive."""
    filled = cells.where(F.col("value") != "")
    first = top_per_group(filled, COLUMN, [F.asc("physical_row")], limit)
    named = first.join(_names(headers), COLUMN)
    shown = named.withColumn("example", redact_example(F.col("header"), F.col("raw")))
    # at most `limit` rows per column are left here
    listed = F.array_sort(F.collect_list(F.struct("_rank", "example")))
    return shown.groupBy(*COLUMN, "header").agg(listed["example"].alias("example_values"))


def enum_candidates(cells: DataFrame, headers: DataFrame, limit: int = 20) -> DataFrame:
    """Values of the columns that have at most ``limit`` of them and are not sensitive."""
    open_columns = _names(headers.where(~has_term(F.col("internal"), SENSITIVE_TERMS)))
    values = (
        cells.where(F.col("value") != "")
        .join(open_columns, COLUMN)
        .groupBy(*COLUMN, "header", "value")
        .agg(F.min("physical_row").alias("_first"))
    )
    few = values.groupBy(*COLUMN).agg(F.count("*").alias("_values")).where(F.col("_values") <= limit)
    kept = values.join(few.select(*COLUMN), COLUMN, "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("_first", "value")))
    return kept.groupBy(*COLUMN, "header").agg(ordered["value"].alias("enum_values"))


def sheet_profile(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Data and blank rows per sheet, and how many header names repeat."""
    counts = rows.groupBy(*SHEET).agg(
        F.count_if(has_content()).alias("data_rows"), F.count_if(~has_content()).alias("blank_rows")
    )
    names = headers.groupBy(*SHEET, "raw").agg(F.count("*").alias("_times"))
    repeats = names.groupBy(*SHEET).agg(
        F.sum("_times").alias("columns"), F.count_if(F.col("_times") > 1).alias("repeated_names")
    )
    return counts.join(repeats, SHEET, "left")


def claim_coverage(claim_cells: DataFrame, claim_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Fill and distinct values per column over claim rows only."""
    totals = claim_rows.groupBy(*SHEET).agg(F.count("*").alias("_rows"))
    filled = F.when(F.col("value") != "", F.col("value"))
    per_column = claim_cells.groupBy(*COLUMN).agg(
        F.count(filled).alias("nonblank_count"), F.count_distinct(filled).alias("distinct_count")
    )
    return (
        per_column.join(_names(headers), COLUMN)
        .join(totals, SHEET)
        .select(
            *COLUMN,
            "header",
            "nonblank_count",
            share_percent(F.col("nonblank_count"), F.col("_rows")).alias("coverage_percent"),
            "distinct_count",
        )
    )


def money_stats(cells: DataFrame, claim_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Zero, negative and malformed amounts, range and exact median per money column."""
    counts = value_counts(cells).join(_names(headers), COLUMN)
    filled = F.col("value") != ""
    number = F.when(filled & (F.col("cell_type") != "boolean"), accounting_number(F.col("value")))
    # the texts are gone once their numbers are known; this is what both the stats and the medians read
    valued = kept(
        counts.select(*COLUMN, "header", number.alias("number"), filled.alias("filled"), "cell_type", "n")
        .groupBy(*COLUMN, "header", "number", "filled", "cell_type").agg(F.sum("n").alias("n")),
        "amounts",
    )
    n = F.col("n")
    filled = F.col("filled")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    stats = valued.groupBy(*COLUMN, "header").agg(
        rows_where(filled).alias("nonblank_count"),
        rows_where(F.col("number") == 0).alias("zero_count"),
        rows_where(F.col("number") < 0).alias("negative_count"),
        rows_where(filled & F.col("number").isNull()).alias("malformed_count"),
        F.min("number").alias("minimum"),
        F.max("number").alias("maximum"),
        rows_where(filled & (F.col("cell_type") == "text")).alias("_texts"),
        rows_where(F.col("cell_type").isin("number", "boolean")).alias("_numbers"),
    )
    amounts = valued.select(*COLUMN, "number", "n")
    medians = exact_median(amounts, COLUMN, "number", "median", weight="n").drop("value_count")
    totals = claim_rows.groupBy(*SHEET).agg(F.count("*").alias("_rows"))
    form = (
        F.when((F.col("_texts") > 0) & (F.col("_numbers") > 0), "mixed")
        .when(F.col("_texts") > 0, "text")
        .otherwise("numeric")
    )
    return (
        stats.join(medians, COLUMN, "left")
        .join(totals, SHEET)
        .withColumn("coverage_percent", share_percent(F.col("nonblank_count"), F.col("_rows")))
        .withColumn("representation", form)
        .drop("_rows", "_texts", "_numbers")
    )


def identity_profile(rows: DataFrame, column: str) -> DataFrame:
    """Raw and normalised distinct names, and how many names fall together."""
    values = rows.groupBy(norm_text(F.col(column)).alias("_value")).agg(F.count("*").alias("_n"))
    totals = values.agg(
        F.coalesce(F.sum(F.when(F.col("_value") != "", F.col("_n"))), F.lit(0)).alias("nonblank_count"),
        F.coalesce(F.sum(F.when(F.col("_value") == "", F.col("_n"))), F.lit(0)).alias("blank_count"),
    ).withColumn("_k", F.lit(1))
    names = values.where(F.col("_value") != "")
    groups = names.groupBy(identity_key(F.col("_value")).alias("_key")).agg(F.count("*").alias("_variants"))
    spread = groups.agg(
        F.coalesce(F.sum("_variants"), F.lit(0)).alias("distinct_raw_count"),
        F.count("*").alias("normalized_distinct_count"),
        F.count_if(F.col("_variants") > 1).alias("collision_groups"),
        F.coalesce(F.sum(F.col("_variants") - 1), F.lit(0)).alias("variant_count"),
    ).withColumn("_k", F.lit(1))
    return totals.join(spread, "_k").select(F.lit(column).alias("column"), "*").drop("_k")


def key_audit(rows: DataFrame, key: str) -> DataFrame:
    """Non-blank, missing and surplus rows of a key column."""
    value = F.nullif(norm_text(F.col(key)), F.lit(""))
    return rows.agg(
        F.count(value).alias("nonblank"),
        F.count_if(value.isNull()).alias("missing"),
        (F.count(value) - F.count_distinct(value)).alias("duplicate_rows"),
    )


def exact_duplicate_rows(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Rows beyond the first of each identical row."""
    whole = F.sha2(F.to_json(F.transform(cells, norm_text)), 256)
    return rows.agg((F.count("*") - F.count_distinct(whole)).alias("duplicate_rows"))


def update_audit(updates: DataFrame) -> DataFrame:
    """Blank bodies, authors, system posts and time range of the updates.

    ``updates`` has (body, author, at); a missing author counts as one author.
    """
    body = norm_text(F.col("body"))
    author = norm_text(F.col("author"))
    by_system = author == ""
    for token in SYSTEM_UPDATE_TOKENS:
        by_system = by_system | F.lower(body).contains(token)
    return updates.agg(
        F.count("*").alias("total_rows"),
        F.count_if(body == "").alias("blank_bodies"),
        F.count_distinct(author).alias("authors_including_blank"),
        F.count_if(by_system).alias("system_estimate"),
        F.min("at").alias("earliest"),
        F.max("at").alias("latest"),
    )


def keyword_counts(updates: DataFrame, families: Mapping[str, str] = KEYWORD_FAMILIES) -> DataFrame:
    """Updates that mention each keyword family, all counted in one pass."""
    body = norm_text(F.col("body"))
    # (?U) gives \b its Unicode meaning
    hits = [F.count_if(body.rlike(f"(?iU){pattern}")).alias(name) for name, pattern in families.items()]
    counted = updates.agg(*hits)
    rows = [F.struct(F.lit(name).alias("family"), F.col(name).alias("mentions")) for name in families]
    return counted.select(F.inline(F.array(*rows)))


def date_audit(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Parsed, invalid and extreme dates of every date column."""
    dated = _names(headers.where(has_term(F.col("internal"), DATE_TERMS)))
    counts = value_counts(cells.where(F.col("value") != "")).join(dated, COLUMN)
    valued = counts.select("*", _day_of(F.col("value"), F.col("cell_type")).alias("day"))
    n = F.col("n")
    stats = valued.groupBy(*COLUMN, "header").agg(
        F.sum(n).alias("nonblank_count"),
        F.coalesce(F.sum(F.when(F.col("day").isNotNull(), n)), F.lit(0)).alias("parsed_count"),
        F.coalesce(F.sum(F.when(F.col("day").isNull(), n)), F.lit(0)).alias("invalid_count"),
        F.min("day").alias("earliest"),
        F.max("day").alias("latest"),
        F.bool_and(F.col("cell_type") == "date").alias("_cells_are_dates"),
    )
    form = F.when((F.col("parsed_count") > 0) & F.col("_cells_are_dates"), "date cells").otherwise("mixed or text")
    return stats.select(*stats.columns, form.alias("representation")).drop("_cells_are_dates")


def service_candidates(claims: DataFrame, handler: str) -> DataFrame:
    """Two counts that hint at the service type; a report figure, never a fact."""
    present = norm_text(F.col(handler)) != ""
    return claims.agg(
        F.count_if(present).alias("claim_handling_candidates"), F.count_if(~present).alias("estimate_only_candidates")
    )


def acceptance_counts(rows: DataFrame, item_id: str, name: str, updates: DataFrame, label: str) -> DataFrame:
    """Twelve acceptance figures of an import as (measure, actual) rows.

    ``updates`` has (post_id, item_id).
    """
    item = F.nullif(norm_text(F.col(item_id)), F.lit(""))
    title = norm_text(F.col(name))
    ref = F.nullif(norm_text(F.col("item_id")), F.lit(""))
    post = F.nullif(norm_text(F.col("post_id")), F.lit(""))
    structure = rows.agg(
        F.count("*").alias("archive_physical_rows"),
        F.count(item).alias("archive_claim_rows"),
        F.count_if(title == label).alias("archive_header_rows"),
        F.count_if(item.isNull() & (title == "")).alias("archive_detail_rows"),
        F.count(item).alias("archive_nonblank_item_ids"),
        F.count_distinct(item).alias("archive_unique_item_ids"),
    )
    posts = updates.agg(
        F.count("*").alias("update_rows"),
        F.count(post).alias("updates_nonblank_post_ids"),
        F.count_distinct(post).alias("updates_unique_post_ids"),
    )
    known = rows.select(item.alias("_id")).where(F.col("_id").isNotNull()).distinct().withColumn("_known", F.lit(True))
    referred = updates.select(ref.alias("_id")).where(F.col("_id").isNotNull()).groupBy("_id").agg(F.count("*").alias("_n"))
    links = referred.join(known, "_id", "full_outer").agg(
        F.count("_n").alias("updates_unique_item_ids"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("orphan_update_rows"),
        F.count_if(F.col("_n").isNull()).alias("archive_items_without_updates"),
    )
    frames = []
    for frame in (structure, posts, links):
        entries = [
            F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("actual")) for c in frame.columns
        ]
        frames.append(frame.select(F.inline(F.array(*entries))))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def field_inventory(
    profile: DataFrame, coverage: DataFrame, repeat_suffix: str = "__2", hierarchical: Sequence[str] = ()
) -> DataFrame:
    """Column profile next to its claim coverage, with notes."""
    notes = F.concat_ws(
        " ",
        F.when(F.col("header").endswith(repeat_suffix), "Repeated header, renamed by its order."),
        F.when(
            F.col("whitespace_only_count") > 0,
            F.concat(F.col("whitespace_only_count").cast("string"), F.lit(" cells hold only blanks.")),
        ),
        F.when(F.col("nonblank_count") == 0, "No value at all."),
        F.when(F.col("sheet").isin(*hierarchical), "Read together with the row class.") if hierarchical else F.lit(None),
    )
    claims = coverage.select(*COLUMN, F.col("coverage_percent").alias("claim_coverage_percent"))
    return profile.join(claims, COLUMN, "left").withColumn("notes", notes)
