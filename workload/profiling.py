"""Profile queries: columns, keys, amounts, identities, dates, updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.dates import profile_date
from claimloom.functions.text import clean_text
from claimloom.operators import profile
from claimloom.schema import DATE_TERMS, FINANCIAL_TERMS, KEYWORD_FAMILIES, SENSITIVE_TERMS, SUBITEM_LABEL
from claimloom.session import kept
from claimloom.sources import grid as grids
from workload import views
from workload.ingest import _named, parsed
from workload.views import ARCHIVE, ARCHIVE_COLUMNS, ARCHIVE_HEADERS, LAYOUT, POSTS, sql_clean, sql_number, table, text

EVENT_HEADERS = ("Event ID", "Sent date", "Visitor", "Kind", "Fee amount", "Notes")


def _sheet(spark: SparkSession, sf: str, sheet: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Non-blank rows, their cells and the profiler's header names of one sheet."""
    # the cells are built once: the filters on them would build them again
    grid = kept(views.grid(spark, sf).where(F.col("sheet") == sheet), "grid")
    headers = grids.held_headers(grids.ordinal_headers(grids.header_cells(grid, LAYOUT.header_rows)))
    rows = grids.drop_blank_rows(grids.data_rows(grid, LAYOUT.header_rows))
    return rows, grids.unrolled_cells(rows), headers


def _claim_rows(rows: DataFrame) -> DataFrame:
    item = F.get("cells", F.lit(ARCHIVE_COLUMNS.index("item_id")))
    return rows.where(clean_text(item).isNotNull())


def _event_sheet(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The event table as a sheet whose cells keep their types."""
    events = table(spark, sf, "events")
    moment = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    columns = [F.col("event_id"), moment, F.col("user_id"), F.col("event_type"), F.col("value"), F.col("props")]
    kinds = ("number", "date", "number", "text", "number", "text")
    rows = events.select(
        F.lit("export").alias("file_name"),
        F.lit("events").alias("sheet"),
        F.col("event_id").alias("physical_row"),
        F.array(*[text(c) for c in columns]).alias("cells"),
        F.array(*[F.lit(k) for k in kinds]).alias("cell_types"),
    )
    names = F.array(*[F.lit(h) for h in EVENT_HEADERS])
    heads = spark.range(1).select(
        F.lit("export").alias("file_name"), F.lit("events").alias("sheet"), F.posexplode(names).alias("_at", "cell")
    ).withColumn("position", (F.col("_at") + 1).cast("bigint"))
    return rows, grids.unrolled_cells(rows), grids.ordinal_headers(heads)


def _shown(profiled: DataFrame) -> DataFrame:
    return (
        profiled.drop("file_name", "sheet")
        .withColumn("minimum_date", F.date_format("minimum_date", "yyyy-MM-dd HH:mm:ss"))
        .withColumn("maximum_date", F.date_format("maximum_date", "yyyy-MM-dd HH:mm:ss"))
    )


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(profile.column_profile(*_sheet(spark, sf, LAYOUT.archive_sheet)))


def typed_column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(profile.column_profile(*_event_sheet(spark, sf)))


def example_values(spark: SparkSession, sf: str) -> DataFrame:
    _, cells, headers = _sheet(spark, sf, LAYOUT.archive_sheet)
    shown = profile.example_values(cells, headers)
    return shown.select("position", "header", F.array_join("example_values", "|").alias("examples"))


def enum_values(spark: SparkSession, sf: str) -> DataFrame:
    _, cells, headers = _sheet(spark, sf, LAYOUT.archive_sheet)
    listed = profile.enum_candidates(cells, headers)
    return listed.select("position", "header", F.array_join("enum_values", "|").alias("enum_values"))


def sheet_profile(spark: SparkSession, sf: str) -> DataFrame:
    grid = views.grid(spark, sf)
    headers = grids.ordinal_headers(grids.header_cells(grid, LAYOUT.header_rows))
    return profile.sheet_profile(grids.data_rows(grid, LAYOUT.header_rows), headers)


def claim_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, headers = _sheet(spark, sf, LAYOUT.archive_sheet)
    claims = _claim_rows(rows)
    covered = profile.claim_coverage(grids.unrolled_cells(claims), claims, headers)
    return covered.drop("file_name", "sheet")


def money_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, headers = _sheet(spark, sf, LAYOUT.archive_sheet)
    claims = _claim_rows(rows)
    money = headers.where(F.col("internal").isin(*[m.header for m in LAYOUT.money]))
    cells = grids.unrolled_cells(claims).join(money.select("position"), "position", "left_semi")
    return profile.money_stats(cells, claims, money).drop("file_name", "sheet")


def identity_profiles(spark: SparkSession, sf: str) -> DataFrame:
    claims = parsed(spark, sf).claims
    rows = None
    for column in ("contractor", "carrier", "claim_handler", "adjuster", "admin"):
        part = profile.identity_profile(claims, column)
        rows = part if rows is None else rows.unionByName(part)
    return rows


def key_audit(spark: SparkSession, sf: str) -> DataFrame:
    archive = _named(spark, sf, LAYOUT.archive_sheet).select(F.col("row")[LAYOUT.item_id].alias("key"))
    posts = _named(spark, sf, LAYOUT.updates_sheet).select(F.col("row")[LAYOUT.post_id].alias("key"))
    first = profile.key_audit(archive, "key").withColumn("table", F.lit("archive"))
    return first.unionByName(profile.key_audit(posts, "key").withColumn("table", F.lit("updates")))


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Identical rows of the archive, of its claims and of the document texts."""
    rows, _, _ = _sheet(spark, sf, LAYOUT.archive_sheet)
    documents = table(spark, sf, "documents").select(F.array("text").alias("cells"))
    found = None
    for name, frame in (("archive", rows), ("claims", _claim_rows(rows)), ("documents", documents)):
        part = profile.exact_duplicate_rows(frame).withColumn("table", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named(spark, sf, LAYOUT.updates_sheet)
    cell = F.col("row")
    return rows.select(
        cell[LAYOUT.post_id].alias("post_id"),
        cell[LAYOUT.update_item_id].alias("item_id"),
        cell[LAYOUT.update_body].alias("body"),
        cell[LAYOUT.update_author].alias("author"),
        cell[LAYOUT.update_created].alias("created"),
    )


def update_audit(spark: SparkSession, sf: str) -> DataFrame:
    audited = profile.update_audit(_posts(spark, sf).withColumn("at", profile_date(F.col("created"))))
    return audited.withColumn("earliest", F.date_format("earliest", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss")
    )


def keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Over update bodies, page sources and all conversation turns, whole texts."""
    bodies = _posts(spark, sf).select("body")
    pages = table(spark, sf, "pages").select(F.col("html").alias("body"))
    turns = table(spark, sf, "conversations").select(F.col("text").alias("body"))
    return profile.keyword_counts(bodies.unionByName(pages).unionByName(turns))


def word_families(spark: SparkSession, sf: str) -> DataFrame:
    """The same counting with families of words that the texts do hold."""
    bodies = _posts(spark, sf).select("body")
    return profile.keyword_counts(bodies, FAMILIES)


FAMILIES = {"article": r"\bthe\b|\bla\b", "clicked": r"\bclick(?:ed)?\b", "error": r"\berror\b", "ending": r"tion\b"}


def date_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, headers = _sheet(spark, sf, LAYOUT.archive_sheet)
    audited = profile.date_audit(grids.unrolled_cells(_claim_rows(rows)), headers)
    return (
        audited.drop("file_name", "sheet")
        .withColumn("earliest", F.date_format("earliest", "yyyy-MM-dd HH:mm:ss"))
        .withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))
    )


def service_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return profile.service_candidates(parsed(spark, sf).claims, "claim_handler")


def acceptance(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named(spark, sf, LAYOUT.archive_sheet).select(
        F.col("row")[LAYOUT.item_id].alias("item"), F.col("row")[LAYOUT.name].alias("name")
    )
    return profile.acceptance_counts(rows, "item", "name", _posts(spark, sf), SUBITEM_LABEL)


def field_inventory(spark: SparkSession, sf: str) -> DataFrame:
    rows, cells, headers = _sheet(spark, sf, LAYOUT.archive_sheet)
    claims = _claim_rows(rows)
    inventory = profile.field_inventory(
        profile.column_profile(rows, cells, headers),
        profile.claim_coverage(grids.unrolled_cells(claims), claims, headers),
        hierarchical=(LAYOUT.archive_sheet,),
    )
    return inventory.select("position", "header", "nonblank_count", "coverage_percent", "claim_coverage_percent", "notes")


# --- SQL twins -------------------------------------------------------------------


def _ordinal_names() -> list[str]:
    seen: dict[str, int] = {}
    names = []
    for position, header in enumerate(ARCHIVE_HEADERS, 1):
        base = header or f"Unnamed_{position}"
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}__{seen[base]}")
    return names


NAMES = _ordinal_names()


def _has(header: str, terms: tuple[str, ...]) -> bool:
    return any(t in header.lower() for t in terms)


def _flag(value: bool) -> str:
    return "TRUE" if value else "FALSE"


def _sensitivity(header: str) -> str:
    return "PII" if _has(header, SENSITIVE_TERMS) else "Financial" if _has(header, FINANCIAL_TERMS) else "Operational"


CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT physical_row, item_id IS NOT NULL AS is_claim, CAST({i} AS BIGINT) AS position, '{name}' AS header, "
    f"\"{column}\" AS raw, coalesce({sql_clean(chr(34) + column + chr(34))}, '') AS value, "
    f"{_flag(_has(name, FINANCIAL_TERMS))} AS financial, {_flag(_has(name, DATE_TERMS))} AS dated, "
    f"{_flag(_has(name, SENSITIVE_TERMS))} AS sensitive, '{_sensitivity(name)}' AS sensitivity FROM archive"
    for i, (name, column) in enumerate(zip(NAMES, ARCHIVE_COLUMNS), 1)
) + ")"

_ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?$"
TYPED = f"""typed AS (SELECT *, CASE WHEN value <> '' AND financial THEN {sql_number('value')} END AS number,
  CASE WHEN dated AND regexp_matches(value, '{_ISO}') THEN TRY_CAST(value AS TIMESTAMP) END AS day,
  {sql_number('value')} AS any_number FROM cells),
kinded AS (SELECT *, CASE WHEN value = '' THEN NULL WHEN day IS NOT NULL THEN 'date_string'
  WHEN number IS NOT NULL THEN 'numeric_text' ELSE 'text' END AS kind FROM typed),
kinds AS (SELECT position, kind, count(*) AS n, min(physical_row) AS first_row FROM kinded WHERE kind IS NOT NULL GROUP BY 1, 2),
majority AS (SELECT position, first(kind ORDER BY n DESC, first_row) AS inferred_type, count(*) - 1 AS mixed FROM kinds GROUP BY 1)"""

PROFILE_SQL = f"""{ARCHIVE}, {CELLS}, {TYPED},
profiled AS (SELECT k.position, header, coalesce(any_value(inferred_type), 'empty') AS inferred_type,
  count(*) FILTER (WHERE value <> '') AS nonblank_count,
  round_even(100.0::DOUBLE * count(*) FILTER (WHERE value <> '') / count(*), 2) AS coverage_percent,
  count(DISTINCT value) FILTER (WHERE value <> '') AS distinct_count,
  count(*) FILTER (WHERE value = '' AND raw <> '') AS whitespace_only_count,
  coalesce(any_value(mixed), 0) AS mixed_type_count,
  count(*) FILTER (WHERE kind = 'text' AND financial) AS malformed_count,
  count(*) FILTER (WHERE value <> '') AS static_value_count,
  min(number) AS minimum_number, max(number) AS maximum_number,
  CASE WHEN min(number) IS NULL THEN strftime(min(day), '%Y-%m-%d %H:%M:%S') END AS minimum_date,
  CASE WHEN min(number) IS NULL THEN strftime(max(day), '%Y-%m-%d %H:%M:%S') END AS maximum_date,
  any_value(sensitivity) AS sensitivity
  FROM kinded k LEFT JOIN majority m ON m.position = k.position GROUP BY 1, 2)"""

COVERED_SQL = """covered AS (SELECT position, header, count(*) FILTER (WHERE value <> '') AS nonblank_count,
  round_even(100.0::DOUBLE * count(*) FILTER (WHERE value <> '') / count(*), 2) AS coverage_percent,
  count(DISTINCT value) FILTER (WHERE value <> '') AS distinct_count FROM cells WHERE is_claim GROUP BY 1, 2)"""


def _event_column(position: int, header: str, kind: str, value: str, number: str = "NULL", day: str = "NULL") -> str:
    return f"""SELECT CAST({position} AS BIGINT) AS position, '{header}' AS header, '{kind}' AS inferred_type,
    count(*) AS nonblank_count, 100.0::DOUBLE AS coverage_percent, count(DISTINCT {value}) AS distinct_count,
    CAST(0 AS BIGINT) AS whitespace_only_count, CAST(0 AS BIGINT) AS mixed_type_count, CAST(0 AS BIGINT) AS malformed_count,
    count(*) AS static_value_count, CAST(min({number}) AS DOUBLE) AS minimum_number, CAST(max({number}) AS DOUBLE) AS maximum_number,
    CAST(min({day}) AS VARCHAR) AS minimum_date, CAST(max({day}) AS VARCHAR) AS maximum_date,
    '{_sensitivity(header)}' AS sensitivity FROM events"""


_SECOND = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
EVENTS_PROFILE_SQL = " UNION ALL ".join(
    (
        _event_column(1, EVENT_HEADERS[0], "number", "event_id"),
        _event_column(2, EVENT_HEADERS[1], "date", _SECOND, day=_SECOND),
        _event_column(3, EVENT_HEADERS[2], "number", "user_id"),
        _event_column(4, EVENT_HEADERS[3], "text", "event_type"),
        _event_column(5, EVENT_HEADERS[4], "number", "value", number="value"),
        _event_column(6, EVENT_HEADERS[5], "text", "props"),
    )
)

EXAMPLES_SQL = f"""WITH {ARCHIVE}, {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY physical_row) AS nth
  FROM cells WHERE value <> '') SELECT position, header, string_agg(CASE WHEN sensitive THEN '[REDACTED PERSON/IDENTITY]'
  WHEN length(value) > 100 THEN substr(value, 1, 97) || '...' ELSE value END, '|' ORDER BY nth) AS examples
  FROM r WHERE nth <= 3 GROUP BY 1, 2"""

_IDENTITY = " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", count(v) AS nonblank_count, count(*) - count(v) AS blank_count,
    count(DISTINCT v) AS distinct_raw_count, count(DISTINCT k) AS normalized_distinct_count,
    coalesce((SELECT count(*) FROM (SELECT k FROM ids_{name} WHERE v IS NOT NULL GROUP BY k HAVING count(DISTINCT v) > 1)), 0)
      AS collision_groups,
    count(DISTINCT v) - count(DISTINCT k) AS variant_count FROM ids_{name}"""
    for name in ("contractor", "carrier", "claim_handler", "adjuster", "admin")
)
_IDENTITY_CTE = ", ".join(
    f"""ids_{name} AS (SELECT {sql_clean(f'"{column}"')} AS v,
    regexp_replace(lower({sql_clean(f'"{column}"')}), '[^a-z0-9]+', '', 'g') AS k FROM archive WHERE item_id IS NOT NULL)"""
    for name, column in (
        ("contractor", "contractor"), ("carrier", "carrier"), ("claim_handler", "handler"), ("adjuster", "adjuster"),
        ("admin", "admin"),
    )
)


def _keywords_sql(families: dict[str, str], source: str) -> str:
    def pattern(p: str) -> str:
        # RE2 knows only ASCII word borders, so they are written out
        start = p.replace(r"\b", "\x00")
        parts = start.split("\x00")
        out = parts[0]
        for i, part in enumerate(parts[1:], 1):
            before = parts[i - 1]
            opens = before == "" or before.endswith("|")
            out += (rf"(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])" if opens else rf"(?:$|[^\p{{L}}\p{{N}}\p{{M}}_])") + part
        return out

    return " UNION ALL ".join(
        f"SELECT '{name}' AS family, count(*) FILTER (WHERE regexp_matches(body, '(?i){pattern(p)}')) AS mentions FROM {source}"
        for name, p in families.items()
    )


QUERIES = {
    "column_profile": (column_profile, f"WITH {PROFILE_SQL} SELECT * FROM profiled"),
    "typed_column_profile": (typed_column_profile, EVENTS_PROFILE_SQL),
    "example_values": (example_values, EXAMPLES_SQL),
    "enum_values": (
        enum_values,
        f"""WITH {ARCHIVE}, {CELLS}, v AS (SELECT position, header, value, min(physical_row) AS f FROM cells
        WHERE value <> '' AND NOT sensitive GROUP BY 1, 2, 3)
        SELECT position, header, string_agg(value, '|' ORDER BY f, value) AS enum_values FROM v GROUP BY 1, 2 HAVING count(*) <= 20""",
    ),
    "sheet_profile": (
        sheet_profile,
        f"""WITH {ARCHIVE},{POSTS} SELECT 'export' AS file_name, 'archive' AS sheet, count(*) FILTER (WHERE
        item_id IS NOT NULL OR {sql_clean('name')} IS NOT NULL OR {sql_clean('subtasks')} IS NOT NULL) AS data_rows,
        count(*) FILTER (WHERE item_id IS NULL AND {sql_clean('name')} IS NULL AND {sql_clean('subtasks')} IS NULL) AS blank_rows,
        CAST(22 AS BIGINT) AS columns, CAST(1 AS BIGINT) AS repeated_names FROM archive
        UNION ALL SELECT 'export', 'updates', count(*), 0, 9, 1 FROM posts""",
    ),
    "claim_coverage": (claim_coverage, f"WITH {ARCHIVE}, {CELLS}, {COVERED_SQL} SELECT * FROM covered"),
    "money_stats": (
        money_stats,
        f"""WITH {ARCHIVE}, {CELLS}, {TYPED}, m AS (SELECT position, header, value, any_number AS v FROM typed
        WHERE is_claim AND header IN ({', '.join(f"'{m.header}'" for m in LAYOUT.money)})),
        s AS (SELECT position, header, count(*) FILTER (WHERE value <> '') AS nonblank_count,
        count(*) FILTER (WHERE v = 0) AS zero_count, count(*) FILTER (WHERE v < 0) AS negative_count,
        count(*) FILTER (WHERE value <> '' AND v IS NULL) AS malformed_count, min(v) AS minimum, max(v) AS maximum,
        list_sort(list(v) FILTER (WHERE v IS NOT NULL)) AS l,
        round_even(100.0::DOUBLE * count(*) FILTER (WHERE value <> '') / count(*), 2) AS coverage_percent FROM m GROUP BY 1, 2)
        SELECT * EXCLUDE (l), (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2.0 AS median, 'text' AS representation FROM s""",
    ),
    "identity_profiles": (identity_profiles, f"WITH {ARCHIVE}, {_IDENTITY_CTE} {_IDENTITY}"),
    "key_audit": (
        key_audit,
        f"""WITH {ARCHIVE},{POSTS} SELECT 'archive' AS "table", count(item_id) AS nonblank, count(*) - count(item_id) AS missing,
        count(item_id) - count(DISTINCT item_id) AS duplicate_rows FROM archive
        UNION ALL SELECT 'updates', count(post_id), count(*) - count(post_id), count(post_id) - count(DISTINCT post_id) FROM posts""",
    ),
    "exact_duplicates": (
        exact_duplicates,
        f"""WITH {ARCHIVE}, clean AS (SELECT item_id IS NOT NULL AS is_claim, {', '.join(
            f'''coalesce({sql_clean(f'"{c}"')}, '') AS "{c}"''' for c in ARCHIVE_COLUMNS)} FROM archive)
        SELECT 'archive' AS "table", (SELECT count(*) FROM clean) - (SELECT count(*) FROM (SELECT DISTINCT * FROM clean)) AS duplicate_rows
        UNION ALL SELECT 'claims', (SELECT count(*) FROM clean WHERE is_claim)
          - (SELECT count(*) FROM (SELECT DISTINCT * FROM clean WHERE is_claim))
        UNION ALL SELECT 'documents', count(*) - count(DISTINCT coalesce({sql_clean('text')}, '')) FROM documents""",
    ),
    "update_audit": (
        update_audit,
        f"""WITH {POSTS} SELECT count(*) AS total_rows, count(*) - count(clean_body) AS blank_bodies,
        count(DISTINCT coalesce(author, '')) AS authors_including_blank,
        count(*) FILTER (WHERE author IS NULL OR contains(lower(clean_body), 'outgoing email')
          OR contains(lower(clean_body), 'incoming email') OR contains(lower(clean_body), 'automatically')) AS system_estimate,
        strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM post_bodies""",
    ),
    "keyword_counts": (
        keyword_counts,
        f"""WITH {POSTS}, b AS (SELECT body FROM posts UNION ALL SELECT html FROM pages UNION ALL SELECT text FROM conversations)
        {_keywords_sql(KEYWORD_FAMILIES, 'b')}""",
    ),
    "word_families": (word_families, f"WITH {POSTS} {_keywords_sql(FAMILIES, 'posts')}"),
    "date_audit": (
        date_audit,
        f"""WITH {ARCHIVE}, {CELLS}, {TYPED} SELECT position, header, count(*) AS nonblank_count, count(day) AS parsed_count,
        count(*) - count(day) AS invalid_count, strftime(min(day), '%Y-%m-%d %H:%M:%S') AS earliest,
        strftime(max(day), '%Y-%m-%d %H:%M:%S') AS latest, 'mixed or text' AS representation
        FROM typed WHERE is_claim AND dated AND value <> '' GROUP BY 1, 2""",
    ),
    "service_candidates": (
        service_candidates,
        f"""WITH {ARCHIVE} SELECT count(handler) AS claim_handling_candidates, count(*) - count(handler) AS estimate_only_candidates
        FROM archive WHERE item_id IS NOT NULL""",
    ),
    "acceptance_counts": (
        acceptance,
        f"""WITH {ARCHIVE},{POSTS}, a AS (SELECT item_id AS item, {sql_clean('name')} AS title FROM archive),
        t AS (SELECT (SELECT count(*) FROM a) AS archive_physical_rows, (SELECT count(item) FROM a) AS archive_claim_rows,
        (SELECT count(*) FROM a WHERE title = 'Subitems') AS archive_header_rows,
        (SELECT count(*) FROM a WHERE item IS NULL AND title IS NULL) AS archive_detail_rows,
        (SELECT count(item) FROM a) AS archive_nonblank_item_ids, (SELECT count(DISTINCT item) FROM a) AS archive_unique_item_ids,
        (SELECT count(*) FROM posts) AS update_rows, (SELECT count(post_id) FROM posts) AS updates_nonblank_post_ids,
        (SELECT count(DISTINCT post_id) FROM posts) AS updates_unique_post_ids,
        (SELECT count(DISTINCT item_id) FROM posts) AS updates_unique_item_ids,
        (SELECT count(*) FROM post_bodies WHERE NOT matched) AS orphan_update_rows,
        (SELECT count(*) FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT item_id FROM posts)) AS archive_items_without_updates)
        UNPIVOT t ON COLUMNS(*) INTO NAME measure VALUE actual""",
    ),
    "field_inventory": (
        field_inventory,
        f"""WITH {PROFILE_SQL}, {COVERED_SQL} SELECT p.position, p.header, p.nonblank_count, p.coverage_percent,
        c.coverage_percent AS claim_coverage_percent, concat_ws(' ',
        CASE WHEN p.header LIKE '%\\_\\_2' ESCAPE '\\' THEN 'Repeated header, renamed by its order.' END,
        CASE WHEN whitespace_only_count > 0 THEN whitespace_only_count || ' cells hold only blanks.' END,
        CASE WHEN p.nonblank_count = 0 THEN 'No value at all.' END, 'Read together with the row class.') AS notes
        FROM profiled p LEFT JOIN covered c ON c.position = p.position""",
    ),
}
