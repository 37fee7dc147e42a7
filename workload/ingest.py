"""Import queries: headers, row classes, amounts, dates, matching, issues, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.dates import profile_date
from claimloom.functions.numbers import accounting_number, availability, decimal_amount, minor_units
from claimloom.functions.text import (
    alias_key,
    alias_key_trimmed,
    clean_text,
    identity_key,
    redact_example,
    run_fingerprint,
    sensitivity_class,
)
from claimloom.operators import gate, issues, joins
from claimloom.operators.distributed import OrderKey
from claimloom.operators.reconcile import money_facts, reconcile_audit
from claimloom.operators.rows import row_structure, with_parents, with_row_class
from claimloom.plans.ingest import ParsedImport, parse_import
from claimloom.schema import SUBITEM_LABEL
from claimloom.session import kept
from claimloom.sources import grid as grids
from claimloom.sources import tables as sources
from workload import views
from workload.views import ARCHIVE, LAYOUT, POSTS, sql_amount, sql_clean, sql_number, table, text

VERSION = "loader-1"
ARTIFACT = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
BLOCK = 4096


_PLANS: dict[tuple[str, str], ParsedImport] = {}


def parsed(spark: SparkSession, sf: str) -> ParsedImport:
    """The parse plan of one data folder, built once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PLANS:
        _PLANS[key] = parse_import(views.grid(spark, sf), LAYOUT, block_rows=BLOCK)
    return _PLANS[key]


def _named(spark: SparkSession, sf: str, sheet: str) -> DataFrame:
    # the cells are built once: the filters on them would build them again
    grid = kept(views.grid(spark, sf).where(F.col("sheet") == sheet), "grid")
    heads = LAYOUT.header_rows
    headers = grids.held_headers(grids.positional_headers(grids.header_cells(grid, heads)))
    return grids.named_rows(grids.drop_blank_rows(grids.data_rows(grid, heads)), headers)


# --- headers -------------------------------------------------------------------


def _part_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as header cells, one sheet per brand; small parts have no name."""
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("sheet"),
        F.col("p_partkey").alias("position"),
        F.when(F.col("p_type") != "SMALL", F.col("p_name")).alias("cell"),
    )


def header_names(spark: SparkSession, sf: str) -> DataFrame:
    return grids.positional_headers(_part_headers(spark, sf), ["sheet"])


def header_names_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return grids.ordinal_headers(_part_headers(spark, sf), ["sheet"])


def header_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return grids.repeated_headers(grids.ordinal_headers(_part_headers(spark, sf), ["sheet"]), ["sheet"])


_HEADERS = """h AS (SELECT p_brand AS sheet, p_partkey AS position,
  CASE WHEN p_type <> 'SMALL' THEN p_name END AS cell FROM part)"""


def sheet_extents(spark: SparkSession, sf: str) -> DataFrame:
    return grids.sheet_extents(views.grid(spark, sf))


def shape_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Expected shape from the tables behind the export; the update sheet is expected one row short."""
    longest = table(spark, sf, "conversations").agg(F.max("turn")).scalar()
    stride = F.coalesce(longest, F.lit(0)) + 2
    last = {
        "archive": (
            table(spark, sf, "orders").agg(F.max("o_orderkey")).scalar() * stride + 6,
            table(spark, sf, "conversations").agg(F.max(F.col("conv_id") * stride + F.col("turn"))).scalar() + 7,
        ),
        "updates": (
            table(spark, sf, "events").agg(F.max("event_id")).scalar() * 2 + 3,
            table(spark, sf, "documents").agg(F.max("doc_id")).scalar() * 2 + 4,
        ),
    }
    columns = {"archive": len(views.ARCHIVE_HEADERS), "updates": len(views.UPDATE_HEADERS)}
    sheets = [
        F.struct(
            F.lit(sheet).alias("sheet"),
            (F.greatest(*rows) - (1 if sheet == LAYOUT.updates_sheet else 0)).cast("bigint").alias("expected_last_row"),
            F.lit(columns[sheet]).cast("bigint").alias("expected_columns"),
        )
        for sheet, rows in last.items()
    ]
    expected = spark.range(1).select(F.inline(F.array(*sheets)))
    return grids.shape_gate(views.grid(spark, sf), expected)


def named_archive(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named(spark, sf, LAYOUT.archive_sheet)
    return rows.select(
        "physical_row",
        F.col("row")["Name"].alias("name"),
        F.col("row")["CH Update"].alias("first_note"),
        F.col("row")["CH Update__column_17"].alias("second_note"),
        F.col("row")["unnamed_column_21"].alias("unnamed"),
        F.col("row")["Item ID (auto generated)"].alias("item_id"),
        F.size("row").cast("bigint").alias("fields"),
    )


# --- row classes ----------------------------------------------------------------


def row_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named(spark, sf, LAYOUT.archive_sheet)
    classed = with_row_class(rows, F.col("row")[LAYOUT.item_id], F.col("row")[LAYOUT.name])
    return with_parents(classed, block_rows=BLOCK).select("physical_row", "row_class", "source_item_id", "parent_item_id", "header_row")


_CLASSED = f"""cls AS (SELECT *, {sql_clean('item_id')} AS item, CASE WHEN {sql_clean('item_id')} IS NOT NULL THEN 'claim'
  WHEN {sql_clean('name')} = 'Subitems' THEN 'subitem_header' ELSE 'subitem_detail' END AS row_class FROM archive),
placed AS (SELECT *,
  last_value(item IGNORE NULLS) OVER w AS parent,
  max(CASE WHEN row_class = 'claim' THEN physical_row END) OVER w AS claim_row,
  max(CASE WHEN row_class = 'subitem_header' THEN physical_row END) OVER w AS last_header
  FROM cls WINDOW w AS (ORDER BY physical_row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def structure(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named(spark, sf, LAYOUT.archive_sheet)
    return row_structure(rows, F.col("row")[LAYOUT.item_id], F.col("row")[LAYOUT.name], SUBITEM_LABEL)


def subitems(spark: SparkSession, sf: str) -> DataFrame:
    """Staged header and detail rows with the claim and header above them."""
    one = parsed(spark, sf)
    heads = one.subitem_headers.select("source_row", "parent_item_id", F.lit(None).cast("bigint").alias("header_row"))
    details = one.subitem_details.select("source_row", "parent_item_id", "header_row")
    return heads.unionByName(details)


# --- values ----------------------------------------------------------------------


def facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named(spark, sf, LAYOUT.archive_sheet).where(clean_text(F.col("row")[LAYOUT.item_id]).isNotNull())
    tall = money_facts(rows.withColumn("item_id", F.col("row")[LAYOUT.item_id]), ["item_id"], LAYOUT.money)
    return tall.withColumn("parsed_value", F.col("parsed_value").cast("double"))


_FACTS = (
    ("initial_rcv", "Initial Ins. RCV", 9, "initial"),
    ("requested_rcv", "Requested RCV", 10, "requested"),
    ("current_rcv", "Current Ins. RCV", 11, "current"),
    ("additional_secured", "Additional Secured $", 12, "additional"),
    ("percentage_increase", "Percentage Increase", 13, "percentage"),
    ("client_fee", "Client Fee", 15, "fee"),
)

FACTS_SQL = " UNION ALL ".join(
    f"SELECT item_id, '{metric}' AS metric, '{header}' AS source_field, CAST({position} AS BIGINT) AS source_column, "
    f"\"{column}\" AS raw_value, CAST({sql_amount(chr(34) + column + chr(34))} AS DOUBLE) AS parsed_value, "
    f"CASE WHEN {sql_amount(chr(34) + column + chr(34))} IS NULL THEN 'not_captured' ELSE 'captured' END AS availability "
    "FROM archive WHERE item_id IS NOT NULL"
    for metric, header, position, column in _FACTS
)


def strict_availability(spark: SparkSession, sf: str) -> DataFrame:
    """With the strict option, text that is no number is invalid rather than missing."""
    rows = _named(spark, sf, LAYOUT.archive_sheet).where(clean_text(F.col("row")[LAYOUT.item_id]).isNotNull())
    raw = F.col("row")["Requested RCV"]
    return rows.groupBy(availability(decimal_amount(raw), raw, strict=True).alias("availability")).agg(
        F.count("*").alias("rows")
    )


def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).claims.select(
        "item_id",
        F.col("calculated_additional").cast("double").alias("value"),
        F.col("reconciliation_status").alias("status"),
        F.col("difference").cast("double").alias("difference"),
    )


_AMOUNTS = f"""amounts AS (SELECT item_id, {sql_amount('"initial"')} AS i, {sql_amount('"current"')} AS c,
  {sql_amount('"additional"')} AS a, {sql_amount('percentage')} AS pct, {sql_amount('fee')} AS fee,
  {sql_number('"initial"')} AS ni, {sql_number('"current"')} AS nc, {sql_number('"additional"')} AS na
  FROM archive WHERE item_id IS NOT NULL),
reconciled AS (SELECT *, CASE WHEN i IS NULL OR c IS NULL THEN 'missing_component' WHEN c - i - a = 0 THEN 'exact_match'
  WHEN abs(c - i - a) <= 0.01 THEN 'tolerance_match' ELSE 'mismatch' END AS status FROM amounts)"""


def audit_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named(spark, sf, LAYOUT.archive_sheet).where(clean_text(F.col("row")[LAYOUT.item_id]).isNotNull())
    heads = {"initial": "Initial Ins. RCV", "current": "Current Ins. RCV", "source": "Additional Secured $"}
    # each amount is parsed once, not wherever its status looks at it
    amounts = rows.select(*[accounting_number(F.col("row")[h]).alias(name) for name, h in heads.items()])
    return amounts.groupBy(reconcile_audit(*[F.col(n) for n in heads]).alias("status")).agg(F.count("*").alias("rows"))


def claim_dates(spark: SparkSession, sf: str) -> DataFrame:
    entries = [
        F.struct(
            F.lit(name).alias("field"),
            F.col(f"date_{i}.raw").alias("raw"),
            F.date_format(f"date_{i}.parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"),
            F.col(f"date_{i}.state").alias("state"),
        )
        for i, name in enumerate(LAYOUT.dates)
    ]
    return parsed(spark, sf).claims.select("item_id", F.inline(F.array(*entries)))


def _date_sql(field: str, column: str) -> str:
    iso = r"^\d{4}-\d{2}-\d{2}$"
    moment = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"
    return f"""SELECT item_id, '{field}' AS field, {column} AS raw,
    CASE WHEN regexp_matches({column}, '{iso}') OR regexp_matches({column}, '{moment}')
      THEN strftime(TRY_CAST({column} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS parsed,
    CASE WHEN {column} IS NULL OR {column} = '' OR regexp_matches({column}, '{iso}') THEN 'date_only'
      WHEN regexp_matches({column}, '{moment}') THEN CASE WHEN {column} LIKE '%T00:00:00' THEN 'date_only'
      ELSE 'unknown_timezone' END ELSE 'unparseable' END AS state FROM archive WHERE item_id IS NOT NULL"""


def update_times(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).updates.select(
        "post_id",
        F.col("timestamp_raw").alias("raw"),
        F.date_format("timestamp_parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        F.col("timestamp_state").alias("state"),
    )


def _mixed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates written in every format the profiler reads, by priority."""
    day = F.col("o_orderdate")
    priority = F.col("o_orderpriority")
    serial = text(F.date_diff(F.to_date(day), F.lit("1899-12-30").cast("date")))
    shown = (
        F.when(priority == "1-URGENT", F.date_format(day, "yyyy-MM-dd"))
        .when(priority == "2-HIGH", F.date_format(day, "MM/dd/yyyy"))
        .when(priority == "3-MEDIUM", F.date_format(day, "dd/MMMM/yyyy  hh:mm:ss a"))
        .when(priority == "4-NOT SPECIFIED", F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(serial)
    )
    return table(spark, sf, "orders").select("o_orderkey", shown.alias("shown"))


def mixed_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_dates(spark, sf).select(
        "o_orderkey",
        F.date_format(profile_date(F.col("shown"), serial_numbers=True), "yyyy-MM-dd HH:mm:ss").alias("with_serials"),
        F.date_format(profile_date(F.col("shown")), "yyyy-MM-dd HH:mm:ss").alias("text_only"),
    )


def amount_parses(spark: SparkSession, sf: str) -> DataFrame:
    """The two amount readings side by side; they differ on parentheses."""
    rows = _named(spark, sf, LAYOUT.archive_sheet).where(clean_text(F.col("row")[LAYOUT.item_id]).isNotNull())
    raw = F.col("row")["Initial Ins. RCV"]
    return rows.select(
        F.col("row")[LAYOUT.item_id].alias("item_id"),
        decimal_amount(raw).cast("double").alias("importer_value"),
        accounting_number(raw).alias("accounting_value"),
        minor_units(decimal_amount(raw)).alias("minor_units"),
    )


def alias_forms(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit(" "), F.col("c_name"), F.lit(" & Söhne-"), F.col("c_mktsegment"), F.lit("!"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        alias_key(name).alias("alias"),
        alias_key_trimmed(name).alias("alias_trimmed"),
        identity_key(name).alias("identity"),
    )


def claim_texts(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).claims.select(
        "item_id", "display_name", "raw_status", "normalized_status", "contractor", "carrier", "claim_handler"
    )


def body_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).updates.select("post_id", "blank_body", "body_fingerprint", "duplicate_body")


def duplicate_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return joins.duplicate_bodies(parsed(spark, sf).updates)


def body_surplus(spark: SparkSession, sf: str) -> DataFrame:
    return joins.duplicate_body_surplus(parsed(spark, sf).updates)


def run_identity(spark: SparkSession, sf: str) -> DataFrame:
    one = parsed(spark, sf)
    rows = one.source_rows.agg(F.count("*").alias("rows"))
    n_updates = one.updates.agg(F.count("*")).scalar()
    fingerprint = run_fingerprint(F.lit(ARTIFACT), F.lit(VERSION), F.col("rows"), n_updates)
    return rows.select(fingerprint.alias("run_fingerprint"))


def redacted_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Customer columns and whole document texts under headers of every class."""
    customers = table(spark, sf, "customer").select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(header).alias("header"), text(F.col(column)).alias("value"))
                    for header, column in (
                        ("Adjuster Email", "c_name"), ("Phone extension", "c_custkey"), ("Site address", "c_name"),
                        ("Homeowner", "c_name"), ("Invoice total", "c_acctbal"), ("Segment", "c_mktsegment"),
                    )
                ]
            )
        )
    )
    documents = table(spark, sf, "documents").select(F.lit("Body").alias("header"), F.col("text").alias("value"))
    both = customers.unionByName(documents)
    header = F.col("header")
    shown = both.select(
        "header", redact_example(header, F.col("value")).alias("example"), sensitivity_class(header).alias("sensitivity")
    )
    return shown.groupBy("header", "example", "sensitivity").agg(F.count("*").alias("rows"))


# --- matching ---------------------------------------------------------------------


def matched_updates(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).updates.select("post_id", "item_id", "matched")


def update_claims(spark: SparkSession, sf: str) -> DataFrame:
    one = parsed(spark, sf)
    known = one.claims.select("item_id", F.concat(F.lit("claim-"), "item_id").alias("claim_id"))
    return joins.lookup_claim(one.updates.select("post_id", "item_id"), known).select("post_id", "claim_id")


def orphan_counts(spark: SparkSession, sf: str) -> DataFrame:
    one = parsed(spark, sf)
    return joins.orphan_counts(one.updates, one.claims)


def unmatched_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Claims without updates and updates without claims, by direction."""
    one = parsed(spark, sf)
    silent = joins.unmatched_ids(one.claims, one.updates, "item_id").withColumn("direction", F.lit("claim_without_update"))
    orphan = joins.unmatched_ids(one.updates, one.claims, "item_id").withColumn("direction", F.lit("update_without_claim"))
    return silent.unionByName(orphan)


def reply_threads(spark: SparkSession, sf: str) -> DataFrame:
    posts = parsed(spark, sf).updates.select("post_id", "item_id", "parent_post_id", "author")
    return joins.reply_threads(posts).select("post_id", "parent_post_id", "parent_author", "thread_role")


# --- issues and gate ----------------------------------------------------------------


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    one = parsed(spark, sf)
    return issues.all_issues(
        one.claims, one.updates, grids.repeated_headers(one.headers), one.subitem_details, "all"
    )


def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    return _issues(spark, sf).select("deterministic_key", "issue_type", "severity", "source_entity", "status")


def issue_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return issues.issue_rollup(_issues(spark, sf))


_UPDATES_FLAGGED = """flagged AS (SELECT *, fingerprint IS NOT NULL AND count(*) OVER (PARTITION BY fingerprint) > 1 AS repeated
  FROM post_bodies)"""

ISSUES_SQL = f"""WITH {ARCHIVE},{POSTS}, {_UPDATES_FLAGGED}, {_CLASSED}, {_AMOUNTS},
issues AS (
  SELECT 'missing-initial-rcv:' || item_id AS deterministic_key, 'missing_initial_rcv' AS issue_type, 'warning' AS severity,
    'claim' AS source_entity FROM reconciled WHERE status = 'missing_component'
  UNION ALL SELECT 'extreme-percentage:' || item_id, 'extreme_percentage_value', 'warning', 'claim' FROM amounts WHERE pct >= 4510
  UNION ALL SELECT 'unmatched-update:' || post_id, 'unmatched_update_item_id', 'warning', 'claim_update' FROM flagged WHERE NOT matched
  UNION ALL SELECT 'blank-update:' || post_id, 'blank_update_body', 'info', 'claim_update' FROM flagged WHERE clean_body IS NULL
  UNION ALL SELECT DISTINCT 'duplicate-update-body:' || fingerprint, 'duplicate_update_body', 'info', 'claim_update'
    FROM flagged WHERE repeated
  UNION ALL VALUES ('duplicate-header:archive:ch-update', 'duplicate_header_disambiguation', 'info', 'worksheet'),
    ('duplicate-header:updates:content-type', 'duplicate_header_disambiguation', 'info', 'worksheet'),
    ('timezone:all', 'unknown_timezone', 'warning', 'import_job')
  UNION ALL SELECT 'subitems:all', 'unresolved_subitem_meaning', 'warning', 'staging'
    FROM (SELECT count(*) AS n FROM cls WHERE row_class = 'subitem_detail') WHERE n > 0)"""

SUMMARY_CTE = f"""{ARCHIVE},{POSTS}, {_UPDATES_FLAGGED}, {_CLASSED}, {_AMOUNTS},
statuses AS (SELECT {sql_clean('status')} AS raw_status FROM archive WHERE item_id IS NOT NULL),
summary AS (
  SELECT 'claims' AS measure, count(*) AS actual FROM statuses
  UNION ALL SELECT 'complete', count(*) FROM statuses WHERE raw_status = 'Complete'
  UNION ALL SELECT 'closed', count(*) FROM statuses WHERE raw_status = 'Closed'
  UNION ALL SELECT 'subitem_headers', count(*) FROM cls WHERE row_class = 'subitem_header'
  UNION ALL SELECT 'subitem_details', count(*) FROM cls WHERE row_class = 'subitem_detail'
  UNION ALL SELECT 'updates', count(*) FROM flagged
  UNION ALL SELECT 'unmatched_update_rows', count(*) FROM flagged WHERE NOT matched
  UNION ALL SELECT 'unmatched_update_item_ids', count(DISTINCT item_id) FROM flagged WHERE NOT matched
  UNION ALL SELECT 'unique_post_ids', count(DISTINCT post_id) FROM flagged
  UNION ALL SELECT 'blank_update_bodies', count(*) FROM flagged WHERE clean_body IS NULL
  UNION ALL SELECT 'duplicate_body_surplus', count(fingerprint) - count(DISTINCT fingerprint) FROM flagged
  UNION ALL SELECT 'exact_matches', count(*) FROM reconciled WHERE status = 'exact_match'
  UNION ALL SELECT 'tolerance_matches', count(*) FROM reconciled WHERE status = 'tolerance_match'
  UNION ALL SELECT 'mismatches', count(*) FROM reconciled WHERE status = 'mismatch'
  UNION ALL SELECT 'missing_components', count(*) FROM reconciled WHERE status = 'missing_component')"""


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    one = parsed(spark, sf)
    return gate.import_summary(one.claims, one.subitem_headers, one.subitem_details, one.updates)


def import_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf)


def _expected(spark: SparkSession, sf: str) -> DataFrame:
    """All fifteen expected counts straight from the tables; one of them is wrong on purpose."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("lines")).distinct()
    priority = F.col("o_orderpriority")
    # an initial amount in brackets, or a current one without lines, is a missing component; a missing additional amount is a mismatch
    complete = (F.col("o_orderstatus") != "P") & F.coalesce("lines", F.lit(False))
    off = priority.isin("1-URGENT", "4-NOT SPECIFIED")
    orders = table(spark, sf, "orders").join(lines, "o_orderkey", "left").agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("o_orderstatus") == "F").alias("complete"),
        F.count_if(F.col("o_orderstatus") == "P").alias("closed"),
        F.count_if(~complete).alias("missing_components"),
        F.count_if(complete & (priority == "3-MEDIUM")).alias("tolerance_matches"),
        F.count_if(complete & off).alias("mismatches"),
        F.count_if(complete & ~off & (priority != "3-MEDIUM")).alias("exact_matches"),
    )
    turns = table(spark, sf, "conversations").agg(
        F.count_if(F.col("role") == "user").alias("subitem_headers"),
        (F.count_if(F.col("role") != "user") + 1).alias("subitem_details"),
    )
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    posts = table(spark, sf, "events").select(
        (F.col("user_id") * 131).alias("o_orderkey"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("body")
    ).unionByName(table(spark, sf, "documents").select(F.col("doc_id").alias("o_orderkey"), F.when(body != "", body).alias("body")))
    counts = posts.agg(
        F.count("*").alias("updates"), F.count("*").alias("unique_post_ids"), F.count_if(F.col("body").isNull()).alias("blank_update_bodies"),
        (F.count("body") - F.count_distinct("body")).alias("duplicate_body_surplus"),
    )
    strangers = posts.join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "left_anti").agg(
        F.count("*").alias("unmatched_update_rows"), F.count_distinct("o_orderkey").alias("unmatched_update_item_ids")
    )
    rows = None
    for frame in (orders, turns, counts, strangers):
        entries = [F.struct(F.lit(c).alias("measure"), F.col(c).alias("expected")) for c in frame.columns]
        part = frame.select(F.inline(F.array(*entries)))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def import_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gate.compare_counts(_summary(spark, sf), _expected(spark, sf))


def gate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return gate.gate_verdict(gate.compare_counts(_summary(spark, sf), _expected(spark, sf)))


_EXPECTED = r"""expected_orders AS (SELECT *, o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') AS off, o_orderstatus <> 'P'
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem) AS whole FROM orders),
expected_posts AS (
  SELECT user_id * 131 AS item, CASE WHEN event_type <> 'view' THEN event_type END AS body FROM events
  UNION ALL SELECT doc_id, nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') FROM documents),
expected AS (
  SELECT 'claims' AS measure, count(*) AS expected FROM orders
  UNION ALL SELECT 'complete', count(*) FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'closed', count(*) FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'missing_components', count(*) FROM expected_orders WHERE NOT whole
  UNION ALL SELECT 'tolerance_matches', count(*) FROM expected_orders WHERE whole AND o_orderpriority = '3-MEDIUM'
  UNION ALL SELECT 'mismatches', count(*) FROM expected_orders WHERE whole AND off
  UNION ALL SELECT 'exact_matches', count(*) FROM expected_orders WHERE whole AND NOT off AND o_orderpriority <> '3-MEDIUM'
  UNION ALL SELECT 'subitem_headers', count(*) FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'subitem_details', count(*) + 1 FROM conversations WHERE role <> 'user'
  UNION ALL SELECT 'updates', count(*) FROM expected_posts
  UNION ALL SELECT 'unique_post_ids', count(*) FROM expected_posts
  UNION ALL SELECT 'blank_update_bodies', count(*) FROM expected_posts WHERE body IS NULL
  UNION ALL SELECT 'duplicate_body_surplus', count(body) - count(DISTINCT body) FROM expected_posts
  UNION ALL SELECT 'unmatched_update_rows', count(*) FROM expected_posts WHERE item NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'unmatched_update_item_ids', count(DISTINCT item) FROM expected_posts WHERE item NOT IN (SELECT o_orderkey FROM orders))"""


def batch_count(spark: SparkSession, sf: str) -> DataFrame:
    one = parsed(spark, sf)
    frames = {
        "source_rows": one.source_rows, "claims": one.claims, "subitem_headers": one.subitem_headers,
        "subitem_details": one.subitem_details, "updates": one.updates,
    }
    counts = None
    for phase, frame in frames.items():
        part = frame.agg(F.count("*").alias("rows")).select(F.lit(phase).alias("phase"), "rows")
        counts = part if counts is None else counts.unionByName(part)
    return sources.batch_count(counts)


def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey")
    return sources.batch_summary(sources.batch_plan(rows, [OrderKey(F.col("o_orderkey"))], "claims", range_rows=BLOCK))


_REDACT = """r AS (SELECT 'Adjuster Email' AS header, c_name AS value FROM customer
  UNION ALL SELECT 'Phone extension', CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'Site address', c_name FROM customer UNION ALL SELECT 'Homeowner', c_name FROM customer
  UNION ALL SELECT 'Invoice total', CAST(c_acctbal AS VARCHAR) FROM customer
  UNION ALL SELECT 'Segment', c_mktsegment FROM customer UNION ALL SELECT 'Body', text FROM documents)"""

QUERIES = {
    "header_names": (
        header_names,
        f"""WITH {_HEADERS}, n AS (SELECT sheet, position, coalesce(cell, 'unnamed_column_' || position) AS raw FROM h)
        SELECT sheet, position, raw, CASE WHEN row_number() OVER (PARTITION BY sheet, raw ORDER BY position) = 1 THEN raw
        ELSE raw || '__column_' || position END AS internal FROM n""",
    ),
    "header_names_ordinal": (
        header_names_ordinal,
        f"""WITH {_HEADERS}, n AS (SELECT sheet, position, coalesce(cell, 'Unnamed_' || position) AS raw FROM h),
        c AS (SELECT *, row_number() OVER (PARTITION BY sheet, raw ORDER BY position) AS nth FROM n)
        SELECT sheet, position, raw, CASE WHEN nth = 1 THEN raw ELSE raw || '__' || nth END AS internal FROM c""",
    ),
    "header_repeats": (
        header_repeats,
        f"""WITH {_HEADERS} SELECT sheet, cell AS raw, count(*) AS occurrences FROM h WHERE cell IS NOT NULL
        GROUP BY 1, 2 HAVING count(*) > 1""",
    ),
    "sheet_extents": (
        sheet_extents,
        f"""WITH {ARCHIVE},{POSTS} SELECT 'export' AS file_name, 'archive' AS sheet, max(physical_row) AS last_row,
        CAST(22 AS BIGINT) AS columns FROM archive
        UNION ALL SELECT 'export', 'updates', max(physical_row), 9 FROM posts""",
    ),
    "shape_gate": (
        shape_gate,
        f"""WITH {ARCHIVE},{POSTS}, e AS (SELECT 'archive' AS sheet, max(physical_row) AS last_row, CAST(22 AS BIGINT) AS columns,
        0 AS short FROM archive UNION ALL SELECT 'updates', max(physical_row), 9, 1 FROM posts)
        SELECT sheet, last_row, columns, last_row - short AS expected_last_row, columns AS expected_columns, short = 0 AS passes FROM e""",
    ),
    "named_archive": (
        named_archive,
        f"""WITH {ARCHIVE} SELECT physical_row, name, note AS first_note, note2 AS second_note, empty AS unnamed, item_id,
        CAST(22 AS BIGINT) AS fields FROM archive""",
    ),
    "row_classes": (
        row_classes,
        f"""WITH {ARCHIVE}, {_CLASSED} SELECT physical_row, row_class, item AS source_item_id,
        CASE WHEN row_class <> 'claim' THEN parent END AS parent_item_id,
        CASE WHEN row_class = 'subitem_detail' AND (claim_row IS NULL OR last_header > claim_row) THEN last_header END AS header_row
        FROM placed""",
    ),
    "row_structure": (
        structure,
        f"""WITH {ARCHIVE}, a AS (SELECT {sql_clean('item_id')} AS item, {sql_clean('name')} AS title FROM archive),
        t AS (SELECT count(*) AS physical_rows, count(item) AS claim_rows, count(*) FILTER (WHERE title = 'Subitems') AS header_rows,
        count(*) FILTER (WHERE item IS NULL AND title IS NULL) AS detail_rows FROM a)
        SELECT *, physical_rows = claim_rows + header_rows + detail_rows AS reconciles FROM t""",
    ),
    "subitems": (
        subitems,
        f"""WITH {ARCHIVE}, {_CLASSED} SELECT physical_row AS source_row, parent AS parent_item_id,
        CASE WHEN row_class = 'subitem_detail' AND (claim_row IS NULL OR last_header > claim_row) THEN last_header END AS header_row
        FROM placed WHERE row_class <> 'claim'""",
    ),
    "money_facts": (facts, f"WITH {ARCHIVE} {FACTS_SQL}"),
    "strict_availability": (
        strict_availability,
        f"""WITH {ARCHIVE}, a AS (SELECT CASE WHEN {sql_amount('requested')} IS NOT NULL THEN 'captured'
        WHEN {sql_clean('requested')} IS NOT NULL THEN 'invalid' ELSE 'not_captured' END AS availability
        FROM archive WHERE item_id IS NOT NULL) SELECT availability, count(*) AS rows FROM a GROUP BY 1""",
    ),
    "reconciliation": (
        reconciliation,
        f"""WITH {ARCHIVE}, {_AMOUNTS} SELECT item_id, CAST(c - i AS DOUBLE) AS value, status,
        CAST(c - i - a AS DOUBLE) AS difference FROM reconciled""",
    ),
    "audit_reconciliation": (
        audit_reconciliation,
        f"""WITH {ARCHIVE}, {_AMOUNTS}, s AS (SELECT CASE WHEN ni IS NULL OR nc IS NULL OR na IS NULL THEN 'missing_component'
        WHEN abs(nc - ni - na) < 0.005::DOUBLE THEN 'exact_match' WHEN abs(nc - ni - na) <= 1.0 THEN 'tolerance_match'
        ELSE 'mismatch' END AS status FROM amounts) SELECT status, count(*) AS rows FROM s GROUP BY 1""",
    ),
    "claim_dates": (
        claim_dates,
        f"WITH {ARCHIVE} "
        + " UNION ALL ".join(
            _date_sql(f, c)
            for f, c in zip(LAYOUT.dates, ("assigned", "closed", "changed", "loss"))
        ),
    ),
    "update_times": (
        update_times,
        f"""WITH {POSTS} SELECT post_id, {sql_clean('created')} AS raw, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed,
        CASE WHEN ts IS NOT NULL THEN 'unknown_timezone' ELSE 'unparseable' END AS state FROM posts""",
    ),
    "mixed_dates": (
        mixed_dates,
        """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS with_serials,
        CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS text_only FROM orders""",
    ),
    "amount_parses": (
        amount_parses,
        f"""WITH {ARCHIVE} SELECT item_id, CAST({sql_amount('"initial"')} AS DOUBLE) AS importer_value,
        {sql_number('"initial"')} AS accounting_value, CAST(round({sql_amount('"initial"')} * 100) AS BIGINT) AS minor_units
        FROM archive WHERE item_id IS NOT NULL""",
    ),
    "alias_forms": (
        alias_forms,
        """WITH n AS (SELECT c_custkey, ' ' || c_name || ' & Söhne-' || c_mktsegment || '!' AS name FROM customer)
        SELECT c_custkey, lower(regexp_replace(name, '[^a-zA-Z0-9]+', ' ', 'g')) AS alias,
        trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS alias_trimmed,
        regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS identity FROM n""",
    ),
    "claim_texts": (
        claim_texts,
        f"""WITH {ARCHIVE} SELECT item_id, name AS display_name, {sql_clean('status')} AS raw_status,
        lower(coalesce({sql_clean('status')}, 'unknown')) AS normalized_status, contractor, carrier, handler AS claim_handler
        FROM archive WHERE item_id IS NOT NULL""",
    ),
    "body_fingerprints": (
        body_fingerprints,
        f"""WITH {POSTS}, {_UPDATES_FLAGGED} SELECT post_id, clean_body IS NULL AS blank_body, fingerprint AS body_fingerprint,
        repeated AS duplicate_body FROM flagged""",
    ),
    "duplicate_bodies": (
        duplicate_bodies,
        f"""WITH {POSTS} SELECT fingerprint AS body_fingerprint, count(*) AS body_rows FROM post_bodies
        WHERE fingerprint IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    ),
    "body_surplus": (
        body_surplus,
        f"WITH {POSTS} SELECT count(fingerprint) - count(DISTINCT fingerprint) AS duplicate_body_surplus FROM post_bodies",
    ),
    "run_identity": (
        run_identity,
        f"""WITH {ARCHIVE},{POSTS} SELECT sha256('{ARTIFACT}:{VERSION}:' ||
        ((SELECT count(*) FROM archive) + (SELECT count(*) FROM posts)) || ':' || (SELECT count(*) FROM posts)) AS run_fingerprint""",
    ),
    "redacted_examples": (
        redacted_examples,
        f"""WITH {_REDACT}, s AS (SELECT header, CASE header WHEN 'Adjuster Email' THEN '[REDACTED EMAIL]'
        WHEN 'Phone extension' THEN '[REDACTED PHONE]' WHEN 'Site address' THEN '[REDACTED ADDRESS]'
        WHEN 'Homeowner' THEN '[REDACTED PERSON/IDENTITY]' ELSE
        CASE WHEN length({sql_clean('value')}) > 100 THEN substr(replace({sql_clean('value')}, chr(13), chr(10)), 1, 97) || '...'
        ELSE {sql_clean('value')} END END AS example,
        CASE WHEN header IN ('Invoice total') THEN 'Financial' WHEN header IN ('Segment', 'Body') THEN 'Operational' ELSE 'PII' END
        AS sensitivity FROM r) SELECT header, example, sensitivity, count(*) AS rows FROM s GROUP BY 1, 2, 3""",
    ),
    "matched_updates": (matched_updates, f"WITH {POSTS} SELECT post_id, item_id, matched FROM post_bodies"),
    "update_claims": (
        update_claims,
        f"WITH {POSTS} SELECT post_id, CASE WHEN matched THEN 'claim-' || item_id END AS claim_id FROM post_bodies",
    ),
    "orphan_counts": (
        orphan_counts,
        f"""WITH {POSTS} SELECT count(*) FILTER (WHERE NOT matched) AS orphan_update_rows,
        count(DISTINCT item_id) FILTER (WHERE NOT matched) AS orphan_item_ids,
        (SELECT count(*) FROM orders) - count(DISTINCT item_id) FILTER (WHERE matched) AS claims_without_updates FROM post_bodies""",
    ),
    "unmatched_ids": (
        unmatched_ids,
        f"""WITH {POSTS} SELECT CAST(o_orderkey AS VARCHAR) AS item_id, 'claim_without_update' AS direction FROM orders
        WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT item_id FROM posts)
        UNION ALL SELECT DISTINCT item_id, 'update_without_claim' FROM post_bodies WHERE NOT matched""",
    ),
    "reply_threads": (
        reply_threads,
        f"""WITH {POSTS} SELECT a.post_id, a.parent_post_id, b.author AS parent_author, CASE WHEN a.parent_post_id IS NULL THEN 'root'
        WHEN b.post_id IS NOT NULL THEN 'reply' ELSE 'orphan_reply' END AS thread_role
        FROM posts a LEFT JOIN posts b ON b.post_id = a.parent_post_id AND b.item_id = a.item_id""",
    ),
    "quality_issues": (
        quality_issues,
        f"{ISSUES_SQL} SELECT deterministic_key, issue_type, severity, source_entity, 'pending' AS status FROM issues",
    ),
    "issue_rollup": (
        issue_rollup,
        f"{ISSUES_SQL} SELECT issue_type, severity, 'pending' AS status, count(*) AS issues FROM issues GROUP BY 1, 2",
    ),
    "import_summary": (import_summary, f"WITH {SUMMARY_CTE} SELECT measure, actual FROM summary"),
    "import_gate": (
        import_gate,
        f"""WITH {SUMMARY_CTE}, {_EXPECTED}, j AS (SELECT measure, expected, actual, expected IS NOT DISTINCT FROM actual AS passes
        FROM expected FULL JOIN summary USING (measure))
        SELECT *, CASE WHEN NOT passes THEN measure || ': expected ' || coalesce(CAST(expected AS VARCHAR), 'none') || ', found '
        || coalesce(CAST(actual AS VARCHAR), 'none') END AS message FROM j""",
    ),
    "gate_verdict": (
        gate_verdict,
        f"""WITH {SUMMARY_CTE}, {_EXPECTED}, j AS (SELECT expected IS NOT DISTINCT FROM actual AS passes
        FROM expected FULL JOIN summary USING (measure))
        SELECT bool_and(passes) AS accepted, count(*) FILTER (WHERE NOT passes) AS failed_measures FROM j""",
    ),
    "batch_count": (
        batch_count,
        f"""WITH {SUMMARY_CTE}, n AS (SELECT (SELECT count(*) FROM archive) + (SELECT count(*) FROM posts) AS source_rows)
        SELECT CAST(ceil(source_rows / 250.0)
        + (SELECT sum(ceil(actual / CASE measure WHEN 'claims' THEN 25.0 WHEN 'updates' THEN 250.0 ELSE 100.0 END)) FROM summary
           WHERE measure IN ('claims', 'subitem_headers', 'subitem_details', 'updates')) + 1 AS BIGINT) AS batch_count FROM n""",
    ),
    "batch_plan": (
        batch_plan,
        """WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS ordinal FROM orders),
        b AS (SELECT ordinal, CAST(ceil(ordinal / 25.0) AS BIGINT) AS batch FROM p)
        SELECT 'claims' AS phase, batch, min(ordinal) - 1 AS batch_offset, count(*) AS batch_size FROM b GROUP BY batch""",
    ),
}
