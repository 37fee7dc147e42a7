"""Promotion, validation and published-view queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import alias_key, natural_key
from claimloom.operators import filters, gate, joins, merge
from claimloom.operators.explorer import updates_in_order
from claimloom.plans import publish
from claimloom.plans.promotion import ImportJob, Tables, empty_tables, promote
from workload import views
from workload.ingest import ARTIFACT, ISSUES_SQL, SUMMARY_CTE, VERSION, _AMOUNTS, _CLASSED, _FACTS, _UPDATES_FLAGGED, parsed
from workload.views import ARCHIVE, LAYOUT, POSTS, sql_amount, sql_clean, table, text

SYSTEM = "board_export"
JOB = ImportJob(SYSTEM, "all", "export", ARTIFACT, VERSION, "rules-1", "2024-07-01 00:00:00")
_PLANS: dict[tuple[str, str], Tables] = {}
MEASURES = (
    "claims", "complete", "closed", "subitem_headers", "subitem_details", "updates", "unmatched_update_rows", "unmatched_update_item_ids",
    "unique_post_ids", "blank_update_bodies", "duplicate_body_surplus", "exact_matches", "tolerance_matches", "mismatches", "missing_components",
)


def promoted(spark: SparkSession, sf: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PLANS:
        _PLANS[key] = promote(empty_tables(spark), parsed(spark, sf), JOB, LAYOUT)
    return _PLANS[key]


# --- promoted tables --------------------------------------------------------------


def promoted_claims(spark: SparkSession, sf: str) -> DataFrame:
    claims = promoted(spark, sf)["claims"]
    days = ("assigned_date", "closed_date", "status_change_date", "loss_date")
    return claims.select(*[text(F.col(c)).alias(c) if c in days else F.col(c) for c in claims.columns])


def promoted_facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = promoted(spark, sf)["claim_financial_facts"]
    return facts.withColumn("parsed_numeric_value", F.col("parsed_numeric_value").cast("double"))


def promoted_derived(spark: SparkSession, sf: str) -> DataFrame:
    derived = promoted(spark, sf)["claim_derived_metrics"]
    numbers = ("calculated_value", "source_comparison_value", "difference")
    return derived.select(*[F.col(c).cast("double").alias(c) if c in numbers else F.col(c) for c in derived.columns])


def promoted_updates(spark: SparkSession, sf: str) -> DataFrame:
    updates = promoted(spark, sf)["claim_updates"].drop("raw_row", "source_timestamp_raw", "update_body")
    return updates.withColumn("parsed_timestamp", F.date_format("parsed_timestamp", "yyyy-MM-dd HH:mm:ss"))


def promoted_source_rows(spark: SparkSession, sf: str) -> DataFrame:
    return promoted(spark, sf)["source_rows"].drop("raw_row", "row_fingerprint")


def row_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose canonical content occurs more than once."""
    rows = promoted(spark, sf)["source_rows"]
    counts = rows.groupBy("worksheet_id", "row_fingerprint").agg(F.count("*").alias("rows"))
    return counts.agg(
        F.sum("rows").alias("source_rows"),
        F.count("*").alias("distinct_rows"),
        F.count_if(F.length("row_fingerprint") == 64).alias("well_formed"),
    )


def promoted_worksheets(spark: SparkSession, sf: str) -> DataFrame:
    """Worksheets with their header names and stored rows."""
    tables = promoted(spark, sf)
    stored = tables["source_rows"].groupBy("worksheet_id").agg(F.count("*").alias("stored_rows"))
    sheets = tables["source_worksheets"].join(stored, "worksheet_id")
    return sheets.select(
        "worksheet_id", "source_file_id", "file_name", "sheet", "worksheet_index", "header_row", "import_job_id",
        F.array_join("header_map.internal", "|").alias("names"), "stored_rows",
    )


def organizations(spark: SparkSession, sf: str) -> DataFrame:
    return promoted(spark, sf)["organizations"]


def organization_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return promoted(spark, sf)["organization_aliases"]


def people(spark: SparkSession, sf: str) -> DataFrame:
    tables = promoted(spark, sf)
    aliases = tables["person_aliases"].select("person_id", "raw_alias", "normalized_alias")
    return tables["people"].join(aliases, "person_id")


def staged_claims(spark: SparkSession, sf: str) -> DataFrame:
    return promoted(spark, sf)["staged_claim_rows"].drop("raw_values", "normalized_values")


def staged_subitems(spark: SparkSession, sf: str) -> DataFrame:
    tables = promoted(spark, sf)
    heads = tables["staged_subitem_headers"].withColumn("header_row", F.lit(None).cast("bigint"))
    columns = ["source_row", "source_row_id", "parent_item_id", "header_row", "inference_method", "confidence"]
    return heads.select(*columns).unionByName(tables["staged_subitem_details"].select(*columns))


def promoted_issues(spark: SparkSession, sf: str) -> DataFrame:
    found = promoted(spark, sf)["dq_issues"]
    return found.select("deterministic_key", "issue_type", "severity", "source_entity", "import_job_id")


# --- keyed writes on plain tables ----------------------------------------------------


def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Customer names as stored organizations, supplier-side names arriving later.

    A known name takes the new display name and keeps its id; the last arrival
    of a name wins.
    """
    target = table(spark, sf, "customer").select(
        F.lit("contractor").alias("organization_type"),
        alias_key(F.concat(F.lit("Party "), text(F.col("c_custkey")))).alias("normalized_name"),
        F.concat(F.lit("Party "), text(F.col("c_custkey"))).alias("display_name"),
        text(F.col("c_custkey")).alias("organization_id"),
    )
    arriving = table(spark, sf, "orders").select(
        F.lit("contractor").alias("organization_type"),
        F.concat(F.lit("PARTY-"), text(F.col("o_custkey") * 2), F.when(F.col("o_orderstatus") == "F", ".").otherwise("")).alias(
            "display_name"
        ),
        F.col("o_orderkey"),
    )
    named = arriving.withColumn("normalized_name", alias_key(F.rtrim(F.translate("display_name", ".", " "))))
    source = named.withColumn("organization_id", F.concat(F.lit("new-"), "normalized_name"))
    return merge.upsert(
        target, source, ["organization_type", "normalized_name"], ["display_name"], [F.col("o_orderkey")]
    )


def keyed_insert(spark: SparkSession, sf: str) -> DataFrame:
    """First document per source that no event of that key number precedes."""
    target = table(spark, sf, "labels").select(text(F.col("doc_id")).alias("key"), F.col("quality").cast("bigint").alias("value"))
    source = table(spark, sf, "lineitem").select(
        text(F.col("l_orderkey")).alias("key"), F.col("l_linenumber").cast("bigint").alias("value"), "l_partkey", "l_suppkey"
    )
    order = [F.col("value"), F.col("l_partkey"), F.col("l_suppkey")]
    return merge.insert_if_absent(target, source, ["key"], order)


def refused_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as posts, every seventh without an id: stored, refused, and added by a second run, per event type."""
    posts = table(spark, sf, "events").select(
        F.col("event_type").alias("system"),
        F.when(F.col("event_id") % 7 != 0, F.floor(F.col("event_id") / 2)).alias("post_id"),
        "event_id",
    )
    keys, order = ["system", "post_id"], [F.col("event_id")]
    stored = merge.insert_if_absent(posts.limit(0), posts, keys, order)
    again = merge.insert_if_absent(stored, posts, keys, order)
    parts = [
        stored.select("system", F.lit("stored").alias("outcome")),
        merge.without_key(posts, keys).select("system", F.lit("refused").alias("outcome")),
        again.select("system", F.lit("added again").alias("outcome")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("system", "outcome").agg(F.count("*").alias("posts"))


def second_import(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as stored claims of two systems that share item ids; orders arrive with changes and blank carriers.

    A known claim takes the new status, keeps its carrier where the new one is
    blank, and keeps its state; the last row of a repeated order counts.
    """
    system = F.when(F.col("c_custkey") % 2 == 0, "board").otherwise("mail")
    target = table(spark, sf, "customer").select(
        system.alias("system"), F.floor(F.col("c_custkey") / 2).alias("item_id"), F.col("c_mktsegment").alias("carrier"),
        F.lit("stored").alias("status"), F.lit("terminal").alias("state"),
    )
    source = table(spark, sf, "orders").select(
        F.lit("board").alias("system"), F.floor(F.col("o_custkey") / 2).alias("item_id"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("carrier"),
        F.col("o_orderstatus").alias("status"), F.lit("open").alias("state"), "o_orderkey",
    )
    return merge.upsert(
        target, source, ["system", "item_id"], ["carrier", "status"], [F.col("o_orderkey")], keep_if_missing=["carrier"]
    )


def append_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text another version of the table altered or lost."""
    before = table(spark, sf, "documents").select("doc_id", "text", "lang")
    after = before.where(F.col("lang") != "fr").withColumn("text", F.replace("text", F.lit("the "), F.lit("THE ")))
    return merge.changed_rows(before, after, ["doc_id"]).select("doc_id", F.col("hash_after").isNull().alias("lost"))


def source_row_lookup(spark: SparkSession, sf: str) -> DataFrame:
    tables = promoted(spark, sf)
    one = parsed(spark, sf)
    staged = one.claims.select("file_name", "sheet", F.col("source_row").alias("physical_row"), "item_id")
    found = joins.resolve_source_row(staged, tables["source_worksheets"], tables["source_rows"])
    return found.select("item_id", "physical_row", "source_row_id")


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as import jobs, one source per customer."""
    return table(spark, sf, "orders").select(
        text(F.col("o_orderkey")).alias("import_job_id"),
        text(F.col("o_custkey")).alias("source_sha256"),
        F.col("o_orderpriority").alias("importer_version"),
        F.lit("all").alias("source_period"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running").alias(
            "status"
        ),
        F.lit(0).cast("bigint").alias("warning_count"),
        F.lit(0).cast("bigint").alias("error_count"),
        F.lit(None).cast("map<string,bigint>").alias("accepted_counts"),
        F.lit(None).cast("string").alias("last_error"),
    )


def latest_job(spark: SparkSession, sf: str) -> DataFrame:
    return gate.latest_job(_jobs(spark, sf), "all").select("import_job_id", "status")


def latest_job_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return gate.latest_per_source(_jobs(spark, sf), ["source_sha256"]).select("source_sha256", "import_job_id", "status")


def job_restart(spark: SparkSession, sf: str) -> DataFrame:
    """One ledger row per (source, version); sources with an urgent order run again."""
    ledger = merge.one_per_key(_jobs(spark, sf), ["source_sha256", "importer_version"], [F.col("started_at"), F.col("import_job_id")])
    again = ledger.where(F.col("importer_version") == "1-URGENT").withColumn(
        "started_at", F.lit("2030-01-01").cast("timestamp")
    )
    restarted = gate.start_job(ledger, again)
    return restarted.select("import_job_id", "status", F.date_format("started_at", "yyyy-MM-dd").alias("started_on"))


def job_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Running jobs of the lowest priority fail with a message that is cut to its limit."""
    hit = (F.col("status") == "running") & (F.col("importer_version") == "5-LOW")
    message = F.repeat(F.concat(F.lit("job "), "import_job_id", F.lit(" ")), 400)
    failed = gate.fail_jobs(_jobs(spark, sf), hit, message, F.lit("2030-01-02").cast("timestamp"))
    return failed.select("import_job_id", "status", "error_count", F.length("last_error").cast("bigint").alias("message_length"))


def job_finish(spark: SparkSession, sf: str) -> DataFrame:
    """The import's own ledger row after its counts and warnings are in."""
    tables = promoted(spark, sf)
    one = parsed(spark, sf)
    summary = gate.import_summary(one.claims, one.subitem_headers, one.subitem_details, one.updates)
    counts = summary.withColumn("import_job_id", JOB.job_id)
    closed = gate.finalize_job(tables["import_jobs"], counts, tables["dq_issues"], F.lit("2024-07-01 01:00:00").cast("timestamp"))
    return closed.select(
        "import_job_id", "status", "warning_count", "error_count", "run_fingerprint",
        *[F.element_at("accepted_counts", m).alias(m) for m in MEASURES],
    )


def _validation(spark: SparkSession, sf: str) -> DataFrame:
    t = promoted(spark, sf)
    return gate.validation_counts(
        t["import_jobs"], t["claims"], t["staged_subitem_headers"], t["staged_subitem_details"], t["claim_updates"],
        t["claim_derived_metrics"],
    )


def validation_view(spark: SparkSession, sf: str) -> DataFrame:
    return _validation(spark, sf)


def job_consistency(spark: SparkSession, sf: str) -> DataFrame:
    job = gate.latest_job(promoted(spark, sf)["import_jobs"], "all").select("import_job_id", "status")
    return gate.job_matches_summary(job, _validation(spark, sf))


# --- published frames ------------------------------------------------------------------


def financial_sums(spark: SparkSession, sf: str) -> DataFrame:
    sums = publish.financial_sums(promoted(spark, sf)["claim_financial_facts"])
    return sums.withColumn("value", F.col("value").cast("double"))


def live_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = promoted(spark, sf)
    return publish.live_summary(t["claims"], t["claim_financial_facts"], t["claim_derived_metrics"])


_DAYS = ("assigned_date", "closed_date", "status_change_date")
_NUMBERS = ("parsed_numeric_value", "calculated_value", "source_comparison_value", "difference")


def _view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """All columns of one published view, in types that compare across engines."""
    view = publish.published(promoted(spark, sf))[name]

    def shown(column: str) -> Column:
        if column in _DAYS:
            return text(F.col(column)).alias(column)
        if column in _NUMBERS:
            return F.col(column).cast("double").alias(column)
        if column == "parsed_timestamp":
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)
        return F.col(column)

    return view.select(*[shown(c) for c in view.columns])


def published_updates(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "claim_updates")


def published_claims(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "claims")


def published_organizations(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "organizations")


def published_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "claim_financial_facts")


def published_derived(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "claim_derived_metrics")


def published_source_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "source_rows")


def claim_list(spark: SparkSession, sf: str) -> DataFrame:
    return publish.published_claim_list(promoted(spark, sf))


def claim_details(spark: SparkSession, sf: str) -> DataFrame:
    details = publish.claim_details(promoted(spark, sf))
    amounts = F.transform("financial_facts", lambda f: F.concat(f["normalized_metric_name"], F.lit("="), f["source_availability_status"]))
    return details.select(
        "item_id", "contractor", "carrier", F.array_join(amounts, ",").alias("facts"),
        F.array_join("derived_metrics.reconciliation_status", ",").alias("derived"),
    )


def published_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = publish.published_claim_list(promoted(spark, sf))
    found = filters.search_published_claims(rows, "order 1", "Complete", carrier="MACHINERY")
    return found.select("item_id", "display_name", "carrier")


def claim_update_feed(spark: SparkSession, sf: str) -> DataFrame:
    """All updates of one claim, newest first."""
    tables = promoted(spark, sf)
    wanted = natural_key(F.lit(SYSTEM), F.lit("1310"))
    one = publish.published(tables)["claim_updates"].where(F.col("claim_id") == wanted)
    return updates_in_order(one).select("post_id", F.date_format("parsed_timestamp", "yyyy-MM-dd HH:mm:ss").alias("at_time"), "source_row")


# --- SQL twins ---------------------------------------------------------------------------

def _part(value: str) -> str:
    """A part of a natural key, behind its length."""
    return f"length({value}) || ':' || {value}"


def _fixed(value: str) -> str:
    return f"'{len(value)}:{value}'"


_JOB_ID = f"sha256({_fixed(ARTIFACT)} || {_fixed(VERSION)})"
_FILE_ID = f"sha256({_fixed(SYSTEM)} || {_fixed(ARTIFACT)})"


def _sheet_id(index: int) -> str:
    return f"sha256('64:' || {_FILE_ID} || {_fixed(str(index))})"


def _row_id(row: str, index: int = 0) -> str:
    return f"sha256('64:' || {_sheet_id(index)} || {_part(f'CAST({row} AS VARCHAR)')})"


def _alias(column: str) -> str:
    return f"lower(regexp_replace({column}, '[^a-zA-Z0-9]+', ' ', 'g'))"


def _ref(kind: str, column: str) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN sha256({_fixed(kind)} || {_part(_alias(column))}) END"


_CLAIM_ID = f"sha256({_fixed(SYSTEM)} || {_part('item_id')})"
_ROWS = "(SELECT * FROM archive WHERE item_id IS NOT NULL)"
_MOMENT = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?$"


def _day(column: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '{_MOMENT}') THEN substr({column}, 1, 10) END"


_ORGS = """orgs AS (SELECT 'contractor' AS kind, contractor AS name, physical_row FROM archive WHERE contractor IS NOT NULL
  UNION ALL SELECT 'carrier', carrier, physical_row FROM archive WHERE carrier IS NOT NULL)"""

_JOBS_SQL = """jobs AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS source, o_orderpriority AS version,
  o_orderdate AS started, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'running' END
  AS status FROM orders)"""

_LIST = f"""listed AS (SELECT item_id, name AS display_name, {sql_clean('status')} AS raw_status,
  lower(coalesce({sql_clean('status')}, 'unknown')) AS normalized_status, contractor, physical_row,
  (SELECT 1) AS one, carrier AS own_carrier, {_alias('carrier')} AS carrier_key FROM archive WHERE item_id IS NOT NULL),
shown_carrier AS (SELECT {_alias('carrier')} AS carrier_key, last(carrier ORDER BY physical_row) AS carrier FROM archive
  WHERE carrier IS NOT NULL GROUP BY 1)"""

_FACT_ROWS = " UNION ALL ".join(
    f"SELECT item_id, physical_row, '{metric}' AS metric, '{header}' AS header, {position} AS position, \"{column}\" AS raw, "
    f"{sql_amount(chr(34) + column + chr(34))} AS parsed FROM archive WHERE item_id IS NOT NULL"
    for metric, header, position, column in _FACTS
)

_SUMS = f"""f AS ({_FACT_ROWS}), s AS (SELECT metric, coalesce(sum(parsed), 0) AS value, count(parsed) AS available,
  count(*) AS total FROM f GROUP BY 1)"""


def _summary_row(ordinal: int, metric: str, value: str, shape: str, available: str, total: str, confidence: str, source: str,
                 kind: str = "source_provided") -> str:
    return (
        f"SELECT CAST({ordinal} AS BIGINT) AS ordinal, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value, '{shape}' AS format, "
        f"CAST({available} AS BIGINT) AS available, CAST({total} AS BIGINT) AS total, '{confidence}' AS confidence, '{kind}' AS kind "
        f"FROM {source}"
    )


def _money_row(ordinal: int, metric: str, confidence: str) -> str:
    return _summary_row(ordinal, metric, "value", "currency", "available", "total", confidence, f"s WHERE metric = '{metric}'")


LIVE_SQL = f"""WITH {ARCHIVE}, {_AMOUNTS}, {_SUMS}, c AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE {sql_clean('status')} = 'Complete') AS complete,
  count(*) FILTER (WHERE {sql_clean('status')} = 'Closed') AS closed FROM {_ROWS}),
  d AS (SELECT coalesce(sum(c - i), 0) AS value, count(c - i) AS available, count(*) AS total FROM reconciled) """ + " UNION ALL ".join(
    (
        _summary_row(1, "claims", "n", "count", "n", "n", "A", "c"),
        _summary_row(2, "complete", "complete", "count", "n", "n", "A", "c"),
        _summary_row(3, "closed", "closed", "count", "n", "n", "A", "c"),
        _money_row(4, "initial_rcv", "B"),
        _money_row(5, "current_rcv", "A"),
        _money_row(6, "additional_secured", "B"),
        _summary_row(7, "calculated_additional", "value", "currency", "available", "total", "A", "d", "derived"),
        _money_row(8, "client_fee", "B"),
        _summary_row(9, "financial_coverage", "CAST(available AS DOUBLE) / CAST(total AS DOUBLE) * 100.0", "percent",
                     "available", "total", "A", "s WHERE metric = 'initial_rcv'"),
    )
)

_WARNINGS = "(SELECT count(*) FROM issues WHERE severity = 'warning')"

QUERIES = {
    "promoted_claims": (
        promoted_claims,
        f"""WITH {ARCHIVE} SELECT {_CLAIM_ID} AS claim_id, '{SYSTEM}' AS source_system, item_id, name AS display_name,
        {sql_clean('status')} AS raw_status, lower(coalesce({sql_clean('status')}, 'unknown')) AS normalized_status,
        CASE WHEN {sql_clean('status')} IN ('Complete', 'Closed') THEN 'terminal_source_status' END AS lifecycle_state,
        {_ref('contractor', 'contractor')} AS contractor_id, {_ref('carrier', 'carrier')} AS carrier_id,
        {_ref('claim_handler', 'handler')} AS assigned_staff_id, {_day('assigned')} AS assigned_date, {_day('closed')} AS closed_date,
        {_day('changed')} AS status_change_date, {_day('loss')} AS loss_date, CAST(NULL AS VARCHAR) AS service_type,
        CAST(NULL AS VARCHAR) AS property_type, {_JOB_ID} AS import_job_id, {_row_id('physical_row')} AS source_row_id FROM {_ROWS}""",
    ),
    "promoted_facts": (
        promoted_facts,
        f"""WITH {ARCHIVE}, f AS ({_FACT_ROWS}) SELECT {_CLAIM_ID} AS claim_id, metric AS normalized_metric_name,
        {_JOB_ID} AS import_job_id, header AS source_field_name, raw AS raw_value, CAST(parsed AS DOUBLE) AS parsed_numeric_value,
        CASE WHEN parsed IS NULL THEN 'not_captured' ELSE 'captured' END AS source_availability_status, 'archive' AS source_sheet,
        physical_row AS source_row, CAST(position AS BIGINT) AS source_column, 'rules-1' AS transformation_version FROM f""",
    ),
    "promoted_derived": (
        promoted_derived,
        f"""WITH {ARCHIVE}, {_AMOUNTS} SELECT {_CLAIM_ID} AS claim_id, 'calculated_additional_rcv' AS metric_name,
        'additional-rcv-v1' AS metric_version, {_JOB_ID} AS import_job_id, CAST(c - i AS DOUBLE) AS calculated_value,
        CAST(a AS DOUBLE) AS source_comparison_value, status AS reconciliation_status, CAST(c - i - a AS DOUBLE) AS difference,
        CASE WHEN status = 'exact_match' THEN 'A' ELSE 'Limited' END AS confidence FROM reconciled""",
    ),
    "promoted_updates": (
        promoted_updates,
        f"""WITH {POSTS}, {_UPDATES_FLAGGED} SELECT '{SYSTEM}' AS source_system, post_id, item_id,
        CASE WHEN matched THEN {_CLAIM_ID} END AS claim_id, NOT matched AS unmatched_source, clean_body IS NULL AS blank_body,
        fingerprint AS body_fingerprint, repeated AS duplicate_body, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed_timestamp,
        CASE WHEN ts IS NOT NULL THEN 'unknown_timezone' ELSE 'unparseable' END AS timezone_status, author AS author_name,
        'updates' AS source_sheet, physical_row AS source_row, {_JOB_ID} AS import_job_id FROM flagged""",
    ),
    "promoted_source_rows": (
        promoted_source_rows,
        f"""WITH {ARCHIVE},{POSTS}, {_CLASSED} SELECT {_row_id('physical_row')} AS source_row_id, {_sheet_id(0)} AS worksheet_id,
        physical_row, row_class, item AS source_item_id, {_JOB_ID} AS import_job_id FROM cls
        UNION ALL SELECT {_row_id('physical_row', 1)}, {_sheet_id(1)}, physical_row, 'update', item_id, {_JOB_ID} FROM posts""",
    ),
    "row_fingerprints": (
        row_fingerprints,
        f"""WITH {ARCHIVE},{POSTS}, d AS (SELECT count(*) AS rows, 1 AS k FROM (SELECT DISTINCT * EXCLUDE (physical_row) FROM archive)
        UNION ALL SELECT count(*), 2 FROM (SELECT DISTINCT * EXCLUDE (physical_row, ts) FROM posts))
        SELECT CAST((SELECT count(*) FROM archive) + (SELECT count(*) FROM posts) AS BIGINT) AS source_rows,
        CAST(sum(rows) AS BIGINT) AS distinct_rows, CAST(sum(rows) AS BIGINT) AS well_formed FROM d""",
    ),
    "promoted_worksheets": (
        promoted_worksheets,
        f"""WITH {ARCHIVE},{POSTS}, w AS (SELECT * FROM (VALUES (0, 'archive', 5, '{"|".join(
            [n if n else "unnamed_column_21" for n in [*views.ARCHIVE_HEADERS[:16], "CH Update__column_17", *views.ARCHIVE_HEADERS[17:]]]
        )}'), (1, 'updates', 2, '{"|".join([*views.UPDATE_HEADERS[:7], "Content Type__column_8", "unnamed_column_9"])}'))
        v(i, sheet, header_row, names))
        SELECT sha256('64:' || {_FILE_ID} || {_part('CAST(i AS VARCHAR)')}) AS worksheet_id, {_FILE_ID} AS source_file_id, 'export' AS file_name, sheet,
        CAST(i AS BIGINT) AS worksheet_index, CAST(header_row AS BIGINT) AS header_row, {_JOB_ID} AS import_job_id, names,
        CASE i WHEN 0 THEN (SELECT count(*) FROM archive) ELSE (SELECT count(*) FROM posts) END AS stored_rows FROM w""",
    ),
    "organizations": (
        organizations,
        f"""WITH {ARCHIVE}, {_ORGS} SELECT sha256({_part('kind')} || {_part(_alias('name'))}) AS organization_id, kind AS organization_type,
        last(name ORDER BY physical_row) AS display_name, {_alias('name')} AS normalized_name FROM orgs GROUP BY kind, {_alias('name')}""",
    ),
    "organization_aliases": (
        organization_aliases,
        f"""WITH {ARCHIVE}, {_ORGS} SELECT sha256({_part('kind')} || {_part(_alias('name'))}) AS organization_id, '{SYSTEM}' AS source_system,
        first(name ORDER BY physical_row) AS raw_alias, {_alias('name')} AS normalized_alias, {_JOB_ID} AS import_job_id
        FROM orgs GROUP BY kind, {_alias('name')}""",
    ),
    "people": (
        people,
        f"""WITH {ARCHIVE} SELECT sha256({_fixed('claim_handler')} || {_part(_alias('handler'))}) AS person_id, 'claim_handler' AS person_type,
        last(handler ORDER BY physical_row) AS display_name, {_alias('handler')} AS normalized_name,
        first(handler ORDER BY physical_row) AS raw_alias, {_alias('handler')} AS normalized_alias
        FROM archive WHERE handler IS NOT NULL GROUP BY {_alias('handler')}""",
    ),
    "staged_claims": (
        staged_claims,
        f"""WITH {ARCHIVE} SELECT {_JOB_ID} AS import_job_id, item_id AS source_item_id, {_row_id('physical_row')} AS source_row_id,
        {sql_clean('status')} AS raw_status, lower(coalesce({sql_clean('status')}, 'unknown')) AS normalized_status,
        'promoted' AS promotion_status FROM {_ROWS}""",
    ),
    "staged_subitems": (
        staged_subitems,
        f"""WITH {ARCHIVE}, {_CLASSED} SELECT physical_row AS source_row, {_row_id('physical_row')} AS source_row_id,
        parent AS parent_item_id, CASE WHEN row_class = 'subitem_detail' AND (claim_row IS NULL OR last_header > claim_row)
        THEN last_header END AS header_row, CASE WHEN row_class = 'subitem_header' THEN 'preceding_claim_position'
        ELSE 'preceding_claim_and_header_position' END AS inference_method, 'limited' AS confidence
        FROM placed WHERE row_class <> 'claim'""",
    ),
    "promoted_issues": (
        promoted_issues,
        f"{ISSUES_SQL} SELECT deterministic_key, issue_type, severity, source_entity, {_JOB_ID} AS import_job_id FROM issues",
    ),
    "keyed_upsert": (
        keyed_upsert,
        """WITH t AS (SELECT 'party ' || c_custkey AS normalized_name, 'Party ' || c_custkey AS display_name,
        CAST(c_custkey AS VARCHAR) AS organization_id FROM customer),
        s AS (SELECT 'party ' || (o_custkey * 2) AS normalized_name,
        last('PARTY-' || (o_custkey * 2) || CASE WHEN o_orderstatus = 'F' THEN '.' ELSE '' END ORDER BY o_orderkey) AS display_name
        FROM orders GROUP BY 1)
        SELECT 'contractor' AS organization_type, coalesce(t.normalized_name, s.normalized_name) AS normalized_name,
        coalesce(s.display_name, t.display_name) AS display_name, coalesce(organization_id, 'new-' || s.normalized_name) AS organization_id
        FROM t FULL JOIN s ON s.normalized_name = t.normalized_name""",
    ),
    "keyed_insert": (
        keyed_insert,
        """SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(min(l_linenumber) AS BIGINT) AS value FROM lineitem
        WHERE l_orderkey NOT IN (SELECT doc_id FROM labels) GROUP BY 1""",
    ),
    "refused_posts": (
        refused_posts,
        """WITH p AS (SELECT event_type AS system, CASE WHEN event_id % 7 <> 0 THEN event_id // 2 END AS post_id FROM events)
        SELECT system, 'stored' AS outcome, count(DISTINCT post_id) AS posts FROM p WHERE post_id IS NOT NULL GROUP BY 1
        UNION ALL SELECT system, 'refused', count(*) FROM p WHERE post_id IS NULL GROUP BY 1""",
    ),
    "second_import": (
        second_import,
        """WITH t AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'board' ELSE 'mail' END AS system, c_custkey // 2 AS item_id,
        c_mktsegment AS carrier FROM customer), s AS (SELECT o_custkey // 2 AS item_id,
        arg_max(struct_pack(c := CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END, st := o_orderstatus), o_orderkey) AS r
        FROM orders GROUP BY 1)
        SELECT coalesce(t.system, 'board') AS system, coalesce(t.item_id, s.item_id) AS item_id,
        CASE WHEN s.item_id IS NULL THEN t.carrier ELSE coalesce(s.r.c, t.carrier) END AS carrier,
        CASE WHEN s.item_id IS NULL THEN 'stored' ELSE s.r.st END AS status,
        CASE WHEN t.item_id IS NULL THEN 'open' ELSE 'terminal' END AS state
        FROM t FULL JOIN s ON t.system = 'board' AND t.item_id = s.item_id""",
    ),
    "append_guard": (
        append_guard,
        "SELECT doc_id, lang = 'fr' AS lost FROM documents WHERE lang = 'fr' OR contains(text, 'the ')",
    ),
    "source_row_lookup": (
        source_row_lookup,
        f"WITH {ARCHIVE} SELECT item_id, physical_row, {_row_id('physical_row')} AS source_row_id FROM {_ROWS}",
    ),
    "latest_job": (
        latest_job,
        f"WITH {_JOBS_SQL} SELECT id AS import_job_id, status FROM jobs ORDER BY started DESC, id DESC LIMIT 1",
    ),
    "latest_job_per_source": (
        latest_job_per_source,
        f"""WITH {_JOBS_SQL} SELECT source AS source_sha256, id AS import_job_id, status FROM jobs
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY started DESC, id DESC) = 1""",
    ),
    "job_restart": (
        job_restart,
        f"""WITH {_JOBS_SQL}, l AS (SELECT * FROM jobs QUALIFY
        row_number() OVER (PARTITION BY source, version ORDER BY started DESC, id DESC) = 1)
        SELECT id AS import_job_id, CASE WHEN version = '1-URGENT' THEN 'running' ELSE status END AS status,
        CASE WHEN version = '1-URGENT' THEN '2030-01-01' ELSE strftime(started, '%Y-%m-%d') END AS started_on FROM l""",
    ),
    "job_failures": (
        job_failures,
        f"""WITH {_JOBS_SQL} SELECT id AS import_job_id, CASE WHEN hit THEN 'failed' ELSE status END AS status,
        CAST(CASE WHEN hit THEN 1 ELSE 0 END AS BIGINT) AS error_count,
        CAST(CASE WHEN hit THEN least(2000, 400 * (5 + length(id))) END AS BIGINT) AS message_length
        FROM (SELECT *, status = 'running' AND version = '5-LOW' AS hit FROM jobs)""",
    ),
    "job_finish": (
        job_finish,
        f"""{ISSUES_SQL} SELECT {_JOB_ID} AS import_job_id,
        CASE WHEN {_WARNINGS} > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status, {_WARNINGS} AS warning_count,
        CAST(0 AS BIGINT) AS error_count, sha256('{ARTIFACT}:{VERSION}:' || ((SELECT count(*) FROM archive) + (SELECT count(*) FROM posts))
        || ':' || (SELECT count(*) FROM posts)) AS run_fingerprint, {', '.join(
            f"(SELECT actual FROM (WITH {SUMMARY_CTE} SELECT * FROM summary) WHERE measure = '{m}') AS {m}" for m in MEASURES
        )}""",
    ),
    "validation_view": (
        validation_view,
        f"""WITH {SUMMARY_CTE}, n AS (PIVOT summary ON measure IN ('claims', 'complete', 'closed', 'subitem_headers', 'subitem_details',
        'updates', 'unmatched_update_rows', 'unmatched_update_item_ids', 'unique_post_ids', 'exact_matches', 'tolerance_matches',
        'mismatches', 'missing_components') USING any_value(actual))
        SELECT {_JOB_ID} AS import_job_id, 'running' AS import_status, claims AS claim_count, complete AS complete_status_count,
        closed AS closed_status_count, subitem_headers AS staged_subitem_header_count, subitem_details AS staged_subitem_detail_count,
        updates AS update_count, unmatched_update_rows AS unmatched_update_row_count,
        unmatched_update_item_ids AS unmatched_update_item_id_count, unique_post_ids AS unique_post_id_count,
        exact_matches AS additional_exact_match_count, tolerance_matches AS additional_tolerance_only_count,
        mismatches AS additional_mismatch_count, missing_components AS additional_missing_component_count
        FROM (SELECT {', '.join(f"max({m}) AS {m}" for m in (
            'claims', 'complete', 'closed', 'subitem_headers', 'subitem_details', 'updates', 'unmatched_update_rows',
            'unmatched_update_item_ids', 'unique_post_ids', 'exact_matches', 'tolerance_matches', 'mismatches', 'missing_components'
        ))} FROM n)""",
    ),
    "job_consistency": (
        job_consistency,
        f"SELECT {_JOB_ID} AS import_job_id, count(*) > 0 AS available FROM orders",
    ),
    "financial_sums": (
        financial_sums,
        f"""WITH {ARCHIVE}, {_SUMS} SELECT metric AS normalized_metric_name, CAST(value AS DOUBLE) AS value, available, total FROM s""",
    ),
    "live_summary": (live_summary, LIVE_SQL),
    "published_updates": (
        published_updates,
        f"""WITH {POSTS}, {_UPDATES_FLAGGED} SELECT post_id, {_CLAIM_ID} AS claim_id, clean_body AS update_body,
        clean_body IS NULL AS blank_body, repeated AS duplicate_body, {sql_clean('created')} AS source_timestamp_raw,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed_timestamp,
        CASE WHEN ts IS NOT NULL OR {sql_clean('created')} IS NULL THEN 'unknown_timezone' ELSE 'unparseable' END AS timezone_status,
        author AS author_name, 'updates' AS source_sheet, physical_row AS source_row FROM flagged WHERE matched""",
    ),
    "claim_list": (
        claim_list,
        f"""WITH {ARCHIVE}, {_LIST} SELECT {_CLAIM_ID} AS claim_id, item_id, display_name, raw_status, normalized_status, contractor,
        c.carrier, physical_row AS source_row FROM listed l LEFT JOIN shown_carrier c ON c.carrier_key = l.carrier_key""",
    ),
    "claim_details": (
        claim_details,
        f"""WITH {ARCHIVE}, {_AMOUNTS}, {_LIST}, f AS ({_FACT_ROWS}), g AS (SELECT item_id, string_agg(metric || '=' ||
        CASE WHEN parsed IS NULL THEN 'not_captured' ELSE 'captured' END, ',' ORDER BY position) AS facts FROM f GROUP BY 1)
        SELECT l.item_id, contractor, c.carrier, facts, r.status AS derived FROM listed l
        LEFT JOIN shown_carrier c ON c.carrier_key = l.carrier_key JOIN g ON g.item_id = l.item_id
        JOIN reconciled r ON r.item_id = l.item_id""",
    ),
    "published_search": (
        published_search,
        f"""WITH {ARCHIVE}, {_LIST} SELECT item_id, display_name, c.carrier FROM listed l
        LEFT JOIN shown_carrier c ON c.carrier_key = l.carrier_key
        WHERE contains(lower(display_name || ' ' || item_id), 'order 1') AND raw_status = 'Complete' AND c.carrier = 'MACHINERY'""",
    ),
    "claim_update_feed": (
        claim_update_feed,
        f"""WITH {POSTS} SELECT post_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_time, physical_row AS source_row
        FROM post_bodies WHERE item_id = '1310' AND matched""",
    ),
}

# the published views show some columns of tables whose whole rows have twins above
QUERIES |= {
    query: (run, f"SELECT {', '.join(publish.PUBLISHED_COLUMNS[name])} FROM ({QUERIES[twin][1]})")
    for query, run, name, twin in (
        ("published_claims", published_claims, "claims", "promoted_claims"),
        ("published_organizations", published_organizations, "organizations", "organizations"),
        ("published_facts", published_facts, "claim_financial_facts", "promoted_facts"),
        ("published_derived", published_derived, "claim_derived_metrics", "promoted_derived"),
        ("published_source_rows", published_source_rows, "source_rows", "promoted_source_rows"),
    )
}
