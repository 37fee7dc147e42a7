"""Queries over stored tables: bucket merges, imports one after the other, versions and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from claimloom.operators.lifecycle import spliced_ranges
from claimloom.plans.ingest import ParsedImport, parse_import
from claimloom.plans.promotion import ImportJob, PromotedStore, empty_tables, promote, staged
from claimloom.session import forget, shuffles_removed, work_folder
from claimloom.sources.buckets import BucketTable
from claimloom.streaming.landing import run_refused, run_stateful
from workload import ingest, serving, views
from workload.serving import JOB, SYSTEM
from workload.views import LAYOUT, Changed, table

EVENT_BUCKETS = 64
EVENT_TABLE = "event_id bigint, user_id bigint, event_type string, value double"


def _stored_events(spark: SparkSession, sf: str) -> tuple[BucketTable, DataFrame]:
    """Events up to ten minutes before the last one in a bucket table, and the batch that comes after.

    The batch has the events of the last ten minutes and corrects, for each of
    them, the event with half its number.
    """
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    end = table(spark, sf, "events").agg(F.max("ts")).scalar()
    late = F.col("ts") > end - F.expr("INTERVAL 10 MINUTES")
    stored = BucketTable(spark, work_folder(spark, "events"), EVENT_TABLE, ["event_id"], EVENT_BUCKETS)
    stored.merge(events.where(~late).drop("ts"), replace=None)
    last = events.where(late)
    corrected = last.select(
        F.expr("event_id div 2").alias("event_id"), "user_id", F.lit("corrected").alias("event_type"), (F.col("value") + 1).alias("value")
    )
    return stored, last.drop("ts").unionByName(corrected)


def _per_bucket(stored: BucketTable, version: int) -> DataFrame:
    return stored.manifest(version).select("bucket", F.col("folder"), F.col("rows"))


def bucket_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The last ten minutes of events merged into a table of 64 buckets: what was rewritten, and what is there now."""
    stored, batch = _stored_events(spark, sf)
    before = stored.version()
    done = stored.merge(batch, ["event_type", "value"], order=[F.col("event_type") == "corrected", F.col("value")])
    old = _per_bucket(stored, before).withColumnsRenamed({"folder": "old_folder", "rows": "rows_before"})
    new = _per_bucket(stored, done.version).withColumnsRenamed({"rows": "rows_after"})
    cents = stored.read().groupBy(stored.bucket().alias("bucket")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
        F.count_if(F.col("event_type") == "corrected").alias("corrected"),
    )
    rewritten = F.col("bucket").isin(*done.rewritten)
    return new.join(old, "bucket", "left").join(cents, "bucket").select(
        F.col("bucket").cast("bigint").alias("bucket"), F.coalesce("rows_before", F.lit(0)).alias("rows_before"), "rows_after", "cents",
        "corrected", rewritten.alias("rewritten"), F.col("folder").eqNullSafe(F.col("old_folder")).alias("same_files"),
    )


BUCKET_SQL = f"CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % {EVENT_BUCKETS}"

_BATCH_SQL = """late AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE),
batch AS (
  SELECT event_id, arg_max(event_type, (fixed, value)) AS event_type, arg_max(value, (fixed, value)) AS value
  FROM (SELECT event_id, event_type, value, false AS fixed FROM late
        UNION ALL SELECT event_id // 2, 'corrected', value + 1, true FROM late)
  GROUP BY event_id
), stored AS (SELECT event_id, event_type, value FROM events WHERE event_id NOT IN (SELECT event_id FROM late)),
merged AS (
  SELECT event_id, coalesce(b.event_type, s.event_type) AS event_type, coalesce(b.value, s.value) AS value,
         b.event_id IS NOT NULL AS changed, s.event_id IS NOT NULL AS known
  FROM stored s FULL JOIN batch b USING (event_id)
)"""


# --- an effective-dated history -----------------------------------------------------------

RANGE_TABLE = "user_id bigint, event_type string, assignee string, started_at timestamp_ntz, ended_at timestamp_ntz"


def assignment_history(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments per user and event type after two loads: every fifth event comes late, and some are corrected.

    The second load is spliced into the stored ranges and merged by their start,
    so only ranges that change are written.
    """
    events = table(spark, sf, "events").select(
        "user_id", "event_type", F.concat(F.lit("P"), (F.col("event_id") % 7).cast("string")).alias("assignee"),
        F.col("ts").cast("timestamp_ntz").alias("started_at"), "event_id", F.lit(False).alias("corrected"),
    )
    late = F.col("event_id") % 5 == 0
    corrections = events.where("event_id % 35 = 1").withColumns({"assignee": F.lit("corrected"), "corrected": F.lit(True)})
    keys = ["user_id", "event_type"]
    stored = BucketTable(spark, work_folder(spark, "assignments"), RANGE_TABLE, [*keys, "started_at"], 16)
    for arriving in (events.where(~late), events.where(late).unionByName(corrections)):
        changed = spliced_ranges(
            stored.read(), arriving, keys, "started_at", "ended_at", [F.col("corrected"), F.col("event_id")], block_rows=ingest.BLOCK
        )
        stored.merge(changed, ["assignee", "ended_at"])
    at = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("started_at", "ended_at")]
    return stored.read().select(*keys, "assignee", *at)


HISTORY_SQL = """WITH arrived AS (
  SELECT user_id, event_type, 'P' || (event_id % 7) AS assignee, ts, event_id, 0 AS corrected, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS load
  FROM events
  UNION ALL SELECT user_id, event_type, 'corrected', ts, event_id, 1, 1 FROM events WHERE event_id % 35 = 1
), known AS (
  SELECT user_id, event_type, ts, arg_max(assignee, (load, corrected, event_id)) AS assignee FROM arrived GROUP BY ALL
)
SELECT user_id, event_type, assignee, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
       strftime(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts), '%Y-%m-%d %H:%M:%S.%f') AS ended_at FROM known"""

# --- a landing folder, drained in three runs --------------------------------------------

LANDED = StructType([StructField("row", LongType()), StructField("post", StringType()), StructField("kind", StringType()), StructField("value", DoubleType())])


def _post_columns() -> dict[str, Column]:
    return {"post_id": F.col("post").cast("bigint"), "kind": F.col("kind"), "value": F.col("value"), "row": F.col("row")}


def _delivery(events: DataFrame, run: int) -> DataFrame:
    """The events of one run: a third of all, some twice in the run, some of the run before once more, and some without an id."""
    own = events.where(F.col("event_id") % 3 == run)
    late = events.where((F.col("event_id") % 3 == run - 1) & (F.col("event_id") % 10 == 0))
    post = F.when(F.col("event_id") % 11 != 0, F.col("event_id").cast("string"))
    parts = [
        own.select((F.col("event_id") * 4).alias("row"), post.alias("post"), F.col("event_type").alias("kind"), "value"),
        own.where("event_id % 7 = 0").select(
            (F.col("event_id") * 4 + 1).alias("row"), post.alias("post"), F.lit("repeated").alias("kind"), (F.col("value") + 1).alias("value")
        ),
        late.select((F.col("event_id") * 4 - 1).alias("row"), post.alias("post"), F.lit("late").alias("kind"), (F.col("value") + 2).alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def landing_posts(spark: SparkSession, sf: str) -> DataFrame:
    """First rows of all posts after three runs over a growing landing folder, and the refused ones by kind."""
    folder = work_folder(spark, "landing")
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    for run in range(3):
        _delivery(events, run).write.mode("append").parquet(f"{folder}/in")
        run_stateful(
            spark, f"{folder}/in", LANDED, _post_columns(), ["post_id"], ["row"], f"{folder}/posts", f"{folder}/state"
        ).awaitTermination()
        run_refused(spark, f"{folder}/in", LANDED, _post_columns(), ["post_id"], f"{folder}/refused", f"{folder}/refused-state").awaitTermination()
    stored = spark.read.parquet(f"{folder}/posts").select("post_id", "kind", "value", F.col("batch").cast("bigint").alias("run"))
    refused = spark.read.parquet(f"{folder}/refused").groupBy("kind").agg(F.count("*").alias("run"))
    return stored.unionByName(refused.select(F.lit(None).cast("bigint").alias("post_id"), "kind", F.lit(None).cast("double").alias("value"), "run"))


LANDING_SQL = """WITH refused AS (
  SELECT event_type AS kind FROM events WHERE event_id % 11 = 0
  UNION ALL SELECT 'repeated' FROM events WHERE event_id % 11 = 0 AND event_id % 7 = 0
  UNION ALL SELECT 'late' FROM events WHERE event_id % 11 = 0 AND event_id % 10 = 0 AND event_id % 3 < 2
)
SELECT event_id AS post_id, event_type AS kind, value, event_id % 3 AS run FROM events WHERE event_id % 11 <> 0
UNION ALL SELECT NULL, kind, NULL, count(*) FROM refused GROUP BY kind"""

# --- a second, different import -------------------------------------------------------

LATER_ARTIFACT = "cb8379ac2098aa165029e3938a51da0bcecfc008fd6795f401178647f96c5b34"
LATER_JOB = ImportJob(SYSTEM, "all", "export", LATER_ARTIFACT, ingest.VERSION, "rules-1", "2024-08-01 00:00:00")
STORE_BUCKETS = 8


def later_folder(spark: SparkSession, sf: str) -> Changed:
    """What a later export holds: every third order and conversation, some events edited, some new.

    Open orders are complete now, low ones urgent, and every ninth has lost its
    customer, so its contractor, carrier and handler are blank.
    """
    orders = table(spark, sf, "orders").where("o_orderkey % 3 = 0").withColumns({
        "o_orderstatus": F.when(F.col("o_orderstatus") == "O", "F").otherwise(F.col("o_orderstatus")),
        "o_orderpriority": F.when(F.col("o_orderpriority") == "5-LOW", "1-URGENT").otherwise(F.col("o_orderpriority")),
        "o_custkey": F.when(F.col("o_orderkey") % 9 == 0, F.lit(-1)).otherwise(F.col("o_custkey")),
    })
    events = table(spark, sf, "events")
    new = events.where("event_id % 50 = 0").withColumn("event_id", F.col("event_id") + 100_000_000)
    return Changed(sf, {
        "orders": orders,
        "conversations": table(spark, sf, "conversations").where("conv_id % 3 = 0"),
        "events": events.where("event_id % 2 = 0").withColumn("event_type", F.lit("edited")).unionByName(new),
        "documents": table(spark, sf, "documents").where("doc_id % 5 = 0"),
    })


def later_import(spark: SparkSession, sf: str) -> ParsedImport:
    return parse_import(views.grid(spark, later_folder(spark, sf)), LAYOUT, block_rows=ingest.BLOCK)


def second_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Claims after two imports: values of the later one, states of the first, links where the later cells are blank."""
    first = promote(empty_tables(spark), ingest.parsed(spark, sf), JOB, LAYOUT)
    claims = promote(first, later_import(spark, sf), LATER_JOB, LAYOUT)["claims"]
    days = ("assigned_date", "closed_date", "status_change_date", "loss_date")
    return claims.select(*[F.col(c).cast("string").alias(c) if c in days else F.col(c) for c in claims.columns])


def rerun_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen stored tables: rows after an import, buckets that its rerun rewrote, rows after a later import, rows that it brought."""
    store = PromotedStore(spark, work_folder(spark, "promoted"), STORE_BUCKETS)
    held = work_folder(spark, "import")
    one = staged(ingest.parsed(spark, sf), held)
    store.promote(one, JOB, LAYOUT)
    first = store.log.latest()
    store.promote(one, JOB, LAYOUT)
    again = store.log.latest()
    forget(spark, held)
    held = work_folder(spark, "import")
    store.promote(staged(later_import(spark, sf), held), LATER_JOB, LAYOUT)
    forget(spark, held)
    last = store.log.latest()
    rerun, versions = store.differing(first, again), (store.published(first), store.published(last))
    parts = []
    for name, stored in store.tables.items():
        rows = [sum(e["rows"] for e in stored.entries(v[name]).values()) for v in versions]
        # one table after the other, so that the shuffles of sixteen comparisons are not held at once
        with shuffles_removed(spark):
            found = stored.differences(versions[0][name], versions[1][name])
            brought = found.agg(F.coalesce(F.sum(F.greatest("surplus", F.lit(0))), F.lit(0))).first()[0]
        parts.append((name, rows[0], len(rerun[name]), rows[1], brought))
    return spark.createDataFrame(parts, "table string, rows_first bigint, rerun_buckets bigint, rows_second bigint, brought bigint")


_LATER = """WITH orders AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderpriority = '5-LOW' THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE o_custkey END AS o_custkey) FROM orders WHERE o_orderkey % 3 = 0),
conversations AS (SELECT * FROM conversations WHERE conv_id % 3 = 0),
events AS (SELECT * REPLACE ('edited' AS event_type) FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT * REPLACE (event_id + 100000000 AS event_id) FROM events WHERE event_id % 50 = 0),
documents AS (SELECT * FROM documents WHERE doc_id % 5 = 0), """


def later_sql(sql: str) -> str:
    """The same query over the later export, under its job."""
    body = sql.replace(ingest.ARTIFACT, LATER_ARTIFACT).strip()
    assert body.upper().startswith("WITH ")
    return _LATER + body[5:]


_TWIN = {name: sql for name, (_, sql) in serving.QUERIES.items() if sql}
_FIXED = ("claim_id", "source_system", "item_id", "service_type", "property_type", "lifecycle_state")
_REPLACED = ("display_name", "raw_status", "normalized_status", "contractor_id", "assigned_date", "closed_date", "status_change_date",
             "loss_date", "import_job_id", "source_row_id")


def _brought(keys: str, sql: str, value: str | None = None) -> tuple[str, str]:
    """Rows after both imports, and rows that the later one brought: new keys, and known ones with another value."""
    both = f"(SELECT {keys} FROM ({sql}) UNION SELECT {keys} FROM ({later_sql(sql)}))"
    known = f"SELECT {keys}{', ' + value if value else ''} FROM"
    return f"(SELECT count(*) FROM {both})", f"(SELECT count(*) FROM ({known} ({later_sql(sql)}) EXCEPT {known} ({sql})))"


def _table_twin(name: str, keys: str, sql: str, value: str | None = None) -> str:
    second, brought = _brought(keys, sql, value)
    return (
        f"SELECT '{name}' AS \"table\", (SELECT count(*) FROM ({sql})) AS rows_first, CAST(0 AS BIGINT) AS rerun_buckets, "
        f"{second} AS rows_second, {brought} AS brought"
    )


def _subitems(kind: str) -> str:
    return f"{_TWIN['staged_subitems']} AND row_class = 'subitem_{kind}'"


_JOB_ROW = f"WITH one AS (SELECT {serving._JOB_ID} AS import_job_id) SELECT import_job_id FROM one"
_PERSON = _TWIN["people"].replace("raw_alias", "raw_name")
RERUN_SQL = " UNION ALL ".join(
    (
        _table_twin("import_jobs", "import_job_id", _JOB_ROW),
        _table_twin("source_files", "import_job_id", _JOB_ROW),
        _table_twin("source_worksheets", "worksheet_id", _TWIN["promoted_worksheets"]),
        _table_twin("source_rows", "source_row_id", _TWIN["promoted_source_rows"]),
        _table_twin("organizations", "organization_id", _TWIN["organizations"], "display_name"),
        _table_twin("organization_aliases", "organization_id", _TWIN["organization_aliases"]),
        _table_twin("people", "person_id", _PERSON, "display_name"),
        _table_twin("person_aliases", "person_id", _PERSON),
        _table_twin("staged_claim_rows", "source_row_id", _TWIN["staged_claims"]),
        _table_twin("staged_subitem_headers", "source_row_id", _subitems("header")),
        _table_twin("staged_subitem_details", "source_row_id", _subitems("detail")),
        _table_twin("claims", "claim_id", _TWIN["promoted_claims"], "import_job_id"),
        _table_twin("claim_financial_facts", "claim_id, normalized_metric_name, import_job_id", _TWIN["promoted_facts"]),
        _table_twin("claim_derived_metrics", "claim_id, import_job_id", _TWIN["promoted_derived"]),
        _table_twin("claim_updates", "post_id", _TWIN["promoted_updates"]),
        _table_twin("dq_issues", "deterministic_key", _TWIN["promoted_issues"]),
    )
)

QUERIES = {
    "bucket_merge": (
        bucket_merge,
        f"""WITH {_BATCH_SQL}
SELECT {BUCKET_SQL} AS bucket, count(*) FILTER (known) AS rows_before, count(*) AS rows_after,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) FILTER (event_type = 'corrected') AS corrected,
       bool_or(changed) AS rewritten, NOT bool_or(changed) AS same_files
FROM merged GROUP BY 1""",
    ),
    "second_promotion": (
        second_promotion,
        f"""SELECT {', '.join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in _FIXED if c != 'lifecycle_state')},
CASE WHEN a.claim_id IS NULL THEN b.lifecycle_state ELSE a.lifecycle_state END AS lifecycle_state,
{', '.join(f"CASE WHEN b.claim_id IS NULL THEN a.{c} ELSE b.{c} END AS {c}" for c in _REPLACED)},
coalesce(b.carrier_id, a.carrier_id) AS carrier_id, coalesce(b.assigned_staff_id, a.assigned_staff_id) AS assigned_staff_id
FROM ({_TWIN['promoted_claims']}) a FULL JOIN ({later_sql(_TWIN['promoted_claims'])}) b ON a.claim_id = b.claim_id""",
    ),
    "rerun_changes": (rerun_changes, RERUN_SQL),
    "landing_posts": (landing_posts, LANDING_SQL),
    "assignment_history": (assignment_history, HISTORY_SQL),
}
