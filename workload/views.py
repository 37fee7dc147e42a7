"""Domain views over the supplied tables, in Spark and in SQL.

Only this module knows the supplied tables; the library works on domain
columns. The SQL texts are common table expressions that the SQL twins of the
queries start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.dates import quarter_label
from claimloom.operators.weather import match_events
from claimloom.plans.dashboards import Warehouse
from claimloom.schema import SUBITEM_LABEL as LABEL
from claimloom.schema import SheetLayout

AS_OF = "2001-09-01"
WEATHER_WINDOW = 60

LAYOUT = SheetLayout()

# (id, name, kind, day, states, ZIP prefixes, severity)
WEATHER = (
    ("wx-1", "Plains hail", "hail", "1996-05-14", ("NATION_1", "NATION_7"), ("00", "01"), "severe"),
    ("wx-2", "Coastal wind", "wind", "1997-06-22", ("NATION_3", "NATION_12"), ("00", "02"), "high"),
    ("wx-3", "Ridge hail", "hail", "1998-07-08", ("NATION_20",), ("01",), "high"),
    ("wx-4", "Northern freeze", "freeze", "2000-01-18", ("NATION_5", "NATION_9"), ("00", "01", "14"), "moderate"),
    ("wx-5", "Inland wind", "wind", "2003-03-03", ("NATION_2", "NATION_15"), ("00",), "high"),
)


class Changed(str):
    """A data folder in which some tables are given as frames."""

    frames: dict[str, DataFrame]

    def __new__(cls, folder: str, frames: dict[str, DataFrame]) -> Changed:
        made = super().__new__(cls, folder)
        made.frames = frames
        return made


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    given = sf.frames if isinstance(sf, Changed) else {}
    return given[name] if name in given else spark.read.parquet(f"{sf}/{name}.parquet")


def text(value: Column) -> Column:
    return value.cast("string")


def money(column: str, precision: str = "decimal(18,2)") -> Column:
    return F.col(column).cast(precision)


# --- claims ------------------------------------------------------------------


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with lines: value, last shipment and line flags."""
    value = money("l_extendedprice") * (F.lit(1) - money("l_discount", "decimal(4,2)"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(value).cast("decimal(28,4)").alias("current_value"),
        F.max(F.to_date("l_shipdate")).alias("last_ship"),
        F.min("l_suppkey").alias("adjuster"),
        F.count("*").alias("lines"),
        F.count_if(F.col("l_linestatus") == "F").alias("lines_f"),
        F.count_if(F.col("l_returnflag") == "R").alias("lines_r"),
    )


def claims(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    wide = (
        orders.join(order_lines(spark, sf), "o_orderkey", "left")
        .join(customer, "o_custkey", "left")
        .join(nation, "c_nationkey", "left")
    )
    lines, lines_f = F.col("lines"), F.col("lines_f")
    priority = F.col("o_orderpriority")
    opened = F.to_date("o_orderdate")
    status = (
        F.when(F.col("o_orderstatus") == "F", "closed")
        .when(F.col("o_orderstatus") == "P", "negotiating")
        .when(priority == "5-LOW", "stalled")
        .when(priority == "1-URGENT", "new")
        .otherwise("estimating")
    )
    availability = (
        F.when(lines.isNull(), "not_captured")
        .when(lines_f == lines, "captured")
        .when(lines_f > 0, "partially_captured")
        .when(F.col("lines_r") > 0, "invalid")
        .otherwise("not_applicable")
    )
    initial = money("o_totalprice")
    return wide.select(
        text(F.col("o_orderkey")).alias("id"),
        F.concat(F.lit("C-"), text(F.col("o_orderkey"))).alias("claim_number"),
        quarter_label(opened).alias("source_quarter"),
        text(F.col("o_custkey")).alias("contractor_id"),
        F.col("c_mktsegment").alias("carrier_id"),
        text(F.col("adjuster")).alias("adjuster_id"),
        F.col("n_name").alias("state"),
        F.lpad(text(F.col("o_custkey")), 5, "0").alias("zip_code"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "claim_handling").otherwise("estimate_only").alias("service_type"),
        status.alias("status"),
        availability.alias("financial_status"),
        opened.alias("opened_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("last_ship")).alias("closed_at"),
        initial.alias("original_rcv"),
        F.col("current_value").alias("settled_rcv"),
        (F.col("current_value") - initial).alias("additional_rcv"),
        (initial * F.lit("0.075").cast("decimal(4,3)")).cast("decimal(24,5)").alias("service_fee"),
    )


CLAIMS = """
order_lines AS (
  SELECT l_orderkey,
         sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS current_value,
         max(CAST(l_shipdate AS DATE)) AS last_ship, min(l_suppkey) AS adjuster, count(*) AS lines,
         count(*) FILTER (WHERE l_linestatus = 'F') AS lines_f, count(*) FILTER (WHERE l_returnflag = 'R') AS lines_r
  FROM lineitem GROUP BY l_orderkey),
claims AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 'C-' || o_orderkey AS claim_number,
         year(o_orderdate) || ' Q' || quarter(o_orderdate) AS source_quarter,
         CAST(o_custkey AS VARCHAR) AS contractor_id, c_mktsegment AS carrier_id, n_name AS state,
         lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS zip_code,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'claim_handling' ELSE 'estimate_only' END AS service_type,
         CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderstatus = 'P' THEN 'negotiating'
              WHEN o_orderpriority = '5-LOW' THEN 'stalled' WHEN o_orderpriority = '1-URGENT' THEN 'new'
              ELSE 'estimating' END AS status,
         CASE WHEN lines IS NULL THEN 'not_captured' WHEN lines_f = lines THEN 'captured'
              WHEN lines_f > 0 THEN 'partially_captured' WHEN lines_r > 0 THEN 'invalid'
              ELSE 'not_applicable' END AS financial_status,
         CAST(o_orderdate AS DATE) AS opened_at,
         CASE WHEN o_orderstatus = 'F' THEN last_ship END AS closed_at,
         CAST(o_totalprice AS DECIMAL(18,2)) AS original_rcv, current_value AS settled_rcv,
         current_value - CAST(o_totalprice AS DECIMAL(18,2)) AS additional_rcv,
         CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.075 AS DECIMAL(4,3)) AS service_fee,
         o_orderstatus, o_orderpriority
  FROM orders LEFT JOIN order_lines ON l_orderkey = o_orderkey
       LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey),
measured AS (
  SELECT *, CASE WHEN financial_status IN ('captured', 'partially_captured') THEN additional_rcv END AS gain,
         CASE WHEN financial_status IN ('captured', 'partially_captured') THEN service_fee END AS fee,
         CASE WHEN closed_at IS NOT NULL THEN greatest(0, date_diff('day', opened_at, closed_at)) END AS cycle
  FROM claims)"""


def updates(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select(
        text(F.col("user_id") * 131).alias("claim_id"), F.col("event_id").alias("position"), F.to_date("ts").alias("at")
    )


UPDATES = """
updates AS (SELECT CAST(user_id * 131 AS VARCHAR) AS claim_id, event_id AS position, CAST(ts AS DATE) AS upd_day FROM events)"""


def carriers(spark: SparkSession, sf: str) -> DataFrame:
    segments = table(spark, sf, "customer").select("c_mktsegment").distinct()
    return segments.select(F.col("c_mktsegment").alias("id"), F.initcap("c_mktsegment").alias("name"))


CARRIERS = """
carriers AS (SELECT DISTINCT c_mktsegment AS id,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS name FROM customer)"""


def contractors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(text(F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"))


CONTRACTORS = """
contractors AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer)"""


def quarters(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return (
        table(spark, sf, "orders")
        .select((F.year(day) * 4 + F.quarter(day)).cast("bigint").alias("ordinal"), quarter_label(day).alias("quarter"))
        .distinct()
    )


QUARTERS = """
quarters AS (SELECT DISTINCT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS ordinal,
  year(o_orderdate) || ' Q' || quarter(o_orderdate) AS quarter FROM orders)"""


def weather_events(spark: SparkSession) -> DataFrame:
    """The event catalogue: a fixed list, so Spark knows its size."""
    entries = [
        F.struct(
            F.lit(w[0]).alias("id"), F.lit(w[1]).alias("name"), F.lit(w[2]).alias("kind"),
            F.lit(w[3]).cast("date").alias("occurred_at"), F.array(*[F.lit(v) for v in w[4]]).alias("states"),
            F.array(*[F.lit(v) for v in w[5]]).alias("zip_prefixes"), F.lit(w[6]).alias("severity"),
        )
        for w in WEATHER
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


WEATHER_EVENTS = "\nweather_events(id, name, occurred_at, states, zip_prefixes) AS (VALUES " + ", ".join(
    f"('{w[0]}', '{w[1]}', DATE '{w[3]}', {_sql_list(w[4])}, {_sql_list(w[5])})" for w in WEATHER
) + ")"

MATCHES = f"""
matches AS (
  SELECT c.id AS claim_id, e.id AS weather_event_id, abs(date_diff('day', e.occurred_at, c.opened_at)) AS gap_days
  FROM claims c JOIN weather_events e ON list_contains(e.states, c.state)
    AND list_contains(e.zip_prefixes, substr(c.zip_code, 1, 2))
    AND c.opened_at BETWEEN e.occurred_at - {WEATHER_WINDOW} AND e.occurred_at + {WEATHER_WINDOW})"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """Matches with a confidence of whole cents, so that sums are exact."""
    found = match_events(claims(spark, sf), weather_events(spark), WEATHER_WINDOW)
    return found.withColumn(
        "confidence", (F.lit(100) - F.col("gap_days")).cast("decimal(10,2)") / F.lit(100).cast("decimal(3,0)")
    )


def warehouse(spark: SparkSession, sf: str) -> Warehouse:
    return Warehouse(
        claims=claims(spark, sf),
        updates=updates(spark, sf),
        contractors=contractors(spark, sf),
        carriers=carriers(spark, sf),
        events=weather_events(spark),
        matches=matches(spark, sf),
        quarters=quarters(spark, sf),
        as_of=AS_OF,
    )


# --- sheet grids --------------------------------------------------------------

ARCHIVE_HEADERS = (
    "Name", "Subtasks", "Status", "Assigned", "Contractor", "CH", "Insurance Carrier", "Adjuster Name",
    "Initial Ins. RCV", "Requested RCV", "Current Ins. RCV", "Additional Secured $", "Percentage Increase",
    "CH Update", "Client Fee", "Closed Date", "CH Update", "Date of Status Change", "Date of Loss",
    "Item ID (auto generated)", "", "Admin",
)
UPDATE_HEADERS = (
    "Item ID", "Post ID", "Parent Post ID", "Update Content", "Created At", "User", "Content Type", "Content Type", "",
)
ARCHIVE_COLUMNS = (
    "name", "subtasks", "status", "assigned", "contractor", "handler", "carrier", "adjuster", "initial", "requested",
    "current", "additional", "percentage", "note", "fee", "closed", "note2", "changed", "loss", "item_id", "empty",
    "admin",
)
UPDATE_COLUMNS = ("item_id", "post_id", "parent_post_id", "body", "created", "author", "kind", "kind2", "empty")
FILE = "export"


def _claim_rows(spark: SparkSession, sf: str, stride: Column) -> DataFrame:
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_nationkey"
    )
    wide = table(spark, sf, "orders").join(order_lines(spark, sf), "o_orderkey", "left").join(customer, "o_custkey", "left")
    key = F.col("o_orderkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    total = money("o_totalprice")
    gain = F.col("current_value") - total
    shown_gain = (
        F.when(priority == "1-URGENT", F.lit(None).cast("decimal(28,4)"))
        .when(priority == "3-MEDIUM", gain + F.lit("0.0050").cast("decimal(5,4)"))
        .when(priority == "4-NOT SPECIFIED", gain + F.lit("0.9000").cast("decimal(5,4)"))
        .otherwise(gain)
        .cast("decimal(28,4)")
    )
    cells = {
        "name": F.concat(F.lit("Order "), text(key)),
        "status": F.when(status == "F", "Complete").when(status == "P", " Closed ").when(priority != "5-LOW", "In Progress"),
        "assigned": F.when(priority == "2-HIGH", F.concat(day, F.lit("T13:30:00")))
        .when(priority == "4-NOT SPECIFIED", "n/a")
        .otherwise(day),
        "contractor": F.col("c_name"),
        "handler": F.when(status != "O", F.concat(F.lit("Handler-"), text(F.col("c_nationkey")))),
        "carrier": F.when(priority == "1-URGENT", F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")),
        "adjuster": F.concat(F.lit("Adjuster "), text(F.col("adjuster"))),
        "initial": F.when(status == "P", F.concat(F.lit("("), text(total), F.lit(")"))).otherwise(
            F.concat(F.lit("$ "), text(total))
        ),
        "requested": F.when(priority == "1-URGENT", "pending").otherwise(text(total)),
        "current": text(F.col("current_value")),
        "additional": text(shown_gain),
        "percentage": F.concat(text(F.col("lines") * 1000), F.lit("%")),
        "fee": text((total * F.lit("0.075").cast("decimal(4,3)")).cast("decimal(24,5)")),
        "closed": F.date_format("last_ship", "yyyy-MM-dd"),
        "changed": F.concat(day, F.lit("T00:00:00")),
        "loss": F.when(status == "O", F.lit(" \t ")),
        "item_id": text(key),
    }
    return wide.select(
        (F.lit(6) + key * stride).alias("physical_row"),
        F.array(*[cells.get(c, F.lit(None)).cast("string") for c in ARCHIVE_COLUMNS]).alias("cells"),
    )


def _subitem_rows(spark: SparkSession, sf: str, stride: Column) -> DataFrame:
    role = F.col("role")
    cells = {
        "name": F.when(role == "user", LABEL).when(role == "system", "note"),
        "subtasks": F.col("text"),
    }
    return table(spark, sf, "conversations").select(
        (F.lit(7) + F.col("conv_id") * stride + F.col("turn")).alias("physical_row"),
        F.array(*[cells.get(c, F.lit(None)).cast("string") for c in ARCHIVE_COLUMNS]).alias("cells"),
    )


def _event_rows(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    cells = {
        "item_id": text(F.col("user_id") * 131),
        "post_id": F.concat(F.lit("E"), text(F.col("event_id"))),
        "parent_post_id": F.when(kind == "purchase", F.concat(F.lit("E"), text(F.col("event_id") - 1))),
        "body": F.when(kind == "view", "  \t ").when(kind == "signup", F.concat(F.lit(" "), kind, F.lit(" "))).otherwise(kind),
        "created": F.date_format("ts", "dd/MMMM/yyyy  hh:mm:ss a"),
        "author": F.when(kind != "error", F.concat(F.lit("user "), text(F.col("user_id")))),
        "kind": F.col("props"),
    }
    return table(spark, sf, "events").select(
        (F.lit(3) + F.col("event_id") * 2).alias("physical_row"),
        F.array(*[cells.get(c, F.lit(None)).cast("string") for c in UPDATE_COLUMNS]).alias("cells"),
    )


def _document_rows(spark: SparkSession, sf: str) -> DataFrame:
    cells = {
        "item_id": text(F.col("doc_id")),
        "post_id": F.concat(F.lit("D"), text(F.col("doc_id"))),
        "body": F.col("text"),
        "created": F.col("source"),
        "author": F.col("lang"),
    }
    return table(spark, sf, "documents").select(
        (F.lit(4) + F.col("doc_id") * 2).alias("physical_row"),
        F.array(*[cells.get(c, F.lit(None)).cast("string") for c in UPDATE_COLUMNS]).alias("cells"),
    )


def _header(spark: SparkSession, row: int, names: tuple[str, ...]) -> DataFrame:
    return spark.range(1).select(
        F.lit(row).cast("bigint").alias("physical_row"), F.array(*[F.lit(n) for n in names]).alias("cells")
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """The two-sheet export: orders with their conversation turns, and all updates.

    Row numbers leave room for the longest conversation under each order.
    """
    longest = table(spark, sf, "conversations").agg(F.max("turn")).scalar()
    stride = F.coalesce(longest, F.lit(0)) + 2
    archive = (
        _header(spark, LAYOUT.archive_header_row, ARCHIVE_HEADERS)
        .unionByName(_claim_rows(spark, sf, stride))
        .unionByName(_subitem_rows(spark, sf, stride))
        .withColumn("sheet", F.lit(LAYOUT.archive_sheet))
    )
    update_rows = (
        _header(spark, LAYOUT.updates_header_row, UPDATE_HEADERS)
        .unionByName(_event_rows(spark, sf))
        .unionByName(_document_rows(spark, sf))
        .withColumn("sheet", F.lit(LAYOUT.updates_sheet))
    )
    both = archive.unionByName(update_rows)
    return both.select(F.lit(FILE).alias("file_name"), "sheet", "physical_row", "cells")


_NULLS = {c: "NULL" for c in ARCHIVE_COLUMNS}
_STRIDE = "(SELECT coalesce(max(turn), 0) + 2 FROM conversations)"
_CLAIM_SQL = {
    **_NULLS,
    "name": "'Order ' || o_orderkey",
    "status": "CASE WHEN o_orderstatus = 'F' THEN 'Complete' WHEN o_orderstatus = 'P' THEN ' Closed ' "
    "WHEN o_orderpriority <> '5-LOW' THEN 'In Progress' END",
    "assigned": "CASE WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d') || 'T13:30:00' "
    "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END",
    "contractor": "c_name",
    "handler": "CASE WHEN o_orderstatus <> 'O' THEN 'Handler-' || c_nationkey END",
    "carrier": "CASE WHEN o_orderpriority = '1-URGENT' THEN lower(c_mktsegment) ELSE c_mktsegment END",
    "adjuster": "'Adjuster ' || adjuster",
    "initial": "CASE WHEN o_orderstatus = 'P' THEN '(' || CAST(o_totalprice AS DECIMAL(18,2)) || ')' "
    "ELSE '$ ' || CAST(o_totalprice AS DECIMAL(18,2)) END",
    "requested": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'pending' "
    "ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END",
    "current": "CAST(CAST(current_value AS DECIMAL(28,4)) AS VARCHAR)",
    "additional": "CAST(CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN NULL "
    "WHEN o_orderpriority = '3-MEDIUM' THEN current_value - CAST(o_totalprice AS DECIMAL(18,2)) + 0.0050 "
    "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN current_value - CAST(o_totalprice AS DECIMAL(18,2)) + 0.9000 "
    "ELSE current_value - CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(28,4)) AS VARCHAR)",
    "percentage": "(lines * 1000) || '%'",
    "fee": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.075 AS DECIMAL(4,3)) AS VARCHAR)",
    "closed": "strftime(last_ship, '%Y-%m-%d')",
    "changed": "strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00'",
    "loss": "CASE WHEN o_orderstatus = 'O' THEN ' ' || chr(9) || ' ' END",
    "item_id": "CAST(o_orderkey AS VARCHAR)",
}
_TURN_SQL = {
    **_NULLS,
    "name": "CASE WHEN role = 'user' THEN 'Subitems' WHEN role = 'system' THEN 'note' END",
    "subtasks": "text",
}


def _columns(cells: dict[str, str]) -> str:
    return ", ".join(f"CAST({sql} AS VARCHAR) AS {name}" for name, sql in cells.items())


ARCHIVE = (
    CLAIMS
    + f""",
archive AS (
  SELECT 6 + o_orderkey * {_STRIDE} AS physical_row, {_columns(_CLAIM_SQL)}
  FROM orders LEFT JOIN order_lines ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
  UNION ALL
  SELECT 7 + conv_id * {_STRIDE} + turn, {_columns(_TURN_SQL)} FROM conversations)"""
)

_BLANK = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def sql_clean(value: str) -> str:
    return f"nullif(regexp_replace({value}, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '')"


def sql_amount(value: str) -> str:
    return f"TRY_CAST(regexp_replace({value}, '[$,%]|{_BLANK}', '', 'g') AS DECIMAL(38,10))"


def sql_number(value: str) -> str:
    digits = f"regexp_replace({value}, '[$,%()]|{_BLANK}', '', 'g')"
    number = f"TRY_CAST({digits} AS DOUBLE)"
    plain = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return (
        f"CASE WHEN NOT regexp_matches({digits}, '{plain}') THEN NULL "
        f"WHEN regexp_matches({sql_clean(value)}, '^\\(.*\\)$') THEN -{number} ELSE {number} END"
    )


_EVENT_SQL = {
    **{c: "NULL" for c in UPDATE_COLUMNS},
    "item_id": "user_id * 131",
    "post_id": "'E' || event_id",
    "parent_post_id": "CASE WHEN event_type = 'purchase' THEN 'E' || (event_id - 1) END",
    "body": "CASE WHEN event_type = 'view' THEN '  ' || chr(9) || ' ' "
    "WHEN event_type = 'signup' THEN ' ' || event_type || ' ' ELSE event_type END",
    "created": "strftime(ts, '%d/%B/%Y  %I:%M:%S %p')",
    "author": "CASE WHEN event_type <> 'error' THEN 'user ' || user_id END",
    "kind": "props",
}
_DOCUMENT_SQL = {
    **{c: "NULL" for c in UPDATE_COLUMNS},
    "item_id": "doc_id",
    "post_id": "'D' || doc_id",
    "body": "text",
    "created": "source",
    "author": "lang",
}

POSTS = f"""
posts AS (
  SELECT 3 + event_id * 2 AS physical_row, date_trunc('second', ts) AS ts, {_columns(_EVENT_SQL)} FROM events
  UNION ALL SELECT 4 + doc_id * 2, NULL, {_columns(_DOCUMENT_SQL)} FROM documents),
post_bodies AS (
  SELECT *, {sql_clean('body')} AS clean_body, sha256({sql_clean('body')}) AS fingerprint,
         item_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders) AS matched FROM posts)"""
