"""Queries for the operators that follow written definitions: lifecycle, receivables, governance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.dates import quarter_label
from claimloom.functions.envelope import coverage_percent, grade
from claimloom.operators import governance, lifecycle, metrics, receivables
from claimloom.operators.governance import QualityRule
from claimloom.schema import STRICT_GRADE_CUTS
from workload import views
from workload.kpi import panel_sql, sql_coverage, sql_grade
from workload.views import AS_OF, CLAIMS, table, text

BLOCK = 512


def _plain(panel: DataFrame) -> DataFrame:
    return panel.drop("explanation", "drill_down")


# --- lifecycle ------------------------------------------------------------------


def _status_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "New")
        .when(kind == "view", "In Queue")
        .when(kind == "click", "In Progress")
        .when(kind == "purchase", "Completed")
        .otherwise("Escalated")
    )
    return table(spark, sf, "events").select(
        text(F.col("user_id")).alias("file_id"),
        F.col("event_id").alias("position"),
        status.alias("status"),
        F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("entered_at"),
        F.when(F.col("user_id") > 40, "claim_handling").otherwise("estimate_only").alias("service_type"),
    )


STATUS = """st AS (SELECT CAST(user_id AS VARCHAR) AS file_id, event_id AS position, CASE event_type WHEN 'signup' THEN 'New'
  WHEN 'view' THEN 'In Queue' WHEN 'click' THEN 'In Progress' WHEN 'purchase' THEN 'Completed' ELSE 'Escalated' END AS status,
  date_trunc('hour', ts) AS entered, CASE WHEN user_id > 40 THEN 'claim_handling' ELSE 'estimate_only' END AS service_type FROM events),
iv AS (SELECT *, lead(entered) OVER (PARTITION BY file_id ORDER BY position) AS exited,
  lag(status) OVER (PARTITION BY file_id ORDER BY position) AS from_status FROM st)"""


def status_groups(spark: SparkSession, sf: str) -> DataFrame:
    events = _status_events(spark, sf)
    return events.groupBy("status", lifecycle.status_group(F.col("status")).alias("status_group")).agg(
        F.count("*").alias("rows")
    )


def status_intervals(spark: SparkSession, sf: str) -> DataFrame:
    intervals = lifecycle.status_intervals(_status_events(spark, sf), block_rows=BLOCK)
    return intervals.select("file_id", "position", "status", "duration_seconds", "is_current")


def invalid_transitions(spark: SparkSession, sf: str) -> DataFrame:
    bad = lifecycle.invalid_transitions(_status_events(spark, sf), block_rows=BLOCK)
    return bad.select("file_id", "position", "from_status", "status")


def collapsed_status_events(spark: SparkSession, sf: str) -> DataFrame:
    collapsed = lifecycle.collapse_status_events(_status_events(spark, sf))
    return collapsed.select("file_id", "status", "position", "source_rows")


def status_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Collapsed events and the rows behind them: as many rows as events, no more ids than events."""
    provenance = lifecycle.status_event_provenance(_status_events(spark, sf))
    return provenance.groupBy("status_event_id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("events"), F.sum("n").alias("source_rows")
    )


def stage_ageing(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.stage_ageing(lifecycle.status_intervals(_status_events(spark, sf), block_rows=BLOCK))


def _assignments(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        text(F.col("user_id")).alias("file_id"),
        F.col("event_type").alias("assignment_type"),
        F.concat(F.lit("agent "), text(F.floor(F.col("value") / 10))).alias("assignee"),
        F.col("event_id").alias("position"),
        F.col("ts").cast("timestamp_ntz").alias("started_at"),
    )
    return lifecycle.assignment_intervals(events, block_rows=BLOCK)


ASSIGNED = """asg AS (SELECT CAST(user_id AS VARCHAR) AS file_id, event_type AS assignment_type,
  'agent ' || CAST(floor(value / 10) AS BIGINT) AS assignee, event_id AS position, ts AS started,
  lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS ended FROM events)"""


def current_assignments(spark: SparkSession, sf: str) -> DataFrame:
    return _assignments(spark, sf).where("is_current").select("file_id", "assignment_type", "assignee", "position")


def open_assignment_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Before reassignment closes the earlier rows, nearly every pair is in conflict."""
    raw = _assignments(spark, sf).withColumn("ended_at", F.lit(None).cast("timestamp_ntz"))
    return lifecycle.multiple_current(raw)


def workload(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.workload(_assignments(spark, sf))


def overlapping_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Each assignment is said to last ten hours; it overlaps when the next one starts sooner."""
    ranges = _assignments(spark, sf).withColumn("ended_at", F.col("started_at") + F.expr("INTERVAL 10 HOURS"))
    found = lifecycle.overlapping_ranges(ranges.drop("is_current"), ["file_id", "assignment_type"], block_rows=BLOCK)
    return found.select("file_id", "assignment_type", "position")


def derived_quarters(spark: SparkSession, sf: str) -> DataFrame:
    files = views.claims(spark, sf).select(
        "id",
        F.col("source_quarter").alias("source_archive_quarter"),
        F.when(F.col("service_type") == "estimate_only", F.date_add("opened_at", 95)).otherwise(F.col("opened_at")).alias("submitted"),
        F.col("closed_at").alias("completed"),
        F.date_add("closed_at", 30).alias("due"),
        F.date_add("closed_at", 7).alias("invoiced"),
        F.date_add("closed_at", 75).alias("collected"),
    )
    names = {
        "submission_quarter": "submitted", "completion_quarter": "completed", "due_quarter": "due", "invoice_quarter": "invoiced",
        "collection_quarter": "collected",
    }
    return lifecycle.derived_quarters(files, names).select("id", *names, "quarter_conflict")


# --- receivables ------------------------------------------------------------------


def _cents(value: Column) -> Column:
    return F.round(value.cast("decimal(18,2)") * 100, 0).cast("bigint")


def _parties(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    return customer.select(
        F.col("c_custkey").alias("o_custkey"),
        F.col("c_nationkey").alias("organization_id"),
        F.when(F.col("c_nationkey") >= 20, "CAD").otherwise("USD").alias("currency"),
    )


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a coarse amount, so that equal amounts of one party occur."""
    coarse = (F.floor(F.col("o_totalprice") / 50000) * 50000 * 100).cast("bigint")
    return (
        table(spark, sf, "orders")
        .join(_parties(spark, sf), "o_custkey")
        .select(
            "o_orderkey", "o_custkey", "organization_id", "currency", "o_orderpriority", "o_orderstatus",
            coarse.alias("amount_minor"), F.to_date("o_orderdate").alias("day"),
        )
    )


def _invoices(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("customer_id"),
        "organization_id", "currency", "amount_minor", F.col("day").alias("invoice_date"), F.date_add("day", 30).alias("due_on"),
    )


def _payments(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    key = F.col("o_orderkey")
    return _orders(spark, sf).select(
        key.alias("payment_id"),
        F.when(priority == "1-URGENT", key).alias("reference_invoice_id"),
        F.when(priority == "2-HIGH", key).alias("reference_file_id"),
        F.when(priority == "3-MEDIUM", key).alias("metadata_invoice_id"),
        F.when(priority == "4-NOT SPECIFIED", F.col("o_custkey")).alias("customer_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("organization_id")).alias("organization_id"),
        "amount_minor", "currency", F.date_add("day", 5).alias("paid_on"),
    )


def _line_table(spark: SparkSession, sf: str, amount: Column, *extra: Column) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_orderkey").alias("payment_id"), amount.alias("amount_minor"), *extra
    )


def _charges(spark: SparkSession, sf: str) -> DataFrame:
    return _line_table(spark, sf, _cents(F.col("l_extendedprice")), (F.col("l_returnflag") == "R").alias("is_void"))


def _allocations(spark: SparkSession, sf: str) -> DataFrame:
    lines = _line_table(
        spark, sf, _cents(F.col("l_extendedprice")), (F.col("l_returnflag") != "N").alias("is_settled"), F.col("l_linestatus"),
        F.to_date("l_shipdate").alias("paid_on"),
    )
    return lines.where(F.col("l_linestatus") == "F")


def _refunds(spark: SparkSession, sf: str) -> DataFrame:
    flagged = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return _line_table(spark, sf, _cents(F.col("l_extendedprice")), flagged.alias("_hit")).where("_hit")


def _adjustments(spark: SparkSession, sf: str) -> DataFrame:
    return _line_table(spark, sf, (F.col("l_quantity") * 100).cast("bigint"), (F.col("l_tax") > 0.04).alias("is_approved"))


def _balances(spark: SparkSession, sf: str) -> DataFrame:
    return receivables.invoice_balances(
        _invoices(spark, sf), _charges(spark, sf), _allocations(spark, sf), _refunds(spark, sf), _adjustments(spark, sf)
    )


MONEY = """ord AS (SELECT o_orderkey, o_custkey, c_nationkey AS organization_id,
  CASE WHEN c_nationkey >= 20 THEN 'CAD' ELSE 'USD' END AS currency, o_orderpriority, o_orderstatus,
  CAST(floor(o_totalprice / 50000) * 50000 * 100 AS BIGINT) AS amount, CAST(o_orderdate AS DATE) AS day
  FROM orders JOIN customer ON c_custkey = o_custkey),
ln AS (SELECT l_orderkey, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 100) AS BIGINT) AS cents, l_returnflag, l_linestatus,
  CAST(l_quantity * 100 AS BIGINT) AS adj, l_tax > 0.04::DOUBLE AS approved, CAST(l_shipdate AS DATE) AS paid_on FROM lineitem),
per AS (SELECT l_orderkey, coalesce(sum(cents) FILTER (WHERE l_returnflag <> 'R'), 0) AS charged,
  count(*) FILTER (WHERE l_returnflag <> 'R') AS active_lines,
  coalesce(sum(cents) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'N'), 0) AS allocated,
  coalesce(sum(cents) FILTER (WHERE l_linestatus = 'F'), 0) AS allocated_all,
  coalesce(sum(cents) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R'), 0) AS refunded,
  coalesce(sum(adj) FILTER (WHERE approved), 0) AS adjusted FROM ln GROUP BY 1),
bal AS (SELECT o.*, coalesce(charged, 0) AS charged, coalesce(active_lines, 0) AS active_lines,
  coalesce(allocated, 0) - coalesce(refunded, 0) AS collected,
  coalesce(charged, 0) - (coalesce(allocated, 0) - coalesce(refunded, 0)) - coalesce(adjusted, 0) AS open
  FROM ord o LEFT JOIN per ON l_orderkey = o_orderkey)"""


def invoice_balances(spark: SparkSession, sf: str) -> DataFrame:
    return _balances(spark, sf).select("invoice_id", "currency", "charged_minor", "active_lines", "collected_minor", "open_balance_minor")


def unbalanced_invoices(spark: SparkSession, sf: str) -> DataFrame:
    return receivables.unbalanced_invoices(_balances(spark, sf)).select("invoice_id", "amount_minor", "charged_minor")


def currency_totals(spark: SparkSession, sf: str) -> DataFrame:
    return receivables.sums_by_currency(_invoices(spark, sf), ["organization_id"])


def receivables_ageing(spark: SparkSession, sf: str) -> DataFrame:
    return receivables.receivables_ageing(_balances(spark, sf), AS_OF)


def payment_matches(spark: SparkSession, sf: str) -> DataFrame:
    matched = receivables.match_payments(_payments(spark, sf), _invoices(spark, sf), window_days=30)
    return matched.select("payment_id", "match_step", "candidates", "invoice_id", "match_state")


MATCH = """pay AS (SELECT o_orderkey AS payment_id, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END AS r1,
  CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderkey END AS r2, CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_orderkey END AS r3,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_custkey END AS customer_id,
  CASE WHEN o_orderstatus <> 'P' THEN organization_id END AS org, amount, currency, day + 5 AS paid_on FROM ord),
cand AS (
  SELECT payment_id, 1 AS step, o_orderkey AS invoice_id FROM pay JOIN ord ON o_orderkey = r1
  UNION ALL SELECT payment_id, 2, o_orderkey FROM pay JOIN ord ON o_orderkey = r2
  UNION ALL SELECT payment_id, 3, o_orderkey FROM pay JOIN ord ON o_orderkey = r3
  UNION ALL SELECT payment_id, 4, o_orderkey FROM pay p JOIN ord o ON o.o_custkey = p.customer_id AND o.amount = p.amount
    AND o.currency = p.currency AND o.day BETWEEN p.paid_on - 30 AND p.paid_on + 30
  UNION ALL SELECT payment_id, 5, o_orderkey FROM pay p JOIN ord o ON o.organization_id = p.org AND o.amount = p.amount
    AND o.currency = p.currency AND o.day BETWEEN p.paid_on - 30 AND p.paid_on + 30),
best AS (SELECT payment_id, step, count(*) AS candidates, min(invoice_id) AS invoice_id FROM cand GROUP BY 1, 2
  QUALIFY step = min(step) OVER (PARTITION BY payment_id)),
pm AS (SELECT p.*, step, coalesce(candidates, 0) AS candidates, CASE WHEN candidates = 1 THEN b.invoice_id END AS invoice_id,
  CASE WHEN candidates = 1 AND step <= 3 THEN 'matched' WHEN candidates = 1 THEN 'candidate_found'
    WHEN candidates > 1 THEN 'ambiguous' ELSE 'unmatched' END AS match_state FROM pay p LEFT JOIN best b ON b.payment_id = p.payment_id)"""


def reconciliation_states(spark: SparkSession, sf: str) -> DataFrame:
    matched = receivables.match_payments(_payments(spark, sf), _invoices(spark, sf), window_days=30)
    given = _allocations(spark, sf).groupBy("payment_id").agg(F.sum("amount_minor").alias("allocated_minor"))
    back = _refunds(spark, sf).groupBy("payment_id").agg(F.sum("amount_minor").alias("refunded_minor"))
    flags = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("payment_id"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")).alias("is_disputed"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "2-HIGH")).alias("is_resolved_manually"),
    )
    wide = matched.join(given, "payment_id", "left").join(back, "payment_id", "left").join(flags, "payment_id")
    filled = wide.na.fill(0, ["allocated_minor", "refunded_minor"])
    return receivables.reconciliation_state(filled).select("payment_id", "reconciliation_state")


def over_allocations(spark: SparkSession, sf: str) -> DataFrame:
    found = receivables.over_allocations(
        _payments(spark, sf), _invoices(spark, sf), _allocations(spark, sf), _refunds(spark, sf)
    )
    return found.select("entity", "entity_id", "limit_minor", "allocated_minor")


def refunds_over_limit(spark: SparkSession, sf: str) -> DataFrame:
    found = receivables.refunds_over_limit(_payments(spark, sf), _refunds(spark, sf))
    return found.select("payment_id", "amount_minor", "refunded_minor")


def revenue_lenses(spark: SparkSession, sf: str) -> DataFrame:
    invoices = _invoices(spark, sf)
    currency = invoices.select("invoice_id", "currency")
    closed = views.claims(spark, sf).select(F.col("id").cast("bigint").alias("invoice_id"), F.col("closed_at").alias("completed_on"))
    production = invoices.join(closed, "invoice_id")
    cash = _allocations(spark, sf).join(currency, "invoice_id")
    deductions = _refunds(spark, sf).join(invoices.select("invoice_id", "currency", F.col("due_on").alias("paid_on")), "invoice_id")
    return receivables.revenue_lenses(production, invoices, cash, deductions)


def completion_to_cash(spark: SparkSession, sf: str) -> DataFrame:
    currency = _invoices(spark, sf).select("invoice_id", "currency")
    closed = views.claims(spark, sf).select(F.col("id").cast("bigint").alias("invoice_id"), F.col("closed_at").alias("completed_on"))
    chain = _allocations(spark, sf).join(currency, "invoice_id").join(closed, "invoice_id", "left")
    return receivables.completion_to_cash(chain)


# --- governance ---------------------------------------------------------------------


def gated_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics by state that show no value below 93 percent coverage."""
    return _plain(metrics.metric_panel(views.claims(spark, sf), ["state"], minimum_coverage=93))


def strict_grades(spark: SparkSession, sf: str) -> DataFrame:
    totals = metrics.metric_totals(views.claims(spark, sf), ["carrier_id", "state"])
    coverage = coverage_percent(F.col("usable"), F.col("files"))
    return totals.select("carrier_id", "state", coverage.alias("coverage_percent"), grade(coverage, STRICT_GRADE_CUTS).alias("grade"))


def _rules() -> list[QualityRule]:
    closed = F.col("status") == "closed"
    return [
        QualityRule("completion-has-date", "error", "closed_at", closed & F.col("closed_at").isNull()),
        QualityRule("closed-not-before-opened", "error", "closed_at", F.col("closed_at") < F.col("opened_at")),
        QualityRule("missing-amount-has-reason", "warning", "additional_rcv",
                    F.col("additional_rcv").isNull() & ~F.col("financial_status").isin("not_captured", "not_applicable")),
        QualityRule("negative-gain", "info", "additional_rcv", F.col("additional_rcv") < 0),
    ]


def quality_violations(spark: SparkSession, sf: str) -> DataFrame:
    found = governance.rule_violations(views.claims(spark, sf), "claim", "id", _rules())
    return found.select("entity", "entity_id", "rule_id", "severity", "state")


def exclusion_reasons(spark: SparkSession, sf: str) -> DataFrame:
    reasons = {
        "not_closed": F.col("status") != "closed",
        "no_closing_date": F.col("closed_at").isNull(),
        "reversed_dates": F.col("closed_at") < F.col("opened_at"),
    }
    return governance.exclusion_counts(views.claims(spark, sf), reasons)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Metric of a quarter <- claim <- source line."""
    # number and quarter of a claim stand in its order, so the joins of the claims are not needed
    metric = table(spark, sf, "orders").select(
        F.concat(F.lit("claim:"), text(F.col("o_orderkey"))).alias("parent"),
        F.concat(F.lit("metric:"), quarter_label(F.to_date("o_orderdate"))).alias("child"),
    )
    lines = table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.lit("line:"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("parent"),
        F.concat(F.lit("claim:"), text(F.col("l_orderkey"))).alias("child"),
    )
    return metric.unionByName(lines)


def lineage_back(spark: SparkSession, sf: str) -> DataFrame:
    """Everything the 1998 Q2 metric rests on."""
    start = spark.range(1).select(F.lit("metric:1998 Q2").alias("node"))
    return governance.trace(start, _edges(spark, sf), backward=True)


def lineage_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that returned lines feed."""
    lines = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    start = lines.select(
        F.concat_ws("-", F.lit("line:"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("node")
    )
    return governance.trace(start, _edges(spark, sf))


def parent_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as organizations under the customer of half their number; a few loops, one of twelve."""
    key = F.col("c_custkey")
    organizations = table(spark, sf, "customer").select(
        key.alias("id"),
        F.when(key == 0, F.lit(5)).when(key.between(20, 31), F.when(key == 31, 20).otherwise(key + 1)).when(F.col("c_acctbal") < 0, -key - 1).otherwise(F.floor(key / 2)).cast("bigint").alias("parent_id"),
        F.col("c_mktsegment").alias("tenant_id"),
    )
    return governance.parent_violations(organizations).select("id", "missing_parent", "other_tenant", "cycle")


def source_authority(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals as two sources report them; the ledger outranks the board."""
    claims = views.claims(spark, sf)
    board = claims.select(
        F.col("id").alias("entity_id"), F.lit("amount").alias("field"), F.lit("board").alias("source"),
        text(F.col("original_rcv")).alias("value"),
    )
    ledger = claims.where(F.col("settled_rcv").isNotNull()).select(
        F.col("id").alias("entity_id"), F.lit("amount").alias("field"), F.lit("ledger").alias("source"),
        text(F.col("settled_rcv")).alias("value"),
    )
    ranks = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit("amount").alias("field"), F.lit(s).alias("source"), F.lit(r).alias("rank"))
                    for s, r in (("ledger", 1), ("board", 2))
                ]
            )
        )
    )
    return governance.resolve_authority(board.unionByName(ledger), ranks)


_QUARTER = "year({0}) || ' Q' || quarter({0})"

QUERIES = {
    "status_groups": (
        status_groups,
        f"""WITH {STATUS} SELECT status, CASE WHEN status IN ('New', 'In Queue', 'In Progress') THEN 'open'
        WHEN status = 'Completed' THEN 'completed' END AS status_group, count(*) AS rows FROM st GROUP BY 1, 2""",
    ),
    "status_intervals": (
        status_intervals,
        f"""WITH {STATUS} SELECT file_id, position, status, CAST(date_diff('second', entered, exited) AS BIGINT) AS duration_seconds,
        exited IS NULL AS is_current FROM iv""",
    ),
    "invalid_transitions": (
        invalid_transitions,
        f"""WITH {STATUS} SELECT file_id, position, from_status, status FROM iv WHERE from_status IS NOT NULL AND NOT (
        (from_status = 'New' AND status = 'In Queue') OR (from_status = 'In Queue' AND status = 'In Progress')
        OR (service_type = 'estimate_only' AND from_status = 'In Progress' AND status = 'Completed')
        OR (service_type = 'estimate_only' AND from_status = 'Completed' AND status = 'In Queue'))""",
    ),
    "collapsed_status_events": (
        collapsed_status_events,
        f"""WITH {STATUS} SELECT file_id, status, min(position) AS position, count(*) AS source_rows FROM st
        GROUP BY file_id, status, entered""",
    ),
    "status_provenance": (
        status_provenance,
        f"""WITH {STATUS} SELECT count(DISTINCT (file_id, status, entered)) AS events, count(*) AS source_rows FROM st""",
    ),
    "stage_ageing": (
        stage_ageing,
        f"""WITH {STATUS} SELECT status, count(*) AS entries, count(exited) AS finished, count(*) - count(exited) AS waiting,
        CAST(sum(date_diff('second', entered, exited)) AS DOUBLE) / CAST(count(exited) AS DOUBLE) AS mean_seconds FROM iv GROUP BY 1""",
    ),
    "current_assignments": (
        current_assignments,
        f"WITH {ASSIGNED} SELECT file_id, assignment_type, assignee, position FROM asg WHERE ended IS NULL",
    ),
    "open_assignment_conflicts": (
        open_assignment_conflicts,
        f"""WITH {ASSIGNED} SELECT file_id, assignment_type, count(*) AS open_rows FROM asg GROUP BY 1, 2 HAVING count(*) > 1""",
    ),
    "workload": (
        workload,
        f"""WITH {ASSIGNED} SELECT assignee, assignment_type, count(*) AS assignments, count(*) FILTER (WHERE ended IS NULL) AS "current",
        count(ended) AS handed_on FROM asg GROUP BY 1, 2""",
    ),
    "overlapping_ranges": (
        overlapping_ranges,
        f"""WITH {ASSIGNED} SELECT file_id, assignment_type, position FROM asg WHERE ended IS NOT NULL
        AND started + INTERVAL 10 HOURS > ended""",
    ),
    "derived_quarters": (
        derived_quarters,
        f"""WITH {CLAIMS}, q AS (SELECT id, source_quarter, CASE WHEN service_type = 'estimate_only' THEN opened_at + 95
        ELSE opened_at END AS s, closed_at AS c, closed_at + 30 AS d, closed_at + 7 AS i, closed_at + 75 AS p FROM claims),
        r AS (SELECT id, source_quarter, {_QUARTER.format('s')} AS submission_quarter, {_QUARTER.format('c')} AS completion_quarter,
        {_QUARTER.format('d')} AS due_quarter, {_QUARTER.format('i')} AS invoice_quarter, {_QUARTER.format('p')} AS collection_quarter FROM q)
        SELECT id, submission_quarter, completion_quarter, due_quarter, invoice_quarter, collection_quarter,
        NOT (source_quarter = submission_quarter OR coalesce(source_quarter = completion_quarter, FALSE)
        OR coalesce(source_quarter = due_quarter, FALSE) OR coalesce(source_quarter = invoice_quarter, FALSE)
        OR coalesce(source_quarter = collection_quarter, FALSE)) AS quarter_conflict FROM r""",
    ),
    "invoice_balances": (
        invoice_balances,
        f"""WITH {MONEY} SELECT o_orderkey AS invoice_id, currency, CAST(charged AS BIGINT) AS charged_minor,
        CAST(active_lines AS BIGINT) AS active_lines, CAST(collected AS BIGINT) AS collected_minor,
        CAST(open AS BIGINT) AS open_balance_minor FROM bal""",
    ),
    "unbalanced_invoices": (
        unbalanced_invoices,
        f"""WITH {MONEY} SELECT o_orderkey AS invoice_id, amount AS amount_minor, CAST(charged AS BIGINT) AS charged_minor
        FROM bal WHERE amount <> charged""",
    ),
    "currency_totals": (
        currency_totals,
        f"""WITH {MONEY} SELECT organization_id, currency, CAST(sum(amount) AS BIGINT) AS total_minor, count(*) AS rows
        FROM ord GROUP BY 1, 2""",
    ),
    "receivables_ageing": (
        receivables_ageing,
        f"""WITH {MONEY}, b AS (SELECT *, date_diff('day', day + 30, DATE '{AS_OF}') AS late FROM bal WHERE open > 0)
        SELECT CASE WHEN late <= 0 THEN 'not due' WHEN late <= 30 THEN '0–30' WHEN late <= 60 THEN '31–60'
        WHEN late <= 90 THEN '61–90' ELSE '90+' END AS bucket, currency, count(*) AS invoices, CAST(sum(open) AS BIGINT) AS open_minor
        FROM b GROUP BY 1, 2""",
    ),
    "payment_matches": (
        payment_matches,
        f"""WITH {MONEY}, {MATCH} SELECT payment_id, CASE step WHEN 1 THEN 'invoice_id' WHEN 2 THEN 'file_id'
        WHEN 3 THEN 'metadata_reference' WHEN 4 THEN 'customer_amount_window' WHEN 5 THEN 'organization_amount_window'
        ELSE 'manual_review' END AS match_step, candidates, invoice_id, match_state FROM pm""",
    ),
    "reconciliation_states": (
        reconciliation_states,
        f"""WITH {MONEY}, {MATCH} SELECT payment_id, CASE
        WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '2-HIGH' THEN 'resolved_manual'
        WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '1-URGENT' THEN 'disputed'
        WHEN coalesce(allocated_all, 0) > pm.amount THEN 'overallocated_blocked'
        WHEN coalesce(refunded, 0) > 0 AND coalesce(allocated_all, 0) > 0 THEN 'refunded'
        WHEN coalesce(allocated_all, 0) > 0 AND allocated_all = pm.amount THEN 'fully_allocated'
        WHEN coalesce(allocated_all, 0) > 0 THEN 'partially_allocated'
        WHEN match_state = 'ambiguous' THEN 'ambiguous'
        WHEN match_state IN ('matched', 'candidate_found') THEN 'candidate_found' ELSE 'unmatched' END AS reconciliation_state
        FROM pm JOIN ord o ON o.o_orderkey = payment_id LEFT JOIN per ON l_orderkey = payment_id""",
    ),
    "over_allocations": (
        over_allocations,
        f"""WITH {MONEY}, a AS (SELECT l_orderkey, sum(cents) AS allocated FROM ln WHERE l_linestatus = 'F' GROUP BY 1)
        SELECT 'payment' AS entity, o_orderkey AS entity_id, CAST(amount - refunded AS BIGINT) AS limit_minor,
        CAST(a.allocated AS BIGINT) AS allocated_minor FROM ord JOIN a ON a.l_orderkey = o_orderkey JOIN per ON per.l_orderkey = o_orderkey
        WHERE a.allocated > amount - refunded
        UNION ALL SELECT 'invoice', o_orderkey, amount, CAST(allocated AS BIGINT) FROM ord JOIN a ON a.l_orderkey = o_orderkey
        WHERE allocated > amount""",
    ),
    "refunds_over_limit": (
        refunds_over_limit,
        f"""WITH {MONEY} SELECT o_orderkey AS payment_id, amount AS amount_minor, CAST(refunded AS BIGINT) AS refunded_minor
        FROM ord JOIN per ON l_orderkey = o_orderkey WHERE refunded > amount""",
    ),
    "revenue_lenses": (
        revenue_lenses,
        f"""WITH {CLAIMS}, {MONEY}, x AS (
        SELECT 'operational_production' AS lens, closed_at AS d, currency, amount FROM ord JOIN claims ON id = CAST(o_orderkey AS VARCHAR)
        UNION ALL SELECT 'invoiced_revenue', day, currency, amount FROM ord
        UNION ALL SELECT 'cash_received', paid_on, currency, cents FROM ln JOIN ord ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'
        UNION ALL SELECT 'net_collections', paid_on, currency, cents FROM ln JOIN ord ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'
        UNION ALL SELECT 'net_collections', day + 30, currency, -cents FROM ln JOIN ord ON o_orderkey = l_orderkey
          WHERE l_linestatus = 'F' AND l_returnflag = 'R')
        SELECT lens, {_QUARTER.format('d')} AS quarter, currency, CAST(sum(amount) AS BIGINT) AS total_minor FROM x
        WHERE d IS NOT NULL GROUP BY 1, 2, 3""",
    ),
    "completion_to_cash": (
        completion_to_cash,
        f"""WITH {CLAIMS}, {MONEY}, x AS (SELECT closed_at, paid_on, currency, cents FROM ln JOIN ord ON o_orderkey = l_orderkey
        LEFT JOIN claims ON id = CAST(l_orderkey AS VARCHAR) WHERE l_linestatus = 'F')
        SELECT {_QUARTER.format('closed_at')} AS completion_quarter, {_QUARTER.format('paid_on')} AS collection_quarter, currency,
        CAST(sum(cents) AS BIGINT) AS cash_minor, count(*) AS allocations,
        CASE WHEN count(closed_at) > 0 THEN CAST(sum(date_diff('day', closed_at, paid_on)) AS DOUBLE) / CAST(count(closed_at) AS DOUBLE)
        END AS mean_lag_days FROM x GROUP BY 1, 2, 3""",
    ),
    "gated_panel": (gated_panel, panel_sql(group="state", minimum=93)),
    "strict_grades": (
        strict_grades,
        f"""WITH {CLAIMS}, c AS (SELECT carrier_id, state, count(*) AS files, count(*) FILTER (WHERE financial_status IN
        ('captured', 'partially_captured')) AS usable FROM claims GROUP BY 1, 2),
        d AS (SELECT *, {sql_coverage('usable', 'files')} AS coverage_percent FROM c)
        SELECT carrier_id, state, coverage_percent, {sql_grade('coverage_percent', (95, 80, 50))} AS grade FROM d""",
    ),
    "quality_violations": (
        quality_violations,
        f"""WITH {CLAIMS}, v AS (SELECT id, 'completion-has-date' AS rule_id, 'error' AS severity FROM claims
          WHERE status = 'closed' AND closed_at IS NULL
        UNION ALL SELECT id, 'closed-not-before-opened', 'error' FROM claims WHERE closed_at < opened_at
        UNION ALL SELECT id, 'missing-amount-has-reason', 'warning' FROM claims WHERE additional_rcv IS NULL
          AND financial_status NOT IN ('not_captured', 'not_applicable')
        UNION ALL SELECT id, 'negative-gain', 'info' FROM claims WHERE additional_rcv < 0)
        SELECT 'claim' AS entity, id AS entity_id, rule_id, severity, 'open' AS state FROM v""",
    ),
    "exclusion_reasons": (
        exclusion_reasons,
        f"""WITH {CLAIMS} SELECT CASE WHEN status <> 'closed' THEN 'not_closed' WHEN closed_at IS NULL THEN 'no_closing_date'
        WHEN closed_at < opened_at THEN 'reversed_dates' ELSE 'eligible' END AS reason, count(*) AS rows FROM claims GROUP BY 1""",
    ),
    "lineage_back": (
        lineage_back,
        f"""WITH {CLAIMS}, c AS (SELECT id FROM claims WHERE source_quarter = '1998 Q2')
        SELECT 'metric:1998 Q2' AS node, CAST(0 AS BIGINT) AS steps FROM claims GROUP BY 1, 2
        UNION ALL SELECT 'claim:' || id, 1 FROM c
        UNION ALL SELECT DISTINCT concat_ws('-', 'line:', l_orderkey, l_partkey, l_suppkey, l_linenumber), 2 FROM lineitem
        JOIN c ON id = CAST(l_orderkey AS VARCHAR)""",
    ),
    "lineage_forward": (
        lineage_forward,
        f"""WITH {CLAIMS}, l AS (SELECT * FROM lineitem WHERE l_returnflag = 'R')
        SELECT DISTINCT concat_ws('-', 'line:', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS node, CAST(0 AS BIGINT) AS steps FROM l
        UNION ALL SELECT DISTINCT 'claim:' || l_orderkey, 1 FROM l
        UNION ALL SELECT DISTINCT 'metric:' || source_quarter, 2 FROM l JOIN claims ON id = CAST(l_orderkey AS VARCHAR)""",
    ),
    "parent_violations": (
        parent_violations,
        """WITH RECURSIVE o AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN 5
        WHEN c_custkey BETWEEN 20 AND 31 THEN CASE WHEN c_custkey = 31 THEN 20 ELSE c_custkey + 1 END
        WHEN c_acctbal < 0 THEN -c_custkey - 1 ELSE c_custkey // 2 END AS parent_id, c_mktsegment AS tenant_id FROM customer),
        up AS (SELECT id AS origin, parent_id AS node FROM o UNION SELECT up.origin, o.parent_id FROM up JOIN o ON o.id = up.node),
        loops AS (SELECT DISTINCT origin FROM up WHERE origin = node),
        w AS (SELECT a.id, p1.id IS NULL AS missing_parent, coalesce(p1.tenant_id <> a.tenant_id, FALSE) AS other_tenant,
        a.id IN (SELECT origin FROM loops) AS cycle FROM o a LEFT JOIN o p1 ON p1.id = a.parent_id)
        SELECT * FROM w WHERE missing_parent OR other_tenant OR cycle""",
    ),
    "source_authority": (
        source_authority,
        f"""WITH {CLAIMS} SELECT id AS entity_id, 'amount' AS field, CASE WHEN settled_rcv IS NULL THEN 'board' ELSE 'ledger' END AS source,
        CASE WHEN settled_rcv IS NULL THEN CAST(original_rcv AS VARCHAR) ELSE CAST(CAST(settled_rcv AS DECIMAL(28,4)) AS VARCHAR) END
        AS value, CAST(CASE WHEN settled_rcv IS NULL THEN 1 ELSE 2 END AS BIGINT) AS candidates,
        coalesce(CAST(original_rcv AS VARCHAR) <> CAST(CAST(settled_rcv AS DECIMAL(28,4)) AS VARCHAR), FALSE) AS conflict FROM claims""",
    ),
}
