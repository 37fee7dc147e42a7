"""Dashboard queries: metrics, rankings, ageing, observations, weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.dates import cycle_days, days_since
from claimloom.functions.envelope import coverage_percent, grade
from claimloom.operators import explorer, filters, metrics, observations, rankings, weather
from claimloom.operators.filters import ClaimFilter
from claimloom.plans import dashboards
from workload import views
from workload.views import AS_OF, CARRIERS, CLAIMS, CONTRACTORS, MATCHES, QUARTERS, UPDATES, WEATHER_EVENTS

PERIOD = ClaimFilter(quarter="1998 Q2")
NARROW = ClaimFilter(
    start_date="1996-01-01", end_date="2000-12-31", carrier_id="MACHINERY", service_type="estimate_only"
)

_METRICS = (
    ("total_files", "files", "files"),
    ("estimate_only_files", "estimate_only", "estimate_only"),
    ("claim_handling_files", "claim_handling", "claim_handling"),
    ("active_inventory", "active", "active"),
    ("closed_files", "closed", "closed"),
    ("additional_value", "gain_sum", "gain_n"),
    ("mean_additional_value", "gain_sum / gain_n", "gain_n"),
    ("fee_revenue", "fee_sum", "fee_n"),
    ("mean_cycle_days", "cycle_sum / cycle_n", "cycle_n"),
    ("financial_coverage", "CASE WHEN files > 0 THEN usable / files * 100.0::DOUBLE END", "usable"),
    ("median_additional_value", "gain_median", "gain_n"),
    ("median_cycle_days", "cycle_median", "cycle_n"),
)


def middle(values: str) -> str:
    return f"(CAST({values}[(len({values}) + 1) // 2] AS DOUBLE) + CAST({values}[len({values}) // 2 + 1] AS DOUBLE)) / 2.0"


def sql_grade(coverage: str, cuts: tuple[int, int, int] = (90, 75, 50)) -> str:
    a, b, c = cuts
    return f"CASE WHEN {coverage} >= {a} THEN 'A' WHEN {coverage} >= {b} THEN 'B' WHEN {coverage} >= {c} THEN 'C' ELSE 'D' END"


def sql_coverage(part: str, whole: str) -> str:
    return (
        f"CAST(CASE WHEN {whole} = 0 THEN 0 ELSE floor(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0 + 0.5) END "
        "AS BIGINT)"
    )


def panel_sql(
    where: str = "TRUE",
    group: str = "",
    names: tuple[str, ...] = (),
    minimum: int | None = None,
    cuts: tuple[int, int, int] = (90, 75, 50),
) -> str:
    chosen = [m for m in _METRICS if not names or m[0] in names]
    lead = f"{group}, " if group else ""
    tall = " UNION ALL ".join(
        f"SELECT {lead}'{name}' AS metric, CAST({value} AS DOUBLE) AS raw, CAST({part} AS BIGINT) AS numerator, "
        "CAST(files AS BIGINT) AS denominator FROM numbers"
        for name, value, part in chosen
    )
    shown = "raw" if minimum is None else f"CASE WHEN coverage_percent >= {minimum} THEN raw END"
    return f"""WITH {CLAIMS},
    totals AS (
      SELECT {lead}CAST(count(*) AS DOUBLE) AS files,
        CAST(count(*) FILTER (WHERE service_type = 'estimate_only') AS DOUBLE) AS estimate_only,
        CAST(count(*) FILTER (WHERE service_type = 'claim_handling') AS DOUBLE) AS claim_handling,
        CAST(count(*) FILTER (WHERE status <> 'closed') AS DOUBLE) AS active,
        CAST(count(*) FILTER (WHERE status = 'closed') AS DOUBLE) AS closed,
        CAST(count(*) FILTER (WHERE financial_status IN ('captured', 'partially_captured')) AS DOUBLE) AS usable,
        CAST(sum(gain) AS DOUBLE) AS gain_sum, CAST(count(gain) AS DOUBLE) AS gain_n,
        CAST(sum(fee) AS DOUBLE) AS fee_sum, CAST(count(fee) AS DOUBLE) AS fee_n,
        CAST(sum(cycle) AS DOUBLE) AS cycle_sum, CAST(count(cycle) AS DOUBLE) AS cycle_n,
        list_sort(list(gain) FILTER (WHERE gain IS NOT NULL)) AS gains,
        list_sort(list(cycle) FILTER (WHERE cycle IS NOT NULL)) AS cycles
      FROM measured WHERE {where} {'GROUP BY ' + group if group else ''}),
    numbers AS (SELECT *, {middle('gains')} AS gain_median, {middle('cycles')} AS cycle_median FROM totals),
    tall AS ({tall}),
    covered AS (SELECT *, {sql_coverage('numerator', 'denominator')} AS coverage_percent FROM tall),
    shown AS (SELECT *, {shown} AS value FROM covered)
    SELECT {lead}metric, value, numerator, denominator, coverage_percent,
      {sql_grade('coverage_percent', cuts)} AS grade,
      CASE WHEN value IS NULL THEN 'unavailable' ELSE 'measured' END AS status FROM shown"""


def _plain(panel: DataFrame) -> DataFrame:
    return panel.drop("explanation", "drill_down")


def quarter_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    panel = metrics.metric_panel(filters.filter_claims(views.claims(spark, sf), PERIOD), with_medians=False)
    return _plain(panel).where(F.col("metric").isin("total_files", "active_inventory", "financial_coverage"))


def kpi_panel(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(metrics.metric_panel(views.claims(spark, sf)))


def kpi_panel_by_quarter(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(metrics.metric_panel(views.claims(spark, sf), ["source_quarter"]))


def kpi_panel_by_state(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(metrics.metric_panel(views.claims(spark, sf), ["state"]))


def filtered_panel(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(metrics.metric_panel(filters.filter_claims(views.claims(spark, sf), NARROW)))


def metric_drill_downs(spark: SparkSession, sf: str) -> DataFrame:
    """Files behind each drill-down of the panel, counted through the filter it names."""
    claims = views.claims(spark, sf)
    rows = None
    for service in ("estimate_only", "claim_handling"):
        part = filters.filter_claims(claims, ClaimFilter(service_type=service)).agg(F.count("*").alias("files"))
        part = part.select(F.lit(service).alias("service_type"), "files")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def usable_amounts(spark: SparkSession, sf: str) -> DataFrame:
    values = filters.usable_values(views.claims(spark, sf), "additional_rcv")
    return values.select("id", F.col("value").cast("double").alias("value"))


def claim_durations(spark: SparkSession, sf: str) -> DataFrame:
    claims = views.claims(spark, sf)
    return claims.select(
        "id",
        cycle_days(F.col("opened_at"), F.col("closed_at")).cast("bigint").alias("cycle_days"),
        days_since(F.col("opened_at"), F.lit(AS_OF).cast("date")).cast("bigint").alias("age_days"),
    )


def coverage_grades(spark: SparkSession, sf: str) -> DataFrame:
    """Share of usable files per contractor, with its grade."""
    totals = metrics.metric_totals(views.claims(spark, sf), ["contractor_id"])
    coverage = coverage_percent(F.col("usable"), F.col("files"))
    return totals.select("contractor_id", "files", coverage.alias("coverage_percent"), grade(coverage).alias("grade"))


def carrier_mix(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.carrier_mix(views.claims(spark, sf), views.carriers(spark, sf))


def carrier_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.carrier_scorecard(views.claims(spark, sf), views.carriers(spark, sf))


def contractor_ranking(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rankings.contractor_ranking(views.claims(spark, sf), views.contractors(spark, sf))
    return ranked.withColumn("recovered", F.col("recovered").cast("double"))


def ageing(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ageing_buckets(views.claims(spark, sf), AS_OF)


def update_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(metrics.update_frequency(views.claims(spark, sf), views.updates(spark, sf)))


def update_gaps(spark: SparkSession, sf: str) -> DataFrame:
    gaps = metrics.update_gaps(views.updates(spark, sf), block_rows=512)
    return gaps.select("claim_id", "position", F.col("gap_days").cast("bigint").alias("gap_days"))


def last_update_age(spark: SparkSession, sf: str) -> DataFrame:
    aged = metrics.days_since_last_update(views.claims(spark, sf), views.updates(spark, sf), "2024-12-31")
    return aged.select("id", F.col("days_since_last_update").cast("bigint").alias("days"))


def quarter_trend(spark: SparkSession, sf: str) -> DataFrame:
    chosen = ClaimFilter(quarter="1998 Q2", state="NATION_3", start_date="1997-01-01")
    return rankings.quarter_trend(views.claims(spark, sf), views.quarters(spark, sf), chosen)


def prior_quarters(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.prior_quarters(views.quarters(spark, sf))


def report_index(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.report_index(views.claims(spark, sf))


def executive_observations(spark: SparkSession, sf: str) -> DataFrame:
    return dashboards.executive(views.warehouse(spark, sf), PERIOD)["observations"]


def first_quarter_observations(spark: SparkSession, sf: str) -> DataFrame:
    """The first quarter has an empty prior period."""
    return dashboards.executive(views.warehouse(spark, sf), ClaimFilter(quarter="1995 Q1"))["observations"]


def new_states(spark: SparkSession, sf: str) -> DataFrame:
    """States with closed files opened after 2001-07-30 but none opened before 1995-01-03."""
    claims = views.claims(spark, sf).where(filters.is_closed())
    late = filters.filter_claims(claims, ClaimFilter(start_date="2001-07-30"))
    early = filters.filter_claims(claims, ClaimFilter(end_date="1995-01-03"))
    return rankings.only_in_first(late, early, "state")


def weather_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = views.matches(spark, sf)
    return found.select("claim_id", "weather_event_id", "gap_days", F.col("confidence").cast("double"))


def weather_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = dashboards.weather_review(views.warehouse(spark, sf), NARROW)["events"]
    return rolled.select("id", "name", "matches", "mean_confidence")


def top_carrier(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.most_frequent(views.claims(spark, sf), "carrier_id")


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.counts_by(views.claims(spark, sf), ["status", "financial_status"])


def busiest_share(spark: SparkSession, sf: str) -> DataFrame:
    per_state = rankings.counts_by(views.claims(spark, sf), ["state"], "files")
    return rankings.share_of_largest(per_state, "files", "percent_of_largest")


def claim_search(spark: SparkSession, sf: str) -> DataFrame:
    found = filters.search_claims(
        views.claims(spark, sf), views.contractors(spark, sf), views.carriers(spark, sf), "#00000000", "closed", "captured"
    )
    return found.select("id", "claim_number", "contractor", "carrier")


def claim_page(spark: SparkSession, sf: str) -> DataFrame:
    """Third page of ten claims, newest first as text, ids as tie-break."""
    order = explorer.text_order("opened_at", descending=True)
    rows = views.claims(spark, sf).select("id", "claim_number", "opened_at", "status")
    page = explorer.page_slice(rows, order, page=3, size=10)
    return page.withColumn("opened_at", F.col("opened_at").cast("string"))


def last_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page far past the end gives the last one."""
    order = explorer.typed_order("additional_rcv", descending=True)
    rows = views.claims(spark, sf).select("id", "additional_rcv")
    page = explorer.page_slice(rows, order, page=10_000_000, size=20)
    return page.select("id", F.col("additional_rcv").cast("double"), "position", "page", "pages")


def picker_states(spark: SparkSession, sf: str) -> DataFrame:
    return explorer.picker_values(views.claims(spark, sf), "state")


def claim_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = filters.find_by_id(views.claims(spark, sf), "id", "42")
    return found.select("id", "claim_number", "status", "source_quarter", F.col("original_rcv").cast("double"))


def impossible_dates(spark: SparkSession, sf: str) -> DataFrame:
    return filters.count_impossible_dates(views.claims(spark, sf), "opened_at", "closed_at")


_OBS_PERIOD = f"""
now AS (SELECT * FROM measured WHERE source_quarter = '{{quarter}}'),
prior_quarter AS (SELECT quarter FROM quarters WHERE ordinal <
  (SELECT ordinal FROM quarters WHERE quarter = '{{quarter}}') ORDER BY ordinal DESC LIMIT 1),
prior AS (SELECT * FROM measured WHERE source_quarter IN (SELECT quarter FROM prior_quarter)),
n AS (SELECT count(*) AS files, CAST(sum(gain) AS DOUBLE) / CAST(nullif(count(gain), 0) AS DOUBLE) AS gain,
  CAST(sum(cycle) AS DOUBLE) / CAST(nullif(count(cycle), 0) AS DOUBLE) AS cycle,
  coalesce(CAST(count(*) FILTER (WHERE financial_status IN ('captured', 'partially_captured')) AS DOUBLE)
    / CAST(nullif(count(*), 0) AS DOUBLE) * 100.0, 0.0) AS coverage FROM now),
p AS (SELECT count(*) AS files, CAST(sum(gain) AS DOUBLE) / CAST(nullif(count(gain), 0) AS DOUBLE) AS gain,
  CAST(sum(cycle) AS DOUBLE) / CAST(nullif(count(cycle), 0) AS DOUBLE) AS cycle FROM prior),
newest AS (SELECT claim_id, max(upd_day) AS last_at FROM updates GROUP BY claim_id),
attention AS (SELECT count(*) AS stalled,
  count(*) FILTER (WHERE greatest(0, date_diff('day', last_at, DATE '{AS_OF}')) > 21) AS silent
  FROM now LEFT JOIN newest ON claim_id = id WHERE status = 'stalled'),
old AS (SELECT count(*) AS old FROM now WHERE status <> 'closed'
  AND greatest(0, date_diff('day', opened_at, DATE '{AS_OF}')) BETWEEN 91 AND 9999),
top AS (SELECT c.name, count(*) AS files FROM now JOIN carriers c ON c.id = carrier_id
  GROUP BY c.id, c.name ORDER BY files DESC, c.id LIMIT 1),
fresh AS (SELECT coalesce(string_agg(state, ', ' ORDER BY state), '') AS states FROM
  (SELECT DISTINCT state FROM now WHERE state IS NOT NULL EXCEPT SELECT state FROM prior)),
wx AS (SELECT count(*) AS matched, count(DISTINCT weather_event_id) AS events FROM matches
  WHERE claim_id IN (SELECT id FROM now)),
one_decimal AS (SELECT 1),
facts AS (SELECT n.files AS nf, p.files AS pf, n.gain AS ng, p.gain AS pg, n.cycle AS nc, p.cycle AS pc, n.coverage,
  attention.*, old.old, top.name AS carrier, CAST(top.files AS DOUBLE) / CAST(n.files AS DOUBLE) * 100.0 AS share,
  fresh.states, wx.matched, wx.events,
  CASE WHEN p.files = 0 THEN 0.0 ELSE CAST(n.files - p.files AS DOUBLE) / CAST(p.files AS DOUBLE) * 100.0 END AS volume,
  CASE WHEN coalesce(n.gain, 0) <> 0 AND coalesce(p.gain, 0) <> 0 THEN (n.gain - p.gain) / p.gain * 100.0 END AS gain_change,
  coalesce(n.cycle, 0) <> 0 AND coalesce(p.cycle, 0) <> 0 AND n.cycle > p.cycle * 1.08::DOUBLE AS slower
  FROM n, p, attention, old, fresh, wx LEFT JOIN top ON TRUE)"""


def _one(value: str) -> str:
    return (
        f"CAST(CAST(CASE WHEN {value} < 0 THEN -floor(abs({value}) * 10.0 + 0.5) / 10.0 "
        f"ELSE floor(abs({value}) * 10.0 + 0.5) / 10.0 END AS DECIMAL(18,1)) AS VARCHAR)"
    )


def observation_sql(quarter: str) -> str:
    rules = [
        ("volume", "TRUE", "CASE WHEN volume >= 0 THEN 'info' ELSE 'warning' END", "volume", "pf",
         "nf || ' files after ' || pf"),
        ("recovery", "TRUE", "CASE WHEN gain_change IS NOT NULL AND ng >= pg THEN 'positive' ELSE 'info' END",
         "gain_change", "pg",
         f"CASE WHEN gain_change IS NULL THEN 'no usable amounts to compare' ELSE {_one('gain_change')} || ' percent change' END"),
        ("cycle", "slower", "'warning'", "nc - pc", "pc", f"{_one('(nc - pc)')} || ' days slower'"),
        ("carrier", "share > 35", "'warning'", "share", "NULL", f"carrier || ' holds ' || {_one('share')} || ' percent'"),
        ("coverage", "coverage < 75", "'warning'", "coverage", "NULL", f"{_one('coverage')} || ' percent usable'"),
        ("stalled", "stalled > 0", "'critical'", "stalled", "silent",
         "stalled || ' stalled, ' || silent || ' without a recent update'"),
        ("aging", "old > 0", "'warning'", "old", "NULL", "old || ' old active files'"),
        ("geo", "states <> ''", "'positive'", "NULL", "NULL", "'new in ' || states"),
        ("weather", "matched > 0", "'info'", "matched", "events", "matched || ' files match ' || events || ' events'"),
    ]
    body = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS ordinal, '{rule}' AS rule, {severity} AS severity, CAST({measure} AS DOUBLE) AS measure, "
        f"CAST({comparison} AS DOUBLE) AS comparison, {detail} AS detail FROM facts WHERE {fires}"
        for i, (rule, fires, severity, measure, comparison, detail) in enumerate(rules, 1)
    )
    ctes = ",".join((CLAIMS, UPDATES, CARRIERS, QUARTERS, WEATHER_EVENTS, MATCHES))
    return f"WITH {ctes},{_OBS_PERIOD.format(quarter=quarter).replace('one_decimal AS (SELECT 1),', '')} {body}"


_AGE = f"greatest(0, date_diff('day', opened_at, DATE '{AS_OF}'))"

QUERIES = {
    "quarter_snapshot": (
        quarter_snapshot,
        panel_sql("source_quarter = '1998 Q2'", names=("total_files", "active_inventory", "financial_coverage")),
    ),
    "kpi_panel": (kpi_panel, panel_sql()),
    "kpi_panel_by_quarter": (kpi_panel_by_quarter, panel_sql(group="source_quarter")),
    "kpi_panel_by_state": (kpi_panel_by_state, panel_sql(group="state")),
    "filtered_panel": (
        filtered_panel,
        panel_sql(
            "opened_at BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND carrier_id = 'MACHINERY' "
            "AND service_type = 'estimate_only'"
        ),
    ),
    "metric_drill_downs": (
        metric_drill_downs,
        f"WITH {CLAIMS} SELECT service_type, count(*) AS files FROM claims GROUP BY service_type",
    ),
    "usable_amounts": (
        usable_amounts,
        f"WITH {CLAIMS} SELECT id, CAST(gain AS DOUBLE) AS value FROM measured WHERE gain IS NOT NULL",
    ),
    "claim_durations": (
        claim_durations,
        f"WITH {CLAIMS} SELECT id, CAST(cycle AS BIGINT) AS cycle_days, CAST({_AGE} AS BIGINT) AS age_days FROM measured",
    ),
    "coverage_grades": (
        coverage_grades,
        f"""WITH {CLAIMS}, c AS (SELECT contractor_id, count(*) AS files,
        count(*) FILTER (WHERE financial_status IN ('captured', 'partially_captured')) AS usable FROM claims GROUP BY 1),
        d AS (SELECT *, {sql_coverage('usable', 'files')} AS coverage_percent FROM c)
        SELECT contractor_id, files, coverage_percent, {sql_grade('coverage_percent')} AS grade FROM d""",
    ),
    "carrier_mix": (
        carrier_mix,
        f"""WITH {CLAIMS},{CARRIERS}, c AS (SELECT carrier_id, count(*) AS files FROM claims GROUP BY 1)
        SELECT id, name, files, CAST(files AS DOUBLE) / CAST((SELECT count(*) FROM claims) AS DOUBLE) * 100.0 AS share_percent,
        row_number() OVER (ORDER BY files DESC, id) AS position FROM c JOIN carriers ON id = carrier_id""",
    ),
    "carrier_scorecard": (
        carrier_scorecard,
        f"""WITH {CLAIMS},{CARRIERS}, c AS (SELECT carrier_id, count(*) AS files,
        CAST(sum(gain) AS DOUBLE) / CAST(count(gain) AS DOUBLE) AS mean_additional_value,
        CAST(sum(cycle) AS DOUBLE) / CAST(count(cycle) AS DOUBLE) AS mean_cycle_days,
        count(*) FILTER (WHERE financial_status IN ('captured', 'partially_captured')) AS usable FROM measured GROUP BY 1),
        d AS (SELECT *, CAST(usable AS DOUBLE) / CAST(files AS DOUBLE) * 100.0 AS coverage_value,
        {sql_coverage('usable', 'files')} AS coverage_percent FROM c)
        SELECT id, name, files, mean_additional_value, mean_cycle_days, coverage_value, coverage_percent,
        {sql_grade('coverage_percent')} AS grade FROM d JOIN carriers ON id = carrier_id""",
    ),
    "contractor_ranking": (
        contractor_ranking,
        f"""WITH {CLAIMS},{CONTRACTORS}, c AS (SELECT contractor_id, count(*) AS files,
        count(*) FILTER (WHERE status = 'closed') AS closed, coalesce(sum(gain), 0) AS recovered_exact,
        count(gain) AS usable_count FROM measured GROUP BY 1)
        SELECT contractor_id, name, files, closed, CAST(recovered_exact AS DOUBLE) AS recovered, usable_count,
        CAST(closed AS DOUBLE) / CAST(files AS DOUBLE) * 100.0 AS close_rate,
        row_number() OVER (ORDER BY recovered_exact DESC, contractor_id) AS position,
        CAST(recovered_exact AS DOUBLE) / greatest(1.0, CAST(max(recovered_exact) OVER () AS DOUBLE)) * 100.0 AS percent_of_largest
        FROM c JOIN contractors ON id = contractor_id""",
    ),
    "ageing": (
        ageing,
        f"""WITH {CLAIMS}, b(ordinal, bucket, low, high) AS (VALUES (1, '0–30', 0, 30), (2, '31–60', 31, 60),
        (3, '61–90', 61, 90), (4, '90+', 91, 9999)),
        c AS (SELECT ordinal, bucket, count(id) AS files FROM b LEFT JOIN claims
        ON status <> 'closed' AND {_AGE} BETWEEN low AND high GROUP BY 1, 2)
        SELECT CAST(ordinal AS BIGINT) AS ordinal, bucket, files,
        CAST(files AS DOUBLE) / greatest(1.0, CAST(max(files) OVER () AS DOUBLE)) * 100.0 AS percent_of_largest FROM c""",
    ),
    "update_frequency": (
        update_frequency,
        f"""WITH {CLAIMS},{UPDATES}, g AS (SELECT claim_id,
        greatest(0, date_diff('day', lag(upd_day) OVER (PARTITION BY claim_id ORDER BY position), upd_day)) AS gap,
        lag(upd_day) OVER (PARTITION BY claim_id ORDER BY position) AS before FROM updates),
        active AS (SELECT id FROM claims WHERE status <> 'closed'),
        t AS (SELECT CAST(sum(gap) AS DOUBLE) AS days, count(*) AS gaps FROM g JOIN active ON id = claim_id WHERE before IS NOT NULL),
        r AS (SELECT 'update_frequency' AS metric, days / CAST(gaps AS DOUBLE) AS value, gaps AS numerator,
        (SELECT count(*) FROM active) AS denominator FROM t),
        c AS (SELECT *, {sql_coverage('numerator', 'denominator')} AS coverage_percent FROM r)
        SELECT *, {sql_grade('coverage_percent')} AS grade, 'measured' AS status FROM c""",
    ),
    "update_gaps": (
        update_gaps,
        f"""WITH {UPDATES}, g AS (SELECT claim_id, position, upd_day,
        lag(upd_day) OVER (PARTITION BY claim_id ORDER BY position) AS before FROM updates)
        SELECT claim_id, position, CAST(greatest(0, date_diff('day', before, upd_day)) AS BIGINT) AS gap_days
        FROM g WHERE before IS NOT NULL""",
    ),
    "last_update_age": (
        last_update_age,
        f"""WITH {CLAIMS},{UPDATES}, m AS (SELECT claim_id, max(upd_day) AS latest FROM updates GROUP BY 1)
        SELECT id, CASE WHEN latest IS NOT NULL THEN CAST(greatest(0, date_diff('day', latest, DATE '2024-12-31')) AS BIGINT) END AS days
        FROM claims LEFT JOIN m ON claim_id = id""",
    ),
    "quarter_trend": (
        quarter_trend,
        f"""WITH {CLAIMS},{QUARTERS} SELECT quarter, ordinal, count(id) AS files FROM quarters LEFT JOIN claims
        ON source_quarter = quarter AND state = 'NATION_3' AND opened_at >= DATE '1997-01-01' GROUP BY 1, 2""",
    ),
    "prior_quarters": (
        prior_quarters,
        f"WITH {QUARTERS} SELECT ordinal, quarter, lag(quarter) OVER (ORDER BY ordinal) AS prior_quarter FROM quarters",
    ),
    "report_index": (
        report_index,
        f"""WITH {CLAIMS}, t AS (SELECT CAST(count(*) AS DOUBLE) AS files, CAST(sum(gain) AS DOUBLE) AS gain,
        CAST(count(gain) AS DOUBLE) AS gain_n, CAST(sum(cycle) AS DOUBLE) AS cycle, CAST(count(cycle) AS DOUBLE) AS cycle_n,
        CAST(count(*) FILTER (WHERE financial_status IN ('captured', 'partially_captured')) AS DOUBLE) AS usable FROM measured)
        SELECT CAST(1 AS BIGINT) AS ordinal, 'executive' AS report, 'files' AS scope_measure, files AS scope_value,
          usable / files * 100.0 AS coverage_value FROM t
        UNION ALL SELECT 2, 'additional_value', 'additional_value', gain, gain_n / files * 100.0 FROM t
        UNION ALL SELECT 3, 'throughput', 'mean_cycle_days', cycle / cycle_n, cycle_n / files * 100.0 FROM t
        UNION ALL SELECT 4, 'weather', 'files', files, 100.0 FROM t""",
    ),
    "executive_observations": (executive_observations, observation_sql("1998 Q2")),
    "first_quarter_observations": (first_quarter_observations, observation_sql("1995 Q1")),
    "new_states": (
        new_states,
        f"""WITH {CLAIMS} SELECT DISTINCT state FROM claims WHERE status = 'closed' AND opened_at >= DATE '2001-07-30'
        AND state IS NOT NULL
        EXCEPT SELECT state FROM claims WHERE status = 'closed' AND opened_at <= DATE '1995-01-03'""",
    ),
    "weather_matches": (
        weather_matches,
        f"""WITH {CLAIMS},{WEATHER_EVENTS},{MATCHES} SELECT claim_id, weather_event_id, CAST(gap_days AS BIGINT) AS gap_days,
        CAST(100 - gap_days AS DOUBLE) / 100.0 AS confidence FROM matches""",
    ),
    "weather_rollup": (
        weather_rollup,
        f"""WITH {CLAIMS},{WEATHER_EVENTS},{MATCHES}, s AS (SELECT m.* FROM matches m WHERE claim_id IN (
        SELECT id FROM claims WHERE opened_at BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
        AND carrier_id = 'MACHINERY' AND service_type = 'estimate_only'))
        SELECT id, name, count(claim_id) AS matches,
        CAST(sum(100 - gap_days) AS DOUBLE) / 100.0 / nullif(count(claim_id), 0) AS mean_confidence
        FROM weather_events LEFT JOIN s ON weather_event_id = id GROUP BY 1, 2""",
    ),
    "top_carrier": (
        top_carrier,
        f"WITH {CLAIMS} SELECT carrier_id, count(*) AS rows FROM claims GROUP BY 1 ORDER BY rows DESC, carrier_id LIMIT 1",
    ),
    "status_counts": (
        status_counts,
        f"WITH {CLAIMS} SELECT status, financial_status, count(*) AS rows FROM claims GROUP BY 1, 2",
    ),
    "busiest_share": (
        busiest_share,
        f"""WITH {CLAIMS}, c AS (SELECT state, count(*) AS files FROM claims GROUP BY 1)
        SELECT state, files, CAST(files AS DOUBLE) / greatest(1.0, CAST(max(files) OVER () AS DOUBLE)) * 100.0
        AS percent_of_largest FROM c""",
    ),
    "claim_search": (
        claim_search,
        f"""WITH {CLAIMS},{CARRIERS},{CONTRACTORS}
        SELECT c.id, claim_number, o.name AS contractor, r.name AS carrier FROM claims c
        LEFT JOIN contractors o ON o.id = contractor_id LEFT JOIN carriers r ON r.id = carrier_id
        WHERE contains(lower(concat_ws(' ', claim_number, o.name, r.name)), '#00000000')
        AND status = 'closed' AND financial_status = 'captured'""",
    ),
    "claim_page": (
        claim_page,
        f"""WITH {CLAIMS}, p AS (SELECT id, claim_number, CAST(opened_at AS VARCHAR) AS opened_at, status,
        row_number() OVER (ORDER BY opened_at DESC, id) AS position FROM claims)
        SELECT *, CAST(3 AS BIGINT) AS page,
        CAST(ceil((SELECT count(*) FROM claims) / 10.0) AS BIGINT) AS pages FROM p WHERE position BETWEEN 21 AND 30""",
    ),
    "last_page": (
        last_page,
        f"""WITH {CLAIMS}, p AS (SELECT id, CAST(additional_rcv AS DOUBLE) AS additional_rcv,
        row_number() OVER (ORDER BY measured.additional_rcv DESC NULLS LAST, id) AS position FROM measured),
        n AS (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM claims)
        SELECT p.*, pages AS page, pages FROM p, n WHERE position > (pages - 1) * 20""",
    ),
    "picker_states": (
        picker_states,
        f"WITH {CLAIMS} SELECT DISTINCT state FROM claims WHERE state IS NOT NULL ORDER BY state",
    ),
    "claim_lookup": (
        claim_lookup,
        f"""WITH {CLAIMS} SELECT id, claim_number, status, source_quarter, CAST(original_rcv AS DOUBLE) AS original_rcv
        FROM claims WHERE id = '42'""",
    ),
    "impossible_dates": (
        impossible_dates,
        f"WITH {CLAIMS} SELECT count(*) AS assigned_after_closed FROM claims WHERE closed_at < opened_at",
    ),
}
