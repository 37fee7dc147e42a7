"""Metric envelopes on small claims with every edge case."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimloom.operators import filters, metrics, observations, rankings, weather
from claimloom.operators.filters import ClaimFilter
from claimloom.schema import CLAIMS

AS_OF = "2026-04-01"


def claim(i, **given):
    base = dict(
        id=f"c{i}", claim_number=f"N-{i}", source_quarter="2026 Q1", contractor_id="k1", carrier_id="r1", adjuster_id="a1",
        state="TX", zip_code="75001", service_type="claim_handling", status="new", financial_status="captured",
        opened_at=date(2026, 3, 1), closed_at=None, original_rcv=Decimal("100"), settled_rcv=Decimal("110"),
        additional_rcv=Decimal("10"), service_fee=Decimal("1"), updates=[],
    )
    base.update(given)
    return tuple(base[f] for f in CLAIMS.fieldNames())


@pytest.fixture(scope="module")
def claims(spark):
    def at(*days):
        return [(d, "note", "x", "s") for d in days]

    rows = [
        claim(1, additional_rcv=Decimal("10"), updates=at(date(2026, 3, 2), date(2026, 3, 12), date(2026, 3, 5))),
        claim(2, additional_rcv=Decimal("20"), status="closed", closed_at=date(2026, 3, 11), contractor_id="k2"),
        claim(3, additional_rcv=Decimal("5"), status="closed", closed_at=date(2026, 2, 1), contractor_id="k2"),
        claim(4, additional_rcv=None, status="closed"),
        claim(5, financial_status="partially_captured", additional_rcv=Decimal("40"), opened_at=date(2026, 3, 2)),
        claim(6, financial_status="invalid", service_type="estimate_only", opened_at=date(2026, 3, 1), carrier_id="ghost"),
        claim(7, financial_status="not_captured", additional_rcv=None, opened_at=date(2025, 12, 31), status="stalled",
              updates=at(date(2026, 1, 1))),
        claim(8, opened_at=date(2026, 5, 1), source_quarter="2026 Q2", state="FL", additional_rcv=Decimal("5"), contractor_id="k3"),
        claim(9, opened_at=date(1990, 1, 1), source_quarter="2025 Q4", additional_rcv=Decimal("5")),
    ]
    return spark.createDataFrame(rows, CLAIMS).cache()


def panel(df, **kw):
    return {r.metric: r for r in metrics.metric_panel(df, **kw).collect()}


def test_panel_values(claims):
    m = panel(claims)
    assert m["total_files"].value == 9 and m["total_files"].coverage_percent == 100 and m["total_files"].grade == "A"
    assert m["closed_files"].value == 3 and m["active_inventory"].value == 6
    assert m["additional_value"].value == 85.0 and m["additional_value"].numerator == 6
    assert m["median_additional_value"].value == 7.5
    assert m["mean_cycle_days"].value == 5.0 and m["median_cycle_days"].value == 5.0
    assert m["financial_coverage"].value == pytest.approx(700 / 9) and m["financial_coverage"].grade == "B"
    assert m["estimate_only_files"].drill_down == {"service_type": "estimate_only"}


def test_panel_of_nothing_is_unavailable_not_zero(claims):
    m = panel(claims.where(F.lit(False)))
    assert m["total_files"].value == 0 and m["total_files"].coverage_percent == 0
    for name in ("additional_value", "mean_additional_value", "median_additional_value", "fee_revenue", "mean_cycle_days",
                 "financial_coverage"):
        assert m[name].value is None and m[name].status == "unavailable"


def test_minimum_coverage_withholds_values(claims):
    m = panel(claims, minimum_coverage=80)
    assert m["additional_value"].value is None and m["additional_value"].status == "unavailable"
    assert m["total_files"].value == 9


def test_grouped_panel(claims):
    rows = metrics.metric_panel(claims, ["source_quarter"]).where("metric = 'median_additional_value'").collect()
    assert {r.source_quarter: r.value for r in rows} == {"2026 Q1": 15.0, "2026 Q2": 5.0, "2025 Q4": 5.0}


def test_filters(claims):
    def ids(**kw):
        return {r.id for r in filters.filter_claims(claims, ClaimFilter(**kw)).collect()}

    assert len(ids()) == 9 and len(ids(quarter="all")) == 9
    assert ids(quarter="2026 Q2") == {"c8"}
    assert ids(start_date="2026-03-02", end_date="2026-05-01") == {"c5", "c8"}
    assert ids(carrier_id="ghost", service_type="estimate_only") == {"c6"}
    assert ids(state="FL", contractor_id="k3") == {"c8"}


def test_ageing_edges(spark):
    ages = {0: 0, 1: 30, 2: 31, 3: 60, 4: 61, 5: 90, 6: 91, 7: 9999, 8: 10000, 9: -30}
    rows = [claim(i, opened_at=date.fromordinal(date(2026, 4, 1).toordinal() - a)) for i, a in ages.items()]
    df = spark.createDataFrame(rows, CLAIMS)
    found = {r.bucket: r.files for r in metrics.ageing_buckets(df, AS_OF).collect()}
    assert found == {"0–30": 3, "31–60": 2, "61–90": 2, "90+": 3}
    closed = {r.bucket: r.files for r in metrics.ageing_buckets(df, AS_OF, upper_bound=9999).collect()}
    assert closed["90+"] == 2
    assert {r.files for r in metrics.ageing_buckets(df.where("false"), AS_OF).collect()} == {0}


def test_update_frequency_keeps_stored_order(spark, claims):
    nested = metrics.nested_update_frequency(claims).first()
    # 10 days forward, then back in time, which counts as zero
    assert (nested.value, nested.numerator, nested.denominator) == (5.0, 2, 6)
    flat = claims.select(F.col("id").alias("claim_id"), F.posexplode("updates").alias("position", "u")).select(
        "claim_id", F.col("position").cast("long").alias("position"), F.col("u.at").alias("at")
    )
    by_rows = metrics.update_frequency(claims, flat, block_rows=2).first()
    assert by_rows == nested


def test_update_coverage_may_pass_one_hundred(spark):
    days = [date(2026, 1, d) for d in range(1, 6)]
    df = spark.createDataFrame([claim(1, updates=[(d, "note", "x", "s") for d in days])], CLAIMS)
    assert metrics.nested_update_frequency(df).first().coverage_percent == 400


def test_last_update_of_a_claim_without_updates_is_null(claims):
    flat = claims.select(F.col("id").alias("claim_id"), F.explode("updates.at").alias("at"))
    found = {r.id: r.days_since_last_update for r in metrics.days_since_last_update(claims, flat, AS_OF).collect()}
    assert found["c1"] == 20 and found["c7"] == 90 and found["c2"] is None


def test_carrier_mix_ties_and_unknown_carriers(spark, claims):
    carriers = spark.createDataFrame([("r1", "One", 1), ("r2", "Two", 2)], "id string, name string, ordinal int")
    rows = rankings.carrier_mix(claims, carriers).collect()
    assert [(r.id, r.files, r.position) for r in rows] == [("r1", 8, 1)]
    assert rows[0].share_percent == pytest.approx(800 / 9)


def test_contractor_ranking_orders_ties_by_id(spark, claims):
    people = spark.createDataFrame([("k1", "A"), ("k2", "B"), ("k3", "C"), ("k4", "D")], "id string, name string")
    rows = sorted(rankings.contractor_ranking(claims, people).collect(), key=lambda r: r.position)
    assert [(r.contractor_id, float(r.recovered), r.usable_count) for r in rows] == [("k1", 55.0, 3), ("k2", 25.0, 2), ("k3", 5.0, 1)]
    assert rows[1].close_rate == 100.0


def test_prior_period_of_first_quarter(spark, claims):
    quarters = spark.createDataFrame([(1, "2025 Q4"), (2, "2026 Q1"), (3, "2026 Q2")], "ordinal int, quarter string")

    def count(quarter, **kw):
        return observations.prior_period(claims, quarters, quarter, **kw).count()

    assert count("2026 Q1") == 1 and count("2026 Q2") == 7 and count("2025 Q4") == 0 and count("all") == 0
    assert count("2025 Q4", first_is_everything=True) == 9
    assert count("2026 Q1", first_is_everything=True) == 1


def test_observations(spark, claims):
    current = claims.where("source_quarter = '2026 Q1'")
    prior = claims.where("source_quarter = '2025 Q4'")
    carriers = spark.createDataFrame([("r1", "One")], "id string, name string")
    updates = claims.select(F.col("id").alias("claim_id"), F.explode("updates.at").alias("at"))
    matches = spark.createDataFrame([("c1", "w1"), ("c2", "w1"), ("c9", "w2")], "claim_id string, weather_event_id string")
    rows = {r.rule: r for r in observations.observations(current, prior, carriers, updates, matches, AS_OF).collect()}
    assert rows["volume"].measure == 600.0 and rows["volume"].severity == "info"
    assert rows["recovery"].severity == "positive"
    assert rows["stalled"].measure == 1 and rows["stalled"].comparison == 1
    assert rows["aging"].measure == 1
    assert rows["weather"].measure == 2 and rows["weather"].comparison == 1
    assert rows["carrier"].detail == "One holds 85.7 percent"
    assert "cycle" not in rows and "geo" not in rows and rows["coverage"].measure == pytest.approx(500 / 7)


def test_event_without_matches_stays(spark):
    events = spark.createDataFrame([("w1", "A"), ("w2", "B")], "id string, name string")
    matches = spark.createDataFrame([("c1", "w1", 0.75), ("c2", "w1", 0.5)], "claim_id string, weather_event_id string, confidence double")
    rows = {r.id: (r.matches, r.mean_confidence) for r in weather.event_rollup(events, matches).collect()}
    assert rows == {"w1": (2, 0.625), "w2": (0, None)}
