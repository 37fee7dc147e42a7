"""Nine observation rules that compare a period with the one before it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.dates import days_since
from claimloom.functions.numbers import one_decimal_text, percent_of
from claimloom.operators.filters import is_active
from claimloom.operators.metrics import mean_of, metric_totals
from claimloom.operators.rankings import only_in_first
from claimloom.schema import (
    AGE_BUCKETS,
    CARRIER_CONCENTRATION_PERCENT,
    CYCLE_DETERIORATION_FACTOR,
    LOW_COVERAGE_PERCENT,
    STALLED_SILENCE_DAYS,
)

KEY = "_one"


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn(KEY, F.lit(1))


def _period(claims: DataFrame, prefix: str) -> DataFrame:
    totals = metric_totals(claims).select(
        F.col("files").alias(f"{prefix}_files"),
        mean_of("gain_sum", "gain_n").alias(f"{prefix}_gain"),
        mean_of("cycle_sum", "cycle_n").alias(f"{prefix}_cycle"),
        F.coalesce(percent_of(F.col("usable"), F.col("files")), F.lit(0.0)).alias(f"{prefix}_coverage"),
    )
    return _keyed(totals)


def _attention(current: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Stalled files, those long silent, and old active files."""
    newest = updates.groupBy(F.col("claim_id").alias("id")).agg(F.max("at").alias("_last"))
    stalled = current.where(F.col("status") == "stalled").select("id")
    silent = (
        stalled.join(newest, "id", "left")
        .agg(
            F.count("*").alias("stalled"),
            F.count_if(days_since(F.col("_last"), as_of) > STALLED_SILENCE_DAYS).alias("silent"),
        )
    )
    low = AGE_BUCKETS[-1][1]
    age = days_since(F.col("opened_at"), as_of)
    old = current.agg(F.count_if(is_active() & (age >= low)).alias("old"))
    return _keyed(silent).join(_keyed(old), KEY)


def _top_carrier(current: DataFrame, carriers: DataFrame) -> DataFrame:
    counts = current.groupBy("carrier_id").agg(F.count("*").alias("carrier_files"))
    named = counts.join(carriers.withColumnRenamed("id", "carrier_id"), "carrier_id")
    order = "ordinal" if "ordinal" in carriers.columns else "carrier_id"
    top = named.orderBy(F.desc("carrier_files"), F.asc(order)).limit(1)
    return _keyed(top.select(F.col("name").alias("carrier_name"), "carrier_files"))


def _new_states(current: DataFrame, prior: DataFrame) -> DataFrame:
    # states are a short closed list, so they fit one text
    fresh = only_in_first(current, prior, "state")
    return _keyed(fresh.agg(F.array_join(F.array_sort(F.collect_set("state")), ", ").alias("new_states")))


def _weather(current: DataFrame, matches: DataFrame) -> DataFrame:
    hit = matches.join(current.select(F.col("id").alias("claim_id")), "claim_id", "left_semi")
    per_event = hit.groupBy("weather_event_id").agg(F.count("*").alias("_rows"))
    return _keyed(
        per_event.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("matched"), F.count("*").alias("matched_events"))
    )


def _change(now: Column, before: Column) -> Column:
    return F.coalesce(percent_of(now - before, before), F.lit(0.0))


def observations(
    current: DataFrame,
    prior: DataFrame,
    carriers: DataFrame,
    updates: DataFrame,
    matches: DataFrame,
    as_of: str | date,
) -> DataFrame:
    """Rows (ordinal, rule, severity, measure, comparison, detail), fired rules only."""
    day = F.lit(as_of).cast("date")
    facts = (
        _period(current, "now")
        .join(_period(prior, "before"), KEY)
        .join(_attention(current, updates, day), KEY)
        .join(_top_carrier(current, carriers), KEY, "left")
        .join(_new_states(current, prior), KEY)
        .join(_weather(current, matches), KEY)
    )
    volume = _change(F.col("now_files"), F.col("before_files"))
    both_gains = (F.coalesce("now_gain", F.lit(0.0)) != 0) & (F.coalesce("before_gain", F.lit(0.0)) != 0)
    gain = F.when(both_gains, _change(F.col("now_gain"), F.col("before_gain")))
    both_cycles = (F.coalesce("now_cycle", F.lit(0.0)) != 0) & (F.coalesce("before_cycle", F.lit(0.0)) != 0)
    slower = F.col("now_cycle") - F.col("before_cycle")
    share = percent_of(F.col("carrier_files"), F.col("now_files"))
    none = F.lit(None).cast("double")

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    rules = [
        ("volume", F.lit(True), F.when(volume >= 0, "info").otherwise("warning"), volume,
         F.col("before_files"), text(F.col("now_files"), " files after ", F.col("before_files"))),
        ("recovery", F.lit(True),
         F.when(both_gains & (F.col("now_gain") >= F.col("before_gain")), "positive").otherwise("info"),
         gain, F.col("before_gain"),
         F.when(both_gains, text(one_decimal_text(gain), " percent change")).otherwise("no usable amounts to compare")),
        ("cycle", both_cycles & (F.col("now_cycle") > F.col("before_cycle") * F.lit(CYCLE_DETERIORATION_FACTOR)),
         F.lit("warning"), slower, F.col("before_cycle"), text(one_decimal_text(slower), " days slower")),
        ("carrier", share > CARRIER_CONCENTRATION_PERCENT, F.lit("warning"), share, none,
         text(F.col("carrier_name"), " holds ", one_decimal_text(share), " percent")),
        ("coverage", F.col("now_coverage") < LOW_COVERAGE_PERCENT, F.lit("warning"), F.col("now_coverage"), none,
         text(one_decimal_text(F.col("now_coverage")), " percent usable")),
        ("stalled", F.col("stalled") > 0, F.lit("critical"), F.col("stalled"), F.col("silent"),
         text(F.col("stalled"), " stalled, ", F.col("silent"), " without a recent update")),
        ("aging", F.col("old") > 0, F.lit("warning"), F.col("old"), none, text(F.col("old"), " old active files")),
        ("geo", F.col("new_states") != "", F.lit("positive"), none, none, text("new in ", F.col("new_states"))),
        ("weather", F.col("matched") > 0, F.lit("info"), F.col("matched"), F.col("matched_events"),
         text(F.col("matched"), " files match ", F.col("matched_events"), " events")),
    ]
    entries = [
        F.when(
            F.coalesce(fires, F.lit(False)),
            F.struct(
                F.lit(ordinal).cast("bigint").alias("ordinal"),
                F.lit(rule).alias("rule"),
                severity.alias("severity"),
                measure.cast("double").alias("measure"),
                comparison.cast("double").alias("comparison"),
                detail.alias("detail"),
            ),
        )
        for ordinal, (rule, fires, severity, measure, comparison, detail) in enumerate(rules, 1)
    ]
    return facts.select(F.inline(F.filter(F.array(*entries), lambda row: row.isNotNull())))


def prior_period(claims: DataFrame, quarters: DataFrame, quarter: str, first_is_everything: bool = False) -> DataFrame:
    """Claims of the quarter listed before ``quarter``.

    The first quarter, or no quarter at all, has an empty prior period;
    ``first_is_everything`` takes the whole data set there instead.
    """
    position = quarters.where(F.col("quarter") == quarter).agg(F.max("ordinal")).scalar()
    earlier = quarters.where(F.col("ordinal") < position)
    prior = earlier.orderBy(F.desc("ordinal")).limit(1).select(F.col("quarter").alias("source_quarter"))
    chosen = claims.join(prior, "source_quarter", "left_semi")
    if first_is_everything:
        none_before = prior.agg(F.count("*")).scalar() == 0
        chosen = chosen.unionByName(claims.where(none_before).select(*chosen.columns))
    return chosen
