"""The dashboard pages as plans: one function per page, frames by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from claimloom.operators import metrics, observations, rankings, weather
from claimloom.operators.filters import ClaimFilter, filter_claims


@dataclass
class Warehouse:
    """The frames the dashboards read.

    ``updates`` has (claim_id, position, at); ``matches`` has (claim_id,
    weather_event_id, confidence); ``quarters`` has (ordinal, quarter).
    """

    claims: DataFrame
    updates: DataFrame
    contractors: DataFrame
    carriers: DataFrame
    events: DataFrame
    matches: DataFrame
    quarters: DataFrame
    as_of: str


def executive(data: Warehouse, chosen: ClaimFilter, first_is_everything: bool = False) -> dict[str, DataFrame]:
    current = filter_claims(data.claims, chosen)
    others = filter_claims(data.claims, chosen.with_quarter(""))
    prior = observations.prior_period(others, data.quarters, chosen.quarter, first_is_everything)
    return {
        "metrics": metrics.metric_panel(current),
        "trend": rankings.quarter_trend(data.claims, data.quarters, chosen),
        "observations": observations.observations(
            current, prior, data.carriers, data.updates, data.matches, data.as_of
        ),
    }


def operations(data: Warehouse, chosen: ClaimFilter) -> dict[str, DataFrame]:
    current = filter_claims(data.claims, chosen)
    return {
        "metrics": metrics.metric_panel(current),
        "update_frequency": metrics.update_frequency(current, data.updates),
        "ageing": metrics.ageing_buckets(current, data.as_of),
    }


def carriers(data: Warehouse, chosen: ClaimFilter) -> dict[str, DataFrame]:
    current = filter_claims(data.claims, chosen)
    return {
        "mix": rankings.carrier_mix(current, data.carriers),
        "scorecard": rankings.carrier_scorecard(current, data.carriers),
    }


def contractors(data: Warehouse, chosen: ClaimFilter) -> dict[str, DataFrame]:
    return {"ranking": rankings.contractor_ranking(filter_claims(data.claims, chosen), data.contractors)}


def weather_review(data: Warehouse, chosen: ClaimFilter) -> dict[str, DataFrame]:
    selected = weather.selected_matches(data.matches, filter_claims(data.claims, chosen))
    return {"events": weather.event_rollup(data.events, selected)}


def reports(data: Warehouse, chosen: ClaimFilter) -> dict[str, DataFrame]:
    return {"index": metrics.report_index(filter_claims(data.claims, chosen))}
