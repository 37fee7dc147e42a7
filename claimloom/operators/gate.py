"""Counts of an import, the comparison with what was expected, and the job ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.distributed import top_per_group
from claimloom.schema import FAILURE_MESSAGE_LIMIT

RECONCILIATION_COUNTS = {
    "exact_matches": "exact_match",
    "tolerance_matches": "tolerance_match",
    "mismatches": "mismatch",
    "missing_components": "missing_component",
}


def _tall(row: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A one-row frame of counts as (measure, actual) rows."""
    names = [c for c in row.columns if c not in keys]
    entries = [F.struct(F.lit(n).alias("measure"), F.col(n).cast("bigint").alias("actual")) for n in names]
    return row.select(*keys, F.inline(F.array(*entries)))


def import_summary(claims: DataFrame, headers: DataFrame, details: DataFrame, updates: DataFrame) -> DataFrame:
    """Fifteen counts of a parsed import as (measure, actual) rows.

    The id count of unmatched updates leaves missing ids out. Each frame is read
    once.
    """
    claim_counts = claims.agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("raw_status") == "Complete").alias("complete"),
        F.count_if(F.col("raw_status") == "Closed").alias("closed"),
        *[F.count_if(F.col("reconciliation_status") == s).alias(n) for n, s in RECONCILIATION_COUNTS.items()],
    )
    unmatched = ~F.col("matched")
    # all counts of the updates in one pass, the distinct ones over their own keys
    update_counts = updates.agg(
        F.count("*").alias("updates"),
        F.count_if(unmatched).alias("unmatched_update_rows"),
        F.count_if(F.col("blank_body")).alias("blank_update_bodies"),
        F.count_distinct(F.when(unmatched, F.col("item_id"))).alias("unmatched_update_item_ids"),
        F.count_distinct("post_id").alias("unique_post_ids"),
        # rows with a body minus distinct bodies: what is left over per fingerprint
        (F.count("body_fingerprint") - F.count_distinct("body_fingerprint")).alias("duplicate_body_surplus"),
    )
    frames = [
        _tall(claim_counts),
        _tall(headers.agg(F.count("*").alias("subitem_headers"))),
        _tall(details.agg(F.count("*").alias("subitem_details"))),
        _tall(update_counts),
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def compare_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against actual, null-safe, with a verdict and a message on failure."""
    joined = expected.join(actual, "measure", "full_outer")
    passes = F.col("actual").eqNullSafe(F.col("expected"))

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("none"))

    message = F.concat(F.col("measure"), F.lit(": expected "), shown("expected"), F.lit(", found "), shown("actual"))
    return joined.select("measure", "expected", "actual", passes.alias("passes"), F.when(~passes, message).alias("message"))


def gate_verdict(compared: DataFrame) -> DataFrame:
    """One row: does every measure agree?"""
    return compared.agg(
        F.coalesce(F.bool_and("passes"), F.lit(False)).alias("accepted"),
        F.count_if(~F.col("passes")).alias("failed_measures"),
    )


def require_gate(compared: DataFrame) -> None:
    """Raise when a measure differs. Only the verdict row reaches the driver."""
    verdict = gate_verdict(compared).first()
    if not verdict["accepted"]:
        raise ValueError(f"import refused: {verdict['failed_measures']} counts differ from what was expected")


def validation_counts(
    jobs: DataFrame, claims: DataFrame, headers: DataFrame, details: DataFrame, updates: DataFrame, derived: DataFrame
) -> DataFrame:
    """Thirteen counts per job, one aggregation per table instead of one per count."""
    job = "import_job_id"
    claim_counts = claims.groupBy(job).agg(
        F.count("*").alias("claim_count"),
        F.count_if(F.col("raw_status") == "Complete").alias("complete_status_count"),
        F.count_if(F.col("raw_status") == "Closed").alias("closed_status_count"),
    )
    header_counts = headers.groupBy(job).agg(F.count("*").alias("staged_subitem_header_count"))
    detail_counts = details.groupBy(job).agg(F.count("*").alias("staged_subitem_detail_count"))
    update_counts = updates.groupBy(job).agg(
        F.count("*").alias("update_count"),
        F.count_if(F.col("unmatched_source")).alias("unmatched_update_row_count"),
        F.count_distinct(F.when(F.col("unmatched_source"), F.col("item_id"))).alias("unmatched_update_item_id_count"),
        F.count_distinct("post_id").alias("unique_post_id_count"),
    )
    states = {
        "additional_exact_match_count": "exact_match",
        "additional_tolerance_only_count": "tolerance_match",
        "additional_mismatch_count": "mismatch",
        "additional_missing_component_count": "missing_component",
    }
    derived_counts = derived.groupBy(job).agg(
        *[F.count_if(F.col("reconciliation_status") == state).alias(name) for name, state in states.items()]
    )
    result = jobs.select(job, F.col("status").alias("import_status"))
    for counts in (claim_counts, header_counts, detail_counts, update_counts, derived_counts):
        result = result.join(counts, job, "left")
    return result.na.fill(0)


def tall_validation(validation: DataFrame) -> DataFrame:
    return _tall(validation, ["import_job_id", "import_status"])


def latest_job(jobs: DataFrame, period: str | None = None) -> DataFrame:
    """The job started last; the larger id decides between equal times."""
    chosen = jobs if period is None else jobs.where(F.col("source_period") == period)
    return chosen.orderBy(F.desc("started_at"), F.desc("import_job_id")).limit(1)


def latest_per_source(jobs: DataFrame, group: Sequence[str]) -> DataFrame:
    return top_per_group(jobs, group, [F.desc("started_at"), F.desc("import_job_id")], 1).drop("_rank")


def job_matches_summary(job: DataFrame, summary: DataFrame) -> DataFrame:
    """Whether job and validation row agree on id and status."""
    found = job.join(summary, "import_job_id", "left")
    return found.select(
        "import_job_id", F.col("status").eqNullSafe(F.col("import_status")).alias("available")
    )


# --- job ledger --------------------------------------------------------------


def start_job(ledger: DataFrame, jobs: DataFrame) -> DataFrame:
    """Register jobs; the same artifact and version runs again under its old id."""
    key = ["source_sha256", "importer_version"]
    restart = jobs.select(*key, F.col("started_at").alias("_started"))
    again = F.col("_started").isNotNull()
    known = ledger.join(restart, key, "left").select(
        *[
            F.when(again, F.lit("running")).otherwise(F.col(c)).alias(c) if c == "status"
            else F.when(again, F.col("_started")).otherwise(F.col(c)).alias(c) if c == "started_at"
            else F.when(~again, F.col(c)).alias(c) if c == "completed_at"
            else F.col(c)
            for c in ledger.columns
        ]
    )
    return known.unionByName(jobs.select(*ledger.columns).join(ledger.select(*key), key, "left_anti"))


def finalize_job(ledger: DataFrame, counts: DataFrame, issues: DataFrame, completed_at: Column) -> DataFrame:
    """Close running jobs: status from their warnings, counts as a map.

    ``counts`` has (import_job_id, measure, actual); a job has a fixed number of
    measures, so the collected map is small.
    """
    warnings = issues.where(F.col("severity") == "warning").groupBy("import_job_id").agg(F.count("*").alias("_warnings"))
    maps = counts.groupBy("import_job_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("measure", "actual")))).alias("_counts")
    )
    joined = ledger.join(warnings, "import_job_id", "left").join(maps, "import_job_id", "left")
    found = F.coalesce(F.col("_warnings"), F.lit(0))
    closing = (F.col("status") == "running") & F.col("_counts").isNotNull()
    replaced = {
        "status": F.when(found > 0, "completed_with_warnings").otherwise("completed"),
        "completed_at": completed_at,
        "warning_count": found,
        "error_count": F.lit(0).cast("bigint"),
        "accepted_counts": F.col("_counts"),
    }
    return joined.select(
        *[
            F.when(closing, replaced[c]).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c)
            for c in ledger.columns
        ]
    )


def fail_job(ledger: DataFrame, artifact_hash: str, version: str, message: str, at: Column) -> DataFrame:
    """Mark one job failed, count the error and keep a shortened message."""
    hit = (F.col("source_sha256") == artifact_hash) & (F.col("importer_version") == version)
    return fail_jobs(ledger, hit, F.lit(message), at)


def fail_jobs(ledger: DataFrame, hit: Column, message: Column, at: Column) -> DataFrame:
    replaced = {
        "status": F.lit("failed"),
        "completed_at": at,
        "error_count": F.col("error_count") + 1,
        "last_error": F.substring(message, 1, FAILURE_MESSAGE_LIMIT),
    }
    return ledger.select(
        *[F.when(hit, replaced[c]).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c) for c in ledger.columns]
    )
