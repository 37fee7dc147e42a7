"""Data-quality issues raised while claims and updates are promoted.

Each rule gives rows of the issue schema. The key of an issue follows from the
record it is about, so a rerun raises the same issue again and the keyed insert
drops it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.filters import is_extreme
from claimloom.schema import EXTREME_PERCENTAGE, ISSUES


def _issue(
    rows: DataFrame,
    key: Column,
    issue_type: str,
    severity: str,
    entity: str,
    description: str,
    evidence: Mapping[str, Column],
    action: str,
) -> DataFrame:
    def present(name: str) -> Column:
        return F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")

    pairs = [c for name, value in evidence.items() for c in (F.lit(name), value.cast("string"))]
    return rows.select(
        key.alias("deterministic_key"),
        F.lit(issue_type).alias("issue_type"),
        F.lit(severity).alias("severity"),
        F.lit("pending").alias("status"),
        F.lit(entity).alias("source_entity"),
        present("source_row_id").alias("source_row_id"),
        present("claim_id").alias("claim_id"),
        F.lit(description).alias("description"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("evidence"),
        F.lit(action).alias("suggested_action"),
        present("import_job_id").alias("import_job_id"),
    )


def missing_component(claims: DataFrame) -> DataFrame:
    """Claims whose initial or current amount is missing."""
    rows = claims.where(F.col("reconciliation_status") == "missing_component")
    return _issue(
        rows, F.concat(F.lit("missing-initial-rcv:"), "item_id"), "missing_initial_rcv", "warning", "claim",
        "An amount needed for the derived value is missing; nothing was filled in.",
        {"initial_rcv": F.col("initial_rcv"), "current_rcv": F.col("current_rcv")},
        "Check the source row.",
    )


def extreme_percentage(claims: DataFrame, limit: int = EXTREME_PERCENTAGE) -> DataFrame:
    rows = claims.where(is_extreme("percentage_increase", limit))
    return _issue(
        rows, F.concat(F.lit("extreme-percentage:"), "item_id"), "extreme_percentage_value", "warning", "claim",
        "The reported percentage is extreme and was kept as it stands.",
        {"percentage_increase": F.col("percentage_increase")},
        "Confirm the unit and meaning of the source value.",
    )


def _post() -> Column:
    """What names a post: its id, or its source row where the id is missing."""
    return F.coalesce(F.col("post_id"), F.concat(F.lit("row-"), F.col("source_row").cast("string")))


def missing_post_id(updates: DataFrame) -> DataFrame:
    """Posts that the keyed insert refuses, because they have no id."""
    rows = updates.where(F.col("post_id").isNull())
    return _issue(
        rows, F.concat(F.lit("missing-post-id:"), _post()), "missing_post_id", "error", "claim_update",
        "The update has no post id and was not stored.",
        {"item_id": F.col("item_id"), "source_row": F.col("source_row")},
        "Export the update again with its id.",
    )


def unmatched_update(updates: DataFrame) -> DataFrame:
    rows = updates.where(~F.col("matched"))
    return _issue(
        rows, F.concat(F.lit("unmatched-update:"), _post()), "unmatched_update_item_id", "warning", "claim_update",
        "The update refers to an item outside the imported claims.",
        {"post_id": F.col("post_id"), "item_id": F.col("item_id"), "source_row": F.col("source_row")},
        "Find the item in another archive or keep the update apart.",
    )


def blank_update(updates: DataFrame) -> DataFrame:
    rows = updates.where(F.col("blank_body"))
    return _issue(
        rows, F.concat(F.lit("blank-update:"), _post()), "blank_update_body", "info", "claim_update",
        "The update has no text.", {"post_id": F.col("post_id")}, "Keep it as provenance.",
    )


def duplicate_update_body(updates: DataFrame) -> DataFrame:
    """One issue per repeated fingerprint, whatever the number of its updates."""
    per_job = ["import_job_id"] if "import_job_id" in updates.columns else []
    rows = updates.where(F.col("duplicate_body")).groupBy("body_fingerprint").agg(
        F.count("*").alias("body_rows"), *[F.min(c).alias(c) for c in per_job]
    )
    return _issue(
        rows, F.concat(F.lit("duplicate-update-body:"), "body_fingerprint"), "duplicate_update_body", "info",
        "claim_update", "Several updates have the same text after trimming.",
        {"body_fingerprint": F.col("body_fingerprint"), "rows": F.col("body_rows")},
        "Review only where it matters; every post is kept.",
    )


def repeated_header(repeats: DataFrame) -> DataFrame:
    """One issue per header name that a sheet uses more than once."""
    slug = F.regexp_replace(F.lower("raw"), "[^a-z0-9]+", "-")
    return _issue(
        repeats, F.concat(F.lit("duplicate-header:"), "sheet", F.lit(":"), slug), "duplicate_header_disambiguation",
        "info", "worksheet", "Columns with the same header are told apart by position.",
        {"worksheet": F.col("sheet"), "header": F.col("raw")}, "Use the stored header map.",
    )


def unknown_timezone(updates: DataFrame, period: str, job: str | None = None) -> DataFrame:
    """One issue when any update time has no zone; an aggregate decides, not a row."""
    found = updates.agg(F.count_if(F.col("timestamp_state") == "unknown_timezone").alias("rows"))
    rows = found.where(F.col("rows") > 0)
    if job:
        rows = rows.withColumn("import_job_id", F.lit(job))
    return _issue(
        rows, F.lit(f"timezone:{period}"), "unknown_timezone", "warning", "import_job",
        "Update times carry no zone and stay naive.", {"rows": F.col("rows")},
        "Agree on a reporting zone before converting.",
    )


def unresolved_subitems(details: DataFrame, period: str, job: str | None = None) -> DataFrame:
    """One issue with the number of detail rows, when there are any."""
    rows = details.agg(F.count("*").alias("rows")).where(F.col("rows") > 0)
    if job:
        rows = rows.withColumn("import_job_id", F.lit(job))
    return _issue(
        rows, F.lit(f"subitems:{period}"), "unresolved_subitem_meaning", "warning", "staging",
        "Subitems take their parent from their position and are not promoted.", {"detail_count": F.col("rows")},
        "Settle their meaning before promoting them.",
    )


def all_issues(
    claims: DataFrame, updates: DataFrame, repeats: DataFrame, details: DataFrame, period: str, job: str | None = None
) -> DataFrame:
    frames = [
        missing_component(claims),
        extreme_percentage(claims),
        missing_post_id(updates),
        unmatched_update(updates),
        blank_update(updates),
        duplicate_update_body(updates),
        repeated_header(repeats),
        unknown_timezone(updates, period, job),
        unresolved_subitems(details, period, job),
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result.select(*ISSUES.fieldNames())


def issue_rollup(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type", "severity", "status").agg(F.count("*").alias("issues"))
