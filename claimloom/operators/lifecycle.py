"""Status history, assignments and quarters of a file.

These follow written definitions; nothing in the reference system executes them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.dates import quarter_label
from claimloom.functions.text import natural_key
from claimloom.operators.distributed import BLOCK_ROWS, carry_last
from claimloom.operators.merge import one_per_key, with_key

# fixed values: lifecycle statuses by group, and the allowed steps per service
STATUS_GROUPS = {
    "New": "open",
    "In Queue": "open",
    "In Progress": "open",
    "Claim Handling": "open",
    "Completed": "completed",
    "Completed Claim Handling": "completed",
    "Rejected": "exception",
    "Withdrawn": "exception",
}
LIFECYCLES = {
    "estimate_only": ("New", "In Queue", "In Progress", "Completed"),
    "claim_handling": ("New", "In Queue", "In Progress", "Claim Handling", "Completed Claim Handling"),
}
EXCEPTION_TERMINALS = ("Rejected", "Withdrawn")
REOPEN_STATUS = "In Queue"


def status_group(status: Column, groups: Mapping[str, str] = STATUS_GROUPS) -> Column:
    """Group of a status; NULL marks an unmapped one."""
    pairs = [F.lit(text) for item in groups.items() for text in item]
    return F.element_at(F.create_map(*pairs), status)


def allowed_steps() -> set[tuple[str, str, str]]:
    """Every valid (service, from, to), derived from the lifecycles."""
    steps = set()
    for service, path in LIFECYCLES.items():
        steps.update((service, a, b) for a, b in zip(path, path[1:]))
        steps.update((service, a, b) for a in path[:-1] for b in EXCEPTION_TERMINALS)
        steps.update((service, a, REOPEN_STATUS) for a in (path[-1], *EXCEPTION_TERMINALS))
    return steps


def status_intervals(
    events: DataFrame, order: str = "position", block_rows: int = BLOCK_ROWS, key: str = "file_id"
) -> DataFrame:
    """Exit time of each status = entry of the next one; the last stays open.

    ``events`` has (file_id, position, status, entered_at), with positions in
    time order.
    """
    ended = carry_last(
        events, [key], order, {"exited_at": F.col("entered_at")}, block_rows, inclusive=False, backward=True
    )
    seconds = F.timestamp_diff("SECOND", F.col("entered_at"), F.col("exited_at"))
    return ended.withColumn("duration_seconds", seconds).withColumn("is_current", F.col("exited_at").isNull())


def invalid_transitions(events: DataFrame, order: str = "position", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Steps that the file's service does not allow; ``events`` also has service_type."""
    stepped = carry_last(events, ["file_id"], order, {"from_status": F.col("status")}, block_rows, inclusive=False)
    step = F.concat_ws(">", "service_type", "from_status", "status")
    allowed = sorted(">".join(s) for s in allowed_steps())
    return stepped.where(F.col("from_status").isNotNull() & ~step.isin(*allowed))


def collapse_status_events(events: DataFrame) -> DataFrame:
    """Exact duplicates of (file, status, time) as one event with its row count."""
    key = ["file_id", "status", "entered_at"]
    return events.groupBy(*key).agg(F.count("*").alias("source_rows"), F.min("position").alias("position")).withColumn(
        "status_event_id", natural_key(*key)
    )


def status_event_provenance(events: DataFrame, source: str = "position") -> DataFrame:
    """Which source row stands behind which collapsed event; one row per source row.

    The event id follows from the row itself, so no join and no list is needed.
    """
    return events.select(
        natural_key("file_id", "status", "entered_at").alias("status_event_id"), F.col(source).alias("source_row")
    )


def assignment_intervals(events: DataFrame, order: str = "position", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each assignment ends when the next one of the same file and type starts."""
    ended = carry_last(
        events,
        ["file_id", "assignment_type"],
        order,
        {"ended_at": F.col("started_at")},
        block_rows,
        inclusive=False,
        backward=True,
    )
    return ended.withColumn("is_current", F.col("ended_at").isNull())


def spliced_ranges(
    history: DataFrame, arriving: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[Column], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows of an effective-dated history that change when ``arriving`` rows are spliced in, in whatever order they come.

    ``history`` has one row per key and ``start``; each lasts until the next
    start of its key, the last one is open (``end`` missing). An arriving row
    closes the range it falls into and lasts until that range ended; one with a
    known start replaces the values of that range. Of arriving rows with the same
    key and start the last one in ``order`` counts. Keys that nothing arrives for
    are not read further than the semi join. Result: new rows, and known rows with
    another end or other values, to be merged by ``keys`` and ``start``.
    """
    keys = list(keys)
    values = [c for c in history.columns if c != end]
    new = one_per_key(with_key(arriving, [*keys, start]), [*keys, start], order).select(*values)
    touched = history.join(new.select(*keys).distinct(), keys, "left_semi")
    kept_starts = touched.join(new.select(*keys, start), [*keys, start], "left_anti")
    both = kept_starts.withColumns({"_was": F.col(end), "_new": F.lit(False)}).drop(end).unionByName(
        new.withColumns({"_was": F.lit(None).cast(history.schema[end].dataType), "_new": F.lit(True)})
    )
    ordered = both.withColumn("_at", F.unix_micros(F.col(start).cast("timestamp")))
    ended = carry_last(ordered, keys, "_at", {end: F.col(start)}, block_rows, inclusive=False, backward=True)
    changed = F.col("_new") | ~F.col(end).eqNullSafe(F.col("_was"))
    return ended.where(changed).select(*history.columns)


def multiple_current(assignments: DataFrame) -> DataFrame:
    """(file, type) pairs with more than one open assignment."""
    return (
        assignments.where(F.col("ended_at").isNull())
        .groupBy("file_id", "assignment_type")
        .agg(F.count("*").alias("open_rows"))
        .where(F.col("open_rows") > 1)
    )


def overlapping_ranges(
    ranges: DataFrame, group: Sequence[str], order: str = "position", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Ranges that end after the next one starts; an open range always does.

    ``ranges`` has (started_at, ended_at) and positions in start order.
    """
    following = carry_last(
        ranges, group, order, {"next_start": F.col("started_at")}, block_rows, inclusive=False, backward=True
    )
    runs_over = F.col("ended_at").isNull() | (F.col("ended_at") > F.col("next_start"))
    return following.where(F.col("next_start").isNotNull() & runs_over)


def derived_quarters(files: DataFrame, dates: Mapping[str, str], archive: str = "source_archive_quarter") -> DataFrame:
    """One quarter per date; the archive quarter is kept as imported.

    ``dates`` maps the new column to its date column. ``quarter_conflict`` says
    that the archive quarter is none of the derived ones.
    """
    labelled = files
    for name, day in dates.items():
        labelled = labelled.withColumn(name, quarter_label(F.col(day)))
    agrees = F.array_contains(F.array(*[F.col(n) for n in dates]), F.col(archive))
    return labelled.withColumn("quarter_conflict", ~F.coalesce(agrees, F.lit(False)))


def stage_ageing(intervals: DataFrame) -> DataFrame:
    """Entries, finished stays and mean stay per status."""
    finished = F.count("duration_seconds")
    return intervals.groupBy("status").agg(
        F.count("*").alias("entries"),
        finished.alias("finished"),
        F.count_if("is_current").alias("waiting"),
        F.when(finished > 0, F.sum("duration_seconds").cast("double") / finished.cast("double")).alias("mean_seconds"),
    )


def workload(assignments: DataFrame) -> DataFrame:
    """Assignments per assignee and type: all, current and handed on."""
    return assignments.groupBy("assignee", "assignment_type").agg(
        F.count("*").alias("assignments"),
        F.count_if("is_current").alias("current"),
        F.count_if(~F.col("is_current")).alias("handed_on"),
    )
