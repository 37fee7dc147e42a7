"""Promotion of a parsed import into keyed tables.

``promote`` maps (tables, parsed import) to the next state of every table and
writes nothing; ``PromotedStore`` merges the same batches into bucket tables and
publishes them together. Running it twice with the same artifact and version gives the
same tables, because every id follows from a natural key and every step is an
upsert or a keyed insert.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimloom.functions.text import alias_key, natural_key, row_fingerprint, run_fingerprint
from claimloom.operators.issues import all_issues
from claimloom.operators.joins import lookup_claim
from claimloom.operators.merge import insert_if_absent, one_per_key, upsert
from claimloom.plans.ingest import ParsedImport
from claimloom.schema import (
    DERIVED_METRIC,
    DERIVED_METRIC_VERSION,
    TABLE_KEYS,
    TABLES,
    TERMINAL_RAW_STATUSES,
    SheetLayout,
)
from claimloom.session import CODEC, shuffles_removed
from claimloom.sources.buckets import BUCKETS, BucketTable, Merge
from claimloom.sources.commits import CommitLog
from claimloom.sources.grid import repeated_headers

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class ImportJob:
    """What identifies one import run."""

    source_system: str
    period: str
    filename: str
    artifact_sha256: str
    importer_version: str
    transformation_version: str
    started_at: str

    @property
    def job_id(self) -> Column:
        return natural_key(F.lit(self.artifact_sha256), F.lit(self.importer_version))

    @property
    def file_id(self) -> Column:
        return natural_key(F.lit(self.source_system), F.lit(self.artifact_sha256))


def empty_tables(spark: SparkSession) -> Tables:
    """Tables without rows; the optimizer knows that they are empty."""
    tables = {}
    for name, ddl in TABLES.items():
        columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)]
        tables[name] = spark.range(1).select(*columns).where(F.lit(False))
    return tables


def job_row(spark: SparkSession, job: ImportJob, source_rows: Column, updates: Column) -> DataFrame:
    """The ledger row of a job that is about to run."""
    fingerprint = run_fingerprint(F.lit(job.artifact_sha256), F.lit(job.importer_version), source_rows, updates)
    return spark.range(1).select(
        job.job_id.alias("import_job_id"),
        F.lit(job.source_system).alias("source_system"),
        F.lit(job.period).alias("source_period"),
        F.lit(job.filename).alias("source_filename"),
        F.lit(job.artifact_sha256).alias("source_sha256"),
        F.lit(job.importer_version).alias("importer_version"),
        F.lit(job.started_at).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit("running").alias("status"),
        F.lit(0).cast("bigint").alias("warning_count"),
        F.lit(0).cast("bigint").alias("error_count"),
        F.lit(None).cast("map<string,bigint>").alias("accepted_counts"),
        fingerprint.alias("run_fingerprint"),
        F.lit(None).cast("string").alias("last_error"),
    )


def organization_rows(claims: DataFrame, role: str) -> DataFrame:
    """(organization, alias) candidates of one role, one row per claim that names it."""
    return claims.where(F.col(role).isNotNull()).select(
        natural_key(F.lit(role), alias_key(F.col(role))).alias("organization_id"),
        F.lit(role).alias("organization_type"),
        F.col(role).alias("display_name"),
        alias_key(F.col(role)).alias("normalized_name"),
        "source_row",
    )


def person_rows(claims: DataFrame, role: str = "claim_handler") -> DataFrame:
    return claims.where(F.col(role).isNotNull()).select(
        natural_key(F.lit(role), alias_key(F.col(role))).alias("person_id"),
        F.lit(role).alias("person_type"),
        F.col(role).alias("display_name"),
        alias_key(F.col(role)).alias("normalized_name"),
        "source_row",
    )


def alias_rows(named: DataFrame, owner: str, job: ImportJob) -> DataFrame:
    return named.select(
        owner,
        F.lit(job.source_system).alias("source_system"),
        F.col("display_name").alias("raw_alias"),
        F.col("normalized_name").alias("normalized_alias"),
        job.job_id.alias("import_job_id"),
        "source_row",
    )


def claim_rows(claims: DataFrame, job: ImportJob) -> DataFrame:
    """Canonical claims; service and property type stay unknown by policy."""

    def reference(kind: str, column: str) -> Column:
        return F.when(F.col(column).isNotNull(), natural_key(F.lit(kind), alias_key(F.col(column))))

    return claims.select(
        natural_key(F.lit(job.source_system), "item_id").alias("claim_id"),
        F.lit(job.source_system).alias("source_system"),
        "item_id",
        "display_name",
        "raw_status",
        "normalized_status",
        F.when(F.col("raw_status").isin(*TERMINAL_RAW_STATUSES), "terminal_source_status").alias("lifecycle_state"),
        reference("contractor", "contractor").alias("contractor_id"),
        reference("carrier", "carrier").alias("carrier_id"),
        reference("claim_handler", "claim_handler").alias("assigned_staff_id"),
        F.to_date("date_0.parsed").alias("assigned_date"),
        F.to_date("date_1.parsed").alias("closed_date"),
        F.to_date("date_2.parsed").alias("status_change_date"),
        F.to_date("date_3.parsed").alias("loss_date"),
        F.lit(None).cast("string").alias("service_type"),
        F.lit(None).cast("string").alias("property_type"),
        job.job_id.alias("import_job_id"),
        "source_row_id",
        "source_row",
    )


def fact_rows(claims: DataFrame, job: ImportJob, layout: SheetLayout) -> DataFrame:
    """Tall amounts, one row per claim and money column, missing ones included."""
    entries = [
        F.struct(
            F.lit(m.metric).alias("normalized_metric_name"),
            F.lit(m.header).alias("source_field_name"),
            F.lit(m.position).cast("bigint").alias("source_column"),
            F.col(f"raw_{m.metric}").alias("raw_value"),
            F.col(m.metric).alias("parsed_numeric_value"),
            F.col(f"availability_{m.metric}").alias("source_availability_status"),
        )
        for m in layout.money
    ]
    return claims.select(
        natural_key(F.lit(job.source_system), "item_id").alias("claim_id"),
        job.job_id.alias("import_job_id"),
        F.col("sheet").alias("source_sheet"),
        "source_row",
        F.lit(job.transformation_version).alias("transformation_version"),
        F.inline(F.array(*entries)),
    )


def derived_rows(claims: DataFrame, job: ImportJob) -> DataFrame:
    return claims.select(
        natural_key(F.lit(job.source_system), "item_id").alias("claim_id"),
        F.lit(DERIVED_METRIC).alias("metric_name"),
        F.lit(DERIVED_METRIC_VERSION).alias("metric_version"),
        job.job_id.alias("import_job_id"),
        F.col("calculated_additional").alias("calculated_value"),
        F.col("additional_secured").alias("source_comparison_value"),
        "reconciliation_status",
        "difference",
        F.when(F.col("reconciliation_status") == "exact_match", "A").otherwise("Limited").alias("confidence"),
        "source_row",
    )


def update_rows(updates: DataFrame, claims: DataFrame, job: ImportJob) -> DataFrame:
    # item ids are unique inside one source system only
    own = claims.where(F.col("source_system") == job.source_system)
    linked = lookup_claim(updates, own.select("item_id", "claim_id"))
    return linked.select(
        F.lit(job.source_system).alias("source_system"),
        "post_id",
        "item_id",
        "claim_id",
        (~F.col("matched")).alias("unmatched_source"),
        F.col("body").alias("update_body"),
        "blank_body",
        "body_fingerprint",
        "duplicate_body",
        F.col("timestamp_raw").alias("source_timestamp_raw"),
        F.col("timestamp_parsed").alias("parsed_timestamp"),
        F.col("timestamp_state").alias("timezone_status"),
        F.col("author").alias("author_name"),
        F.col("sheet").alias("source_sheet"),
        "source_row",
        job.job_id.alias("import_job_id"),
        F.col("row").alias("raw_row"),
    )


@dataclass(frozen=True)
class Batch:
    """Rows of one import for one table: an upsert of ``replace`` columns, or an insert where that is None."""

    table: str
    rows: DataFrame
    replace: tuple[str, ...] | None
    order: tuple[Column, ...] = ()
    keep_if_missing: tuple[str, ...] = ()


def batches(parsed: ParsedImport, job: ImportJob, layout: SheetLayout, claims_now: Callable[[], DataFrame]) -> Iterator[Batch]:
    """What an import brings to each table, in the order in which tables are written.

    ``claims_now`` gives the claims after their batch was taken, which updates
    are linked to.
    """
    spark = parsed.claims.sparkSession
    by_row = (F.col("source_row"),)

    n_rows = parsed.source_rows.agg(F.count("*")).scalar()
    n_updates = parsed.updates.agg(F.count("*")).scalar()
    # a known job runs again: it is open once more under its old id
    yield Batch("import_jobs", job_row(spark, job, n_rows, n_updates), ("status", "started_at", "completed_at"))

    files = spark.range(1).select(
        job.file_id.alias("source_file_id"),
        F.lit(job.source_system).alias("source_system"),
        F.lit(job.filename).alias("filename"),
        F.lit(job.artifact_sha256).alias("sha256"),
        F.create_map(F.lit("period"), F.lit(job.period)).alias("metadata"),
        job.job_id.alias("import_job_id"),
    )
    yield Batch("source_files", files, ("metadata",))

    index = F.when(F.col("sheet") == layout.archive_sheet, F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    sheets = parsed.header_maps.select(
        natural_key(job.file_id, index).alias("worksheet_id"),
        job.file_id.alias("source_file_id"),
        "file_name",
        "sheet",
        index.alias("worksheet_index"),
        F.when(F.col("sheet") == layout.archive_sheet, F.lit(layout.archive_header_row))
        .otherwise(F.lit(layout.updates_header_row))
        .cast("bigint")
        .alias("header_row"),
        "header_map",
        job.job_id.alias("import_job_id"),
    )
    yield Batch("source_worksheets", sheets, ("header_map",))

    worksheet = natural_key(job.file_id, index)
    rows = parsed.source_rows.select(
        natural_key(worksheet, "physical_row").alias("source_row_id"),
        worksheet.alias("worksheet_id"),
        "physical_row",
        "row_class",
        "source_item_id",
        F.col("row").alias("raw_row"),
        row_fingerprint(F.col("row")).alias("row_fingerprint"),
        job.job_id.alias("import_job_id"),
    )
    yield Batch("source_rows", rows, None)

    def with_source_row(df: DataFrame) -> DataFrame:
        # the id follows from file, sheet and row number, so it needs no lookup
        return df.withColumn("source_row_id", natural_key(worksheet, "source_row"))

    organizations = organization_rows(parsed.claims, "contractor").unionByName(
        organization_rows(parsed.claims, "carrier")
    )
    yield Batch("organizations", organizations, ("display_name",), by_row)
    yield Batch("organization_aliases", alias_rows(organizations, "organization_id", job), None, by_row)
    people = person_rows(parsed.claims)
    yield Batch("people", people, ("display_name",), by_row)
    yield Batch("person_aliases", alias_rows(people, "person_id", job), None, by_row)

    resolved = with_source_row(parsed.claims)
    # the last row of an item id counts in every table keyed by it, so it is found before its amounts are unrolled
    last = one_per_key(parsed.claims, ["item_id"], by_row)
    resolved_last = with_source_row(last)
    staged = resolved_last.select(
        job.job_id.alias("import_job_id"),
        F.col("item_id").alias("source_item_id"),
        "source_row_id",
        F.col("row").alias("raw_values"),
        F.col("row").alias("normalized_values"),
        "raw_status",
        "normalized_status",
        F.lit("promoted").alias("promotion_status"),
        "source_row",
    )
    yield Batch("staged_claim_rows", staged, ("normalized_values",))
    # a known claim keeps its state, and its links where the new cell is blank
    fixed = {"claim_id", "source_system", "item_id", "service_type", "property_type", "lifecycle_state"}
    replaced = tuple(f.name for f in StructType.fromDDL(TABLES["claims"]) if f.name not in fixed)
    yield Batch("claims", claim_rows(resolved_last, job), replaced, keep_if_missing=("carrier_id", "assigned_staff_id"))
    facts = fact_rows(last, job, layout)
    yield Batch("claim_financial_facts", facts, ("raw_value", "parsed_numeric_value", "source_availability_status"))
    derived = derived_rows(last, job)
    yield Batch("claim_derived_metrics", derived, ("calculated_value", "reconciliation_status", "difference"))

    def subitems(df: DataFrame, method: str, *extra: str) -> DataFrame:
        return with_source_row(df).select(
            job.job_id.alias("import_job_id"),
            "source_row",
            "source_row_id",
            "parent_item_id",
            *extra,
            F.lit(method).alias("inference_method"),
            F.lit("limited").alias("confidence"),
            F.col("row").alias("raw_values"),
        )

    yield Batch("staged_subitem_headers", subitems(parsed.subitem_headers, "preceding_claim_position"), None)
    details = subitems(parsed.subitem_details, "preceding_claim_and_header_position", "header_row")
    yield Batch("staged_subitem_details", details, None)
    yield Batch("claim_updates", update_rows(parsed.updates, claims_now(), job), None, by_row)

    marked = resolved.withColumn("claim_id", natural_key(F.lit(job.source_system), "item_id")).withColumn(
        "import_job_id", job.job_id
    )
    issues = all_issues(
        marked,
        parsed.updates.withColumn("import_job_id", job.job_id),
        repeated_headers(parsed.headers).withColumn("import_job_id", job.job_id),
        parsed.subitem_details,
        job.period,
    ).withColumn("import_job_id", F.coalesce("import_job_id", job.job_id))
    yield Batch("dq_issues", issues, None, (F.col("issue_type"),))


def promote(tables: Tables, parsed: ParsedImport, job: ImportJob, layout: SheetLayout) -> Tables:
    """Next state of all tables after this import; writes nothing."""
    out: Tables = {}
    for batch in batches(parsed, job, layout, lambda: out["claims"]):
        target, keys = tables[batch.table], list(TABLE_KEYS[batch.table])
        if batch.replace is None:
            out[batch.table] = target.unionByName(insert_if_absent(target, batch.rows, keys, batch.order))
        else:
            out[batch.table] = upsert(target, batch.rows, keys, batch.replace, batch.order, batch.keep_if_missing)
    return out


class PromotedStore:
    """The promoted tables as bucket tables below one folder, and the log of what is published.

    Each import merges its batches into the tables, which rewrites only the
    buckets that change, and then publishes the version of every table in one
    commit. Readers see all tables of one commit. Of two imports that began from
    the same commit, one is refused.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.root = root
        self.log = CommitLog(spark, f"{root}/published")
        self.tables = {
            name: BucketTable(spark, f"{root}/{name}", ddl, TABLE_KEYS[name], 1 if name in SMALL_TABLES else buckets)
            for name, ddl in TABLES.items()
        }

    def differing(self, one: int, other: int) -> dict[str, list[int]]:
        """Buckets of every table whose rows differ between two commits, by their digests."""
        a, b = self.published(one), self.published(other)
        return {name: t.differing(a[name], b[name]) for name, t in self.tables.items()}

    def published(self, commit: int | None = None) -> dict[str, int]:
        """The version of every table in a commit, the latest one if none is named."""
        found = self.log.read(self.log.latest() if commit is None else commit)
        return {name: found.get("versions", {}).get(name, 0) for name in self.tables}

    def read(self, commit: int | None = None) -> Tables:
        return {name: self.tables[name].read(version) for name, version in self.published(commit).items()}

    def promote(self, parsed: ParsedImport, job: ImportJob, layout: SheetLayout, commit: int | None = None) -> dict[str, Merge]:
        """Merges an import into all tables of the latest commit, or of ``commit``, and publishes them together.

        An import that fails on the way leaves the published tables as they were.
        One that changes nothing publishes nothing. ``parsed`` is read by every
        table; ``staged`` writes a large import first.
        """
        began = self.log.latest() if commit is None else commit
        versions = self.published(began)

        def merge(batch: Batch) -> Merge:
            return self.tables[batch.table].merge(
                batch.rows, batch.replace, batch.order, batch.keep_if_missing, versions[batch.table], exclusive=False
            )

        # the tables of one import don't wait for each other, but for the claims that updates are linked to
        with shuffles_removed(self.spark), ThreadPoolExecutor(MERGES_AT_ONCE) as pool:
            running: dict[str, Future[Merge]] = {}
            for batch in batches(parsed, job, layout, lambda: self.tables["claims"].read(running["claims"].result().version)):
                running[batch.table] = pool.submit(merge, batch)
            done = {name: future.result() for name, future in running.items()}
        if any(m.rewritten for m in done.values()):
            self.log.publish(began, {"versions": {name: m.version for name, m in done.items()}, "artifact": job.artifact_sha256})
        return done


MERGES_AT_ONCE = 4
# one row per import, file or sheet
SMALL_TABLES = ("import_jobs", "source_files", "source_worksheets")


def staged(parsed: ParsedImport, folder: str) -> ParsedImport:
    """The frames of an import, written once, so that sixteen tables don't parse the export again."""

    def write(name: str, frame: DataFrame) -> DataFrame:
        frame.write.option("compression", CODEC).parquet(f"{folder}/{name}")
        return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}")

    with shuffles_removed(parsed.claims.sparkSession), ThreadPoolExecutor(MERGES_AT_ONCE) as pool:
        frames = {name: pool.submit(write, name, frame) for name, frame in vars(parsed).items()}
        return ParsedImport(**{name: future.result() for name, future in frames.items()})
