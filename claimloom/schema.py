"""Fixed values of the data model and the column layout of the source sheets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: allowed enum members ------------------------------------
FINANCIAL_STATUSES = ("captured", "not_captured", "partially_captured", "invalid", "not_applicable")
USABLE_FINANCIAL_STATUSES = ("captured", "partially_captured")
SERVICE_TYPES = ("estimate_only", "claim_handling")
FILE_STATUSES = ("new", "estimating", "negotiating", "stalled", "closed")
IMPORT_STATUSES = ("pending", "running", "completed", "completed_with_warnings", "failed", "superseded")
ROW_CLASSES = ("claim", "subitem_header", "subitem_detail", "update")
REVIEW_STATUSES = ("pending", "in_review", "resolved", "accepted", "rejected")
TERMINAL_RAW_STATUSES = ("Complete", "Closed")

# --- fixed values: thresholds ----------------------------------------------
GRADE_CUTS = ((90, "A"), (75, "B"), (50, "C"))
STRICT_GRADE_CUTS = ((95, "A"), (80, "B"), (50, "C"))
AGE_BUCKETS = (("0–30", 0, 30), ("31–60", 31, 60), ("61–90", 61, 90), ("90+", 91, None))
EXTREME_PERCENTAGE = 4510
CYCLE_DETERIORATION_FACTOR = 1.08
CARRIER_CONCENTRATION_PERCENT = 35
LOW_COVERAGE_PERCENT = 75
STALLED_SILENCE_DAYS = 21
FAILURE_MESSAGE_LIMIT = 2000
BATCH_SIZES = {"source_rows": 250, "claims": 25, "subitem_headers": 100, "subitem_details": 100, "updates": 250}

# --- fixed values: header terms of the column profiler ---------------------
SENSITIVE_TERMS = ("name", "email", "phone", "address", "user", "homeowner", "rep", "admin", "ch")
FINANCIAL_TERMS = (
    "rcv", "fee", "outstanding", "amount", "collected", "invoice", "charge", "acv", "deduct", "depreci",
    "payment", "settlement",
)
DATE_TERMS = ("date", "assigned", "closed", "timeline", "update", "loss", "sent")
SYSTEM_UPDATE_TOKENS = ("outgoing email", "incoming email", "automatically")

# --- fixed values: keyword families counted over update bodies -------------
KEYWORD_FAMILIES = {
    "carrier": r"\bcarrier\b|\binsurance\b",
    "adjuster": r"\badjuster\b|\badj\b",
    "payment": r"\bpayment\b|\bpaid\b",
    "settlement": r"\bsettlement\b|\bsettled\b",
    "invoice": r"\binvoice\b|\binvoic",
    "status": r"\bstatus\b",
    "assignment": r"\bassign(?:ed|ment)?\b",
}

# --- fixed values: calendar origin and range of serial dates -----------------
SERIAL_DAY_ZERO = "1899-12-30"
SERIAL_DAY_RANGE = (1, 100000)

# --- fixed values: metric names and versions -------------------------------
DERIVED_METRIC = "calculated_additional_rcv"
DERIVED_METRIC_VERSION = "additional-rcv-v1"
SUBITEM_LABEL = "Subitems"


@dataclass(frozen=True)
class MoneyColumn:
    """One amount column of the archive sheet."""

    metric: str
    header: str
    position: int


@dataclass(frozen=True)
class SheetLayout:
    """Headers that the ingest reads; every one can be replaced."""

    archive_sheet: str = "archive"
    updates_sheet: str = "updates"
    archive_header_row: int = 5
    updates_header_row: int = 2
    item_id: str = "Item ID (auto generated)"
    name: str = "Name"
    status: str = "Status"
    contractor: str = "Contractor"
    carrier: str = "Insurance Carrier"
    claim_handler: str = "CH"
    admin: str = "Admin"
    adjuster: str = "Adjuster Name"
    dates: tuple[str, ...] = ("Assigned", "Closed Date", "Date of Status Change", "Date of Loss")
    money: tuple[MoneyColumn, ...] = (
        MoneyColumn("initial_rcv", "Initial Ins. RCV", 9),
        MoneyColumn("requested_rcv", "Requested RCV", 10),
        MoneyColumn("current_rcv", "Current Ins. RCV", 11),
        MoneyColumn("additional_secured", "Additional Secured $", 12),
        MoneyColumn("percentage_increase", "Percentage Increase", 13),
        MoneyColumn("client_fee", "Client Fee", 15),
    )
    post_id: str = "Post ID"
    parent_post_id: str = "Parent Post ID"
    update_item_id: str = "Item ID"
    update_body: str = "Update Content"
    update_created: str = "Created At"
    update_author: str = "User"

    @property
    def header_rows(self) -> dict[str, int]:
        return {self.archive_sheet: self.archive_header_row, self.updates_sheet: self.updates_header_row}


# two digits below the widest decimal, so that two subtractions stay exact
AMOUNT = T.DecimalType(36, 10)
MONEY = T.DecimalType(18, 2)

GRID = T.StructType(
    [
        T.StructField("file_name", T.StringType(), False),
        T.StructField("sheet", T.StringType(), False),
        T.StructField("physical_row", T.LongType(), False),
        T.StructField("cells", T.ArrayType(T.StringType(), True), False),
    ]
)

CLAIMS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("claim_number", T.StringType()),
        T.StructField("source_quarter", T.StringType()),
        T.StructField("contractor_id", T.StringType()),
        T.StructField("carrier_id", T.StringType()),
        T.StructField("adjuster_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("zip_code", T.StringType()),
        T.StructField("service_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("financial_status", T.StringType()),
        T.StructField("opened_at", T.DateType()),
        T.StructField("closed_at", T.DateType()),
        T.StructField("original_rcv", MONEY),
        T.StructField("settled_rcv", MONEY),
        T.StructField("additional_rcv", MONEY),
        T.StructField("service_fee", MONEY),
        T.StructField(
            "updates",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("at", T.DateType()),
                        T.StructField("type", T.StringType()),
                        T.StructField("author", T.StringType()),
                        T.StructField("summary", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

ISSUES = T.StructType(
    [
        T.StructField("deterministic_key", T.StringType()),
        T.StructField("issue_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("source_entity", T.StringType()),
        T.StructField("source_row_id", T.StringType()),
        T.StructField("claim_id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
        T.StructField("suggested_action", T.StringType()),
        T.StructField("import_job_id", T.StringType()),
    ]
)

# Promoted tables: columns as DDL, and the key each of them is unique by.
TABLES = {
    "import_jobs": (
        "import_job_id string, source_system string, source_period string, source_filename string, "
        "source_sha256 string, importer_version string, started_at timestamp, completed_at timestamp, status string, "
        "warning_count bigint, error_count bigint, accepted_counts map<string,bigint>, run_fingerprint string, "
        "last_error string"
    ),
    "source_files": (
        "source_file_id string, source_system string, filename string, sha256 string, metadata map<string,string>, "
        "import_job_id string"
    ),
    "source_worksheets": (
        "worksheet_id string, source_file_id string, file_name string, sheet string, worksheet_index bigint, "
        "header_row bigint, header_map array<struct<position:bigint,raw:string,internal:string>>, import_job_id string"
    ),
    "source_rows": (
        "source_row_id string, worksheet_id string, physical_row bigint, row_class string, source_item_id string, "
        "raw_row map<string,string>, row_fingerprint string, import_job_id string"
    ),
    "organizations": (
        "organization_id string, organization_type string, display_name string, normalized_name string"
    ),
    "organization_aliases": (
        "organization_id string, source_system string, raw_alias string, normalized_alias string, import_job_id string"
    ),
    "people": "person_id string, person_type string, display_name string, normalized_name string",
    "person_aliases": (
        "person_id string, source_system string, raw_alias string, normalized_alias string, import_job_id string"
    ),
    "staged_claim_rows": (
        "import_job_id string, source_item_id string, source_row_id string, raw_values map<string,string>, "
        "normalized_values map<string,string>, raw_status string, normalized_status string, promotion_status string"
    ),
    "staged_subitem_headers": (
        "import_job_id string, source_row bigint, source_row_id string, parent_item_id string, "
        "inference_method string, confidence string, raw_values map<string,string>"
    ),
    "staged_subitem_details": (
        "import_job_id string, source_row bigint, source_row_id string, parent_item_id string, header_row bigint, "
        "inference_method string, confidence string, raw_values map<string,string>"
    ),
    "claims": (
        "claim_id string, source_system string, item_id string, display_name string, raw_status string, "
        "normalized_status string, lifecycle_state string, contractor_id string, carrier_id string, "
        "assigned_staff_id string, assigned_date date, closed_date date, status_change_date date, loss_date date, "
        "service_type string, property_type string, import_job_id string, source_row_id string"
    ),
    "claim_financial_facts": (
        "claim_id string, normalized_metric_name string, import_job_id string, source_field_name string, "
        "raw_value string, parsed_numeric_value decimal(36,10), source_availability_status string, source_sheet string, "
        "source_row bigint, source_column bigint, transformation_version string"
    ),
    "claim_derived_metrics": (
        "claim_id string, metric_name string, metric_version string, import_job_id string, "
        "calculated_value decimal(38,10), source_comparison_value decimal(36,10), reconciliation_status string, "
        "difference decimal(38,10), confidence string"
    ),
    "claim_updates": (
        "source_system string, post_id string, item_id string, claim_id string, unmatched_source boolean, "
        "update_body string, blank_body boolean, body_fingerprint string, duplicate_body boolean, "
        "source_timestamp_raw string, parsed_timestamp timestamp_ntz, timezone_status string, author_name string, "
        "source_sheet string, source_row bigint, import_job_id string, raw_row map<string,string>"
    ),
    "dq_issues": (
        "deterministic_key string, issue_type string, severity string, status string, source_entity string, "
        "source_row_id string, claim_id string, description string, evidence map<string,string>, "
        "suggested_action string, import_job_id string"
    ),
}

TABLE_KEYS = {
    "import_jobs": ("source_sha256", "importer_version"),
    "source_files": ("source_system", "sha256"),
    "source_worksheets": ("source_file_id", "worksheet_index"),
    "source_rows": ("worksheet_id", "physical_row"),
    "organizations": ("organization_type", "normalized_name"),
    "organization_aliases": ("source_system", "organization_id", "normalized_alias"),
    "people": ("person_type", "normalized_name"),
    "person_aliases": ("source_system", "person_id", "normalized_alias"),
    "staged_claim_rows": ("import_job_id", "source_item_id"),
    "staged_subitem_headers": ("import_job_id", "source_row"),
    "staged_subitem_details": ("import_job_id", "source_row"),
    "claims": ("source_system", "item_id"),
    "claim_financial_facts": ("claim_id", "normalized_metric_name", "import_job_id"),
    "claim_derived_metrics": ("claim_id", "metric_name", "metric_version", "import_job_id"),
    "claim_updates": ("source_system", "post_id"),
    "dq_issues": ("deterministic_key",),
}
