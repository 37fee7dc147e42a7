"""Invoices, payments and the revenue views over them.

These follow written definitions; nothing in the reference system executes them.
Money is in whole minor units, and no sum mixes currencies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.dates import days_since, quarter_label
from claimloom.operators.intervals import join_days, levels_for
from claimloom.schema import AGE_BUCKETS
from claimloom.session import kept

# fixed values: the order in which payment references are tried
MATCH_STEPS = ("invoice_id", "file_id", "metadata_reference", "customer_amount_window", "organization_amount_window")


def _sum(condition: Column | None = None, value: str = "amount_minor") -> Column:
    amount = F.col(value) if condition is None else F.when(condition, F.col(value))
    return F.coalesce(F.sum(amount), F.lit(0))


def sums_by_currency(rows: DataFrame, group: Sequence[str], value: str = "amount_minor") -> DataFrame:
    """Sums per group and currency; amounts of two currencies never meet."""
    return rows.groupBy(*group, "currency").agg(_sum(value=value).alias("total_minor"), F.count("*").alias("rows"))


def invoice_balances(
    invoices: DataFrame, charges: DataFrame, allocations: DataFrame, refunds: DataFrame, adjustments: DataFrame
) -> DataFrame:
    """Charged, collected and open amount per invoice.

    Charged: lines that are not void. Collected: settled allocations less
    refunds. Open: charged less collected less approved adjustments. Every
    detail table is summed per invoice before it is joined.
    """
    charged = charges.groupBy("invoice_id").agg(
        _sum(~F.col("is_void")).alias("charged_minor"), F.count_if(~F.col("is_void")).alias("active_lines")
    )
    allocated = allocations.groupBy("invoice_id").agg(_sum(F.col("is_settled")).alias("allocated_minor"))
    refunded = refunds.groupBy("invoice_id").agg(_sum().alias("refunded_minor"))
    adjusted = adjustments.groupBy("invoice_id").agg(_sum(F.col("is_approved")).alias("adjusted_minor"))
    joined = invoices
    for part in (charged, allocated, refunded, adjusted):
        joined = joined.join(part, "invoice_id", "left")
    filled = joined.na.fill(0, ["charged_minor", "active_lines", "allocated_minor", "refunded_minor", "adjusted_minor"])
    collected = F.col("allocated_minor") - F.col("refunded_minor")
    return filled.withColumn("collected_minor", collected).withColumn(
        "open_balance_minor", F.col("charged_minor") - F.col("collected_minor") - F.col("adjusted_minor")
    )


def unbalanced_invoices(balances: DataFrame) -> DataFrame:
    """Invoices whose stated amount is not the sum of their active lines."""
    return balances.where(F.col("amount_minor") != F.col("charged_minor"))


def _exact_candidates(payments: DataFrame, invoices: DataFrame, reference: str, key: str) -> DataFrame:
    """Candidates by an exact reference: count and smallest invoice per reference value."""
    per_key = invoices.groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("candidates"), F.min("invoice_id").alias("candidate_id")
    )
    return payments.withColumn("_key", F.col(reference)).join(per_key, "_key").drop("_key")


def _window_candidates(payments: DataFrame, invoices: DataFrame, party: str, window_days: int) -> DataFrame:
    """Candidates of the same party and amount within the date window.

    Both sides are first reduced to distinct (party, amount, day). The window of
    each payment day is cut into aligned blocks and meets invoice days by
    equality, so neither a party with many payments nor a long window multiplies
    the rows.
    """
    per_day = invoices.groupBy(party, "amount_minor", "currency", F.col("invoice_date").alias("_day")).agg(
        F.count("*").alias("_n"), F.min("invoice_id").alias("_id")
    )
    keys = [party, "amount_minor", "currency", "paid_on"]
    asked = payments.where(F.col(party).isNotNull()).select(*keys).distinct()
    windows = asked.withColumns({"_from": F.date_sub("paid_on", window_days), "_to": F.date_add("paid_on", window_days)})
    met = join_days(windows, per_day, keys[:3], "_from", "_to", "_day", levels_for(2 * window_days + 1))
    found = met.groupBy(*keys).agg(F.sum("_n").alias("candidates"), F.min("_id").alias("candidate_id"))
    return payments.join(found, keys)


def _first_step(steps: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """(payment_id, _best) of the first step that gives a payment any candidate."""
    found = None
    for number, candidates in steps:
        tagged = candidates.select(
            "payment_id", F.lit(number).alias("_step"), F.lit(MATCH_STEPS[number - 1]).alias("match_step"), "candidates", "candidate_id"
        )
        found = tagged if found is None else found.unionByName(tagged)
    # at most one row per step and payment
    return found.groupBy("payment_id").agg(
        F.min_by(F.struct("_step", "match_step", "candidates", "candidate_id"), "_step").alias("_best")
    )


def match_payments(payments: DataFrame, invoices: DataFrame, window_days: int = 30) -> DataFrame:
    """First step of the hierarchy that gives a payment any candidate.

    ``payments`` has (payment_id, reference_invoice_id, reference_file_id,
    metadata_invoice_id, customer_id, organization_id, amount_minor, currency,
    paid_on). One candidate is a match for the exact steps and a proposal for
    the two heuristic ones; several candidates are ambiguous and none is taken.
    Exact references settle first; the windows are searched for the rest alone.
    """
    columns = payments.columns
    exact = _first_step([
        (1, _exact_candidates(payments, invoices, "reference_invoice_id", "invoice_id")),
        (2, _exact_candidates(payments, invoices, "reference_file_id", "file_id")),
        (3, _exact_candidates(payments, invoices, "metadata_invoice_id", "invoice_id")),
    ])
    # kept, because both the windows and the result go on from it
    settled = kept(payments.join(exact, "payment_id", "left"), "payments")
    rest = settled.where(F.col("_best").isNull()).drop("_best")
    near = _first_step([
        (4, _window_candidates(rest, invoices, "customer_id", window_days)),
        (5, _window_candidates(rest, invoices, "organization_id", window_days)),
    ]).withColumnRenamed("_best", "_near")
    joined = settled.join(near, "payment_id", "left").withColumn("_best", F.coalesce("_best", "_near"))
    unique = F.col("_best.candidates") == 1
    heuristic = F.col("_best._step") > 3
    return joined.select(
        *columns,
        F.coalesce(F.col("_best.match_step"), F.lit("manual_review")).alias("match_step"),
        F.coalesce(F.col("_best.candidates"), F.lit(0)).alias("candidates"),
        F.when(unique, F.col("_best.candidate_id")).alias("invoice_id"),
        F.when(unique & ~heuristic, "matched")
        .when(unique, "candidate_found")
        .when(F.col("_best.candidates") > 1, "ambiguous")
        .otherwise("unmatched")
        .alias("match_state"),
    )


def reconciliation_state(payments: DataFrame) -> DataFrame:
    """One of nine states per payment.

    ``payments`` has (amount_minor, allocated_minor, refunded_minor,
    is_disputed, is_resolved_manually, match_state).
    """
    net = F.col("allocated_minor")
    state = (
        F.when(F.col("is_resolved_manually"), "resolved_manual")
        .when(F.col("is_disputed"), "disputed")
        .when(net > F.col("amount_minor"), "overallocated_blocked")
        .when((F.col("refunded_minor") > 0) & (net > 0), "refunded")
        .when((net > 0) & (net == F.col("amount_minor")), "fully_allocated")
        .when(net > 0, "partially_allocated")
        .when(F.col("match_state") == "ambiguous", "ambiguous")
        .when(F.col("match_state").isin("matched", "candidate_found"), "candidate_found")
        .otherwise("unmatched")
    )
    return payments.withColumn("reconciliation_state", state)


def over_allocations(
    payments: DataFrame, invoices: DataFrame, allocations: DataFrame, refunds: DataFrame
) -> DataFrame:
    """Payments and invoices whose allocations pass what is available."""
    given = allocations.groupBy("payment_id").agg(_sum().alias("allocated_minor"))
    returned = refunds.groupBy("payment_id").agg(_sum().alias("_refunded"))
    by_payment = (
        payments.select("payment_id", "amount_minor")
        .join(given, "payment_id")
        .join(returned, "payment_id", "left")
        .select(
            F.lit("payment").alias("entity"),
            F.col("payment_id").alias("entity_id"),
            (F.col("amount_minor") - F.coalesce("_refunded", F.lit(0))).alias("limit_minor"),
            "allocated_minor",
        )
    )
    received = allocations.groupBy("invoice_id").agg(_sum().alias("allocated_minor"))
    by_invoice = (
        invoices.select("invoice_id", "amount_minor")
        .join(received, "invoice_id")
        .select(
            F.lit("invoice").alias("entity"),
            F.col("invoice_id").alias("entity_id"),
            F.col("amount_minor").alias("limit_minor"),
            "allocated_minor",
        )
    )
    return by_payment.unionByName(by_invoice).where(F.col("allocated_minor") > F.col("limit_minor"))


def refunds_over_limit(payments: DataFrame, refunds: DataFrame) -> DataFrame:
    """Payments that were refunded beyond their amount."""
    returned = refunds.groupBy("payment_id").agg(_sum().alias("refunded_minor"))
    return payments.join(returned, "payment_id").where(F.col("refunded_minor") > F.col("amount_minor"))


def revenue_lenses(production: DataFrame, invoices: DataFrame, cash: DataFrame, deductions: DataFrame) -> DataFrame:
    """The same money under four dates, per quarter and currency.

    ``production`` has completed_on, ``invoices`` invoice_date, ``cash`` and
    ``deductions`` paid_on; deductions lower the net collections.
    """

    def lens(rows: DataFrame, name: str, day: str, sign: int = 1) -> DataFrame:
        return rows.where(F.col(day).isNotNull()).select(
            F.lit(name).alias("lens"),
            quarter_label(F.col(day)).alias("quarter"),
            "currency",
            (F.col("amount_minor") * sign).alias("amount_minor"),
        )

    rows = (
        lens(production, "operational_production", "completed_on")
        .unionByName(lens(invoices, "invoiced_revenue", "invoice_date"))
        .unionByName(lens(cash, "cash_received", "paid_on"))
        .unionByName(lens(cash, "net_collections", "paid_on"))
        .unionByName(lens(deductions, "net_collections", "paid_on", -1))
    )
    return rows.groupBy("lens", "quarter", "currency").agg(_sum().alias("total_minor"))


def completion_to_cash(allocations: DataFrame) -> DataFrame:
    """Cash by completion quarter and collection quarter, with the mean lag in days.

    ``allocations`` has (completed_on, paid_on, amount_minor, currency); rows
    without both dates count as an incomplete chain.
    """
    chained = F.col("completed_on").isNotNull() & F.col("paid_on").isNotNull()
    lag = F.when(chained, F.date_diff("paid_on", "completed_on"))
    return allocations.groupBy(
        quarter_label(F.col("completed_on")).alias("completion_quarter"),
        quarter_label(F.col("paid_on")).alias("collection_quarter"),
        "currency",
    ).agg(
        _sum().alias("cash_minor"),
        F.count("*").alias("allocations"),
        F.when(F.count(lag) > 0, F.sum(lag).cast("double") / F.count(lag).cast("double")).alias("mean_lag_days"),
    )


def receivables_ageing(balances: DataFrame, as_of: str) -> DataFrame:
    """Open balance by days past the due date; not yet due is a bucket of its own."""
    day = F.lit(as_of).cast("date")
    late = days_since(F.col("due_on"), day)
    bucket = F.when(F.col("due_on") >= day, "not due")
    for label, low, high in AGE_BUCKETS[:-1]:
        bucket = bucket.when(late.between(low, high), label)
    bucket = bucket.when(F.col("due_on").isNotNull(), AGE_BUCKETS[-1][0]).otherwise("no due date")
    return (
        balances.where(F.col("open_balance_minor") > 0)
        .groupBy(bucket.alias("bucket"), "currency")
        .agg(F.count("*").alias("invoices"), _sum(value="open_balance_minor").alias("open_minor"))
    )
