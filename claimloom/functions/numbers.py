"""Amounts, shares and the rounding rules they follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import clean_text, without
from claimloom.schema import AMOUNT

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def decimal_amount(value: Column) -> Column:
    """Amount text without currency, percent, group marks and blanks; NULL when it is no number."""
    return without(value, "$,%").try_cast(AMOUNT)


def accounting_number(value: Column) -> Column:
    """Finite double; a value wrapped in parentheses is negative."""
    # value stands in few places of this expression, as each of them may be worked out anew
    number = F.regexp_extract(without(value, "$,%()"), PLAIN_NUMBER, 0).try_cast("double")
    sign = F.when(clean_text(value).rlike(r"(?s)^\(.*\)\z"), -1.0).otherwise(1.0)
    signed = number * sign
    return F.when(F.abs(signed) < F.lit(float("inf")), signed)


def availability(parsed: Column, raw: Column | None = None, strict: bool = False) -> Column:
    """``captured`` when a number was parsed, else ``not_captured``.

    ``strict`` reports text that is present but no number as ``invalid``.
    """
    status = F.when(parsed.isNotNull(), "captured")
    if strict:
        if raw is None:
            raise ValueError("strict availability needs the raw value")
        status = status.when(clean_text(raw).isNotNull(), "invalid")
    return status.otherwise("not_captured")


def additional_value(initial: Column, current: Column) -> Column:
    return current - initial


def half_up(value: Column) -> Column:
    """Nearest whole number, halves upward."""
    return F.floor(value + F.lit(0.5))


def percent_of(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double; NULL when there is nothing to divide by."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double") * F.lit(100.0))


def one_decimal_text(value: Column) -> Column:
    """Text with one decimal place, halves away from zero."""
    scaled = F.floor(F.abs(value) * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)
    return (F.when(value < 0, -scaled).otherwise(scaled)).cast("decimal(18,1)").cast("string")


def minor_units(amount: Column, digits: int = 2) -> Column:
    """Money as whole minor units, halves away from zero."""
    return F.round(amount.cast(AMOUNT) * F.lit(10**digits), 0).cast("bigint")
