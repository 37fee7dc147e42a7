"""Date parsing that never fails a job and never moves a value between time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import BLANK, clean_text
from claimloom.schema import SERIAL_DAY_RANGE, SERIAL_DAY_ZERO

ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
SPACED_TIME = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
NAMED_MONTH_TIME = r"^\d{1,2} [A-Za-z]+ \d{4} \d{1,2}:\d{1,2}(:\d{1,2})? [AaPp][Mm]$"
US_DAY = r"^\d{1,2}/\d{1,2}/\d{4}$"


def _ntz(value: Column) -> Column:
    return value.try_cast("timestamp_ntz")


def _from_pattern(text: Column, pattern: str) -> Column:
    """Text read with a datetime pattern as a naive timestamp, whatever the session's zone.

    The text is read as UTC and its seconds are counted from a naive origin, so
    no local clock change can move it.
    """
    instant = F.unix_seconds(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{pattern} Z")))
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    day = F.floor(instant / F.lit(86400)).cast("int")
    second = F.pmod(instant, F.lit(86400)).cast("int")
    return F.timestamp_add("SECOND", second, F.timestamp_add("DAY", day, origin))


def named_month_time(text: Column) -> Column:
    """``8 April 2025 08:16:10 PM`` as a naive timestamp; the seconds are optional."""
    return _from_pattern(F.when(text.rlike(NAMED_MONTH_TIME), text), "d MMMM yyyy h:m[:s] a")


def claim_date(raw: Column) -> Column:
    """Claim milestone cell as {raw, parsed, state}.

    A cell exported from a date or date-time value is ISO text. Midnight counts
    as a plain date; any other time of day has an unknown zone.
    """
    day = F.when(raw.rlike(ISO_DAY), _ntz(raw))
    moment = F.when(raw.rlike(ISO_TIME), _ntz(raw))
    parsed = F.coalesce(day, moment)
    at_midnight = F.date_trunc("day", moment) == moment
    state = (
        F.when(raw.isNull() | (raw == ""), "date_only")
        .when(day.isNotNull(), "date_only")
        .when(moment.isNotNull(), F.when(at_midnight, "date_only").otherwise("unknown_timezone"))
        .otherwise("unparseable")
    )
    return F.struct(raw.alias("raw"), parsed.alias("parsed"), state.alias("state"))


def update_time(value: Column) -> Column:
    """Update timestamp text as {raw, parsed, state}.

    Day, month name and year may be parted by blanks or slashes and any number
    of blanks may stand before the time of day.
    """
    raw = clean_text(value)
    squeezed = F.regexp_replace(raw, rf"(?:/|{BLANK})+", " ")
    parsed = named_month_time(squeezed)
    state = F.when(raw.isNull() | parsed.isNotNull(), "unknown_timezone").otherwise("unparseable")
    return F.struct(raw.alias("raw"), parsed.alias("parsed"), state.alias("state"))


def serial_day(number: Column) -> Column:
    """Spreadsheet serial number as a naive timestamp, within the accepted range."""
    low, high = SERIAL_DAY_RANGE
    origin = F.lit(SERIAL_DAY_ZERO).cast("timestamp_ntz")
    accepted = F.when(number.between(low, high), number)
    whole = F.floor(accepted).cast("int")
    seconds = F.round((accepted - F.floor(accepted)) * F.lit(86400.0)).cast("int")
    return F.timestamp_add("SECOND", seconds, F.timestamp_add("DAY", whole, origin))


def profile_date(value: Column, serial_numbers: bool = False) -> Column:
    """Naive timestamp from any of the profiler's formats, else NULL."""
    text = clean_text(value)
    squeezed = F.regexp_replace(text, rf"{BLANK}+", " ")
    slashed = F.when(text.contains("/"), named_month_time(F.replace(squeezed, F.lit("/"), F.lit(" "))))
    us_day = _from_pattern(F.when(text.rlike(US_DAY), text), "M/d/yyyy")
    iso = F.when(
        text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") | text.rlike(ISO_TIME) | squeezed.rlike(SPACED_TIME), _ntz(squeezed)
    )
    options = [iso, slashed, us_day]
    if serial_numbers:
        options.append(serial_day(text.try_cast("double")))
    return F.coalesce(*options)


def cycle_days(opened: Column, closed: Column) -> Column:
    """Days from opening to closing, never below zero; NULL while open."""
    return F.when(closed.isNotNull(), F.greatest(F.lit(0), F.date_diff(closed, opened)))


def days_since(day: Column, as_of: Column) -> Column:
    """Days from ``day`` to ``as_of``, never below zero; NULL without a day."""
    return F.when(day.isNotNull(), F.greatest(F.lit(0), F.date_diff(as_of, day)))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit(" Q"), F.quarter(day).cast("string"))
