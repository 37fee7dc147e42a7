"""Value expressions, with the odd inputs the sources hold."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimloom.functions import dates, envelope, numbers, text


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(v,) for v in inputs], "v string")
    return [tuple(r) for r in df.select(*columns).collect()]


V = F.col("v")


def test_clean_text_knows_every_blank(spark):
    inputs = [None, "", "  ", "\t", " x ", "  a b \n", "\x1fz\x85"]
    assert values(spark, inputs, text.clean_text(V)) == [(None,), (None,), (None,), (None,), ("x",), ("a b",), ("z",)]
    assert values(spark, [None, " q "], text.norm_text(V)) == [("",), ("q",)]


def test_decimal_amount(spark):
    inputs = ["", "0", "$1,234.50", "12%", "1e5", "(5.00)", "abc", "NaN", "1_000", " $ 7 "]
    found = [v for (v,) in values(spark, inputs, numbers.decimal_amount(V).cast("double"))]
    assert found == [None, 0.0, 1234.5, 12.0, 100000.0, None, None, None, None, 7.0]


def test_accounting_number(spark):
    inputs = ["(5.00)", "-3", "$1,200", "5d", "nan", "inf", "1e400", "", "(2", ".5", "1e3"]
    found = [v for (v,) in values(spark, inputs, numbers.accounting_number(V))]
    assert found == [-5.0, -3.0, 1200.0, None, None, None, None, None, 2.0, 0.5, 1000.0]


def test_availability_strict_and_default(spark):
    amount = numbers.decimal_amount(V)
    both = values(spark, ["5", "x", " "], numbers.availability(amount), numbers.availability(amount, V, strict=True))
    assert both == [("captured", "captured"), ("not_captured", "invalid"), ("not_captured", "not_captured")]


def test_minor_units_and_one_decimal(spark):
    assert values(spark, ["1.005", "-1.005", "2"], numbers.minor_units(numbers.decimal_amount(V))) == [(101,), (-101,), (200,)]
    assert values(spark, ["0.25", "-0.25", "3"], numbers.one_decimal_text(V.cast("double"))) == [("0.3",), ("-0.3",), ("3.0",)]


def test_claim_date_states(spark):
    inputs = [None, "", "2026-04-01", "2026-04-01T00:00:00", "2026-04-01T13:30:00", "1 April", "2026-13-01", "  "]
    d = dates.claim_date(V)
    assert values(spark, inputs, d["parsed"].cast("string"), d["state"]) == [
        (None, "date_only"), (None, "date_only"), ("2026-04-01 00:00:00", "date_only"), ("2026-04-01 00:00:00", "date_only"),
        ("2026-04-01 13:30:00", "unknown_timezone"), (None, "unparseable"), (None, "unparseable"), (None, "unparseable"),
    ]


def test_update_time_accepts_slashes_blanks_and_both_precisions(spark):
    inputs = [
        "08/April/2025  08:16:10 PM", "8 april 2025 08:16 am", "08 April 2025   12:00:00 AM", "31/February/2025 01:00:00 PM",
        "08/April/2025 13:16:10 PM", None, "soon", "08/Avril/2025 08:16:10 PM",
    ]
    t = dates.update_time(V)
    found = values(spark, inputs, t["parsed"], t["state"])
    assert found == [
        (datetime(2025, 4, 8, 20, 16, 10), "unknown_timezone"), (datetime(2025, 4, 8, 8, 16), "unknown_timezone"),
        (datetime(2025, 4, 8), "unknown_timezone"), (None, "unparseable"), (None, "unparseable"), (None, "unknown_timezone"),
        (None, "unparseable"), (None, "unparseable"),
    ]


def test_update_time_ignores_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # this local time does not exist in that zone
        assert values(spark, ["09/March/2025 02:30:00 AM"], dates.update_time(V)["parsed"]) == [(datetime(2025, 3, 9, 2, 30),)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_profile_date_formats(spark):
    inputs = [
        "2025-04-08", "04/08/2025", "08/April/2025  08:16:10 PM", "2025-04-08 20:16:10", "45755", "45755.5", "0", "100001",
        "13/40/2025", "April",
    ]
    found = [v for (v,) in values(spark, inputs, dates.profile_date(V, serial_numbers=True))]
    day = datetime(2025, 4, 8)
    assert found == [
        day, day, datetime(2025, 4, 8, 20, 16, 10), datetime(2025, 4, 8, 20, 16, 10), day, datetime(2025, 4, 8, 12), None, None,
        None, None,
    ]
    assert values(spark, ["45755"], dates.profile_date(V)) == [(None,)]


def test_cycle_and_age_never_negative(spark):
    df = spark.sql(
        "select * from values (date'2026-01-10', date'2026-01-05'), (date'2026-01-10', cast(null as date)), "
        "(date'2026-05-01', date'2026-05-04') as t(o, c)"
    )
    found = df.select(dates.cycle_days(F.col("o"), F.col("c")), dates.days_since(F.col("o"), F.lit("2026-04-01").cast("date")))
    assert [tuple(r) for r in found.collect()] == [(0, 81), (None, 81), (3, 0)]


def test_alias_variants(spark):
    inputs = ["  A&B  Co.", "Straße 9", "ﬁne"]
    found = values(spark, inputs, text.alias_key(V), text.alias_key_trimmed(V), text.identity_key(V))
    assert found == [(" a b co ", "a b co", "abco"), ("stra e 9", "stra e 9", "strasse9"), (" ne", "ne", "fine")]


def test_fingerprints_are_canonical(spark):
    assert values(spark, [" abc ", " "], text.body_fingerprint(V)) == [(hashlib.sha256(b"abc").hexdigest(),), (None,)]
    one = spark.sql("select map('b', '1', 'a', null) as m union all select map('a', null, 'b', '1')")
    assert one.select(text.row_fingerprint(F.col("m"))).distinct().count() == 1


def test_redaction_and_sensitivity(spark):
    long = "x" * 101
    rows = [("Adjuster Email", "a"), ("Phone", "1"), ("Site Address", "b"), ("Change", "c"), ("Total", long), ("Total", "x" * 100)]
    df = spark.createDataFrame(rows, "h string, v string")
    found = [r[0] for r in df.select(text.redact_example(F.col("h"), V)).collect()]
    assert found == [
        "[REDACTED EMAIL]", "[REDACTED PHONE]", "[REDACTED ADDRESS]", "[REDACTED PERSON/IDENTITY]", "x" * 97 + "...", "x" * 100,
    ]
    classes = [r[0] for r in df.select(text.sensitivity_class(F.col("h"))).collect()]
    assert classes == ["PII", "PII", "PII", "PII", "Operational", "Operational"]


@pytest.mark.parametrize("percent,letter", [(100, "A"), (90, "A"), (89, "B"), (75, "B"), (74, "C"), (50, "C"), (49, "D"), (0, "D")])
def test_grade_cuts(spark, percent, letter):
    assert spark.range(1).select(envelope.grade(F.lit(percent))).first()[0] == letter


def test_coverage_rounds_half_up_and_zero_denominator(spark):
    rows = spark.sql("select * from values (1, 200), (0, 0), (3, 200), (5, 4) as t(n, d)")
    found = [r[0] for r in rows.select(envelope.coverage_percent(F.col("n"), F.col("d"))).collect()]
    assert found == [1, 0, 2, 125]


def test_natural_keys_tell_their_parts_apart(spark):
    pairs = [("a:b", "c"), ("a", "b:c"), (None, "a"), ("", "a"), ("a", None), ("a", ""), ("1:a", "b"), ("a1:", "b"), ("-", "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(text.natural_key("a", "b").alias("k")).collect()
    assert len({r.k for r in rows}) == len(pairs)
    again = spark.createDataFrame([("x", 5)], "a string, b long").select(text.natural_key("a", "b").alias("k")).first().k
    assert again == hashlib.sha256(b"1:x1:5").hexdigest()
