"""Text expressions: cleaning, aliases, fingerprints, redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.schema import FINANCIAL_TERMS, SENSITIVE_TERMS

# every character that counts as blank, as a list and as a pattern; plain trim() knows only the space
BLANK_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"
NOT_BLANK = r"[^\s\p{Z}\x0B\x1C-\x1F\x{85}]"

# fixed values: case foldings that turn one letter into plain a-z letters
CASE_FOLDS = {
    "ß": "ss", "ẞ": "ss", "ſ": "s", "ŉ": "n", "ǰ": "j", "ẖ": "h", "ẗ": "t", "ẘ": "w", "ẙ": "y", "ẚ": "a",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}


def clean_text(value: Column) -> Column:
    """Trim every kind of blank; an empty result becomes NULL."""
    return F.nullif(F.btrim(value.cast("string"), F.lit(BLANK_CHARACTERS)), F.lit(""))


def without(value: Column, characters: str) -> Column:
    """The text less every blank and every one of ``characters``."""
    return F.translate(value.cast("string"), characters + BLANK_CHARACTERS, "")


def norm_text(value: Column) -> Column:
    """Trimmed text with NULL shown as the empty string."""
    return F.coalesce(clean_text(value), F.lit(""))


def status_key(raw: Column) -> Column:
    return F.lower(F.coalesce(clean_text(raw), F.lit("unknown")))


def alias_key(value: Column) -> Column:
    """Lower case, every run of other characters one blank; ends are kept."""
    return F.lower(F.regexp_replace(value, "[^a-zA-Z0-9]+", " "))


def alias_key_trimmed(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(clean_text(value)), "[^a-z0-9]+", " "))


def identity_key(value: Column) -> Column:
    """Letters and digits only, after case folding."""
    folded = F.lower(value)
    for letter, plain in CASE_FOLDS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.regexp_replace(folded, "[^a-z0-9]+", "")


def body_fingerprint(body: Column) -> Column:
    """SHA-256 of the trimmed body; NULL for a blank one."""
    return F.sha2(clean_text(body), 256)


def natural_key(*parts: Column | str) -> Column:
    """Deterministic identifier of a natural key, so that reruns agree.

    Every part stands behind its length, and a missing one is a dash, so
    different keys never make one text.
    """
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    marked = [F.when(t.isNull(), "-").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*marked), 256)


def join_key(value: Column | str) -> Column:
    """MD5 of an id in sixteen bytes, for joins that shuffle no more of it; NULL stays NULL."""
    return F.unhex(F.md5((F.col(value) if isinstance(value, str) else value).cast("string").cast("binary")))


def row_fingerprint(row: Column) -> Column:
    """SHA-256 of a string map in canonical form: JSON with its keys sorted."""
    entries = F.array_sort(F.map_entries(row))
    return F.sha2(F.to_json(F.map_from_entries(entries)), 256)


def run_fingerprint(artifact_hash: Column, version: Column, source_rows: Column, updates: Column) -> Column:
    return F.sha2(
        F.concat_ws(":", artifact_hash, version, source_rows.cast("string"), updates.cast("string")), 256
    )


def has_term(header: Column, terms: Sequence[str]) -> Column:
    """True when the lower-cased header contains any of the terms."""
    lowered = F.lower(header)
    found = F.lit(False)
    for term in terms:
        found = found | lowered.contains(term)
    return found


def sensitivity_class(
    header: Column,
    sensitive: Sequence[str] = SENSITIVE_TERMS,
    financial: Sequence[str] = FINANCIAL_TERMS,
) -> Column:
    return (
        F.when(has_term(header, sensitive), "PII")
        .when(has_term(header, financial), "Financial")
        .otherwise("Operational")
    )


def redact_example(header: Column, value: Column, sensitive: Sequence[str] = SENSITIVE_TERMS) -> Column:
    """Mask values below a sensitive header; shorten the others to 100 characters."""
    text = F.regexp_replace(norm_text(value), "\r\n?", "\n")
    shortened = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 97), F.lit("..."))).otherwise(text)
    masked = (
        F.when(has_term(header, ["email"]), "[REDACTED EMAIL]")
        .when(has_term(header, ["phone", "extension"]), "[REDACTED PHONE]")
        .when(has_term(header, ["address"]), "[REDACTED ADDRESS]")
        .otherwise("[REDACTED PERSON/IDENTITY]")
    )
    return F.when(has_term(header, sensitive), masked).otherwise(shortened)
