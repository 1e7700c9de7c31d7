"""Masking, scanning and redaction of personal data as column expressions.

Everything is built from SQL functions, so it stays inside whatever stage the text
is already in; nothing here shuffles.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv

# (?U) gives \b, \s and \d their Unicode meaning on every Java version.
UNICODE = "(?U)"
_BLOCK = 64


def hmac_sha256(value: Column, key: str) -> Column:
    """Keyed SHA-256 (RFC 2104) as lower-case hex, from two plain digests.

    The padded key reaches the tasks as the value of a one-row frame, read once when
    the query runs; plans and event logs name the frame, never what it holds.
    """
    secret = key.encode()
    if len(secret) > _BLOCK:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(_BLOCK, b"\0")
    pads = (bytearray(b ^ 0x36 for b in secret), bytearray(b ^ 0x5C for b in secret))
    held = SparkSession.active().createDataFrame([pads], "inner_pad binary, outer_pad binary")
    inner_pad, outer_pad = held.select("inner_pad").scalar(), held.select("outer_pad").scalar()
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def tokenize(value: Column, key: str) -> Column:
    """Deterministic one-way token; equal values share a token."""
    return F.concat(F.lit("tok_"), F.substring(hmac_sha256(value.cast("string"), key), 1, 16))


def mask(frame: DataFrame, entity: str, key: str) -> DataFrame:
    """Tokenize the entity's personal columns; null and empty values stay."""
    columns = [c for c in fv.PHI_COLUMNS.get(entity, []) if c in frame.columns]
    return frame.withColumns(
        {c: F.when(F.col(c).isNull() | (F.col(c) == ""), F.col(c)).otherwise(tokenize(F.col(c), key)) for c in columns}
    )


def is_allowed_name(name: Column) -> Column:
    allowed = F.array(*[F.lit(w) for w in fv.ALLOWED_NAME_WORDS])
    return F.arrays_overlap(F.split(F.lower(name), UNICODE + r"\s+"), allowed)


def person_names(text: Column) -> Column:
    """Two-word capitalised names that no allowed word excuses, in text order."""
    found = F.regexp_extract_all(text, F.lit(UNICODE + fv.PROPER_NAME_PATTERN), F.lit(0))
    return F.filter(found, lambda name: ~is_allowed_name(name))


def scan_input(text: Column) -> Column:
    """Label of the first rule a question trips, or null when it is clean."""
    rules = [F.when(text.rlike(UNICODE + pattern), F.lit(label)) for label, pattern in fv.PHI_PATTERNS]
    person = F.when(F.size(person_names(text)) > 0, F.lit(fv.PERSON_LABEL))
    return F.coalesce(*rules, person)


def redact(text: Column) -> Column:
    """Struct of the redacted text and the labels and names that were removed."""
    labels = F.array().cast("array<string>")
    cleaned = text
    for label, pattern in fv.PHI_PATTERNS:
        hit = cleaned.rlike(UNICODE + pattern)
        labels = F.concat(labels, F.when(hit, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")))
        cleaned = F.regexp_replace(cleaned, UNICODE + pattern, fv.REDACTED.replace("[", r"\[").replace("]", r"\]"))
    return F.struct(cleaned.alias("cleaned"), labels.alias("labels"))


def scan_output(frame: DataFrame, text: str) -> DataFrame:
    """Add ``redacted_text``, ``phi_matches`` and ``phi_detected`` for a text column.

    Removing a name removes all its occurrences, so each distinct name is
    replaced once; the match list still repeats it.
    """
    staged = frame.withColumn("_scan", redact(F.col(text))).withColumn("_names", person_names(F.col("_scan.cleaned")))
    without_names = F.aggregate(
        F.array_distinct("_names"), F.col("_scan.cleaned"), lambda body, name: F.replace(body, name, F.lit(fv.REDACTED))
    )
    return (
        staged.withColumn("redacted_text", without_names)
        .withColumn("phi_matches", F.concat("_scan.labels", "_names"))
        .withColumn("phi_detected", F.size("phi_matches") > 0)
        .drop("_scan", "_names")
    )
