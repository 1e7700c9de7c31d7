"""Row validation and data-quality rules.

Row rules are projections; table rules are folded into one aggregate per
entity, so a table is read once however many rules it carries.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind import contracts
from ledgerwind import fixed_values as fv


def parsed(field: contracts.Field) -> Column:
    """The field in its declared type; null when it is missing or unreadable."""
    raw = F.col(field.name)
    if field.kind == "str":
        return raw.cast("string")
    text = F.trim(raw.cast("string"))
    if field.kind == "int":
        return F.when(text.rlike(r"\A[+-]?\d+(\.0+)?\z"), F.regexp_extract(text, r"\A([+-]?\d+)", 1).try_cast("bigint"))
    # Java reads "1d" and "1f" as numbers; the contract does not.
    return F.when(~text.rlike(r"(?i)[0-9.][df]\z"), text.try_cast("double"))


def field_error(field: contracts.Field, present: bool) -> Column:
    if not present:
        return F.lit(f"{field.name}: {contracts.MISSING}" if field.required else None).cast("string")
    raw = F.col(field.name)
    error = F.when(raw.isNull(), F.lit(f"{field.name}: {contracts.MISSING}")) if field.required else F.when(F.lit(False), F.lit(""))
    if field.kind != "str":
        message = contracts.BAD_INTEGER if field.kind == "int" else contracts.BAD_NUMBER
        error = error.when(raw.isNotNull() & parsed(field).isNull(), F.lit(f"{field.name}: {message}"))
    return error


def validate(frame: DataFrame, entity: str) -> DataFrame:
    """Coerce every contract field and list what is wrong with each row.

    Returns the other columns untouched, the contract columns in their declared
    types and an ``errors`` array; a valid row has none.
    """
    declared = contracts.fields(entity)
    present = {f.name for f in declared} & set(frame.columns)
    errors = F.filter(F.array(*[field_error(f, f.name in present) for f in declared]), lambda e: e.isNotNull())
    others = [c for c in frame.columns if c not in present]
    typed = [
        (parsed(f) if f.name in present else F.lit(None).cast(f.sql_type)).alias(f.name)
        for f in declared
        if f.name in present or not f.required
    ]
    return frame.select(*others, *typed, errors.alias("errors"))


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0).drop("errors")


def error_samples(validated: DataFrame, entity: str, order: str, limit: int = fv.ERROR_SAMPLES_PER_ENTITY) -> DataFrame:
    """The first distinct error messages, by first appearance; no raw values.

    Messages are a small fixed vocabulary, so the map-side minimum leaves a few
    rows per task before anything is shuffled.
    """
    seen = (
        validated.select(order, F.posexplode("errors").alias("position", "message"))
        .groupBy("message")
        .agg(F.min(F.struct(order, "position")).alias("first_seen"))
    )
    rank = F.row_number().over(Window.orderBy("first_seen", "message"))
    return (
        seen.orderBy("first_seen", "message")
        .limit(limit)
        .select(F.lit(entity).alias("entity"), rank.alias("sample"), "message")
    )


def first_errors(entity: str, columns: Iterable[str], order: str) -> dict[str, Column]:
    """Per message that the contract can give, where it is seen first; to be observed while the rows are read."""
    present, found = set(columns), {}
    for field in contracts.fields(entity):
        kinds = [contracts.MISSING] if field.required else []
        if field.name in present and field.kind != "str":
            kinds.append(contracts.BAD_INTEGER if field.kind == "int" else contracts.BAD_NUMBER)
        for kind in kinds:
            message = f"{field.name}: {kind}"
            found[message] = F.min(F.when(F.array_contains("errors", message), F.struct(order, F.array_position("errors", message))))
    return found


def sampled(seen: dict[str, tuple | None], limit: int = fv.ERROR_SAMPLES_PER_ENTITY) -> list[str]:
    """The first distinct messages, by first appearance; a row without order comes first."""
    places = sorted((at[0] is not None, *at, message) for message, at in seen.items() if at is not None)
    return [message for *_, message in places[:limit]]


def schema_failures(columns: Iterable[str], entity: str) -> list[str]:
    """Missing required and unexpected extra columns; metadata only, no job."""
    actual = set(columns)
    declared = contracts.fields(entity)
    missing = sorted(f.name for f in declared if f.required and f.name not in actual)
    extra = sorted(actual - {f.name for f in declared})
    failures = []
    if missing:
        failures.append(f"[{entity}] missing required columns: {missing}")
    if extra:
        failures.append(f"[{entity}] unexpected new columns (possible upstream schema change): {extra}")
    return failures


def rule_measures(entity: str, columns: Iterable[str], domains: dict[str, list[str]] | None = None) -> dict[tuple[str, str], Column]:
    """One aggregate per rule, keyed by (column, rule)."""
    present = set(columns)
    measures: dict[tuple[str, str], Column] = {}
    for c in fv.NOT_NULL_RULES[entity]:
        if c in present:
            measures[c, "null_rate"] = F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0))
    for c in fv.NOT_NEGATIVE_RULES[entity]:
        if c in present:
            measures[c, "negative_rows"] = F.coalesce(F.sum((F.col(c) < 0).cast("double")), F.lit(0.0))
    for c, allowed in (domains or {}).items():
        if c in present:
            outside = F.col(c).isNotNull() & ~F.col(c).isin(*allowed)
            measures[c, "outside_domain_rows"] = F.coalesce(F.sum(outside.cast("double")), F.lit(0.0))
    return measures


RULE_LIMITS = {"null_rate": fv.MAX_NULL_RATE, "negative_rows": 0.0, "outside_domain_rows": 0.0}


def quality_report(frame: DataFrame, entity: str, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """Every rule of the entity with what was observed, not just the first failure."""
    measures = rule_measures(entity, frame.columns, domains)
    row = frame.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures.values())])
    findings = F.array(
        *[
            F.struct(
                F.lit(entity).alias("entity"),
                F.lit(column).alias("column"),
                F.lit(rule).alias("rule"),
                F.col(f"m{i}").alias("observed"),
                F.lit(RULE_LIMITS[rule]).alias("limit"),
            )
            for i, (column, rule) in enumerate(measures)
        ]
    )
    return row.select(F.inline(findings)).withColumn(
        "status", F.when(F.col("observed") > F.col("limit"), "failed").otherwise("passed")
    )


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return frame.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def last_row_wins(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the given order.

    Spark reduces the maximum of a struct by sorted aggregates: a key repeated billions
    of times is reduced inside every map task before it is shuffled, but each task sorts
    its rows by the keys once before the shuffle and once after it.
    """
    payload = [c for c in frame.columns if c not in keys]
    latest = F.max_by(F.struct(*payload), F.struct(*order)) if payload else F.max(F.lit(1))
    return frame.groupBy(*keys).agg(latest.alias("_row")).select(*keys, *([F.col(f"_row.{c}") for c in payload]))


def record_drop(counts: DataFrame, prior: DataFrame, on: list[str], blocking: bool = True, limit: float = fv.MAX_RECORD_DROP) -> DataFrame:
    """Compare row counts with the run before; skipped where there is none."""
    drop = F.when(F.col("prior_rows") > 0, (F.col("prior_rows") - F.col("row_count")) / F.col("prior_rows"))
    verdict = F.when(F.col("drop_rate") > limit, "failed" if blocking else "warning").otherwise("passed")
    joined = counts.join(prior.select(*on, F.col("row_count").alias("prior_rows")), on, "left")
    return joined.withColumn("drop_rate", drop).withColumn("status", verdict)
