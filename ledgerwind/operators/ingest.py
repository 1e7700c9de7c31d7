"""One ingest run: validate, stage, mask, measure, gate, publish, audit.

Each entity is read once from its source.  Counts and rule measures are
observed while the staged files are written, so quality costs no extra pass.
Nothing is visible to readers until every entity has passed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerwind import contracts
from ledgerwind import fixed_values as fv
from ledgerwind.functions import phi
from ledgerwind.operators import quality
from ledgerwind.sources.snapshots import SnapshotStore

AUDIT_SCHEMA = (
    "run_id string, ts timestamp, source_record_count bigint, passed_validation bigint, failed_validation bigint, "
    "phi_masked bigint, schema_ok boolean, quality_ok boolean, operator string, "
    "detail struct<failures:array<string>,warnings:array<string>,aborted:boolean,"
    "validation_errors:map<string,array<string>>>"
)


@dataclass
class IngestReport:
    run_id: str
    source_records: int = 0
    passed: int = 0
    failed: int = 0
    masked: int = 0
    schema_ok: bool = True
    quality_ok: bool = True
    aborted: bool = False
    failures: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    validation_errors: dict[str, list[str]] = field(default_factory=dict)


def curate(valid: DataFrame, entity: str, key: str, order: list[str]) -> DataFrame:
    """Mask, keep only curated columns and the last row of every primary key."""
    masked = phi.mask(valid, entity, key)
    columns = [c for c in contracts.curated_columns(entity) if c in masked.columns]
    kept = quality.last_row_wins(masked.select(*dict.fromkeys([*columns, *order])), contracts.PRIMARY_KEYS[entity], order)
    return kept.select(*columns)


def run_ingest(
    spark: SparkSession,
    sources: dict[str, DataFrame],
    store: SnapshotStore,
    run_id: str,
    sequence: int,
    phi_key: str,
    order: str = "_ord",
    fail_on_quality: bool = True,
    permissive: bool = False,
    delta: bool = False,
) -> IngestReport:
    """Ingest every source frame; ``order`` names the column that ranks its rows.

    With ``delta`` the rows are published behind what is there instead of in its
    place, and the record-count rule, which compares whole tables, is left out.
    """
    report = IngestReport(run_id)
    prior = {} if delta else store.current()
    staged: dict[str, tuple[str, int]] = {}
    for entity, source in sources.items():
        incoming = [c for c in source.columns if c != order]
        failures = quality.schema_failures(incoming, entity)
        if failures:
            report.schema_ok = False
            report.failures += failures
            continue
        _ingest_entity(spark, source, entity, store, report, prior, staged, phi_key, order, permissive)
    report.aborted = not report.schema_ok or (fail_on_quality and not report.quality_ok)
    if not report.aborted:
        keys = {f"curated/{e}": contracts.PRIMARY_KEYS[e] for e in sources}
        store.commit(run_id, sequence, staged, "delta" if delta else "whole", keys)
    write_audit_row(spark, store, report)
    return report


def _ingest_entity(spark, source, entity, store, report, prior, staged, phi_key, order, permissive) -> None:
    validated = quality.validate(source, entity)
    seen = Observation(f"{entity}-source")
    has_personal = F.lit(False)
    for c in contracts.personal_columns(entity):
        if c in validated.columns:
            has_personal = has_personal | (F.col(c).isNotNull() & (F.col(c) != ""))
    good = F.size("errors") == 0
    messages = quality.first_errors(entity, source.columns, order)
    measured = validated.observe(
        seen,
        F.count("*").alias("source"),
        F.sum(good.cast("bigint")).alias("passed"),
        F.sum((good & has_personal).cast("bigint")).alias("masked"),
        *(place.alias(f"e{i}") for i, place in enumerate(messages.values())),
    )
    raw_path = store.stage(quality.valid_rows(measured), f"raw/{entity}", report.run_id)
    counted = seen.get
    total, passed = counted["source"], counted["passed"] or 0
    report.source_records += total
    report.passed += passed
    report.failed += total - passed
    report.masked += counted["masked"] or 0
    if total > passed:
        report.validation_errors[entity] = quality.sampled({m: counted[f"e{i}"] for i, m in enumerate(messages)})
    if passed == 0:
        message = f"[{entity}] no rows from source; skipped"
        if permissive:
            report.warnings.append(message)
        else:
            report.failures.append(message)
            report.schema_ok = False
        return

    # the rules look at every row, also at those that a later row of their key replaces
    valid = spark.read.parquet(raw_path)
    rules = quality.rule_measures(entity, valid.columns)
    checked, counts = Observation(f"{entity}-valid"), Observation(f"{entity}-curated")
    if rules:
        valid = valid.observe(checked, *(m.alias(f"m{i}") for i, m in enumerate(rules.values())))
    curated = curate(valid, entity, phi_key, [order]).observe(counts, F.count("*").alias("rows"))
    path = store.stage(curated, f"curated/{entity}", report.run_id)
    result = checked.get if rules else {}
    for i, (column, rule) in enumerate(rules):
        observed = result[f"m{i}"]
        if observed > quality.RULE_LIMITS[rule]:
            report.quality_ok = False
            report.failures.append(
                f"[{entity}.{column}] null rate {observed:.1%} exceeds {fv.MAX_NULL_RATE:.0%}"
                if rule == "null_rate"
                else f"[{entity}.{column}] contains negative values"
            )
    rows = counts.get["rows"]
    before = prior.get(f"curated/{entity}", ("", 0))[1]
    if before > 0 and (before - rows) / before > fv.MAX_RECORD_DROP:
        message = f"[{entity}] record count dropped {(before - rows) / before:.1%} (prior={before}, now={rows})"
        if permissive:
            report.warnings.append(message)
        else:
            report.quality_ok = False
            report.failures.append(message)
    staged[f"raw/{entity}"] = (raw_path, passed)
    staged[f"curated/{entity}"] = (path, rows)


def write_audit_row(spark: SparkSession, store: SnapshotStore, report: IngestReport) -> None:
    """Append the run to the ingest audit, whether or not it was published."""
    detail = (report.failures, report.warnings, report.aborted, report.validation_errors)
    row = (
        report.run_id, None, report.source_records, report.passed, report.failed, report.masked,
        report.schema_ok, report.quality_ok, "system", detail,
    )
    frame = spark.createDataFrame([row], AUDIT_SCHEMA).withColumn("ts", F.current_timestamp())
    frame.write.mode("append").parquet(f"{store.root}/ingest_audit")
