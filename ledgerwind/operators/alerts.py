"""From findings to explained, screened alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv
from ledgerwind.functions import phi
from ledgerwind.functions.text import dollars, percent, title_case, whole_plain
from ledgerwind.operators import audit
from ledgerwind.operators.detect import DETECTOR_ORDER
from ledgerwind.operators.forecast import ENTITY
from ledgerwind.session import materialise


def rank_of(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in fv.SEVERITY_RANK.items() for x in pair])
    return ranks[severity]


def combine(findings: DataFrame) -> DataFrame:
    """One finding per entity, at its highest severity.

    Earlier detectors win ties.  Two or more findings at P2 or worse without a
    P1 escalate to P1 and name the detectors that agreed.
    """
    place = F.array_position(F.array(*[F.lit(d) for d in DETECTOR_ORDER]), F.col("detector"))
    ranked = findings.withColumns({"_rank": rank_of(F.col("severity")), "_place": place})
    rest = ["metric", "detector", "expected", "actual", "deviation_pct", "severity", "score"]
    serious = F.col("_rank") >= 2
    merged = ranked.groupBy(*ENTITY).agg(
        F.max_by(F.struct(*rest), F.struct("_rank", -F.col("_place"))).alias("best"),
        F.sum(serious.cast("int")).alias("_serious"),
        F.sort_array(F.collect_list(F.when(serious, F.struct("_place", "detector")))).alias("_agreeing"),
    )
    escalated = (F.col("_serious") >= 2) & (F.col("best.severity") != "P1")
    return merged.select(
        *ENTITY,
        *[F.col(f"best.{c}").alias(c) for c in rest if c != "severity"],
        F.when(escalated, "P1").otherwise(F.col("best.severity")).alias("severity"),
        escalated.alias("escalated"),
        F.when(escalated, F.array_join("_agreeing.detector", ",")).alias("agreeing_detectors"),
    )


def latest_per_key(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row of every key."""
    rest = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def velocity_signal(settlement_features: DataFrame) -> DataFrame:
    """The single worst settlement slow-down over all attorneys: one row."""
    latest = latest_per_key(settlement_features, ["attorney_id", "case_type"], "event_date")
    change = F.col("settlement_velocity_change_30d")
    text = F.concat(
        F.lit("settlement velocity down "), percent(F.abs(change), 0),
        F.lit(" (Attorney "), title_case(F.col("attorney_id")), F.lit(")"),
    )
    signal = F.struct(change.alias("value"), text.alias("text"))
    return latest.filter(change < fv.VELOCITY_SIGNAL_BELOW).agg(F.min(signal).alias("signal"))


def turnaround_signals(lop_features: DataFrame) -> DataFrame:
    latest = latest_per_key(lop_features.select("facility_id", "event_date", "lop_turnaround_days_p50"), ["facility_id"], "event_date")
    p50 = F.col("lop_turnaround_days_p50")
    text = F.concat(F.lit("LOP turnaround elevated at "), whole_plain(p50), F.lit(" days median"))
    return latest.filter(p50 > fv.TURNAROUND_SIGNAL_ABOVE_DAYS).select(
        F.col("facility_id").alias("entity_id"), F.struct((-p50).alias("value"), text.alias("text")).alias("_turnaround")
    )


def with_driver(entities: DataFrame, settlement_features: DataFrame, lop_features: DataFrame) -> DataFrame:
    """Add the strongest signal behind each entity as ``driver_narrative``."""
    explained = entities.join(turnaround_signals(lop_features), "entity_id", "left").withColumn(
        "_velocity", velocity_signal(settlement_features).scalar()
    )
    strongest = F.least(F.col("_turnaround.value"), F.col("_velocity.value"))
    text = F.when(F.col("_turnaround.value") == strongest, F.col("_turnaround.text")).otherwise(F.col("_velocity.text"))
    narrative = F.coalesce(F.concat(F.lit("Likely driver: "), text, F.lit(".")), F.lit(fv.NO_DRIVER_TEXT))
    return explained.withColumn("driver_narrative", narrative).drop("_turnaround", "_velocity")


def alert_rows(combined: DataFrame, settlement_features: DataFrame, lop_features: DataFrame, created_at: Column) -> DataFrame:
    """Open alerts, still including any whose text names a person (``phi_detected``).

    The explained findings, one row per entity, are written once before their
    text is screened.
    """
    driven = materialise(with_driver(combined, settlement_features, lop_features), "narratives")
    screened = phi.scan_output(driven, "driver_narrative").drop("redacted_text")
    link = F.concat(F.lit("/dashboard/"), "entity_type", F.lit("/"), "entity_id")
    return screened.withColumns(
        {
            "alert_id": F.sha2(F.concat_ws("|", "entity_type", "entity_id", created_at.cast("string")), 256),
            "created_at": created_at,
            "status": F.lit("open"),
            "acknowledged_by": F.lit(None).cast("string"),
            "acknowledged_at": F.lit(None).cast("timestamp"),
            "dashboard_link": link,
            "chatbot_link": F.concat(F.lit("/chatbot?q=Why+did+"), "entity_id", F.lit("+collections+change")),
        }
    )


def deliverable(alerts: DataFrame) -> DataFrame:
    """Alerts whose text is clean."""
    return alerts.filter(~F.col("phi_detected")).drop("phi_detected", "phi_matches")


def summary(alerts: DataFrame) -> DataFrame:
    """Counts by severity, zeros included, and how many were held back."""
    clean = ~F.col("phi_detected")
    counts = {s: F.count(F.when(clean & (F.col("severity") == s), True)).alias(s.lower()) for s in fv.SEVERITIES}
    return alerts.agg(
        F.count(F.when(clean, True)).alias("alerts_generated"),
        F.count(F.when(~clean, True)).alias("phi_blocked"),
        *counts.values(),
    )


def sweep_events(alerts: DataFrame, created_at: Column) -> DataFrame:
    """Audit events of a sweep: one for every alert held back, one for the sweep with its counts."""
    held = audit.compliance_events(alerts, "alert_id", "phi_matches", "ALERT", "anomaly")
    detail = F.to_json(F.struct(F.col("alerts_generated").alias("alerts"), "phi_blocked"))
    at = created_at.cast("string")
    sweep = audit.audit_events(
        summary(alerts),
        event_id=F.sha2(F.concat_ws("|", F.lit("anomaly"), F.lit("nightly_detection"), at), 256),
        user_id=F.lit("system"), user_role=F.lit("admin"), service=F.lit("anomaly"), action=F.lit("nightly_detection"),
        input_phi_scan=F.lit("n/a"), output_phi_scan=F.lit("n/a"), detail_json=detail,
    )
    return held.unionByName(sweep)


def message_text(alerts: DataFrame) -> Column:
    """The alert as the lines a reader sees."""
    labels = F.create_map(*[F.lit(x) for pair in fv.SEVERITY_LABEL.items() for x in pair])
    head = F.concat(F.lit(":warning: ["), labels[F.col("severity")], F.lit("] "), "entity_id", F.lit(" — Anomaly Detected"))
    source = F.concat(F.lit("Metric: "), "metric", F.lit(" | Detector: "), "detector")
    amounts = F.concat(F.lit("Expected: "), dollars(F.col("expected")), F.lit(" | Actual: "), dollars(F.col("actual")))
    change = F.concat(F.lit(" | Δ: "), percent(F.col("deviation_pct"), 1, signed=True))
    figures = F.when(F.col("expected").isNotNull(), F.concat(amounts, F.coalesce(change, F.lit(""))))
    return F.concat_ws("\n", head, source, figures, "driver_narrative", F.concat(F.lit("→ Dashboard: "), "dashboard_link"))


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Apply acknowledgements ``(alert_id, user_id, acked_at)`` to open alerts.

    ``changed`` tells which alerts an acknowledgement actually moved; the first
    acknowledgement of an alert counts.
    """
    first = acks.groupBy("alert_id").agg(F.min(F.struct("acked_at", "user_id")).alias("_ack"))
    changed = F.col("_ack").isNotNull() & (F.col("status") == "open")
    return (
        alerts.join(first, "alert_id", "left")
        .withColumn("changed", changed)
        .withColumns(
            {
                "status": F.when(F.col("changed"), "acknowledged").otherwise(F.col("status")),
                "acknowledged_by": F.when(F.col("changed"), F.col("_ack.user_id")).otherwise(F.col("acknowledged_by")),
                "acknowledged_at": F.when(F.col("changed"), F.col("_ack.acked_at")).otherwise(F.col("acknowledged_at")),
            }
        )
        .drop("_ack")
    )


def list_alerts(
    alerts: DataFrame, severity: str | None = None, status: str | None = None, limit: int = fv.ALERT_DOCUMENTS, offset: int = 0
) -> DataFrame:
    """A page of alerts, newest first; ties by id so pages never overlap."""
    rows = alerts
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "alert_id").offset(int(offset)).limit(int(limit))
