import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwind.operators import alerts, detect
from ledgerwind.operators.iforest import anomaly_scores, isolation_forest
from ledgerwind.operators.thresholds import with_thresholds

FORECAST = "entity_type string, entity_id string, predicted double"
FEATURES = ["a", "b", "c"]


def deviation(spark, frame, predicted=3000.0):
    forecasts = spark.createDataFrame([("facility", "x", predicted)], FORECAST)
    return detect.forecast_deviation(frame, forecasts).collect()


def test_deviation_fires(spark, series):
    (row,) = deviation(spark, series(x=[50] * 30))
    assert row.severity == "P1" and row.deviation_pct < 0


def test_deviation_quiet(spark, series):
    assert deviation(spark, series(x=[100] * 30)) == []


def test_deviation_boundary_is_inclusive(spark, series):
    (row,) = deviation(spark, series(x=[595 / 7] * 30))
    assert row.severity == "P2"


def test_deviation_needs_forecast_and_a_week(spark, series):
    none = spark.createDataFrame([], FORECAST)
    assert detect.forecast_deviation(series(x=[1] * 30), none).isEmpty()
    assert deviation(spark, series(x=[1] * 6)) == []


SMALL = {("facility", "x"): {"cusum": {"window": 20}}}


def slow_drift(values, window, k=0.5):
    values = np.array(values, dtype=float)
    reference = values[-2 * window : -window]
    z = (values[-window:] - reference.mean()) / reference.std(ddof=1)
    state = deepest = 0.0
    for step in z:
        state = min(0.0, state + step + k)
        deepest = min(deepest, state)
    return abs(deepest)


def test_cusum_fires_and_equals_the_loop(series):
    values = [99, 101] * 20 + [50] * 20
    (row,) = detect.cusum(series(x=values), SMALL).collect()
    assert row.severity == "P1"
    assert row.score == pytest.approx(slow_drift(values, 20))


def test_cusum_equals_the_loop_on_noise(series):
    rng = np.random.default_rng(4)
    values = {f"e{i}": rng.normal(100, 10, 240) for i in range(5)}
    got = {r.entity_id: r.score for r in detect.cusum_scores(series(**values)).collect()}
    for name, ys in values.items():
        assert got[name] == pytest.approx(slow_drift(ys, 90), abs=1e-9)


def test_cusum_quiet_on_flat_and_short(series):
    assert detect.cusum(series(x=[100] * 60), SMALL).isEmpty()
    assert detect.cusum(series(x=[1, 2, 3, 4, 5]), SMALL).isEmpty()


def test_cusum_falls_back_to_all_prior_history(series):
    overrides = {("facility", "x"): {"cusum": {"window": 5}}}
    values = [99, 101] * 20 + [50] * 5
    (row,) = detect.cusum(series(x=values), overrides).collect()
    assert row.expected == pytest.approx(100.0)


def vectors(spark, last, days=120, seed=0, entity="x"):
    rng = np.random.default_rng(seed)
    rows = np.column_stack([rng.normal(1000, 20, days), rng.normal(10, 1, days), rng.normal(5, 1, days)])
    if last is not None:
        rows[-1] = last
    start = dt.date(2025, 1, 1)
    data = [(entity, start + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "entity_id string, event_date date, a double, b double, c double")


WIDE = {("facility", "x"): {"isolation_forest": {"contamination": 0.05, "p2_score": -0.05, "p1_score": -0.10}}}


def test_forest_fires_on_planted_row(spark):
    planted = vectors(spark, [50, 200, 400])
    (row,) = isolation_forest(planted, FEATURES, WIDE).collect()
    assert row.severity == "P1"
    scores = anomaly_scores(planted, FEATURES, WIDE).orderBy("score").collect()
    assert scores[0].event_date == dt.date(2025, 1, 1) + dt.timedelta(days=119)


def test_forest_quiet_and_short(spark):
    assert isolation_forest(vectors(spark, [1000, 10, 5]), FEATURES, WIDE).isEmpty()
    assert isolation_forest(vectors(spark, [50, 200, 400], days=30), FEATURES, WIDE).isEmpty()


def test_forest_does_not_depend_on_partitioning(spark):
    frame = vectors(spark, None).unionByName(vectors(spark, None, seed=1, entity="y"))
    key = lambda r: (r.entity_id, r.event_date)
    one = sorted(anomaly_scores(frame.coalesce(1), FEATURES).collect(), key=key)
    many = sorted(anomaly_scores(frame.repartition(7), FEATURES).collect(), key=key)
    assert [r.score for r in one] == pytest.approx([r.score for r in many], abs=1e-12)


FINDING = "entity_type string, entity_id string, metric string, detector string, expected double, actual double, deviation_pct double, severity string, score double"


def combined(spark, *findings):
    rows = [("facility", "x", "m", d, 1.0, 1.0, None, s, None) for d, s in findings]
    return alerts.combine(spark.createDataFrame(rows, FINDING)).collect()


def test_combine(spark):
    assert combined(spark) == []
    (row,) = combined(spark, ("forecast_deviation", "P2"), ("cusum", "P3"))
    assert row.severity == "P2" and not row.escalated
    (row,) = combined(spark, ("cusum", "P2"), ("forecast_deviation", "P2"))
    assert row.severity == "P1" and row.escalated and row.agreeing_detectors == "forecast_deviation,cusum"
    assert row.detector == "forecast_deviation"
    (row,) = combined(spark, ("forecast_deviation", "P1"), ("cusum", "P2"))
    assert row.severity == "P1" and not row.escalated


def test_threshold_override_replaces_single_values(spark):
    entities = spark.createDataFrame([("facility", "x"), ("facility", "y")], "entity_type string, entity_id string")
    overrides = {("facility", "x"): {"forecast_deviation": {"p2_pct": -0.22}}}
    x, y = with_thresholds(entities, overrides).orderBy("entity_id").collect()
    assert x.forecast_deviation_p2_pct == -0.22 and y.forecast_deviation_p2_pct == -0.15
    assert x.cusum_window == y.cusum_window == 90.0


def test_vectors_fill_missing_with_zero(spark):
    day = dt.date(2025, 1, 1)
    daily = spark.createDataFrame([("f", day, 5.0)], "facility_id string, event_date date, collections_1d double")
    weekly = spark.createDataFrame([], "facility_id string, event_date date, lop_turnaround_days_p50 double, lop_backlog_count bigint")
    (row,) = detect.facility_vectors(daily, weekly).collect()
    assert row.lop_turnaround_days_p50 == 0.0 and row.lop_backlog_count == 0.0


def test_driver_narrative(spark):
    entities = spark.createDataFrame([("facility", "x")], "entity_type string, entity_id string")
    settled = spark.createDataFrame(
        [
            ("alice", "PI", dt.date(2026, 1, 1), -0.30),
            ("alice", "PI", dt.date(2026, 2, 1), -0.40),
            ("bob", "PI", dt.date(2026, 2, 1), -0.20),
        ],
        "attorney_id string, case_type string, event_date date, settlement_velocity_change_30d double",
    )
    lop = "facility_id string, event_date date, lop_turnaround_days_p50 double"
    quiet = spark.createDataFrame([], lop)
    (row,) = alerts.with_driver(entities, settled, quiet).collect()
    assert row.driver_narrative == "Likely driver: settlement velocity down 40% (Attorney Alice)."
    slow = spark.createDataFrame([("x", dt.date(2026, 2, 1), 60.0)], lop)
    (row,) = alerts.with_driver(entities, settled, slow).collect()
    assert row.driver_narrative == "Likely driver: LOP turnaround elevated at 60 days median."
    (row,) = alerts.with_driver(entities, settled.filter("false"), quiet).collect()
    assert row.driver_narrative.startswith("No single dominant driver")


def alert_frame(spark, text="fine"):
    rows = [("facility", f"e{i}", "collections_7d", "forecast_deviation", 1000.5, 500.0, -0.5, "P1" if i % 2 else "P2", None, False, None) for i in range(5)]
    schema = FINDING + ", escalated boolean, agreeing_detectors string"
    frame = spark.createDataFrame(rows, schema)
    settled = spark.createDataFrame([(text, "PI", dt.date(2026, 2, 1), -0.4)], "attorney_id string, case_type string, event_date date, settlement_velocity_change_30d double")
    lop = spark.createDataFrame([], "facility_id string, event_date date, lop_turnaround_days_p50 double")
    return alerts.alert_rows(frame, settled, lop, F.to_timestamp(F.lit("2026-05-28 00:00:00")))


def test_alert_text_and_pages(spark):
    rows = alerts.deliverable(alert_frame(spark))
    text = rows.select("entity_id", alerts.message_text(rows).alias("m")).filter("entity_id = 'e1'").first().m
    assert text.splitlines()[0] == ":warning: [P1 Critical] e1 — Anomaly Detected"
    assert text.splitlines()[2] == "Expected: $1,000 | Actual: $500 | Δ: -50.0%"
    pages = [alerts.list_alerts(rows, limit=2, offset=o).collect() for o in (0, 2, 4)]
    assert len({r.alert_id for page in pages for r in page}) == 5
    assert alerts.list_alerts(rows, severity="P1").count() == 2


def test_personal_text_is_held_back(spark):
    # a two-word name without an allowed word must not leave the engine
    held = alert_frame(spark, "x").withColumn("driver_narrative", F.lit("Jane Roe is late"))
    from ledgerwind.functions import phi

    screened = phi.scan_output(held.drop("phi_detected", "phi_matches"), "driver_narrative")
    assert alerts.deliverable(screened).isEmpty()
    assert alerts.summary(screened).first().phi_blocked == 5


def test_acknowledge_only_open_alerts(spark):
    rows = alerts.deliverable(alert_frame(spark))
    one = rows.first().alert_id
    acks = spark.createDataFrame([(one, "sam", dt.datetime(2026, 5, 29))], "alert_id string, user_id string, acked_at timestamp")
    after = alerts.acknowledge(rows, acks)
    assert after.filter("changed").count() == 1
    again = alerts.acknowledge(after.drop("changed"), acks)
    assert again.filter("changed").isEmpty()
    assert again.filter("status = 'acknowledged'").first().acknowledged_by == "sam"


def test_a_sweep_reads_the_letters_once_and_dates_itself_by_the_series(spark, monkeypatch):
    from unittest.mock import MagicMock

    from ledgerwind.plans import queries_alerts as qa

    for name in ("findings", "detect", "iforest", "al", "business", "densify"):
        monkeypatch.setattr(qa, name, MagicMock())
    monkeypatch.setattr(qa, "ft", MagicMock(), raising=False)
    monkeypatch.setattr(qa, "materialise", lambda frame, name: frame)
    lop, scan = MagicMock(), MagicMock()
    monkeypatch.setattr(qa.qf, "lop_features", lop)
    monkeypatch.setattr(qa.qf, "settlement_features", MagicMock())
    monkeypatch.setattr(qa.qc, "run_date", scan)
    qa.alerts(MagicMock(), with_forest=True, series=MagicMock())
    assert lop.call_count == 1 and not scan.called


def test_run_date_of_the_series_is_that_of_the_collections(spark):
    import datetime as dt

    from ledgerwind.operators import forecast as fc
    from ledgerwind.plans import queries_forecast as qc

    day = lambda d: dt.date(2025, 1, d) if d else None
    for days in ([3, 1, 9, None], [None], [5, 5], []):
        rows = [("f", None, "c", day(d), 1.0) for d in days]
        frame = spark.createDataFrame(rows, "facility_id string, attorney_id string, case_type string, collection_date date, amount_collected double")
        series = fc.dense_series(fc.daily_totals(frame))
        last = max((d for d in days if d), default=None)
        assert spark.range(1).select(qc.run_date_of(series)).first()[0] == (day(last + 1) if last else None)
