"""Smoothing, model choice, Student's tail and the merge of feeds."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwind.functions.numeric import log_gamma, student_two_sided
from ledgerwind.operators import forecast as fc
from ledgerwind.operators import signals
from ledgerwind.operators import smoothing as sm


@pytest.mark.parametrize("alpha", [0.05, 0.3, 0.9])
def test_levels_equal_the_recurrence(spark, alpha):
    rng = np.random.default_rng(2)
    values = rng.normal(100, 30, 301)
    rows = [("k", t, float(v)) for t, v in enumerate(values)] + [("k", 301, None), ("one", 0, 5.0)]
    frame = spark.createDataFrame(rows, "k string, t long, x double").repartition(5)
    got = {(r.k, r.t): (r.level, r.level_before) for r in sm.with_levels(frame, ["k"], alpha).collect()}
    level = None
    for t, v in enumerate(values):
        before, level = level, v if level is None else (1 - alpha) * level + alpha * v
        assert got["k", t][0] == pytest.approx(level, rel=1e-12)
        assert got["k", t][1] == (None if before is None else pytest.approx(before, rel=1e-12))
    assert got["one", 0] == (5.0, None)


def test_smoothing_follows_a_step_that_a_line_does_not(spark, series):
    values = [100.0 + (d % 7) for d in range(300)] + [400.0 + (d % 7) for d in range(300, 420)]
    measured = sm.measure_models(series(x=values))
    by_type = {r.model_type: r for r in measured.collect()}
    assert by_type["exponential_smoothing"].mape < 0.02 < by_type["seasonal_trend"].mape
    assert by_type["exponential_smoothing"].folds == 3


def test_choice_of_the_champion(spark):
    schema = "model_type string, mape double, rmse double, coverage double"
    rows = [("a", 0.10, 1.0, 0.7), ("a", 0.10, 1.0, 0.7), ("b", 0.30, 1.0, 0.9), ("b", None, None, None), ("c", 0.30, 1.0, 0.8), ("d", None, None, None)]
    got = {r.model_type: r for r in sm.select_model(spark.createDataFrame(rows, schema)).collect()}
    assert [n for n, r in got.items() if r.champion] == ["b"]  # a covers too little, c ties
    assert not got["a"].eligible and got["b"].entities == 1 and not got["d"].champion
    none = sm.select_model(spark.createDataFrame([("a", 0.1, 1.0, 0.5)], schema)).collect()
    assert not none[0].champion
    assert sm.select_model(spark.createDataFrame([], schema)).isEmpty()


def test_smoothed_model_serves_every_horizon(spark, series):
    model = sm.fit_smoothed(series(x=[10.0 + (d % 7) for d in range(70)]), fc.ENTITY)
    (row,) = fc.with_bands(model, F.lit(14)).collect()
    assert row.predicted == pytest.approx(2 * sum(10 + d for d in range(7)), rel=0.01)


def test_log_gamma(spark):
    frame = spark.createDataFrame([(0.5,), (1.0,), (7.25,), (500.0,)], "z double")
    for r in frame.select("z", log_gamma(F.col("z")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.z), rel=1e-12, abs=1e-12)


def test_students_tail(spark):
    def density(u, f):
        return math.exp(math.lgamma((f + 1) / 2) - math.lgamma(f / 2)) / math.sqrt(f * math.pi) * (1 + u * u / f) ** (-(f + 1) / 2)

    cases = [(t, f) for t in (0.0, 0.1, -1.0, 2.0, -2.5, 6.0) for f in (1.0, 1.7, 2.0, 5.0, 29.3, 400.0)]
    frame = spark.createDataFrame([*cases, (None, 3.0)], "t double, f double")
    for r in student_two_sided(frame, "t", "f", "p").collect():
        if r.t is None:
            assert r.p is None
            continue
        grid = np.linspace(0, abs(r.t), 20001)
        y = np.array([density(u, r.f) for u in grid])
        inside = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (grid[1] - grid[0]) / 3
        assert r.p == pytest.approx(1 - 2 * inside, abs=1e-10)


def test_feeds_are_merged_as_of_each_day(spark):
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    spine = spark.createDataFrame([(k, day(n), float(n)) for k in ("a", "b") for n in range(6)], "k string, d date, y double")
    weekly = spark.createDataFrame([("a", day(-3), 1.0), ("a", day(2), None), ("a", day(4), 3.0), ("c", day(0), 9.0)], "k string, d date, w double")
    other = spark.createDataFrame([("b", day(5), 7, 8)], "k string, d date, u int, v int")
    got = {(r.k, r.d): (r.y, r.w, r.u, r.v) for r in signals.merge_as_of(spine, [weekly, other], "k", "d").collect()}
    assert len(got) == 12
    assert [got["a", day(n)][1] for n in range(6)] == [1.0, 1.0, None, None, 3.0, 3.0]
    assert got["b", day(5)] == (5.0, None, 7, 8) and got["b", day(4)] == (4.0, None, None, None)


def test_outcomes_of_alerts(spark):
    from ledgerwind.operators import monitor

    at = lambda m: dt.datetime(2026, m, 3)
    rows = [("a", "P1", "open", at(1)), ("b", "P1", "acknowledged", at(1)), ("c", "P2", "open", at(1)), ("d", "P1", "open", at(2))]
    alerts = spark.createDataFrame(rows, "alert_id string, severity string, status string, created_at timestamp")
    dismissed = spark.createDataFrame([("a",), ("a",), ("c",), ("x",)], "alert_id string")
    got = {(r.month.month, r.severity): tuple(r)[2:] for r in monitor.alert_outcomes(alerts, dismissed).collect()}
    assert got == {(1, "P1"): (2, 0.5, 0.5, True), (1, "P2"): (1, 0.0, 1.0, False), (2, "P1"): (1, 0.0, 0.0, False)}
    assert monitor.alert_outcomes(alerts.limit(0), dismissed).isEmpty()
