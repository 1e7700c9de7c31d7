import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwind.operators import forecast as fc
from ledgerwind.operators import registry as rg


def numpy_fit(values, start=dt.date(2025, 1, 1)):
    y = np.array(values, dtype=float)
    t = np.arange(len(y))
    days = [start + dt.timedelta(days=int(i)) for i in range(len(y) + 90)]
    slope, intercept = np.polyfit(t, y, 1)
    left = y - (slope * t + intercept)
    wd = np.array([d.weekday() for d in days])
    mo = np.array([d.month for d in days])
    week = np.array([left[wd[: len(y)] == k].mean() for k in range(7)])
    left = left - week[wd[: len(y)]]
    month = np.array([left[mo[: len(y)] == k].mean() if (mo[: len(y)] == k).any() else 0.0 for k in range(13)])
    sigma = (left - month[mo[: len(y)]]).std()
    ahead = np.arange(len(y), len(y) + 90)
    return np.clip(slope * ahead + intercept + week[wd[ahead]] + month[mo[ahead]], 0, None), sigma


def noisy(days=200, seed=0):
    return 1000 + 10 * np.arange(days) + np.random.default_rng(seed).normal(0, 5, days)


def test_fit_equals_numpy(series):
    values = {"x": noisy(), "y": noisy(400, 3)}
    models = fc.fit_seasonal_trend(series(**values), fc.ENTITY)
    days = fc.project_days(models, 90).orderBy("entity_id", "ds").collect()
    for name, ys in values.items():
        ahead, sigma = numpy_fit(ys)
        got = [r.predicted for r in days if r.entity_id == name]
        assert got == pytest.approx(list(ahead), rel=1e-9)
        assert models.filter(F.col("entity_id") == name).first().resid_std == pytest.approx(sigma)


def test_bands_order_and_widen(series):
    models = fc.fit_seasonal_trend(series(x=noisy()), fc.ENTITY)
    rows = {r.horizon_days: r for r in fc.forecast_batch(models, F.to_date(F.lit("2026-05-28"))).collect()}
    assert sorted(rows) == [30, 60, 90]
    for r in rows.values():
        assert 0 <= r.ci_lower <= r.predicted <= r.ci_upper <= r.p95
        assert r.target_date == dt.date(2026, 5, 28) + dt.timedelta(days=r.horizon_days)
    assert rows[90].ci_upper - rows[90].predicted > rows[30].ci_upper - rows[30].predicted


def test_band_total_equals_projected_days(series):
    models = fc.fit_seasonal_trend(series(x=noisy()), fc.ENTITY)
    total = fc.project_days(models, 30).agg(F.sum("predicted")).first()[0]
    assert fc.with_bands(models, F.lit(30)).first().predicted == pytest.approx(total, abs=0.006)


def test_model_survives_parquet(spark, series, tmp_path):
    models = fc.fit_seasonal_trend(series(x=noisy()), fc.ENTITY)
    models.write.parquet(str(tmp_path / "models"))
    back = spark.read.parquet(str(tmp_path / "models"))
    assert fc.with_bands(back, F.lit(30)).first().predicted == fc.with_bands(models, F.lit(30)).first().predicted


def test_bias_sign_on_a_curve(series):
    days = np.arange(180)
    (row,) = fc.backtest(series(x=1000 + 0.5 * days**1.6), horizon=30, folds=3).collect()
    assert row.bias < 0 and 0 <= row.coverage <= 1 and row.folds == 3


def fixed_forecast(total):
    """A forecaster that always expects ``total`` over thirty days."""

    def fit(training, keys):
        return training.groupBy(*keys).agg(
            F.lit(0.0).alias("slope"), F.lit(total / 30).alias("intercept"),
            F.array(*[F.lit(0.0)] * 7).alias("weekday"), F.array(*[F.lit(0.0)] * 13).alias("month"),
            F.lit(1.0).alias("resid_std"), F.count("y").cast("int").alias("n"), F.max("ds").alias("last_date"),
            F.sum("y_test").alias("actual"),
        )

    return fit


def test_bias_with_a_fixed_forecast(series):
    over = fc.backtest(series(x=[100 / 30] * 200), horizon=30, folds=3, forecaster=fixed_forecast(200.0)).first()
    assert over.bias > 0 and over.bias == pytest.approx(over.mape)
    under = fc.backtest(series(x=[400 / 30] * 200), horizon=30, folds=3, forecaster=fixed_forecast(200.0)).first()
    assert under.bias < 0


def test_short_backtest_has_no_folds(series):
    row = fc.backtest(series(x=[1] * 20)).first()
    assert (row.mape, row.rmse, row.coverage, row.bias, row.folds) == (None, None, None, None, 0)


def test_fold_count_shrinks(series):
    # 80 days: two horizons plus thirty do not fit, one fold remains
    assert fc.backtest(series(x=list(range(1, 81)))).first().folds == 1


def test_history_gate(series):
    rows = fc.history_gate(series(x=[1] * 29, y=[1] * 30)).orderBy("entity_id").collect()
    assert [r.status for r in rows] == ["insufficient_history", "trainable"]


def test_rerun_replaces_the_batch(spark, series, tmp_path):
    from ledgerwind.sources.snapshots import write_partitions

    models = fc.fit_seasonal_trend(series(x=noisy()), fc.ENTITY)
    batch = fc.forecast_batch(models, F.to_date(F.lit("2026-05-28")))
    for _ in range(2):
        write_partitions(batch, str(tmp_path / "f"), "entity_type", "forecast_date")
    assert spark.read.parquet(str(tmp_path / "f")).count() == 3


def registry(spark, *rows):
    return spark.createDataFrame([(n, v, s, m, None, None, None) for n, v, s, m in rows], rg.REGISTRY_SCHEMA)


def challenger(spark, mape, name="m"):
    return spark.createDataFrame([(name, mape, None, None, None)], "model_name string, mape double, rmse double, coverage double, bias double")


@pytest.mark.parametrize(
    "champion, new, stage, blocked",
    [
        (0.05, 0.05, "Production", False),
        (0.05, 0.0599, "Production", False),
        (0.05, 0.07, "Staging", False),
        (0.05, 0.09, "Staging", True),
        (None, None, "Staging", False),
        (None, 0.05, "Production", False),
        (0.05, None, "Staging", False),
    ],
)
def test_gate(spark, champion, new, stage, blocked):
    row = rg.gate(registry(spark, ("m", 1, "Production", champion)), challenger(spark, new)).first()
    assert (row.version, row.stage, row.blocked) == (2, stage, blocked)


def test_first_model_goes_to_production_and_promotion_archives(spark):
    empty = registry(spark)
    first = rg.register(empty, rg.gate(empty, challenger(spark, 0.05)))
    assert first.first().stage == "Production"
    second = rg.register(first, rg.gate(first, challenger(spark, 0.04)))
    assert {r.version: r.stage for r in second.collect()} == {1: "Archived", 2: "Production"}
    back = rg.promote(second, "m", 1)
    assert {r.version: r.stage for r in back.collect()} == {1: "Production", 2: "Archived"}
    assert [r.version for r in rg.versions(back, "m").collect()] == [2, 1]
    assert rg.champions(back).first().version == 1
    with pytest.raises(ValueError):
        rg.promote(second, "m", 9)
