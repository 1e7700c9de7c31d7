"""Registered queries: series, models, forecasts, backtests and the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwind.functions.numeric import rounded
from ledgerwind.operators import forecast as fc
from ledgerwind.operators import registry as rg
from ledgerwind.operators import smoothing as sm
from ledgerwind.plans.catalog import register
from ledgerwind.plans.oracle_views import view
from ledgerwind.session import materialise
from ledgerwind.sources import business
from ledgerwind.sources.tables import Lake

DIMENSIONS = ("facility_id", "attorney_id", "case_type", "collection_date", "amount_collected")
E = fc.ENTITY


def series(lake: Lake) -> DataFrame:
    return fc.dense_series(fc.daily_totals(business.collections(lake, *DIMENSIONS)))


def models(lake: Lake) -> DataFrame:
    trainable = series(lake).filter(F.col("n") >= 30)
    return fc.fit_seasonal_trend(trainable, E)


def run_date(lake: Lake) -> Column:
    """The day after the last collection, as a lazy one-value subquery."""
    return business.collections(lake, "collection_date").agg(F.date_add(F.max("collection_date"), 1)).scalar()


def run_date_of(series: DataFrame) -> Column:
    """:func:`run_date` from the series of all entities, whose last day is that of the last collection."""
    return series.agg(F.date_add(F.max("ds"), 1)).scalar()


def forecasts(lake: Lake) -> DataFrame:
    return fc.forecast_batch(models(lake), run_date(lake))


@register("daily_all_dims", "SELECT entity_type, entity_id, d AS ds, round(y, 4) AS y FROM daily3_v")
def _all_dims(lake: Lake) -> DataFrame:
    return rounded(fc.daily_totals(business.collections(lake, *DIMENSIONS)), {"y": 4})


@register(
    "history_gate",
    """SELECT entity_type, entity_id, count(*) AS history_days,
              CASE WHEN count(*) < 2499 THEN 'insufficient_history' ELSE 'trainable' END AS status FROM dense3_v GROUP BY ALL""",
)
def _gate(lake: Lake) -> DataFrame:
    return fc.history_gate(series(lake), 2499)


@register(
    "forecast_fit",
    """SELECT entity_type, entity_id, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(sigma, 4) AS resid_std,
              n, last_d AS last_date FROM line_v JOIN resid_v USING (run, entity_type, entity_id, fold) WHERE fold = -1""",
)
def _fit(lake: Lake) -> DataFrame:
    return rounded(models(lake).drop("weekday", "month"), {"slope": 6, "intercept": 4, "resid_std": 4})


@register(
    "forecast_offsets",
    """SELECT entity_type, entity_id, 'weekday' AS kind, CAST(wd AS INTEGER) AS slot, round(off, 4) AS offset_value FROM weekday_v WHERE fold = -1
       UNION ALL SELECT entity_type, entity_id, 'month', CAST(mo AS INTEGER), round(off, 4) FROM monthly_v WHERE fold = -1""",
)
def _offsets(lake: Lake) -> DataFrame:
    kinds = F.array(
        F.struct(F.lit("weekday").alias("kind"), F.col("weekday").alias("offsets")),
        F.struct(F.lit("month").alias("kind"), F.col("month").alias("offsets")),
    )
    return (
        models(lake)
        .select(*E, F.inline(kinds))
        .select(*E, "kind", F.posexplode("offsets").alias("slot", "offset_value"))
        .filter("kind = 'weekday' OR slot > 0")
        .withColumn("offset_value", F.round("offset_value", 4))
    )


@register(
    "forecast_daily",
    "SELECT entity_type, entity_id, d AS ds, round(predicted, 4) AS predicted FROM ahead_v WHERE fold = -1",
)
def _daily(lake: Lake) -> DataFrame:
    return rounded(fc.project_days(models(lake), 90), {"predicted": 4})


@register(
    "forecast_bands",
    """SELECT entity_type, entity_id, horizon_days, predicted, ci_lower, ci_upper, predicted AS p50, ci_upper AS p80, p95
       FROM bands_v WHERE fold = -1""",
)
def _bands(lake: Lake) -> DataFrame:
    return forecasts(lake).select(*E, "horizon_days", "predicted", "ci_lower", "ci_upper", "p50", "p80", "p95")


@register(
    "forecast_batch",
    """SELECT entity_type, entity_id, horizon_days, run_d AS forecast_date, run_d + horizon_days AS target_date, predicted,
              ci_lower, ci_upper, 'collections_' || entity_type || '_' || entity_id AS model_name, 1 AS model_version
       FROM bands_v, (SELECT max(collection_date) + 1 AS run_d FROM collections_v) WHERE fold = -1""",
)
def _batch(lake: Lake) -> DataFrame:
    return forecasts(lake).drop("p50", "p80", "p95")


@register(
    "latest_forecast",
    """SELECT entity_type, entity_id, horizon_days, predicted FROM bands_v WHERE fold = -1 AND horizon_days = 60""",
)
def _latest(lake: Lake) -> DataFrame:
    return fc.latest_forecast(forecasts(lake), 60).select(*E, "horizon_days", "predicted")


BACKTEST_PLACES = {"mape": 6, "rmse": 4, "coverage": 4, "bias": 6}


@register(
    "forecast_backtest",
    """SELECT entity_type, entity_id, history_days, round(mape, 6) AS mape, round(rmse, 4) AS rmse, round(coverage, 4) AS coverage,
              round(bias, 6) AS bias, folds FROM backtest_v WHERE run = 2""",
)
def _backtest(lake: Lake) -> DataFrame:
    return rounded(fc.backtest(series(lake)), BACKTEST_PLACES)


@register(
    "backtest_folds",
    """SELECT entity_type, entity_id, CAST(fold AS INTEGER) AS fold, round(actual, 4) AS actual, predicted, ci_lower, ci_upper
       FROM fold_results_v WHERE run = 2""",
)
def _folds(lake: Lake) -> DataFrame:
    return rounded(fc.backtest_folds(series(lake)), {"actual": 4})


def two_runs(lake: Lake) -> DataFrame:
    """Backtests of the whole series (run 2) and of the series a year earlier (run 1)."""
    whole = series(lake)
    runs = F.filter(
        F.array(
            F.struct(F.lit(2).alias("run"), F.col("n").alias("n")),
            F.struct(F.lit(1).alias("run"), (F.col("n") - 365).alias("n")),
        ),
        lambda r: F.col("t") < r["n"],
    )
    both = whole.withColumnRenamed("n", "_n").withColumn("n", F.col("_n")).select(*E, "ds", "t", "y", F.inline(runs))
    return materialise(fc.backtest(both, [*E, "run"]).withColumn("model_name", fc.model_name()), "backtests")


METRICS = ["model_name", "mape", "rmse", "coverage", "bias"]


def registered(lake: Lake) -> tuple[DataFrame, DataFrame]:
    """Decisions of the second run and the registry after both."""
    measured = two_runs(lake)
    empty = lake.spark.createDataFrame([], rg.REGISTRY_SCHEMA)
    first = rg.gate(empty, measured.filter("run = 1").select(*METRICS))
    registry = rg.register(empty, first)
    second = rg.gate(registry, measured.filter("run = 2").select(*METRICS))
    return second, rg.register(registry, second)


@register(
    "champion_gate",
    """SELECT model_name, version, CASE WHEN promoted THEN 'Production' ELSE 'Staging' END AS stage, promoted, blocked,
              round(mape, 6) AS mape, round(champion_mape, 6) AS champion_mape FROM gate_v""",
)
def _champion(lake: Lake) -> DataFrame:
    decisions, _ = registered(lake)
    return rounded(
        decisions.select("model_name", "version", "stage", "promoted", "blocked", "mape", "champion_mape"),
        {"mape": 6, "champion_mape": 6},
    )


@register(
    "model_versions",
    "SELECT model_name, version, stage, round(mape, 6) AS mape, round(coverage, 4) AS coverage FROM registry_v",
)
def _versions(lake: Lake) -> DataFrame:
    _, registry = registered(lake)
    return rounded(
        rg.versions(registry).select("model_name", "version", "stage", "mape", "coverage"), {"mape": 6, "coverage": 4}
    )


@register(
    "model_rollback",
    """SELECT model_name, version, CASE WHEN version = 1 THEN 'Production' WHEN stage = 'Production' THEN 'Archived' ELSE stage END AS stage
       FROM registry_v""",
)
def _rollback(lake: Lake) -> DataFrame:
    _, registry = registered(lake)
    choices = registry.filter("version = 1").select("model_name", "version")
    return rg.set_production(registry, choices).select("model_name", "version", "stage")


@register("next_version", "SELECT model_name, max(version) + 1 AS next_version FROM registry_v GROUP BY model_name")
def _next(lake: Lake) -> DataFrame:
    _, registry = registered(lake)
    return rg.next_versions(registry)


# the smoothing recurrence itself, one day per level of recursion
view("smooth_train_v", """
SELECT entity_type, entity_id, fold, d, t, y, y - (avg(y) OVER (PARTITION BY entity_type, entity_id, fold, isodow(d)) - avg(y) OVER (PARTITION BY entity_type, entity_id, fold)) AS x
FROM train_v WHERE run = 2 AND fold < 3
""")
view("smooth_walk_v", f"""
SELECT entity_type, entity_id, fold, t, x AS level, CAST(NULL AS DOUBLE) AS miss FROM smooth_train_v WHERE t = 0
UNION ALL
SELECT w.entity_type, w.entity_id, w.fold, s.t, {1 - sm.ALPHA!r} * w.level + {sm.ALPHA!r} * s.x, s.x - w.level
FROM smooth_walk_v w JOIN smooth_train_v s ON s.entity_type = w.entity_type AND s.entity_id = w.entity_id AND s.fold = w.fold AND s.t = w.t + 1
""")
view("smooth_model_v", """
SELECT entity_type, entity_id, fold, arg_max(level, t) AS level, stddev_pop(miss) AS sigma, count(*) AS n FROM smooth_walk_v GROUP BY ALL
""")
view("smooth_bands_v", """
SELECT entity_type, entity_id, fold, round(total, 2) AS predicted, round(greatest(0, total - 1.2816 * sigma * sqrt(30)), 2) AS ci_lower, round(total + 1.2816 * sigma * sqrt(30), 2) AS ci_upper
FROM (SELECT m.entity_type, m.entity_id, m.fold, max(sigma) AS sigma, sum(greatest(0, level + coalesce(o.off, 0))) AS total
      FROM smooth_model_v m JOIN line_v l ON l.run = 2 AND l.entity_type = m.entity_type AND l.entity_id = m.entity_id AND l.fold = m.fold, (SELECT unnest(generate_series(1, 30)) AS i) i
      LEFT JOIN (SELECT entity_type, entity_id, fold, isodow(d) AS wd, max(y - x) AS off FROM smooth_train_v GROUP BY ALL) o
        ON o.entity_type = m.entity_type AND o.entity_id = m.entity_id AND o.fold = m.fold AND o.wd = isodow(l.last_d + CAST(i.i AS INTEGER)) GROUP BY ALL)
""")
view("model_folds_v", """
SELECT 'seasonal_trend' AS model_type, entity_type, entity_id, actual, predicted, ci_lower, ci_upper FROM fold_results_v WHERE run = 2 AND fold < 3
UNION ALL
SELECT 'exponential_smoothing', b.entity_type, b.entity_id, r.actual, b.predicted, b.ci_lower, b.ci_upper
FROM smooth_bands_v b JOIN fold_results_v r ON r.run = 2 AND r.entity_type = b.entity_type AND r.entity_id = b.entity_id AND r.fold = b.fold
""")
view("model_types_v", f"""
SELECT *, coverage >= {sm.LEAST_COVERAGE} AS eligible FROM (
  SELECT model_type, count(*) AS entities, avg(mape) AS mape, avg(rmse) AS rmse, avg(coverage) AS coverage FROM (
    SELECT model_type, entity_type, entity_id, avg(abs(predicted - actual) / actual) AS mape, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse,
           avg(CASE WHEN actual BETWEEN ci_lower AND ci_upper THEN 1.0 ELSE 0.0 END) AS coverage FROM model_folds_v GROUP BY ALL) GROUP BY model_type)
""")


@register(
    "model_selection",
    """SELECT model_type, entities, round(mape, 6) AS mean_mape, round(rmse, 4) AS mean_rmse, round(coverage, 4) AS mean_coverage, eligible,
              eligible AND mape = (SELECT min(mape) FROM model_types_v WHERE eligible) AS champion FROM model_types_v""",
)
def _selection(lake: Lake) -> DataFrame:
    chosen = sm.select_model(sm.measure_models(materialise(series(lake), "series")))
    return rounded(chosen, {"mean_mape": 6, "mean_rmse": 4, "mean_coverage": 4})


@register(
    "smoothed_fit",
    """SELECT entity_type, entity_id, round(level, 4) AS level, round(sigma, 4) AS resid_std, n FROM smooth_model_v WHERE fold = -1""",
)
def _smoothed(lake: Lake) -> DataFrame:
    fitted = sm.fit_smoothed(series(lake), E).select(*E, F.col("intercept").alias("level"), "resid_std", "n")
    return rounded(fitted, {"level": 4, "resid_std": 4})
