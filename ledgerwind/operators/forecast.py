"""Seasonal-trend forecasts for every entity in one plan.

A model is a line plus weekday and month offsets.  All entities (and all
backtest folds) are fitted together: facts are reduced to one row per entity
and day, and every step after that is a window or aggregate on the entity key,
so one hash partitioning serves the whole fit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv
from ledgerwind.functions.numeric import at_least_zero
from ledgerwind.operators.timeseries import by_day, densify

ENTITY = ["entity_type", "entity_id"]

# A forecaster turns a daily frame (keys, ds, y) into one model row per key.
Forecaster = Callable[[DataFrame, Sequence[str]], DataFrame]


def daily_totals(collections: DataFrame, types: Sequence[str] = tuple(fv.ENTITY_DIMENSIONS)) -> DataFrame:
    """Daily totals of every entity type from a single pass over the facts.

    Facts are first summed by all dimensions at once; only that small frame is
    fanned out to the entity types.
    """
    columns = {t: fv.ENTITY_DIMENSIONS[t] for t in types}
    base = collections.groupBy(*columns.values(), F.col("collection_date").alias("ds")).agg(
        F.sum("amount_collected").alias("amount")
    )
    pairs = [F.struct(F.lit(t).alias("entity_type"), F.col(c).alias("entity_id")) for t, c in columns.items()]
    return base.select("ds", "amount", F.inline(F.array(*pairs))).groupBy(*ENTITY, "ds").agg(F.sum("amount").alias("y"))


def dense_series(daily: DataFrame, keys: Sequence[str] = tuple(ENTITY)) -> DataFrame:
    """Gap-free daily series with day number ``t`` and length ``n``."""
    dense = densify(daily, keys, "ds", ["y"])
    return dense.withColumns(
        {
            "t": F.row_number().over(by_day(keys, "ds")) - 1,
            "n": F.count("*").over(Window.partitionBy(*keys)),
        }
    )


def history_gate(series: DataFrame, minimum: int = fv.MIN_HISTORY_DAYS) -> DataFrame:
    """Length of each entity's history and whether it may be trained."""
    return series.groupBy(*ENTITY).agg(F.count("*").alias("history_days")).withColumn(
        "status", F.when(F.col("history_days") < minimum, "insufficient_history").otherwise("trainable")
    )


def fit_seasonal_trend(training: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One model row per key from rows ``(keys, ds, t, y)``.

    Rows whose ``y`` is null take no part in the fit.  Offsets are fitted in
    order: line, then weekday means of what the line leaves, then month means of
    what the weekdays leave.
    """
    used = F.col("y").isNotNull()
    whole = Window.partitionBy(*keys)
    lined = training.withColumns(
        {
            "_slope": F.regr_slope("y", "t").over(whole),
            "_intercept": F.regr_intercept("y", "t").over(whole),
            "_weekday": F.weekday("ds"),
            "_month": F.month("ds"),
        }
    ).withColumn("_left", F.col("y") - (F.col("_slope") * F.col("t") + F.col("_intercept")))
    weekly = lined.withColumn("_by_weekday", F.avg("_left").over(Window.partitionBy(*keys, "_weekday")))
    weekly = weekly.withColumn("_left", F.col("_left") - F.col("_by_weekday"))
    monthly = weekly.withColumn("_by_month", F.avg("_left").over(Window.partitionBy(*keys, "_month")))

    def offsets(by: str, value: str, slots: range) -> Column:
        return F.array(*[F.coalesce(F.max(F.when(F.col(by) == s, F.col(value))), F.lit(0.0)) for s in slots])

    extra = [F.sum("y_test").alias("actual")] if "y_test" in training.columns else []
    return monthly.groupBy(*keys).agg(
        F.max("_slope").alias("slope"),
        F.max("_intercept").alias("intercept"),
        offsets("_weekday", "_by_weekday", range(7)).alias("weekday"),
        offsets("_month", "_by_month", range(13)).alias("month"),
        F.stddev_pop(F.col("_left") - F.col("_by_month")).alias("resid_std"),
        F.sum(used.cast("int")).alias("n"),
        F.max(F.when(used, F.col("ds"))).alias("last_date"),
        *extra,
    )


def day_ahead(i: Column) -> Column:
    """Forecast for the ``i``-th day after a model's last date."""
    day = F.date_add(F.col("last_date"), i)
    line = F.col("slope") * (F.col("n") + i - 1) + F.col("intercept")
    return at_least_zero(line + F.col("weekday")[F.weekday(day)] + F.col("month")[F.month(day)])


def project_days(models: DataFrame, horizon: int) -> DataFrame:
    """One row per model and future day."""
    days = models.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    keys = [c for c in ENTITY if c in models.columns]
    return days.select(*keys, F.expr("date_add(last_date, i)").alias("ds"), day_ahead(F.col("i")).alias("predicted"))


def with_bands(models: DataFrame, horizon: Column) -> DataFrame:
    """Total over the horizon with 80 and 95 percent bands, to the cent.

    The total is folded inside each model row, so no day rows are shuffled.
    """
    total = F.aggregate(F.sequence(F.lit(1), horizon), F.lit(0.0), lambda acc, i: acc + day_ahead(i))
    spread = F.col("resid_std") * F.sqrt(horizon.cast("double"))
    staged = models.withColumns({"horizon_days": horizon, "_total": total, "_band": spread})
    return staged.withColumns(
        {
            "predicted": F.round("_total", 2),
            "p50": F.round("_total", 2),
            "ci_lower": F.round(at_least_zero(F.col("_total") - fv.Z80 * F.col("_band")), 2),
            "ci_upper": F.round(F.col("_total") + fv.Z80 * F.col("_band"), 2),
            "p80": F.round(F.col("_total") + fv.Z80 * F.col("_band"), 2),
            "p95": F.round(F.col("_total") + fv.Z95 * F.col("_band"), 2),
        }
    ).drop("_total", "_band")


def fold_count(n: Column, horizon: int, folds: int) -> Column:
    fewer = F.greatest(F.lit(1), F.floor((n - fv.MIN_HISTORY_DAYS) / horizon) - 1)
    return F.when(n < horizon * 2 + fv.MIN_HISTORY_DAYS, fewer).otherwise(folds).cast("int")


def _fold_totals(
    series: DataFrame, keys: Sequence[str], horizon: int, folds: int, forecaster: Forecaster
) -> DataFrame:
    """Held-out and predicted totals per key and fold; a key without folds keeps one empty row.

    Daily rows are copied to the folds that train or test on them (at most
    ``folds`` times), after the facts have been aggregated.  The copies keep the
    series' hash partitioning, so fitting all folds adds no shuffle.
    """
    start = lambda fold: F.col("n") - (fold + 1) * horizon
    usable = F.filter(
        F.sequence(F.lit(0), fold_count(F.col("n"), horizon, folds) - 1), lambda f: start(f) >= fv.MIN_HISTORY_DAYS
    )
    touched = F.filter(usable, lambda f: F.col("t") < start(f) + horizon)
    copied = (
        series.withColumn("_touched", touched)
        .filter((F.size("_touched") > 0) | ((F.size(usable) == 0) & (F.col("t") == 0)))
        .select("*", F.explode_outer("_touched").alias("fold"))
    )
    trains = F.col("t") < start(F.col("fold"))
    split = copied.select(
        *keys,
        F.col("n").alias("history_days"),
        "fold",
        "ds",
        "t",
        F.when(trains, F.col("y")).alias("y"),
        F.when(~trains, F.col("y")).alias("y_test"),
    )
    return with_bands(forecaster(split, [*keys, "history_days", "fold"]), F.lit(horizon))


def backtest_folds(
    series: DataFrame,
    keys: Sequence[str] = tuple(ENTITY),
    horizon: int = 30,
    folds: int = fv.BACKTEST_FOLDS,
    forecaster: Forecaster = fit_seasonal_trend,
) -> DataFrame:
    """Walk-forward folds: actual and predicted totals of each held-out window."""
    totals = _fold_totals(series, keys, horizon, folds, forecaster).filter("actual > 0")
    return totals.select(*keys, "fold", "actual", "predicted", "ci_lower", "ci_upper")


def backtest(
    series: DataFrame,
    keys: Sequence[str] = tuple(ENTITY),
    horizon: int = 30,
    folds: int = fv.BACKTEST_FOLDS,
    forecaster: Forecaster = fit_seasonal_trend,
) -> DataFrame:
    """MAPE, RMSE, interval coverage and signed bias per entity; nulls without folds."""
    counts = F.col("actual") > 0
    miss = F.when(counts, F.col("predicted") - F.col("actual"))
    error = F.try_divide(miss, F.col("actual"))
    covered = F.when(counts, F.col("actual").between(F.col("ci_lower"), F.col("ci_upper")).cast("double"))
    return (
        _fold_totals(series, keys, horizon, folds, forecaster)
        .groupBy(*keys)
        .agg(
            F.max("history_days").alias("history_days"),
            F.avg(F.abs(error)).alias("mape"),
            F.sqrt(F.avg(miss * miss)).alias("rmse"),
            F.avg(covered).alias("coverage"),
            F.avg(error).alias("bias"),
            F.count(miss).alias("folds"),
        )
    )


def model_name() -> Column:
    return F.concat_ws("_", F.lit("collections"), "entity_type", "entity_id")


def forecast_batch(models: DataFrame, run_date: Column, horizons: Sequence[int] = tuple(fv.HORIZONS)) -> DataFrame:
    """Forecast rows of every horizon for one run date."""
    versions = F.col("version") if "version" in models.columns else F.lit(1)
    spread = models.withColumn("_h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    banded = with_bands(spread, F.col("_h"))
    return banded.select(
        *ENTITY,
        "horizon_days",
        run_date.alias("forecast_date"),
        F.date_add(run_date, F.col("horizon_days")).alias("target_date"),
        "predicted", "ci_lower", "ci_upper", "p50", "p80", "p95",
        model_name().alias("model_name"),
        versions.alias("model_version"),
    )


def latest_forecast(forecasts: DataFrame, horizon: int) -> DataFrame:
    """Newest forecast per entity for exactly one horizon."""
    rest = [c for c in forecasts.columns if c not in ENTITY]
    newest = F.max_by(F.struct(*rest), "forecast_date").alias("_row")
    return (
        forecasts.filter(F.col("horizon_days") == horizon).groupBy(*ENTITY).agg(newest).select(*ENTITY, "_row.*")
    )
