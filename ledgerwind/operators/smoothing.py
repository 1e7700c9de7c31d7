"""Exponential smoothing as a second forecaster, and the choice among model types.

The level follows ``l[0] = x[0]``, ``l[t] = (1 - a) l[t-1] + a x[t]`` on the series without its
weekday offsets.  A step is an affine map of the level, and maps compose: the days of a
block are composed by one running sum, the blocks before it by a fold over one map per
block.  So there is no loop over days, and every level of every key and fold comes from
windows on the partitioning that the series has already.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.operators import forecast as fc

ALPHA = 0.1
BLOCK_DAYS = 64  # 1 / (1 - a) to this power must stay well inside a double
SELECTION_FOLDS = 3  # of 30 days: the last 90
LEAST_COVERAGE = 0.75


def with_levels(training: DataFrame, keys: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """Rows ``(keys, ds, t, x)`` with ``level`` after and ``level_before`` that day; ``t`` counts from 0 without gaps.

    Days whose ``x`` is null come last and leave the level alone.
    """
    keep = 1.0 - alpha
    whole = Window.partitionBy(*keys)
    block, inside = F.floor(F.col("t") / BLOCK_DAYS), F.pmod(F.col("t"), F.lit(BLOCK_DAYS)).cast("double")
    part = Window.partitionBy(*keys, "_block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = training.withColumns({"_block": block, "_inside": inside})
    own = F.when(F.col("t") == 0, F.col("x")).otherwise(alpha * F.col("x")) / F.pow(F.lit(keep), "_inside")
    rows = rows.withColumn("_part", F.sum(own).over(part) * F.pow(F.lit(keep), "_inside"))
    # one affine map per full block, in order: (share of the level before that stays, what is added)
    closes = F.col("_inside") == BLOCK_DAYS - 1
    maps = F.collect_list(F.when(closes, F.col("_part"))).over(whole.orderBy("_block").rangeBetween(Window.unboundedPreceding, -1))
    carried = F.aggregate(maps, F.lit(0.0), lambda level, added: level * keep**BLOCK_DAYS + added)
    rows = rows.withColumn("level", F.col("_part") + carried * F.pow(F.lit(keep), F.col("_inside") + 1))
    before = F.lag("level").over(whole.orderBy("t"))
    return rows.withColumn("level_before", before).drop("_block", "_inside", "_part")


def fit_smoothed(training: DataFrame, keys: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """One model row per key, in the layout of the seasonal trend: the last level is the line.

    Weekday offsets are the weekday's mean less the mean; the spread is that of the errors
    one day ahead.
    """
    used = F.col("y").isNotNull()
    by_weekday = Window.partitionBy(*keys, "_weekday")
    lined = training.withColumn("_weekday", F.weekday("ds"))
    lined = lined.withColumn("_off", F.avg("y").over(by_weekday) - F.avg("y").over(Window.partitionBy(*keys)))
    levels = with_levels(lined.withColumn("x", F.col("y") - F.col("_off")), keys, alpha)
    slots = F.array(*[F.coalesce(F.max(F.when(F.col("_weekday") == s, F.col("_off"))), F.lit(0.0)) for s in range(7)])
    extra = [F.sum("y_test").alias("actual")] if "y_test" in training.columns else []
    return levels.groupBy(*keys).agg(
        F.lit(0.0).alias("slope"),
        F.max_by("level", F.when(used, F.col("t"))).alias("intercept"),
        slots.alias("weekday"),
        F.array_repeat(F.lit(0.0), 13).alias("month"),
        F.stddev_pop(F.when(used, F.col("x") - F.col("level_before"))).alias("resid_std"),
        F.sum(used.cast("int")).alias("n"),
        F.max(F.when(used, F.col("ds"))).alias("last_date"),
        *extra,
    )


CANDIDATES: Mapping[str, fc.Forecaster] = {"exponential_smoothing": partial(fit_smoothed, alpha=ALPHA), "seasonal_trend": fc.fit_seasonal_trend}


def measure_models(series: DataFrame, candidates: Mapping[str, fc.Forecaster] = CANDIDATES, folds: int = SELECTION_FOLDS) -> DataFrame:
    """Backtest metrics of every entity under every model type."""
    measured = [fc.backtest(series, folds=folds, forecaster=f).withColumn("model_type", F.lit(name)) for name, f in candidates.items()]
    return reduce(DataFrame.unionByName, measured)


def select_model(metrics: DataFrame, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """One row per model type; the champion has the least mean MAPE among those whose coverage suffices.

    Entities without folds count for no type; ties go to the first name.  Without an
    eligible type there is no champion.
    """
    types = metrics.groupBy("model_type").agg(
        F.count("mape").alias("entities"), F.avg("mape").alias("mean_mape"), F.avg("rmse").alias("mean_rmse"), F.avg("coverage").alias("mean_coverage")
    )
    types = types.withColumn("eligible", F.coalesce(F.col("mean_coverage") >= least_coverage, F.lit(False)))
    # as many rows as there are model types
    place = F.row_number().over(Window.partitionBy("eligible").orderBy(F.col("mean_mape").asc_nulls_last(), "model_type"))
    return types.withColumn("champion", F.col("eligible") & (place == 1) & F.col("mean_mape").isNotNull())
