"""Shortfall detectors.  Every detector returns findings with one shared shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.operators.forecast import ENTITY
from ledgerwind.operators.thresholds import Overrides, with_thresholds
from ledgerwind.operators.timeseries import by_day

DETECTOR_ORDER = ["forecast_deviation", "cusum", "isolation_forest"]
FINDING = [*ENTITY, "metric", "detector", "expected", "actual", "deviation_pct", "severity", "score"]


def severity_below(value: Column, p1: Column, p2: Column) -> Column:
    """P1 or P2 when a value is at or below its bar, else null."""
    return F.when(value <= p1, "P1").when(value <= p2, "P2")


def last_days_total(series: DataFrame, days: int = 7) -> DataFrame:
    """Sum of each entity's last days; entities with fewer days are left out."""
    return (
        series.filter((F.col("n") >= days) & (F.col("t") >= F.col("n") - days))
        .groupBy(*ENTITY)
        .agg(F.sum("y").alias("actual"))
    )


def forecast_deviation(series: DataFrame, forecasts30: DataFrame, overrides: Overrides | None = None) -> DataFrame:
    """Last seven days against seven thirtieths of the 30-day forecast."""
    compared = (
        last_days_total(series)
        .join(forecasts30.select(*ENTITY, "predicted"), ENTITY)
        .withColumn("expected", F.col("predicted") * F.lit(7.0 / 30.0))
        .filter("expected > 0")
        .withColumn("deviation_pct", (F.col("actual") - F.col("expected")) / F.col("expected"))
    )
    judged = with_thresholds(compared, overrides).withColumn(
        "severity",
        severity_below(F.col("deviation_pct"), F.col("forecast_deviation_p1_pct"), F.col("forecast_deviation_p2_pct")),
    )
    return judged.filter("severity is not null").select(
        *ENTITY,
        F.lit("collections_7d").alias("metric"),
        F.lit("forecast_deviation").alias("detector"),
        "expected",
        "actual",
        "deviation_pct",
        "severity",
        F.lit(None).cast("double").alias("score"),
    )


def cusum_scores(series: DataFrame, overrides: Overrides | None = None) -> DataFrame:
    """Reference mean and sigma, and the deepest downward drift, per entity.

    The drift recurrence ``s = min(0, s + z + k)`` equals the running sum of
    ``z + k`` minus its running maximum (floored at zero), so it is two window
    sums instead of a loop.
    """
    window, k = F.col("cusum_window"), F.col("cusum_k")
    whole = Window.partitionBy(*ENTITY)
    aged = with_thresholds(series, overrides).withColumn("_age", F.col("n") - F.col("t"))
    aged = aged.filter(F.col("n") >= window + 10)
    before = F.when((F.col("_age") > window) & (F.col("_age") <= 2 * window), F.col("y"))
    prior = F.when(F.col("_age") > window, F.col("y"))
    enough = F.count(before).over(whole) >= 10
    referenced = aged.withColumns(
        {
            "mu": F.when(enough, F.avg(before).over(whole)).otherwise(F.avg(prior).over(whole)),
            "sigma": F.when(enough, F.stddev_samp(before).over(whole)).otherwise(F.stddev_samp(prior).over(whole)),
        }
    )
    running = by_day(ENTITY, "ds").rowsBetween(Window.unboundedPreceding, 0)
    drift = (
        referenced.filter((F.col("_age") <= window) & (F.col("sigma") > 0))
        .withColumn("_sum", F.sum((F.col("y") - F.col("mu")) / F.col("sigma") + k).over(running))
        .withColumn("_drift", F.col("_sum") - F.greatest(F.lit(0.0), F.max("_sum").over(running)))
    )
    return drift.groupBy(*ENTITY).agg(
        F.max("mu").alias("expected"),
        F.max_by("y", "ds").alias("actual"),
        F.abs(F.least(F.lit(0.0), F.min("_drift"))).alias("score"),
        F.max("cusum_p1_sigma").alias("_p1"),
        F.max("cusum_p2_sigma").alias("_p2"),
    )


def cusum(series: DataFrame, overrides: Overrides | None = None, metric: str = "collections_1d_cusum") -> DataFrame:
    scored = cusum_scores(series, overrides).withColumn(
        "severity", F.when(F.col("score") >= F.col("_p1"), "P1").when(F.col("score") >= F.col("_p2"), "P2")
    )
    return scored.filter("severity is not null").select(
        *ENTITY,
        F.lit(metric).alias("metric"),
        F.lit("cusum").alias("detector"),
        "expected",
        "actual",
        F.lit(None).cast("double").alias("deviation_pct"),
        "severity",
        "score",
    )


def facility_vectors(facility_features: DataFrame, lop_features: DataFrame) -> DataFrame:
    """Daily collections beside the weekly LOP figures, zero where there is none."""
    weekly = lop_features.select("facility_id", "event_date", "lop_turnaround_days_p50", "lop_backlog_count")
    daily = facility_features.select("facility_id", "event_date", "collections_1d")
    joined = daily.join(weekly, ["facility_id", "event_date"], "left")
    names = ["collections_1d", "lop_turnaround_days_p50", "lop_backlog_count"]
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
