"""Monitoring tables: drift, comparisons, control limits, review and retention.

These are described requirements rather than existing behaviour; all are plain
grouped or framed aggregates over frames the other modules produce.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.functions.numeric import student_two_sided
from ledgerwind.operators import forecast as fc
from ledgerwind.operators.timeseries import by_day

# --- fixed values: alert bars and retention periods ----------------------------
PSI_BAR = 0.2
MAPE_DRIFT_BAR = 0.05
REVISION_BAR = 0.10
MAPE_FLAG = 0.20
AB_MINIMUM_DAYS = 14
RETENTION_MONTHS = {"raw": 24, "features": 36, "query_log": 12, "audit": 84}
AB_LEVEL = 0.05
DISMISSED_P1_BAR = 0.15
EMPTY_BIN = 1e-4


def stability_index(values: DataFrame, keys: Sequence[str], baseline: str, bins: int = 10) -> DataFrame:
    """Population stability index of ``value`` rows against rows flagged ``baseline``.

    Bins are the baseline's quantiles.  Only one row per key and bin is shuffled
    after binning.
    """
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = values.filter(baseline).groupBy(*keys).agg(F.percentile("value", cuts).alias("edges"))
    bucket = F.size(F.filter("edges", lambda e: e < F.col("value")))
    binned = values.join(edges, list(keys)).withColumn("bin", bucket)
    counts = binned.groupBy(*keys, "bin").agg(
        F.sum(F.col(baseline).cast("bigint")).alias("before"), F.sum((~F.col(baseline)).cast("bigint")).alias("after")
    )
    whole = Window.partitionBy(*keys)
    share = lambda c: F.greatest(F.try_divide(F.col(c), F.sum(c).over(whole)), F.lit(EMPTY_BIN))
    shares = counts.select(*keys, share("before").alias("p"), share("after").alias("q"))
    return shares.groupBy(*keys).agg(
        F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"),
        F.sum(F.col("q") * F.log(F.col("q") / F.col("p"))).alias("kl"),
    )


def daily_errors(series: DataFrame, days: int = 30) -> DataFrame:
    """Actual, forecast and naive value of each of the last ``days`` days.

    The model has seen nothing of those days; the naive value is the mean of the
    thirty days before them.
    """
    cut = F.col("n") - days
    before = series.filter(F.col("t") < cut)
    models = fc.fit_seasonal_trend(before, fc.ENTITY)
    naive = series.filter((F.col("t") < cut) & (F.col("t") >= cut - 30)).groupBy(*fc.ENTITY).agg(F.avg("y").alias("naive"))
    held_out = series.filter(F.col("t") >= cut).select(*fc.ENTITY, "ds", F.col("y").alias("actual"))
    return held_out.join(fc.project_days(models, days), [*fc.ENTITY, "ds"]).join(naive, fc.ENTITY)


def forecast_delta(errors: DataFrame) -> DataFrame:
    """Daily ``(actual - forecast) / forecast``; null where nothing was forecast."""
    delta = F.when(F.col("predicted") > 0, (F.col("actual") - F.col("predicted")) / F.col("predicted"))
    return errors.select(*fc.ENTITY, "ds", "actual", "predicted", delta.alias("collections_vs_forecast_delta"))


def error_drift(errors: DataFrame, recent: int = 7) -> DataFrame:
    """Mean absolute percentage error of the last days against the whole window."""
    ape = F.when(F.col("actual") > 0, F.abs(F.col("predicted") - F.col("actual")) / F.col("actual"))
    last = F.max("ds").over(Window.partitionBy(*fc.ENTITY))
    rows = errors.withColumns({"ape": ape, "_recent": F.datediff(last, "ds") < recent})
    return rows.groupBy(*fc.ENTITY).agg(
        F.avg("ape").alias("mape_all"), F.avg(F.when(F.col("_recent"), F.col("ape"))).alias("mape_recent")
    ).withColumn("drifting", F.coalesce(F.col("mape_recent") - F.col("mape_all") > MAPE_DRIFT_BAR, F.lit(False)))


def compare_models(errors: DataFrame) -> DataFrame:
    """Welch's t-test of the naive forecast (challenger) against the model (champion).

    The challenger wins with a lower mean error over enough days, if a difference as large
    would be rarer than ``AB_LEVEL`` by chance (two-sided).
    """
    ape = lambda c: F.when(F.col("actual") > 0, F.abs(F.col(c) - F.col("actual")) / F.col("actual"))
    stats = errors.withColumns({"_a": ape("predicted"), "_b": ape("naive")}).groupBy(*fc.ENTITY).agg(
        F.count("_a").alias("days"),
        F.avg("_a").alias("champion_mape"), F.avg("_b").alias("challenger_mape"),
        (F.var_samp("_a") / F.count("_a")).alias("_va"), (F.var_samp("_b") / F.count("_b")).alias("_vb"),
    )
    spread = F.col("_va") + F.col("_vb")
    t = F.when(spread > 0, (F.col("challenger_mape") - F.col("champion_mape")) / F.sqrt(spread))
    freedom = F.when(spread > 0, spread * spread / ((F.col("_va") ** 2 + F.col("_vb") ** 2) / (F.col("days") - 1)))
    tested = student_two_sided(stats.withColumns({"t": t, "freedom": freedom}), "t", "freedom", "p_value")
    wins = (F.col("days") >= AB_MINIMUM_DAYS) & (F.col("t") < 0) & (F.col("p_value") < AB_LEVEL)
    return tested.withColumn("challenger_wins", F.coalesce(wins, F.lit(False))).drop("_va", "_vb")


def alert_outcomes(alerts: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Share of each month's alerts that were acknowledged and that were dismissed as false, by severity.

    ``dismissals`` name alerts by ``alert_id``, once or more.  P1 alerts are over the target
    if a larger share of them was dismissed than ``DISMISSED_P1_BAR``.
    """
    dismissed = dismissals.select(F.col("alert_id").alias("_id")).distinct()
    rows = alerts.join(dismissed, alerts["alert_id"] == F.col("_id"), "left").select(
        F.trunc("created_at", "month").alias("month"), "severity",
        (F.col("status") == "acknowledged").cast("double").alias("_acknowledged"), F.col("_id").isNotNull().cast("double").alias("_dismissed"),
    )
    rates = rows.groupBy("month", "severity").agg(
        F.count("*").alias("alerts"), F.avg("_acknowledged").alias("acknowledged_rate"), F.avg("_dismissed").alias("dismissed_rate")
    )
    over = (F.col("severity") == "P1") & (F.col("dismissed_rate") > DISMISSED_P1_BAR)
    return rates.withColumn("over_target", F.coalesce(over, F.lit(False)))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change of the 30-day outlook between two forecasts of an entity."""
    joined = old.select(*fc.ENTITY, F.col("predicted").alias("before")).join(new.select(*fc.ENTITY, F.col("predicted").alias("after")), fc.ENTITY)
    change = F.when(F.col("before") > 0, (F.col("after") - F.col("before")) / F.col("before"))
    return joined.withColumn("change", change).withColumn("notify", F.coalesce(F.abs("change") > REVISION_BAR, F.lit(False)))


def control_limits(series: DataFrame, days: int = 90, sigmas: float = 3.0) -> DataFrame:
    """Shewhart limits from the preceding days; rows outside them."""
    before = by_day(fc.ENTITY, "ds").rowsBetween(-days, -1)
    charted = series.withColumns(
        {"center": F.avg("y").over(before), "_sigma": F.stddev_samp("y").over(before), "_k": F.count("*").over(before)}
    )
    low, high = F.col("center") - sigmas * F.col("_sigma"), F.col("center") + sigmas * F.col("_sigma")
    outside = (F.col("_k") == days) & ((F.col("y") < low) | (F.col("y") > high))
    return charted.filter(outside).select(*fc.ENTITY, "ds", "y", "center", low.alias("lower"), high.alias("upper"))


def lag_features(facility: DataFrame) -> DataFrame:
    """Lagged weekly totals, quarter and the mean of everything before the day."""
    order = by_day(["facility_id"], "event_date")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    # settled before dividing, so the mean does not depend on summation order
    encoding = F.try_divide(F.round(F.sum("collections_1d").over(past), 4), F.count("collections_1d").over(past))
    lags = {f"collections_rolling_7d_lag{k}": F.lag("collections_7d_rolling", k).over(order) for k in (1, 2, 4)}
    return facility.select("facility_id", "event_date", *[c.alias(n) for n, c in lags.items()], F.quarter("event_date").alias("quarter"), encoding.alias("facility_encoding"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, relation: str) -> DataFrame:
    """How many child rows name no parent."""
    known = parent.select(F.col(parent_key).alias(key))
    return child.select(key).join(known, key, "left_anti").agg(F.count("*").alias("orphan_rows")).select(F.lit(relation).alias("relation"), "orphan_rows")


def digest(combined: DataFrame) -> DataFrame:
    """The lower-priority findings of the day, one line per severity and type."""
    return combined.filter("severity in ('P2', 'P3')").groupBy("severity", "entity_type").agg(
        F.count("*").alias("alerts"), F.array_join(F.sort_array(F.collect_set("entity_id")), ", ").alias("entities")
    )


def frequent_questions(log: DataFrame, top: int = 20) -> DataFrame:
    """Most asked questions with their statement count and rows returned."""
    grouped = log.groupBy("question").agg(F.count("*").alias("asked"), F.sum("row_count").alias("rows_returned"), F.max("asked_on").alias("last_asked"))
    return grouped.withColumn("query_hash", F.sha2("question", 256)).orderBy(F.desc("asked"), "query_hash").limit(top)


def retained(rows: DataFrame, day: str, kind: str, as_of: Column) -> DataFrame:
    """Total and still-retained row counts of one data type."""
    kept = F.col(day) >= F.add_months(as_of, -RETENTION_MONTHS[kind])
    return rows.agg(F.count("*").alias("total_rows"), F.count(F.when(kept, True)).alias("kept_rows")).select(F.lit(kind).alias("data_type"), "total_rows", "kept_rows")


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """Totals by entity type and horizon with their subtotals."""
    return forecasts.rollup("entity_type", "horizon_days").agg(F.count("*").alias("entities"), F.sum("predicted").alias("predicted"))


def detector_quality(entities: DataFrame, flagged: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and false-positive rate of flagged against true entities."""
    marked = (
        entities.join(flagged.select(*fc.ENTITY, F.lit(True).alias("f")).distinct(), fc.ENTITY, "left")
        .join(truth.select(*fc.ENTITY, F.lit(True).alias("t")).distinct(), fc.ENTITY, "left")
        .na.fill(False, ["f", "t"])
    )
    count = lambda c: F.count(F.when(c, True))
    f, t = F.col("f"), F.col("t")
    return marked.agg(
        F.try_divide(count(f & t), count(f)).alias("precision"), F.try_divide(count(f & t), count(t)).alias("recall"),
        F.try_divide(count(f & ~t), count(~t)).alias("false_positive_rate"),
    )
