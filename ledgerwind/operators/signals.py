"""The six-signal vector of a facility and day, from feeds of different grain and key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = [
    "collections_1d", "new_visits_7d", "settlement_velocity_change_30d",
    "lop_turnaround_days_p50", "pct_180_plus", "collections_vs_forecast_delta",
]


def merge_as_of(spine: DataFrame, feeds: Sequence[DataFrame], key: str, day: str) -> DataFrame:
    """``spine`` with the columns of every feed's newest row at or before its day.

    All feeds are laid into one frame and sorted once per key; a feed's row is carried as a
    struct, so a null in its newest row is a null and not the value before it.  Each feed
    has one row per key and day; columns of different feeds have different names.
    """
    carried = [[c for c in feed.columns if c not in (key, day)] for feed in feeds]
    names = [f"_feed{i}" for i in range(len(feeds))]
    rows = [spine.withColumn("_spine", F.lit(1))]
    for name, feed, columns in zip(names, feeds, carried, strict=True):
        rows.append(feed.select(key, day, F.struct(*columns).alias(name), F.lit(0).alias("_spine")))
    laid = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    order = Window.partitionBy(key).orderBy(day, "_spine").rowsBetween(Window.unboundedPreceding, 0)
    newest = laid.withColumns({name: F.last(name, ignorenulls=True).over(order) for name in names}).filter("_spine = 1")
    return newest.select(*spine.columns, *[F.col(f"{n}.{c}").alias(c) for n, columns in zip(names, carried, strict=True) for c in columns])


def visits_by_facility(visit_features: DataFrame) -> DataFrame:
    """New visits of the last seven days over all case types."""
    return visit_features.groupBy("facility_id", "event_date").agg(F.sum("new_visits_7d").alias("new_visits_7d"))


def velocity_by_facility(settlement_features: DataFrame, homes: DataFrame) -> DataFrame:
    """Mean change of settlement velocity over the attorneys and case types of a facility; ``homes`` name it per attorney."""
    placed = settlement_features.join(homes, "attorney_id")
    return placed.groupBy("facility_id", "event_date").agg(F.avg("settlement_velocity_change_30d").alias("settlement_velocity_change_30d"))


def old_share_by_facility(aging_features: DataFrame, homes: DataFrame) -> DataFrame:
    """Share of the balance of all attorneys of a facility that is older than 180 days."""
    summed = aging_features.join(homes, "attorney_id").groupBy("facility_id", "event_date").agg(
        F.sum("bucket_180_plus_balance").alias("_old"), F.sum("total_outstanding").alias("_all")
    )
    share = F.when(F.col("_all") > 0, F.col("_old") / F.col("_all")).otherwise(0.0)
    return summed.select("facility_id", "event_date", share.alias("pct_180_plus"))


def six_signals(
    daily: DataFrame, visit_features: DataFrame, settlement_features: DataFrame, lop_features: DataFrame, aging_features: DataFrame,
    forecast_delta: DataFrame, homes: DataFrame,
) -> DataFrame:
    """One row per facility and day with ``SIGNALS``; zero where a signal has nothing yet.

    ``daily`` is the dense series of collections and ``forecast_delta`` has the days whose
    forecast is known; ``homes`` (attorney_id, facility_id) has one row per attorney.
    """
    feeds = [
        visits_by_facility(visit_features),
        velocity_by_facility(settlement_features, homes),
        lop_features.select("facility_id", "event_date", "lop_turnaround_days_p50"),
        old_share_by_facility(aging_features, homes),
        forecast_delta.select("facility_id", "event_date", "collections_vs_forecast_delta"),
    ]
    merged = merge_as_of(daily.select("facility_id", "event_date", "collections_1d"), feeds, "facility_id", "event_date")
    return merged.select("facility_id", "event_date", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SIGNALS])
