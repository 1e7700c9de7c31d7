"""Feature store: long rows, freshness, latest rows and point-in-time history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwind import fixed_values as fv
from ledgerwind.operators.alerts import latest_per_key
from ledgerwind.sources.snapshots import write_partitions


def to_rows(features: DataFrame, group: str, computed_at: Column) -> DataFrame:
    """Typed features as ``(feature_group, entity_key, event_date, features_json)``."""
    names = fv.FEATURE_NAMES[group]
    return features.select(
        F.lit(group).alias("feature_group"),
        F.concat_ws("|", *fv.FEATURE_KEYS[group]).alias("entity_key"),
        "event_date",
        F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("features_json"),
        computed_at.alias("computed_at"),
    )


def from_rows(rows: DataFrame, group: str, schema: T.StructType) -> DataFrame:
    """Typed features back from stored rows of one group."""
    names = fv.FEATURE_NAMES[group]
    parsed = rows.filter(F.col("feature_group") == group).withColumn(
        "_f", F.from_json("features_json", T.StructType([schema[n] for n in names]))
    )
    return parsed.select("entity_key", "event_date", *[F.col(f"_f.{n}").alias(n) for n in names])


def write_group(rows: DataFrame, root: str) -> None:
    """Replace the stored rows of the groups in the frame, leaving other groups."""
    write_partitions(rows, f"{root}/feature_values", "feature_group")


def read_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/feature_values")


def freshness(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature_group").agg(
        F.max("computed_at").alias("last_updated"), F.count("*").alias("row_count")
    )


def stale_groups(fresh: DataFrame, as_of: Column) -> DataFrame:
    """Groups whose last update was not on the given (UTC) date."""
    return fresh.filter(F.to_date("last_updated") != as_of)


def latest(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    return latest_per_key(features, list(keys), "event_date")


def history(features: DataFrame, keys: dict[str, str], as_of: str | None = None) -> DataFrame:
    """One entity's rows up to a date, in order."""
    rows = features
    for column, value in keys.items():
        rows = rows.filter(F.col(column) == value)
    if as_of is not None:
        rows = rows.filter(F.col("event_date") <= F.lit(as_of).cast("date"))
    return rows.orderBy("event_date")


def as_of_join(spine: DataFrame, features: DataFrame, keys: Sequence[str], at: str, days: int = 32, spread: int = 8) -> DataFrame:
    """Newest feature row at or before each spine date, for all entities at once.

    The raw spine is never sorted.  Its different dates are stacked on the features in
    buckets of ``days`` days, so that a long or hot entity splits over its buckets; the
    last feature of each bucket is carried on by a prefix over one row per entity and
    bucket.  The spine then looks its dates up by an equi-join that deals one entity and
    date to ``spread`` places.

    A spine row without any feature up to its date, or without a date, keeps nulls;
    features without a date are never found.  Keys that are null are equal.  Repeated
    spine rows stay; of features of one entity and date one is taken.
    """
    values = [c for c in features.columns if c not in keys and c != "event_date"]
    carried = F.struct("event_date", *values)
    kind = features.select(carried.alias("c")).schema["c"].dataType
    asked = spine.select(*keys, F.col(at).alias("_at")).filter("_at is not null").distinct()
    known = features.filter("event_date is not null").select(*keys, F.col("event_date").alias("_at"), F.lit(0).alias("_side"), carried.alias("_carried"))
    stacked = known.unionByName(asked.select(*keys, "_at", F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_carried")))
    bucketed = stacked.withColumn("_bucket", F.floor(F.unix_date(F.to_date("_at")) / days))
    # features sort before spine dates of the same day, so "at" is inclusive
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    here = bucketed.withColumn("_carried", F.last("_carried", ignorenulls=True).over(inside))
    ends = here.groupBy(*keys, "_bucket").agg(F.max_by("_carried", F.struct("_at", "_side")).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    found = here.filter("_side = 1").alias("h").join(before.alias("b"), _same([*keys, "_bucket"], "h", "b"), "left")
    answers = found.select(*[f"h.{k}" for k in keys], "h._at", F.coalesce("h._carried", "b._before").alias("_carried"))
    places = answers.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    dealt = spine.select("*", F.col(at).alias("_at"), F.pmod(F.xxhash64(*spine.columns), F.lit(spread)).cast("int").alias("_place"))
    joined = dealt.alias("s").join(places.alias("p"), _same([*keys, "_at", "_place"], "s", "p"), "left")
    taken = [F.col("p._carried.event_date").alias("feature_date"), *[F.col(f"p._carried.{v}").alias(v) for v in values]]
    return joined.select(*[f"s.{c}" for c in spine.columns], *taken)


def _same(columns: Sequence[str], left: str, right: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])
