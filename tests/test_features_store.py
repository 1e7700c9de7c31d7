import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv
from ledgerwind.operators import features, store
from ledgerwind.plans.queries_store import BUILDERS
from ledgerwind.sources.tables import Lake

SF = "/root/testdata/sf0.001"
DAY = dt.date(2025, 1, 1)


@pytest.mark.parametrize("group", list(BUILDERS))
def test_groups_have_exactly_their_features(spark, group):
    frame = BUILDERS[group](Lake(spark, SF))
    names = set(frame.columns) - set(fv.FEATURE_KEYS[group]) - {"event_date", "mom_growth_to_date"}
    assert names == set(fv.FEATURE_NAMES[group])
    assert not frame.isEmpty()


def paid(spark, *pairs):
    rows = [("f", DAY + dt.timedelta(days=d), float(y)) for d, y in pairs]
    return spark.createDataFrame(rows, "facility_id string, collection_date date, amount_collected double")


def test_facility_features_equal_pandas(spark):
    pairs = [(d, 10 + (d * 37) % 101) for d in range(0, 800, 3)]
    got = features.facility_collections(paid(spark, *pairs)).orderBy("event_date").toPandas()
    want = pd.Series({pd.Timestamp(DAY) + pd.Timedelta(days=d): float(y) for d, y in pairs}).asfreq("D", fill_value=0.0)
    roll30 = want.rolling(30, min_periods=1).sum()
    assert list(got.collections_7d_rolling) == pytest.approx(list(want.rolling(7, min_periods=1).sum()))
    assert list(got.collections_30d_rolling) == pytest.approx(list(roll30))
    growth = want.resample("MS").sum().pct_change()
    for i, day in enumerate(want.index):
        month = growth[pd.Timestamp(day.year, day.month, 1)]
        assert got.collections_mom_growth[i] == pytest.approx(month, nan_ok=True)
        year = roll30.get(day - pd.Timedelta(days=365))
        expected = (roll30[day] - year) / year if year and year > 0 else float("nan")
        assert got.collections_yoy_growth[i] == pytest.approx(expected, nan_ok=True)
    assert list(got.day_of_week) == list(want.index.weekday) and list(got.is_month_end) == list(want.index.day >= 28)


def test_growth_after_an_empty_month_is_null(spark):
    rows = features.facility_collections(paid(spark, (0, 5), (70, 5))).orderBy(F.desc("event_date"))
    assert rows.first().collections_mom_growth is None


def test_to_date_growth_never_looks_ahead(spark):
    short = features.facility_collections(paid(spark, *[(d, 5) for d in range(45)]))
    longer = features.facility_collections(paid(spark, *[(d, 5) for d in range(59)]))
    keep = ["event_date", "mom_growth_to_date"]
    assert short.select(*keep).exceptAll(longer.select(*keep)).isEmpty()


def test_weekly_grid_keeps_dates_without_amounts(spark):
    opened = [(dt.date(2026, 1, 1), 5.0), (dt.date(2026, 1, 5), 7.0), (dt.date(2026, 3, 30), None)]
    rows = [("s", "a", "PI", d, None, x, "open") for d, x in opened]
    schema = "settlement_id string, attorney_id string, case_type string, open_date date, close_date date, settlement_amount double, settlement_status string"
    got = features.settlement_pipeline(spark.createDataFrame(rows, schema)).orderBy("event_date").collect()
    assert len(got) == 13 and got[-1].event_date == dt.date(2026, 3, 26) and got[-1].high_value_open_count == 0


def test_aging_migration_lags_four_rows(spark):
    rows = [("a", "f", *[10.0] * 4, float(10 * i), DAY + dt.timedelta(days=7 * i)) for i in range(6)]
    schema = "attorney_id string, facility_id string, " + ", ".join(f"{b} double" for b in fv.AGING_BUCKETS) + ", report_date date"
    got = features.attorney_aging(spark.createDataFrame(rows, schema)).orderBy("event_date").collect()
    assert [r.aging_migration_rate_30d for r in got[:4]] == [None] * 4
    assert got[4].aging_migration_rate_30d == pytest.approx(got[4].pct_180_plus - got[0].pct_180_plus)


def test_empty_aging_total_is_zero(spark):
    schema = "attorney_id string, facility_id string, " + ", ".join(f"{b} double" for b in fv.AGING_BUCKETS) + ", report_date date"
    row = features.attorney_aging(spark.createDataFrame([("a", "f", *[0.0] * 5, DAY)], schema)).first()
    assert row.pct_180_plus == 0.0 and row.avg_days_outstanding == 0.0


def test_store_round_trip_freshness_and_overwrite(spark, tmp_path):
    lop = BUILDERS["lop_metrics"](Lake(spark, SF))
    stamp = F.to_timestamp(F.lit("2026-05-28 03:00:00"))
    for _ in range(2):
        store.write_group(store.to_rows(lop, "lop_metrics", stamp), str(tmp_path))
    aging = BUILDERS["attorney_aging"](Lake(spark, SF))
    store.write_group(store.to_rows(aging, "attorney_aging", stamp), str(tmp_path))
    rows = store.read_rows(spark, str(tmp_path))
    fresh = {r.feature_group: r.row_count for r in store.freshness(rows).collect()}
    assert fresh == {"lop_metrics": lop.count(), "attorney_aging": aging.count()}
    back = store.from_rows(rows, "lop_metrics", lop.schema)
    want = lop.withColumnRenamed("facility_id", "entity_key").select(*back.columns)
    assert back.exceptAll(want).isEmpty()
    assert store.stale_groups(store.freshness(rows), F.to_date(F.lit("2026-05-28"))).isEmpty()
    assert store.stale_groups(store.freshness(rows), F.to_date(F.lit("2026-05-29"))).count() == 2


def test_history_stops_at_the_date(spark):
    frame = features.facility_collections(paid(spark, *[(d, 5) for d in range(40)]))
    rows = store.history(frame, {"facility_id": "f"}, "2025-01-10").collect()
    assert [r.event_date.day for r in rows] == list(range(1, 11))


def test_latest_per_key(spark):
    rows = [("alice", dt.date(2026, 1, 1), -0.30), ("alice", dt.date(2026, 2, 1), -0.40), ("bob", dt.date(2026, 1, 1), -0.05)]
    frame = spark.createDataFrame(rows, "k string, event_date date, v double")
    assert {r.k: r.v for r in store.latest(frame, ["k"]).collect()} == {"alice": -0.40, "bob": -0.05}


def test_as_of_join(spark):
    known = spark.createDataFrame([("a", DAY, 1), ("a", DAY + dt.timedelta(days=5), 2), ("b", DAY, 9)], "k string, event_date date, v int")
    asked = [("a", DAY + dt.timedelta(days=d)) for d in (-1, 0, 4, 5, 9)] + [("c", DAY)]
    spine = spark.createDataFrame(asked, "k string, at date")
    got = store.as_of_join(spine, known, ["k"], "at").orderBy("k", "at").collect()
    assert [r.v for r in got] == [None, 1, 1, 2, 2, None]


def test_as_of_join_equals_brute_force_with_a_hot_entity(spark):
    known = [(k, DAY + dt.timedelta(days=d), float(d)) for k, days in (("hot", range(0, 400, 7)), ("b", (3, 390)), (None, (5,))) for d in days]
    known.append(("hot", None, -1.0))
    asked = [(i, "hot", DAY + dt.timedelta(days=i % 450 - 20)) for i in range(6000)]
    asked += [(6000 + i, k, DAY + dt.timedelta(days=i)) for i, k in enumerate(["b", None, "c"] * 130)]
    asked += [(7000, "hot", None), (7001, "b", DAY + dt.timedelta(days=3)), (7001, "b", DAY + dt.timedelta(days=3))]
    spine = spark.createDataFrame(asked, "id int, k string, at date")
    features = spark.createDataFrame(known, "k string, event_date date, v double")
    got = store.as_of_join(spine, features, ["k"], "at").collect()

    def newest(k, at):
        found = [(d, v) for key, d, v in known if at and d and key == k and d <= at]
        return max(found, default=(None, None))

    order = lambda r: (r[0], str(r))
    assert sorted([tuple(r) for r in got], key=order) == sorted([(i, k, at, *newest(k, at)) for i, k, at in asked], key=order)
    empty = store.as_of_join(spine.limit(0), features, ["k"], "at")
    assert empty.collect() == [] and empty.columns == ["id", "k", "at", "feature_date", "v"]
    assert {r.v for r in store.as_of_join(spine, features.limit(0), ["k"], "at").collect()} == {None}


def test_as_of_join_spreads_one_entity_on_one_day(spark):
    spine = spark.range(20000).selectExpr("id", "'hot' k", "date'2025-03-01' at").repartition(8)
    features = spark.createDataFrame([("hot", DAY, 1.0)], "k string, event_date date, v double")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(old, ("-1", "false")):
            spark.conf.set(c, v)
        known = store.as_of_join(spine, features, ["k"], "at", spread=64)
        sizes = [r["count"] for r in known.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 20000 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
