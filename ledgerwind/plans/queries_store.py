"""Registered queries: latest rows, point-in-time history, freshness, JSON round trip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv
from ledgerwind.functions.numeric import rounded
from ledgerwind.operators import store
from ledgerwind.plans import queries_features as qf
from ledgerwind.plans.catalog import register
from ledgerwind.sources import business
from ledgerwind.sources.tables import Lake

BUILDERS = {
    "facility_collections": qf.facility_features,
    "attorney_aging": qf.aging_features,
    "visit_velocity": qf.visit_features,
    "settlement_pipeline": qf.settlement_features,
    "lop_metrics": qf.lop_features,
}


def rows_of_all_groups(lake: Lake) -> DataFrame:
    stamp = F.to_timestamp(F.lit("2002-01-01 03:00:00"))
    return reduce(DataFrame.unionByName, [store.to_rows(build(lake), group, stamp) for group, build in BUILDERS.items()])


COUNTS = {
    "facility_collections": "facility_features_v",
    "attorney_aging": "attorney_features_v",
    "visit_velocity": "visit_features_v",
    "settlement_pipeline": "settlement_features_v",
    "lop_metrics": "lop_features_v",
}


@register(
    "feature_freshness",
    "SELECT feature_group, DATE '2002-01-01' AS last_updated, row_count, true AS stale FROM ("
    + " UNION ALL ".join(f"SELECT '{g}' AS feature_group, count(*) AS row_count FROM {v}" for g, v in COUNTS.items())
    + ")",
)
def _freshness(lake: Lake) -> DataFrame:
    fresh = store.freshness(rows_of_all_groups(lake))
    stale = F.to_date("last_updated") != F.to_date(F.lit("2002-01-02"))
    return fresh.select("feature_group", F.to_date("last_updated").alias("last_updated"), "row_count", stale.alias("stale"))


@register(
    "latest_features",
    """SELECT facility_id, event_date, round(collections_7d_rolling, 4) AS collections_7d_rolling,
              round(collections_yoy_growth, 6) AS collections_yoy_growth, is_month_end
       FROM facility_features_v f WHERE event_date = (SELECT max(event_date) FROM facility_features_v g WHERE g.facility_id = f.facility_id)""",
)
def _latest(lake: Lake) -> DataFrame:
    rows = store.latest(qf.facility_features(lake), ["facility_id"])
    return rounded(
        rows.select("facility_id", "event_date", "collections_7d_rolling", "collections_yoy_growth", "is_month_end"),
        {"collections_7d_rolling": 4, "collections_yoy_growth": 6},
    )


@register(
    "latest_settlement_features",
    """SELECT attorney_id, case_type, event_date, open_settlements_count, round(settlement_velocity_change_30d, 6) AS settlement_velocity_change_30d
       FROM settlement_features_v f WHERE event_date = (SELECT max(event_date) FROM settlement_features_v g
            WHERE g.attorney_id = f.attorney_id AND g.case_type = f.case_type)""",
)
def _latest_settlements(lake: Lake) -> DataFrame:
    rows = store.latest(qf.settlement_features(lake), ["attorney_id", "case_type"])
    return rounded(
        rows.select("attorney_id", "case_type", "event_date", "open_settlements_count", "settlement_velocity_change_30d"),
        {"settlement_velocity_change_30d": 6},
    )


@register(
    "point_in_time_features",
    """SELECT s.visit_id, s.facility_id, s.visit_date, f.event_date AS feature_date, round(f.y30, 4) AS collections_30d_rolling
       FROM visits_v s ASOF LEFT JOIN (SELECT facility_id, d AS event_date, y30 FROM facility_roll_v) f
         ON f.facility_id = s.facility_id AND s.visit_date >= f.event_date""",
)
def _point_in_time(lake: Lake) -> DataFrame:
    visits = business.visits(lake, "visit_id", "facility_id", "visit_date")
    features = qf.facility_features(lake).select("facility_id", "event_date", "collections_30d_rolling")
    known = store.as_of_join(visits, features, ["facility_id"], "visit_date")
    return rounded(known, {"collections_30d_rolling": 4})


@register(
    "aging_as_of_visits",
    """SELECT s.attorney_id, s.d AS close_date, f.event_date AS feature_date, round(f.total, 2) AS total_outstanding
       FROM (SELECT DISTINCT attorney_id, close_date AS d FROM settlements_v WHERE close_date IS NOT NULL) s
       ASOF LEFT JOIN aging_features_v f ON f.attorney_id = s.attorney_id AND s.d >= f.event_date""",
)
def _aging_as_of(lake: Lake) -> DataFrame:
    spine = business.settlements(lake, "attorney_id", "close_date").filter("close_date is not null").distinct()
    features = qf.aging_features(lake).select("attorney_id", "event_date", "total_outstanding")
    return rounded(store.as_of_join(spine, features, ["attorney_id"], "close_date"), {"total_outstanding": 2})


@register(
    "feature_json_round_trip",
    """SELECT facility_id AS entity_key, event_date, lop_issued_7d, lop_returned_7d, round(lop_rejection_rate_30d, 6) AS lop_rejection_rate_30d,
              round(lop_turnaround_days_p50, 4) AS lop_turnaround_days_p50, round(lop_turnaround_days_p90, 4) AS lop_turnaround_days_p90,
              lop_backlog_count FROM lop_features_v""",
)
def _round_trip(lake: Lake) -> DataFrame:
    features = qf.lop_features(lake)
    rows = store.to_rows(features, "lop_metrics", F.lit(None).cast("timestamp"))
    return rounded(
        store.from_rows(rows, "lop_metrics", features.schema),
        {"lop_rejection_rate_30d": 6, "lop_turnaround_days_p50": 4, "lop_turnaround_days_p90": 4},
    )


@register(
    "feature_rows",
    "SELECT feature_group, entity_key, event_date FROM ("
    + " UNION ALL ".join(
        f"SELECT '{g}' AS feature_group, concat_ws('|', {', '.join(fv.FEATURE_KEYS[g])}) AS entity_key, event_date FROM {v}"
        for g, v in COUNTS.items()
    )
    + ")",
)
def _rows(lake: Lake) -> DataFrame:
    return rows_of_all_groups(lake).select("feature_group", "entity_key", "event_date")
