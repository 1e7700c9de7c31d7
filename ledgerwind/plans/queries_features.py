"""Registered queries: daily totals, rolling frames and the feature groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv
from ledgerwind.functions.numeric import rounded
from ledgerwind.operators import features as ft
from ledgerwind.operators.timeseries import densify, rolling_sum
from ledgerwind.plans.catalog import register
from ledgerwind.plans.oracle_views import VIEWS, view
from ledgerwind.sources import business
from ledgerwind.sources.tables import Lake

FACILITY = ("facility_id", "collection_date", "amount_collected")


def facility_features(lake: Lake) -> DataFrame:
    return ft.facility_collections(business.collections(lake, *FACILITY))


@register("daily_collections", "SELECT facility_id, d AS event_date, round(y, 4) AS collections_1d FROM facility_dense_v")
def _daily(lake: Lake) -> DataFrame:
    daily = ft.daily_collections(business.collections(lake, *FACILITY), ["facility_id"])
    dense = densify(daily, ["facility_id"], "event_date", ["collections_1d"])
    return rounded(dense, {"collections_1d": 4})


@register(
    "rolling_7_30",
    """SELECT facility_id, d AS event_date, round(y7, 4) AS collections_7d_rolling,
              round(y30, 4) AS collections_30d_rolling FROM facility_roll_v""",
)
def _rolling(lake: Lake) -> DataFrame:
    keys = ["facility_id"]
    daily = ft.daily_collections(business.collections(lake, *FACILITY), keys)
    dense = densify(daily, keys, "event_date", ["collections_1d"])
    return dense.select(
        *keys,
        "event_date",
        F.round(rolling_sum("collections_1d", keys, "event_date", 7), 4).alias("collections_7d_rolling"),
        F.round(rolling_sum("collections_1d", keys, "event_date", 30), 4).alias("collections_30d_rolling"),
    )


@register(
    "month_growth",
    """SELECT t.facility_id, CAST(t.m AS DATE) AS month_start, round(t.total, 4) AS month_total,
              round(CASE WHEN p.total > 0 THEN (t.total - p.total) / p.total END, 6) AS mom_growth
       FROM (SELECT facility_id, date_trunc('month', d) AS m, sum(y) AS total FROM facility_daily_v GROUP BY ALL) t
       LEFT JOIN (SELECT facility_id, date_trunc('month', d) AS m, sum(y) AS total FROM facility_daily_v GROUP BY ALL) p
         ON p.facility_id = t.facility_id AND p.m = t.m - INTERVAL 1 MONTH""",
)
def _month_growth(lake: Lake) -> DataFrame:
    return rounded(ft.month_totals(business.collections(lake, *FACILITY)), {"month_total": 4, "mom_growth": 6})


@register(
    "month_growth_to_date",
    """SELECT a.facility_id, a.d AS event_date, round(CASE WHEN p.total > 0 THEN
              (sum(a.y) OVER (PARTITION BY a.facility_id, date_trunc('month', a.d) ORDER BY a.d) - p.total) / p.total END, 6)
              AS mom_growth_to_date
       FROM facility_dense_v a LEFT JOIN facility_month_v p
         ON p.facility_id = a.facility_id AND p.m = date_trunc('month', a.d) - INTERVAL 1 MONTH""",
)
def _month_growth_to_date(lake: Lake) -> DataFrame:
    return facility_features(lake).select("facility_id", "event_date", F.round("mom_growth_to_date", 6).alias("mom_growth_to_date"))


@register(
    "yoy_growth",
    "SELECT facility_id, event_date, round(collections_yoy_growth, 6) AS collections_yoy_growth FROM facility_features_v",
)
def _yoy(lake: Lake) -> DataFrame:
    return facility_features(lake).select(
        "facility_id", "event_date", F.round("collections_yoy_growth", 6).alias("collections_yoy_growth")
    )


@register(
    "facility_features",
    """SELECT facility_id, event_date, round(collections_1d, 4) AS collections_1d,
              round(collections_7d_rolling, 4) AS collections_7d_rolling,
              round(collections_30d_rolling, 4) AS collections_30d_rolling,
              round(collections_mom_growth, 6) AS collections_mom_growth,
              round(collections_yoy_growth, 6) AS collections_yoy_growth,
              CAST(day_of_week AS INTEGER) AS day_of_week, CAST(month AS INTEGER) AS month, is_month_end
       FROM facility_features_v""",
)
def facility_features_query(lake: Lake) -> DataFrame:
    return rounded(
        facility_features(lake).drop("mom_growth_to_date"),
        {
            "collections_1d": 4, "collections_7d_rolling": 4, "collections_30d_rolling": 4,
            "collections_mom_growth": 6, "collections_yoy_growth": 6,
        },
    )


def visit_features(lake: Lake) -> DataFrame:
    return ft.visit_velocity(
        business.visits(lake, "facility_id", "case_type", "visit_date", "billing_status", "billed_amount")
    )


@register(
    "visit_velocity_features",
    """SELECT facility_id, case_type, event_date, coalesce(n7, 0) AS new_visits_7d, n30 AS new_visits_30d,
              round(CASE WHEN n7 > 0 THEN p7 / n7 ELSE 0 END, 6) AS visit_cancellation_rate_7d,
              round(coalesce(n7, 0) / 7.0, 6) AS new_case_open_rate_7d,
              round(CASE WHEN n7 > 0 THEN b7 / n7 ELSE 0 END, 6) AS visit_billing_conversion_rate
       FROM (SELECT facility_id, case_type, event_date, n7, coalesce(n30, 0) AS n30, b7, p7 FROM visit_features_v)""",
)
def _visits(lake: Lake) -> DataFrame:
    return rounded(
        visit_features(lake),
        {"visit_cancellation_rate_7d": 6, "new_case_open_rate_7d": 6, "visit_billing_conversion_rate": 6},
    )


def aging_features(lake: Lake) -> DataFrame:
    return ft.attorney_aging(business.aging(lake))


AGING_PLACES = {
    **{f"{b}_balance": 2 for b in fv.AGING_BUCKETS},
    "total_outstanding": 2, "pct_180_plus": 6, "avg_days_outstanding": 6, "aging_migration_rate_30d": 6,
}


@register(
    "attorney_aging_features",
    "SELECT attorney_id, event_date, "
    + ", ".join(f"round({c}, {n}) AS {c}" for c, n in AGING_PLACES.items())
    + " FROM attorney_features_v",
)
def _aging(lake: Lake) -> DataFrame:
    return rounded(aging_features(lake), AGING_PLACES)


@register(
    "aging_snapshots",
    "SELECT attorney_id, facility_id, report_date, "
    + ", ".join(f"round({b}, 2) AS {b}" for b in fv.AGING_BUCKETS)
    + " FROM aging_v",
)
def _aging_snapshots(lake: Lake) -> DataFrame:
    return rounded(business.aging(lake), {b: 2 for b in fv.AGING_BUCKETS})


def settlement_features(lake: Lake) -> DataFrame:
    rows = business.settlements(lake, "attorney_id", "case_type", "open_date", "close_date", "settlement_amount")
    return ft.settlement_pipeline(rows)


@register(
    "settlement_features",
    """SELECT attorney_id, case_type, event_date, open_settlements_count, settlements_closed_30d,
              round(avg_days_to_settlement_90d, 6) AS avg_days_to_settlement_90d,
              round(settlement_velocity_change_30d, 6) AS settlement_velocity_change_30d, high_value_open_count
       FROM settlement_features_v""",
)
def _settlements(lake: Lake) -> DataFrame:
    return rounded(settlement_features(lake), {"avg_days_to_settlement_90d": 6, "settlement_velocity_change_30d": 6})


# amounts that are missing: two of three settlements have none, so most days lack any
view("settlements_null_v", "SELECT * REPLACE (CASE WHEN settlement_id % 3 = 0 THEN settlement_amount END AS settlement_amount) FROM settlements_v")
for _name in ("settlement_grid_v", "settlement_features_v"):
    view(_name.replace("_v", "_null_v"), VIEWS[_name].replace("settlements_v", "settlements_null_v").replace("settlement_grid_v", "settlement_grid_null_v"))


@register(
    "settlement_features_missing_amounts",
    """SELECT attorney_id, case_type, event_date, open_settlements_count, settlements_closed_30d,
              round(avg_days_to_settlement_90d, 6) AS avg_days_to_settlement_90d,
              round(settlement_velocity_change_30d, 6) AS settlement_velocity_change_30d, high_value_open_count
       FROM settlement_features_null_v""",
)
def _settlements_missing(lake: Lake) -> DataFrame:
    rows = business.settlements(lake)
    amount = F.when(F.col("settlement_id") % 3 == 0, F.col("settlement_amount"))
    features = ft.settlement_pipeline(rows.withColumn("settlement_amount", amount))
    return rounded(features, {"avg_days_to_settlement_90d": 6, "settlement_velocity_change_30d": 6})


LETTER_COLUMNS = ("facility_id", "issued_date", "returned_date", "status")


def lop_features(lake: Lake) -> DataFrame:
    return ft.lop_metrics(business.letters(lake, *LETTER_COLUMNS))


@register(
    "lop_features",
    """SELECT facility_id, event_date, lop_issued_7d, lop_returned_7d,
              round(lop_rejection_rate_30d, 6) AS lop_rejection_rate_30d,
              round(lop_turnaround_days_p50, 4) AS lop_turnaround_days_p50,
              round(lop_turnaround_days_p90, 4) AS lop_turnaround_days_p90, lop_backlog_count
       FROM lop_features_v""",
)
def _lop(lake: Lake) -> DataFrame:
    return rounded(
        lop_features(lake), {"lop_rejection_rate_30d": 6, "lop_turnaround_days_p50": 4, "lop_turnaround_days_p90": 4}
    )


@register(
    "lop_turnaround_pctl",
    """SELECT facility_id, event_date, round(lop_turnaround_days_p50, 4) AS lop_turnaround_days_p50,
              round(lop_turnaround_days_p90, 4) AS lop_turnaround_days_p90
       FROM lop_features_v WHERE lop_turnaround_days_p50 IS NOT NULL""",
)
def _lop_turnaround(lake: Lake) -> DataFrame:
    histogram = ft.lop_histogram(business.letters(lake, *LETTER_COLUMNS))
    first, last = ft.lop_dates(histogram)
    return rounded(
        ft.lop_turnaround(histogram, first, last), {"lop_turnaround_days_p50": 4, "lop_turnaround_days_p90": 4}
    )


@register("lop_backlog", "SELECT facility_id, event_date, lop_backlog_count FROM lop_features_v")
def _lop_backlog(lake: Lake) -> DataFrame:
    histogram = ft.lop_histogram(business.letters(lake, *LETTER_COLUMNS))
    first, last = ft.lop_dates(histogram)
    return ft.lop_counts(histogram, first, last).select("facility_id", "event_date", "lop_backlog_count")
