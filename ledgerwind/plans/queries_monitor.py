"""Registered queries: monitoring tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.functions.numeric import rounded
from ledgerwind.operators import alerts as al
from ledgerwind.operators import detect, features as ft, forecast as fc, monitor, signals
from ledgerwind.operators.timeseries import densify, trailing_count
from ledgerwind.plans import queries_alerts as qa
from ledgerwind.plans import queries_features as qf
from ledgerwind.plans import queries_forecast as qc
from ledgerwind.plans.catalog import register
from ledgerwind.plans.oracle_views import VIEWS, view
from ledgerwind.sources import business
from ledgerwind.sources.questions import query_log
from ledgerwind.sources.tables import Lake

MEASURES = ["collections_1d", "collections_7d_rolling", "collections_30d_rolling"]

view("drift_rows_v", " UNION ALL ".join(
    f"SELECT facility_id, '{m}' AS feature, event_date, {m} AS value FROM facility_features_v" for m in MEASURES
))
view("drift_aged_v", """
SELECT facility_id, feature, value, datediff('day', event_date, max(event_date) OVER (PARTITION BY facility_id)) AS age FROM drift_rows_v
""")
view("drift_edges_v", "SELECT facility_id, feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM drift_aged_v WHERE age BETWEEN 30 AND 59 GROUP BY ALL")
view("drift_bins_v", """
SELECT facility_id, feature, len(list_filter(edges, lambda e: e < value)) AS bin, count(*) FILTER (WHERE age >= 30) AS p, count(*) FILTER (WHERE age < 30) AS q
FROM drift_aged_v JOIN drift_edges_v USING (facility_id, feature) WHERE age < 60 GROUP BY ALL
""")


@register(
    "feature_drift",
    """SELECT facility_id, feature, round(sum((q - p) * ln(q / p)), 6) AS psi, round(sum(q * ln(q / p)), 6) AS kl, sum((q - p) * ln(q / p)) > 0.2 AS drifting
       FROM (SELECT facility_id, feature, greatest(p / sum(p) OVER w, 1e-4) AS p, greatest(q / sum(q) OVER w, 1e-4) AS q
             FROM drift_bins_v WINDOW w AS (PARTITION BY facility_id, feature)) GROUP BY ALL""",
)
def _psi(lake: Lake) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("feature"), F.col(m).alias("value")) for m in MEASURES])
    from pyspark.sql import Window

    last = F.max("event_date").over(Window.partitionBy("facility_id"))
    aged = qf.facility_features(lake).withColumn("_age", F.datediff(last, "event_date")).filter("_age < 60")
    rows = aged.select("facility_id", (F.col("_age") >= 30).alias("baseline"), F.inline(cells))
    scored = monitor.stability_index(rows, ["facility_id", "feature"], "baseline")
    return scored.select("facility_id", "feature", F.round("psi", 6).alias("psi"), F.round("kl", 6).alias("kl"), (F.col("psi") > monitor.PSI_BAR).alias("drifting"))


view("errors_v", """
SELECT d.entity_type, d.entity_id, d.d, d.t, d.n, d.y AS actual, a.predicted, b.naive
FROM dense3_v d JOIN ahead_v a ON a.run = 2 AND a.fold = 0 AND a.entity_type = d.entity_type AND a.entity_id = d.entity_id AND a.d = d.d
JOIN (SELECT entity_type, entity_id, avg(y) AS naive FROM dense3_v WHERE t < n - 30 AND t >= n - 60 GROUP BY ALL) b
  ON b.entity_type = d.entity_type AND b.entity_id = d.entity_id
WHERE d.t >= d.n - 30
""")


@register(
    "forecast_delta",
    """SELECT entity_type, entity_id, d AS ds, round(actual, 4) AS actual, round(predicted, 4) AS predicted,
              round(CASE WHEN predicted > 0 THEN (actual - predicted) / predicted END, 6) AS collections_vs_forecast_delta FROM errors_v""",
)
def _delta(lake: Lake) -> DataFrame:
    rows = monitor.forecast_delta(monitor.daily_errors(qa.stored_series(lake)))
    return rounded(rows, {"actual": 4, "predicted": 4, "collections_vs_forecast_delta": 6})


@register(
    "forecast_error_drift",
    """SELECT entity_type, entity_id, round(a, 6) AS mape_all, round(r, 6) AS mape_recent, coalesce(r - a > 0.05, false) AS drifting
       FROM (SELECT entity_type, entity_id, avg(abs(predicted - actual) / actual) FILTER (WHERE actual > 0) AS a,
                    avg(abs(predicted - actual) / actual) FILTER (WHERE actual > 0 AND t >= n - 7) AS r FROM errors_v GROUP BY ALL)""",
)
def _drift(lake: Lake) -> DataFrame:
    rows = monitor.error_drift(monitor.daily_errors(qa.stored_series(lake)))
    return rounded(rows, {"mape_all": 6, "mape_recent": 6})


# the tail of Student's t by Simpson's rule over its density
view("model_welch_v", """
SELECT entity_type, entity_id, days, a, b, (b - a) / sqrt(va + vb) AS t, (va + vb) * (va + vb) / ((va * va + vb * vb) / (days - 1)) AS f
FROM (SELECT entity_type, entity_id, count(*) AS days, avg(ea) AS a, avg(eb) AS b, var_samp(ea) / count(*) AS va, var_samp(eb) / count(*) AS vb
      FROM (SELECT entity_type, entity_id, abs(predicted - actual) / actual AS ea, abs(naive - actual) / actual AS eb FROM errors_v WHERE actual > 0)
      GROUP BY ALL)
""")
view("model_tail_v", """
SELECT entity_type, entity_id, 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs(t) * i / 4000, 2) / f, -(f + 1) / 2)) * abs(t) / 4000 / 3
       * exp(lgamma((max(f) + 1) / 2) - lgamma(max(f) / 2)) / sqrt(max(f) * pi()) AS p
FROM model_welch_v, (SELECT unnest(generate_series(0, 4000)) AS i) GROUP BY entity_type, entity_id, t
""")


@register(
    "model_comparison",
    f"""SELECT entity_type, entity_id, days, round(a, 6) AS champion_mape, round(b, 6) AS challenger_mape, round(t, 4) AS t, round(f, 4) AS freedom, round(p, 9) AS p_value,
              days >= {monitor.AB_MINIMUM_DAYS} AND t < 0 AND p < {monitor.AB_LEVEL} AS challenger_wins
       FROM model_welch_v JOIN model_tail_v USING (entity_type, entity_id)""",
)
def _compare(lake: Lake) -> DataFrame:
    rows = monitor.compare_models(monitor.daily_errors(qa.stored_series(lake)))
    return rounded(rows, {"champion_mape": 6, "challenger_mape": 6, "t": 4, "freedom": 4, "p_value": 9})


@register(
    "forecast_revisions",
    """SELECT o.entity_type, o.entity_id, o.predicted AS before, n.predicted AS after, round((n.predicted - o.predicted) / o.predicted, 6) AS change,
              abs((n.predicted - o.predicted) / o.predicted) > 0.10 AS notify
       FROM bands_v o JOIN bands_v n ON n.fold = -1 AND n.horizon_days = 30 AND n.entity_type = o.entity_type AND n.entity_id = o.entity_id
       WHERE o.run = 2 AND o.fold = 0""",
)
def _revisions(lake: Lake) -> DataFrame:
    series = qa.stored_series(lake)
    old = fc.backtest_folds(series).filter("fold = 0")
    return rounded(monitor.revisions(old, qa.month_forecasts(series)), {"change": 6})


@register(
    "control_limits",
    """SELECT entity_type, entity_id, d AS ds, round(y, 4) AS y, round(c, 6) AS center, round(c - 3 * s, 4) AS lower, round(c + 3 * s, 4) AS upper
       FROM (SELECT *, avg(y) OVER w AS c, stddev_samp(y) OVER w AS s, count(*) OVER w AS k FROM dense3_v
             WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY d ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING))
       WHERE k = 90 AND (y < c - 3 * s OR y > c + 3 * s)""",
)
def _limits(lake: Lake) -> DataFrame:
    return rounded(monitor.control_limits(qc.series(lake)), {"y": 4, "center": 6, "lower": 4, "upper": 4})


@register(
    "lag_features",
    """SELECT facility_id, d AS event_date, round(lag(y7, 1) OVER w, 4) AS collections_rolling_7d_lag1, round(lag(y7, 2) OVER w, 4) AS collections_rolling_7d_lag2,
              round(lag(y7, 4) OVER w, 4) AS collections_rolling_7d_lag4, CAST(quarter(d) AS INTEGER) AS quarter,
              round(sum(y) OVER p, 4) / count(y) OVER p AS facility_encoding
       FROM facility_roll_v WINDOW w AS (PARTITION BY facility_id ORDER BY d), p AS (PARTITION BY facility_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _lags(lake: Lake) -> DataFrame:
    rows = monitor.lag_features(qf.facility_features(lake))
    return rounded(rows, {f"collections_rolling_7d_lag{k}": 4 for k in (1, 2, 4)})


RELATIONS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("documents", "doc_id", "labels", "doc_id"),
]


@register(
    "referential_integrity",
    " UNION ALL ".join(
        f"SELECT '{c}.{k}->{p}' AS relation, count(*) AS orphan_rows FROM {c} x WHERE NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{pk} = x.{k})"
        for c, k, p, pk in RELATIONS
    ),
)
def _orphans(lake: Lake) -> DataFrame:
    parts = [monitor.orphans(lake.table(c), k, lake.table(p), pk, f"{c}.{k}->{p}") for c, k, p, pk in RELATIONS]
    return reduce(DataFrame.unionByName, parts)


@register(
    "alert_digest",
    """SELECT severity, entity_type, count(*) AS alerts, string_agg(entity_id, ', ' ORDER BY entity_id) AS entities FROM combined_v
       WHERE severity IN ('P2', 'P3') GROUP BY ALL""",
)
def _digest(lake: Lake) -> DataFrame:
    return monitor.digest(al.combine(qa.findings(lake, qa.stored_series(lake))))


@register(
    "query_log_review",
    """SELECT question, count(*) AS asked, CAST(sum(row_count) AS BIGINT) AS rows_returned, max(asked_on) AS last_asked, sha256(question) AS query_hash
       FROM query_log_v GROUP BY question ORDER BY asked DESC, query_hash LIMIT 20""",
)
def _review(lake: Lake) -> DataFrame:
    return monitor.frequent_questions(query_log(lake))


@register(
    "retention",
    """SELECT 'raw' AS data_type, count(*) AS total_rows, count(*) FILTER (WHERE collection_date >= DATE '2002-01-01' - INTERVAL 24 MONTH) AS kept_rows FROM collections_v
       UNION ALL SELECT 'features', count(*), count(*) FILTER (WHERE event_date >= DATE '2002-01-01' - INTERVAL 36 MONTH) FROM facility_features_v
       UNION ALL SELECT 'query_log', count(*), count(*) FILTER (WHERE asked_on >= DATE '2002-01-01' - INTERVAL 12 MONTH) FROM query_log_v
       UNION ALL SELECT 'audit', count(*), count(*) FILTER (WHERE asked_on >= DATE '2002-01-01' - INTERVAL 84 MONTH) FROM query_log_v""",
)
def _retention(lake: Lake) -> DataFrame:
    as_of = F.to_date(F.lit("2002-01-01"))
    log = query_log(lake)
    parts = [
        monitor.retained(business.collections(lake, "collection_date"), "collection_date", "raw", as_of),
        monitor.retained(qf.facility_features(lake), "event_date", "features", as_of),
        monitor.retained(log, "asked_on", "query_log", as_of),
        monitor.retained(log, "asked_on", "audit", as_of),
    ]
    return reduce(DataFrame.unionByName, parts)


@register(
    "forecast_summary",
    """SELECT entity_type, horizon_days, count(*) AS entities, round(sum(predicted), 2) AS predicted FROM bands_v WHERE fold = -1
       GROUP BY ROLLUP (entity_type, horizon_days)""",
)
def _summary(lake: Lake) -> DataFrame:
    return rounded(monitor.forecast_summary(qc.forecasts(lake)), {"predicted": 2})


@register("high_error_entities", "SELECT entity_type, entity_id, round(mape, 6) AS mape FROM backtest_v WHERE run = 2 AND mape > 0.20")
def _high(lake: Lake) -> DataFrame:
    rows = fc.backtest(qc.series(lake)).filter(F.col("mape") > monitor.MAPE_FLAG)
    return rounded(rows.select(*fc.ENTITY, "mape"), {"mape": 6})


view("truth_v", """
SELECT entity_type, entity_id FROM dense3_v GROUP BY ALL
HAVING avg(y) FILTER (WHERE t >= n - 7) < 0.75 * avg(y) FILTER (WHERE t >= n - 97 AND t < n - 7)
""")


@register(
    "detector_quality",
    """SELECT round(count(*) FILTER (WHERE f AND t) / nullif(count(*) FILTER (WHERE f), 0), 6) AS precision,
              round(count(*) FILTER (WHERE f AND t) / nullif(count(*) FILTER (WHERE t), 0), 6) AS recall,
              round(count(*) FILTER (WHERE f AND NOT t) / nullif(count(*) FILTER (WHERE NOT t), 0), 6) AS false_positive_rate
       FROM (SELECT (entity_type, entity_id) IN (SELECT (entity_type, entity_id) FROM findings_v) AS f,
                    (entity_type, entity_id) IN (SELECT (entity_type, entity_id) FROM truth_v) AS t FROM entities_v)""",
)
def _quality(lake: Lake) -> DataFrame:
    series = qa.stored_series(lake)
    recent, earlier = F.col("t") >= F.col("n") - 7, (F.col("t") >= F.col("n") - 97) & (F.col("t") < F.col("n") - 7)
    levels = series.groupBy(*fc.ENTITY).agg(
        F.avg(F.when(recent, F.col("y"))).alias("now"), F.avg(F.when(earlier, F.col("y"))).alias("before")
    )
    truth = levels.filter(F.col("now") < 0.75 * F.col("before"))
    scored = monitor.detector_quality(levels.select(*fc.ENTITY), qa.findings(lake, series), truth)
    return rounded(scored, {"precision": 6, "recall": 6, "false_positive_rate": 6})


# the drift chart of a weekly count: the same views over another series
view("visit_series_v", """
SELECT 'facility' AS entity_type, facility_id AS entity_id, d, row_number() OVER (PARTITION BY facility_id ORDER BY d) - 1 AS t,
       count(*) OVER (PARTITION BY facility_id) AS n, sum(coalesce(k, 0)) OVER (PARTITION BY facility_id ORDER BY d ROWS 6 PRECEDING) AS y
FROM (SELECT g.facility_id, g.d, v.k FROM (SELECT facility_id, CAST(unnest(generate_series(min(visit_date), max(visit_date), INTERVAL 1 DAY)) AS DATE) AS d FROM visits_v GROUP BY facility_id) g
      LEFT JOIN (SELECT facility_id, visit_date AS d, CAST(count(*) AS DOUBLE) AS k FROM visits_v GROUP BY ALL) v ON v.facility_id = g.facility_id AND v.d = g.d)
""")
for _name in ("cusum_ref_v", "cusum_z_v", "cusum_walk_v", "cusum_v"):
    _text = VIEWS[_name].replace("dense3_v", "visit_series_v")
    for _other in ("cusum_ref_v", "cusum_z_v", "cusum_walk_v", "cusum_v"):
        _text = _text.replace(_other, f"visit_{_other}")
    view(f"visit_{_name}", _text)


@register(
    "visit_cusum",
    "SELECT entity_type, entity_id, round(expected, 6) AS expected, round(actual, 4) AS actual, round(score, 6) AS score FROM visit_cusum_v",
)
def _visit_cusum(lake: Lake) -> DataFrame:
    daily = business.visits(lake, "facility_id", "visit_date").groupBy(
        F.lit("facility").alias("entity_type"), F.col("facility_id").alias("entity_id"), F.col("visit_date").alias("ds")
    ).agg(F.count("*").cast("double").alias("y"))
    weekly = fc.dense_series(daily).withColumn("y", trailing_count("y", fc.ENTITY, "ds", 6).cast("double"))
    scored = detect.cusum_scores(weekly).select(*fc.ENTITY, "expected", "actual", "score")
    return rounded(scored, {"expected": 6, "actual": 4, "score": 6})


# settlements opened in the trailing week, as the same chart
view("settlement_series_v", """
SELECT 'attorney' AS entity_type, attorney_id AS entity_id, d, row_number() OVER (PARTITION BY attorney_id ORDER BY d) - 1 AS t,
       count(*) OVER (PARTITION BY attorney_id) AS n, sum(coalesce(k, 0)) OVER (PARTITION BY attorney_id ORDER BY d ROWS 6 PRECEDING) AS y
FROM (SELECT g.attorney_id, g.d, v.k FROM (SELECT attorney_id, CAST(unnest(generate_series(min(open_date), max(open_date), INTERVAL 1 DAY)) AS DATE) AS d FROM settlements_v GROUP BY attorney_id) g
      LEFT JOIN (SELECT attorney_id, open_date AS d, CAST(count(*) AS DOUBLE) AS k FROM settlements_v GROUP BY ALL) v ON v.attorney_id = g.attorney_id AND v.d = g.d)
""")
for _name in ("cusum_ref_v", "cusum_z_v", "cusum_walk_v", "cusum_v"):
    _text = VIEWS[_name].replace("dense3_v", "settlement_series_v")
    for _other in ("cusum_ref_v", "cusum_z_v", "cusum_walk_v", "cusum_v"):
        _text = _text.replace(_other, f"settlement_{_other}")
    view(f"settlement_{_name}", _text)


@register(
    "settlement_cusum",
    "SELECT entity_type, entity_id, round(expected, 6) AS expected, round(actual, 4) AS actual, round(score, 6) AS score FROM settlement_cusum_v",
)
def _settlement_cusum(lake: Lake) -> DataFrame:
    daily = business.settlements(lake).groupBy(
        F.lit("attorney").alias("entity_type"), F.col("attorney_id").alias("entity_id"), F.col("open_date").alias("ds")
    ).agg(F.count("*").cast("double").alias("y"))
    weekly = fc.dense_series(daily).withColumn("y", trailing_count("y", fc.ENTITY, "ds", 6).cast("double"))
    scored = detect.cusum_scores(weekly).select(*fc.ENTITY, "expected", "actual", "score")
    return rounded(scored, {"expected": 6, "actual": 4, "score": 6})


view("homes_v", "SELECT n_name AS attorney_id, r_name AS facility_id FROM nation JOIN region ON r_regionkey = n_regionkey")


view("signal_visits_v", "SELECT facility_id, event_date, sum(n7) AS x FROM visit_features_v GROUP BY ALL")
view("signal_velocity_v", "SELECT facility_id, event_date, avg(settlement_velocity_change_30d) AS x FROM settlement_features_v JOIN homes_v USING (attorney_id) GROUP BY ALL")
view("signal_old_v", """
SELECT facility_id, event_date, CASE WHEN sum(total_outstanding) > 0 THEN sum(bucket_180_plus_balance) / sum(total_outstanding) ELSE 0 END AS x
FROM attorney_features_v JOIN homes_v USING (attorney_id) GROUP BY ALL
""")
view("signal_missed_v", """
SELECT entity_id AS facility_id, d AS event_date, CASE WHEN predicted > 0 THEN (actual - predicted) / predicted END AS x FROM errors_v WHERE entity_type = 'facility'
""")


@register(
    "six_signal_vectors",
    """SELECT s.facility_id, s.d AS event_date, round(s.y, 4) AS collections_1d, CAST(coalesce(v.x, 0) AS DOUBLE) AS new_visits_7d, round(coalesce(w.x, 0), 6) AS settlement_velocity_change_30d,
              round(coalesce(l.lop_turnaround_days_p50, 0), 4) AS lop_turnaround_days_p50, round(coalesce(o.x, 0), 6) AS pct_180_plus, round(coalesce(m.x, 0), 6) AS collections_vs_forecast_delta
       FROM facility_dense_v s
       ASOF LEFT JOIN signal_visits_v v ON v.facility_id = s.facility_id AND s.d >= v.event_date
       ASOF LEFT JOIN signal_velocity_v w ON w.facility_id = s.facility_id AND s.d >= w.event_date
       ASOF LEFT JOIN lop_features_v l ON l.facility_id = s.facility_id AND s.d >= l.event_date
       ASOF LEFT JOIN signal_old_v o ON o.facility_id = s.facility_id AND s.d >= o.event_date
       ASOF LEFT JOIN signal_missed_v m ON m.facility_id = s.facility_id AND s.d >= m.event_date""",
)
def _six_signals(lake: Lake) -> DataFrame:
    daily = ft.daily_collections(business.collections(lake, *qf.FACILITY), ["facility_id"])
    dense = densify(daily, ["facility_id"], "event_date", ["collections_1d"])
    delta = monitor.forecast_delta(monitor.daily_errors(qa.stored_series(lake))).filter("entity_type = 'facility'")
    delta = delta.select(F.col("entity_id").alias("facility_id"), F.col("ds").alias("event_date"), "collections_vs_forecast_delta")
    nation, region = lake.table("nation"), lake.table("region")
    homes = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("attorney_id"), F.col("r_name").alias("facility_id"))
    rows = signals.six_signals(
        dense, qf.visit_features(lake), qf.settlement_features(lake), qf.lop_features(lake), qf.aging_features(lake), delta, homes
    )
    return rounded(
        rows,
        {"collections_1d": 4, "settlement_velocity_change_30d": 6, "lop_turnaround_days_p50": 4, "pct_180_plus": 6, "collections_vs_forecast_delta": 6},
    )
