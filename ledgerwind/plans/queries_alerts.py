"""Registered queries: detectors, severity, narratives, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv
from ledgerwind.functions.numeric import rounded
from ledgerwind.operators import alerts as al
from ledgerwind.operators import detect, features as ft, forecast as fc, iforest, monitor
from ledgerwind.operators.timeseries import densify
from ledgerwind.plans import queries_features as qf
from ledgerwind.plans import queries_forecast as qc
from ledgerwind.plans.catalog import register
from ledgerwind.plans.oracle_views import VIEWS, title_sql, view, whole_sql
from ledgerwind.plans.queries_ingest import OVERRIDES, entities
from ledgerwind.session import materialise
from ledgerwind.sources import business
from ledgerwind.sources.tables import Lake

PLACES = {"expected": 6, "actual": 4, "deviation_pct": 6, "score": 6}
FINDING_SQL = """entity_type, entity_id, metric, detector, round(expected, 6) AS expected, round(actual, 4) AS actual,
                 round(deviation_pct, 6) AS deviation_pct, round(score, 6) AS score, severity"""


def stored_series(lake: Lake) -> DataFrame:
    """The dense series, written once: models, deviations and drifts all read it."""
    return materialise(qc.series(lake), "series")


def month_forecasts(series: DataFrame) -> DataFrame:
    models = fc.fit_seasonal_trend(series.filter("n >= 30"), fc.ENTITY)
    return fc.with_bands(models, F.lit(30))


def deviations(lake: Lake, series: DataFrame) -> DataFrame:
    return detect.forecast_deviation(series, month_forecasts(series), OVERRIDES)


def findings(lake: Lake, series: DataFrame) -> DataFrame:
    return deviations(lake, series).unionByName(detect.cusum(series, OVERRIDES))


@register("forecast_deviation", f"SELECT {FINDING_SQL} FROM deviation_findings_v")
def _deviation(lake: Lake) -> DataFrame:
    return rounded(deviations(lake, qc.series(lake)), PLACES)


@register(
    "cusum_scores",
    "SELECT entity_type, entity_id, round(expected, 6) AS expected, round(actual, 4) AS actual, round(score, 6) AS score FROM cusum_v",
)
def _cusum_scores(lake: Lake) -> DataFrame:
    scored = detect.cusum_scores(qc.series(lake), OVERRIDES).select(*fc.ENTITY, "expected", "actual", "score")
    return rounded(scored, {"expected": 6, "actual": 4, "score": 6})


@register("cusum_findings", f"SELECT {FINDING_SQL} FROM cusum_findings_v")
def _cusum(lake: Lake) -> DataFrame:
    return rounded(detect.cusum(qc.series(lake), OVERRIDES), PLACES)


@register(
    "combined_severity",
    f"SELECT {FINDING_SQL}, escalated, agreeing_detectors FROM combined_v",
)
def _combined(lake: Lake) -> DataFrame:
    return rounded(al.combine(findings(lake, stored_series(lake))), PLACES)


VECTOR = ["collections_1d", "lop_turnaround_days_p50", "lop_backlog_count"]


@register(
    "facility_vectors",
    """SELECT c.facility_id, c.d AS event_date, round(c.y, 4) AS collections_1d,
              round(coalesce(l.lop_turnaround_days_p50, 0), 4) AS lop_turnaround_days_p50,
              CAST(coalesce(l.lop_backlog_count, 0) AS DOUBLE) AS lop_backlog_count
       FROM facility_dense_v c LEFT JOIN lop_features_v l ON l.facility_id = c.facility_id AND l.event_date = c.d""",
)
def _vectors(lake: Lake) -> DataFrame:
    vectors = detect.facility_vectors(qf.facility_features(lake), qf.lop_features(lake))
    return rounded(vectors, {"collections_1d": 4, "lop_turnaround_days_p50": 4})


def entity_vectors(lake: Lake, lop: DataFrame | None = None) -> DataFrame:
    """Vectors from the daily totals alone: the forest reads no other facility feature."""
    daily = ft.daily_collections(business.collections(lake, *qf.FACILITY), ["facility_id"])
    dense = densify(daily, ["facility_id"], "event_date", ["collections_1d"])
    lop = qf.lop_features(lake) if lop is None else lop
    return detect.facility_vectors(dense, lop).withColumnRenamed("facility_id", "entity_id")


# the forest again, one statement per level: nodes by grouping, rows by a join with their node
_X = "x0, x1, x2"


def _draw_sql(*parts: str, first: int = 1) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), {first}, {iforest._DIGITS}) AS BIGINT) / {float(16**iforest._DIGITS)!r}"


def _path_sql(n: str) -> str:
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + {iforest.EULER_GAMMA!r}) - 2 * ({n} - 1.0) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"


view("forest_vectors_v", """
SELECT c.facility_id AS entity_id, c.d AS event_date, c.y AS a, coalesce(l.lop_turnaround_days_p50, 0) AS b, CAST(coalesce(l.lop_backlog_count, 0) AS DOUBLE) AS c
FROM facility_dense_v c LEFT JOIN lop_features_v l ON l.facility_id = c.facility_id AND l.event_date = c.d
""")
view("forest_rows_v", f"""
SELECT * FROM (
  SELECT entity_id, event_date, round(a, {iforest.PLACES}) AS x0, round(b, {iforest.PLACES}) AS x1, round(c, {iforest.PLACES}) AS x2,
         row_number() OVER (PARTITION BY entity_id ORDER BY md5(concat_ws('|', entity_id, CAST(event_date AS VARCHAR))), event_date) - 1 AS number,
         count(*) OVER (PARTITION BY entity_id) AS n FROM forest_vectors_v) WHERE n >= {iforest.MINIMUM_ROWS}
""")
view("forest_at0_v", f"""
SELECT entity_id, tree, m, CAST(1 AS BIGINT) AS node, {_X} FROM (
  SELECT entity_id, tree, m, stretch * n // m + CAST(floor({_draw_sql("entity_id", "tree", "stretch")} * ((stretch + 1) * n // m - stretch * n // m)) AS BIGINT) AS number
  FROM (SELECT entity_id, max(n) AS n, least(max(n), {iforest.SAMPLE_ROWS}) AS m FROM forest_rows_v GROUP BY entity_id),
       (SELECT unnest(range({iforest.TREES})) AS tree), (SELECT unnest(range({iforest.SAMPLE_ROWS})) AS stretch) WHERE stretch < m)
JOIN forest_rows_v USING (entity_id, number)
""")
for _level in range(iforest.LEVELS + 1):
    view(f"forest_node{_level}_v", f"""
SELECT *, CASE WHEN feature IS NULL THEN {_level} + {_path_sql("size")} END AS depth, CASE WHEN drawn < high THEN drawn ELSE low END AS split FROM (
  SELECT *, low + {_draw_sql("entity_id", "tree", "node", first=1 + iforest._DIGITS)} * (high - low) AS drawn FROM (
    SELECT *, [l0, l1, l2][feature + 1] AS low, [h0, h1, h2][feature + 1] AS high FROM (
      SELECT *, CASE WHEN size > 1 AND {_level} < deepest THEN wide[1 + CAST(floor({_draw_sql("entity_id", "tree", "node")} * len(wide)) AS BIGINT)] END AS feature FROM (
        SELECT entity_id, tree, node, max(m) AS m, CAST(ceil(log2(greatest(max(m), 2))) AS INT) AS deepest, count(*) AS size,
               min(x0) AS l0, min(x1) AS l1, min(x2) AS l2, max(x0) AS h0, max(x1) AS h1, max(x2) AS h2,
               list_filter([CASE WHEN max(x0) > min(x0) THEN 0 END, CASE WHEN max(x1) > min(x1) THEN 1 END, CASE WHEN max(x2) > min(x2) THEN 2 END], lambda k: k IS NOT NULL) AS wide
        FROM forest_at{_level}_v GROUP BY entity_id, tree, node))))
""")
    _step = "2 * {0}.node + CASE WHEN [x0, x1, x2][feature + 1] > split THEN 1 ELSE 0 END AS node"
    view(f"forest_at{_level + 1}_v", f"""
SELECT entity_id, tree, a.m AS m, {_step.format("a")}, {_X} FROM forest_at{_level}_v a JOIN forest_node{_level}_v t USING (entity_id, tree, node) WHERE feature IS NOT NULL
""")
    _before = f"forest_walk{_level - 1}_v" if _level else f"(SELECT entity_id, event_date, tree, CAST(1 AS BIGINT) AS node, {_X} FROM forest_rows_v, (SELECT unnest(range({iforest.TREES})) AS tree))"
    view(f"forest_walk{_level}_v", f"""
SELECT entity_id, event_date, tree, t.depth AS depth, t.m AS m, {_step.format("w")}, {_X} FROM {_before} w JOIN forest_node{_level}_v t USING (entity_id, tree, node)
{"WHERE w.depth IS NULL" if _level else ""}
""")
view("forest_raw_v", f"""
SELECT entity_id, event_date, -pow(2.0, -(sum(depth) / {iforest.TREES}) / {_path_sql("max(m)")}) AS raw_score FROM ({
    " UNION ALL ".join(f"SELECT entity_id, event_date, depth, m FROM forest_walk{k}_v WHERE depth IS NOT NULL" for k in range(iforest.LEVELS + 1))
}) GROUP BY entity_id, event_date
""")
_SHARE = fv.DEFAULT_THRESHOLDS["isolation_forest"]
_OWN = {k[1]: {**_SHARE, **v.get("isolation_forest", {})} for k, v in OVERRIDES.items() if k[0] == "facility"}


def _own_sql(name: str) -> str:
    cases = " ".join(f"WHEN '{e}' THEN {t[name]!r}" for e, t in _OWN.items() if t[name] != _SHARE[name])
    return f"CASE entity_id {cases} ELSE {_SHARE[name]!r} END" if cases else repr(_SHARE[name])


_SHARES = sorted({_SHARE["contamination"], *(t["contamination"] for t in _OWN.values())})
view("forest_scores_v", f"""
SELECT entity_id, event_date, raw_score, raw_score - cuts[list_position({_SHARES}, {_own_sql("contamination")})] AS score
FROM forest_raw_v JOIN (SELECT entity_id, quantile_cont(raw_score, {_SHARES}) AS cuts FROM forest_raw_v GROUP BY entity_id) USING (entity_id)
""")
view("forest_last_v", f"""
SELECT 'facility' AS entity_type, entity_id, score, CASE WHEN score <= {_own_sql("p1_score")} THEN 'P1' WHEN score <= {_own_sql("p2_score")} THEN 'P2' END AS severity
FROM (SELECT entity_id, arg_max(score, event_date) AS score FROM forest_scores_v GROUP BY entity_id)
""")


@register("isolation_forest_findings", "SELECT entity_type, entity_id, round(score, 6) AS score, severity FROM forest_last_v")
def _forest(lake: Lake) -> DataFrame:
    return rounded(iforest.last_row_scores(entity_vectors(lake), VECTOR, OVERRIDES), {"score": 6})


@register("isolation_forest_scores", "SELECT entity_id, event_date, round(raw_score, 6) AS raw_score, round(score, 6) AS score FROM forest_scores_v")
def _forest_scores(lake: Lake) -> DataFrame:
    scores = iforest.anomaly_scores(entity_vectors(lake), VECTOR, OVERRIDES).select("entity_id", "event_date", "raw_score", "score")
    return rounded(scores, {"raw_score": 6, "score": 6})


@register("driver_narrative", "SELECT entity_type, entity_id, driver_narrative FROM driver_v")
def _driver(lake: Lake) -> DataFrame:
    return al.with_driver(entities(lake), qf.settlement_features(lake), qf.lop_features(lake))


view("alerts_v", """
SELECT sha256(entity_type || '|' || entity_id || '|' || strftime(created_at, '%Y-%m-%d %H:%M:%S')) AS alert_id, c.*, driver_narrative, created_at,
       '/dashboard/' || entity_type || '/' || entity_id AS dashboard_link
FROM combined_v c JOIN driver_v USING (entity_type, entity_id),
     (SELECT CAST(max(collection_date) + 1 AS TIMESTAMP) AS created_at FROM collections_v)
""")


def alerts(lake: Lake, with_forest: bool = False, series: DataFrame | None = None) -> DataFrame:
    series = stored_series(lake) if series is None else series
    found, lop = findings(lake, series), qf.lop_features(lake)
    if with_forest:
        lop = materialise(lop, "lop-features")  # the forest and the narratives read it
        found = found.unionByName(iforest.isolation_forest(entity_vectors(lake, lop), VECTOR, OVERRIDES))
    return al.alert_rows(al.combine(found), qf.settlement_features(lake), lop, qc.run_date_of(series).cast("timestamp"))


@register(
    "alert_rows",
    f"""SELECT alert_id, {FINDING_SQL}, escalated, driver_narrative, 'open' AS status, dashboard_link,
               '/chatbot?q=Why+did+' || entity_id || '+collections+change' AS chatbot_link, CAST(created_at AS DATE) AS created_on
        FROM alerts_v""",
)
def _alerts(lake: Lake) -> DataFrame:
    rows = al.deliverable(alerts(lake)).withColumn("created_on", F.to_date("created_at"))
    return rounded(
        rows.drop("created_at", "acknowledged_by", "acknowledged_at", "agreeing_detectors"), PLACES
    )


view("findings_all_v", """
SELECT * FROM findings_v
UNION ALL
SELECT 3, entity_type, entity_id, 'multivariate', 'isolation_forest', NULL, NULL, NULL, score, severity FROM forest_last_v WHERE severity IS NOT NULL
""")
view("combined_all_v", VIEWS["combined_v"].replace("findings_v", "findings_all_v"))
SUMMARY_SQL = """count(*) FILTER (NOT held) AS alerts_generated, count(*) FILTER (held) AS phi_blocked, count(*) FILTER (NOT held AND severity = 'P1') AS p1,
       count(*) FILTER (NOT held AND severity = 'P2') AS p2, count(*) FILTER (NOT held AND severity = 'P3') AS p3"""


@register("alert_sweep", f"SELECT {SUMMARY_SQL} FROM (SELECT *, regexp_matches(driver_narrative, 'Jane Walker') AS held FROM combined_all_v JOIN driver_v USING (entity_type, entity_id))")
def _sweep(lake: Lake) -> DataFrame:
    return al.summary(alerts(lake, with_forest=True))


# the same sweep after an attorney has been entered by a person's name: its alerts must be held back
PERSON = "mary jane walker "
view("velocity_named_v", VIEWS["velocity_latest_v"].replace(title_sql("attorney_id"), title_sql(f"'{PERSON}' || attorney_id")))
view("driver_named_v", VIEWS["driver_v"].replace("velocity_latest_v", "velocity_named_v"))
view("named_alerts_v", """
SELECT sha256(entity_type || '|' || entity_id || '|' || strftime(created_at, '%Y-%m-%d %H:%M:%S')) AS alert_id, severity, created_at, regexp_matches(driver_narrative, 'Jane Walker') AS held
FROM combined_v JOIN driver_named_v USING (entity_type, entity_id), (SELECT CAST(max(collection_date) + 1 AS TIMESTAMP) AS created_at FROM collections_v)
""")


def named_alerts(lake: Lake) -> DataFrame:
    named = qf.settlement_features(lake).withColumn("attorney_id", F.concat(F.lit(PERSON), "attorney_id"))
    combined = al.combine(findings(lake, stored_series(lake)))
    return materialise(al.alert_rows(combined, named, qf.lop_features(lake), qc.run_date(lake).cast("timestamp")), "alert-candidates")


@register("alert_sweep_held_back", f"SELECT {SUMMARY_SQL} FROM named_alerts_v")
def _held_back(lake: Lake) -> DataFrame:
    return al.summary(named_alerts(lake))


@register(
    "alert_sweep_events",
    """SELECT sha256('anomaly|ALERT|' || alert_id) AS event_id, alert_id AS session_id, 'anomaly' AS service, 'PHI_DETECTED_ALERT' AS action, CAST(NULL AS VARCHAR) AS user_id,
              'blocked' AS input_phi_scan, '{"matches":["Jane Walker"],"compliance_alert":true}' AS detail_json FROM named_alerts_v WHERE held
       UNION ALL
       SELECT sha256('anomaly|nightly_detection|' || strftime(max(created_at), '%Y-%m-%d %H:%M:%S')), NULL, 'anomaly', 'nightly_detection', 'system', 'n/a',
              '{"alerts":' || count(*) FILTER (NOT held) || ',"phi_blocked":' || count(*) FILTER (held) || '}' FROM named_alerts_v""",
)
def _sweep_events(lake: Lake) -> DataFrame:
    events = al.sweep_events(named_alerts(lake), qc.run_date(lake).cast("timestamp"))
    return events.select("event_id", "session_id", "service", "action", "user_id", "input_phi_scan", "detail_json")


@register(
    "alert_summary",
    """SELECT count(*) AS alerts_generated, CAST(0 AS BIGINT) AS phi_blocked, count(*) FILTER (WHERE severity = 'P1') AS p1,
              count(*) FILTER (WHERE severity = 'P2') AS p2, count(*) FILTER (WHERE severity = 'P3') AS p3 FROM alerts_v""",
)
def _summary(lake: Lake) -> DataFrame:
    return al.summary(alerts(lake))


@register(
    "alert_messages",
    f"""SELECT alert_id, ':warning: [' || CASE severity WHEN 'P1' THEN 'P1 Critical' ELSE 'P2 Warning' END || '] ' || entity_id || ' — Anomaly Detected' || chr(10)
              || 'Metric: ' || metric || ' | Detector: ' || detector || chr(10)
              || coalesce('Expected: $' || {whole_sql('expected')} || ' | Actual: $' || {whole_sql('actual')}
                          || coalesce(' | Δ: ' || CASE WHEN deviation_pct >= 0 THEN '+' ELSE '' END || printf('%.1f', round(deviation_pct * 100, 4)) || '%', '')
                          || chr(10), '')
              || driver_narrative || chr(10) || '→ Dashboard: ' || dashboard_link AS message FROM alerts_v""",
)
def _messages(lake: Lake) -> DataFrame:
    rows = al.deliverable(alerts(lake))
    return rows.select("alert_id", al.message_text(rows).alias("message"))


@register(
    "alert_ack",
    """SELECT alert_id, CASE WHEN severity = 'P2' THEN 'acknowledged' ELSE 'open' END AS status,
              CASE WHEN severity = 'P2' THEN 'ops-' || entity_type END AS acknowledged_by, severity = 'P2' AS changed FROM alerts_v""",
)
def _ack(lake: Lake) -> DataFrame:
    rows = materialise(al.deliverable(alerts(lake)), "alerts")
    acks = rows.filter("severity = 'P2'").select(
        "alert_id", F.concat(F.lit("ops-"), "entity_type").alias("user_id"), F.col("created_at").alias("acked_at")
    )
    return al.acknowledge(rows, acks).select("alert_id", "status", "acknowledged_by", "changed")


@register(
    "alert_outcomes",
    f"""SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, severity, count(*) AS alerts,
               round(avg(CASE WHEN severity = 'P2' THEN 1.0 ELSE 0.0 END), 6) AS acknowledged_rate,
               round(avg(CASE WHEN entity_type = 'case_type' THEN 1.0 ELSE 0.0 END), 6) AS dismissed_rate,
               severity = 'P1' AND avg(CASE WHEN entity_type = 'case_type' THEN 1.0 ELSE 0.0 END) > {monitor.DISMISSED_P1_BAR} AS over_target
        FROM alerts_v GROUP BY 1, severity""",
)
def _outcomes(lake: Lake) -> DataFrame:
    """P2 alerts are acknowledged and alerts of case types dismissed, twice each."""
    rows = materialise(al.deliverable(alerts(lake)), "alerts")
    acks = rows.filter("severity = 'P2'").select("alert_id", F.lit("ops").alias("user_id"), F.col("created_at").alias("acked_at"))
    dismissals = rows.filter("entity_type = 'case_type'").select("alert_id")
    outcomes = monitor.alert_outcomes(al.acknowledge(rows, acks), dismissals.unionByName(dismissals))
    return rounded(outcomes, {"acknowledged_rate": 6, "dismissed_rate": 6})


@register(
    "alerts_page",
    """SELECT alert_id, entity_type, entity_id, severity FROM alerts_v WHERE severity = 'P1'
       ORDER BY created_at DESC, alert_id LIMIT 10 OFFSET 2""",
)
def _page(lake: Lake) -> DataFrame:
    rows = al.list_alerts(al.deliverable(alerts(lake)), severity="P1", status="open", limit=10, offset=2)
    return rows.select("alert_id", "entity_type", "entity_id", "severity")
