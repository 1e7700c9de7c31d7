"""Named DuckDB subqueries that the check statements are assembled from.

``statement(body)`` prefixes a statement with exactly the views it mentions,
directly or through other views, each after those it reads.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, text: str) -> None:
    VIEWS[name] = text.strip()


def statement(body: str) -> str:
    ordered: list[str] = []

    def need(text: str, inside: str = "") -> None:
        for name in VIEWS:
            if name != inside and name not in ordered and re.search(rf"\b{name}\b", text):
                need(VIEWS[name], name)
                ordered.append(name)

    need(body)
    if not ordered:
        return body.strip()
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in ordered) + "\n" + body.strip()


view("collections_v", """
SELECT concat_ws('-', l_orderkey, l_linenumber) AS collection_id, sr.r_name AS facility_id, sn.n_name AS attorney_id,
       c_mktsegment AS case_type, CAST(l_shipdate AS DATE) AS collection_date,
       l_extendedprice * (1 - l_discount) AS amount_collected,
       datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days_outstanding
FROM lineitem
LEFT JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey
LEFT JOIN region sr ON sr.r_regionkey = sn.n_regionkey
LEFT JOIN orders ON o_orderkey = l_orderkey
LEFT JOIN customer ON c_custkey = o_custkey
""")

view("visits_v", """
SELECT o_orderkey AS visit_id, r_name AS facility_id, c_mktsegment AS case_type, CAST(o_orderdate AS DATE) AS visit_date,
       CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'unpaid' ELSE 'pending' END AS billing_status,
       o_totalprice AS billed_amount, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS paid_amount,
       o_orderpriority AS provider_id
FROM orders
LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey
""")

view("last_shipped_v", "SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS last_shipped FROM lineitem GROUP BY l_orderkey")

view("settlements_v", """
SELECT o_orderkey AS settlement_id, n_name AS attorney_id, c_mktsegment AS case_type,
       CAST(o_orderdate AS DATE) AS open_date,
       CASE WHEN last_shipped >= CAST(o_orderdate AS DATE) THEN last_shipped END AS close_date,
       o_totalprice AS settlement_amount,
       CASE WHEN last_shipped >= CAST(o_orderdate AS DATE) THEN 'closed' ELSE 'open' END AS settlement_status
FROM orders
LEFT JOIN last_shipped_v ON l_orderkey = o_orderkey
LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey
""")

view("lop_v", """
SELECT concat_ws('-', l_orderkey, l_linenumber) AS lop_id, r_name AS facility_id, c_mktsegment AS case_type,
       CAST(o_orderdate AS DATE) AS issued_date,
       CASE WHEN l_shipdate >= o_orderdate THEN CAST(l_shipdate AS DATE) END AS returned_date,
       CASE WHEN l_shipdate >= o_orderdate THEN CASE l_returnflag WHEN 'R' THEN 'rejected' ELSE 'returned' END
            ELSE 'open' END AS status,
       CASE WHEN l_shipdate >= o_orderdate AND l_returnflag = 'R' THEN l_linestatus END AS rejection_reason
FROM lineitem
JOIN orders ON o_orderkey = l_orderkey
LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN nation ON n_nationkey = s_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey
""")

view("aging_grid_v", """
SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 7 DAY)) AS DATE) AS report_date
FROM orders
""")

view("aging_orders_v", """
SELECT n_name AS attorney_id, r_name AS facility_id, CAST(o_orderdate AS DATE) AS day,
       sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END) AS balance
FROM orders
LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey
GROUP BY ALL
""")

view("aging_v", """
SELECT attorney_id, facility_id, report_date,
       coalesce(sum(balance) FILTER (WHERE age BETWEEN 0 AND 30), 0) AS bucket_0_30,
       coalesce(sum(balance) FILTER (WHERE age BETWEEN 31 AND 60), 0) AS bucket_31_60,
       coalesce(sum(balance) FILTER (WHERE age BETWEEN 61 AND 90), 0) AS bucket_61_90,
       coalesce(sum(balance) FILTER (WHERE age BETWEEN 91 AND 180), 0) AS bucket_91_180,
       coalesce(sum(balance) FILTER (WHERE age > 180), 0) AS bucket_180_plus
FROM (SELECT attorney_id, facility_id, report_date, balance, datediff('day', day, report_date) AS age
      FROM aging_orders_v, aging_grid_v)
GROUP BY ALL
""")

view("facility_daily_v", """
SELECT facility_id, collection_date AS d, sum(amount_collected) AS y FROM collections_v GROUP BY ALL
""")

view("facility_dense_v", """
SELECT g.facility_id, g.d, coalesce(f.y, 0) AS y
FROM (SELECT facility_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d
      FROM facility_daily_v GROUP BY facility_id) g
LEFT JOIN facility_daily_v f ON f.facility_id = g.facility_id AND f.d = g.d
""")

view("facility_roll_v", """
SELECT facility_id, d, y,
       sum(y) OVER (PARTITION BY facility_id ORDER BY d ROWS 6 PRECEDING) AS y7,
       sum(y) OVER (PARTITION BY facility_id ORDER BY d ROWS 29 PRECEDING) AS y30
FROM facility_dense_v
""")

view("facility_month_v", """
SELECT facility_id, date_trunc('month', d) AS m, sum(y) AS total FROM facility_dense_v GROUP BY ALL
""")

view("facility_features_v", """
SELECT a.facility_id, a.d AS event_date, a.y AS collections_1d, a.y7 AS collections_7d_rolling,
       a.y30 AS collections_30d_rolling,
       CASE WHEN p.total > 0 THEN (t.total - p.total) / p.total END AS collections_mom_growth,
       CASE WHEN b.y30 > 0 THEN (a.y30 - b.y30) / b.y30 END AS collections_yoy_growth,
       isodow(a.d) - 1 AS day_of_week, month(a.d) AS month, day(a.d) >= 28 AS is_month_end
FROM facility_roll_v a
JOIN facility_month_v t ON t.facility_id = a.facility_id AND t.m = date_trunc('month', a.d)
LEFT JOIN facility_month_v p ON p.facility_id = a.facility_id AND p.m = date_trunc('month', a.d) - INTERVAL 1 MONTH
LEFT JOIN facility_roll_v b ON b.facility_id = a.facility_id AND b.d = a.d - INTERVAL 365 DAY
""")

view("aging_features_v", """
SELECT attorney_id, report_date AS event_date, b1, b2, b3, b4, b5, total,
       CASE WHEN total > 0 THEN b5 / total ELSE 0 END AS pct,
       CASE WHEN total > 0 THEN (b1*15 + b2*45 + b3*75 + b4*135 + b5*270) / total ELSE 0 END AS avg_days
FROM (SELECT attorney_id, report_date, sum(bucket_0_30) AS b1, sum(bucket_31_60) AS b2, sum(bucket_61_90) AS b3,
             sum(bucket_91_180) AS b4, sum(bucket_180_plus) AS b5,
             sum(bucket_0_30 + bucket_31_60 + bucket_61_90 + bucket_91_180 + bucket_180_plus) AS total
      FROM aging_v GROUP BY ALL)
""")

view("attorney_features_v", """
SELECT attorney_id, event_date, b1 AS bucket_0_30_balance, b2 AS bucket_31_60_balance, b3 AS bucket_61_90_balance,
       b4 AS bucket_91_180_balance, b5 AS bucket_180_plus_balance, total AS total_outstanding, pct AS pct_180_plus,
       avg_days AS avg_days_outstanding,
       pct - lag(pct, 4) OVER (PARTITION BY attorney_id ORDER BY event_date) AS aging_migration_rate_30d
FROM aging_features_v
""")

view("visit_daily_v", """
SELECT facility_id, case_type, visit_date AS d, count(*) AS n, count(*) FILTER (WHERE billed_amount > 0) AS billed,
       count(*) FILTER (WHERE billing_status = 'pending') AS pending
FROM visits_v GROUP BY ALL
""")

view("visit_calendar_v", """
SELECT facility_id, case_type, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d
FROM visit_daily_v GROUP BY facility_id, case_type
""")

view("visit_features_v", """
SELECT c.facility_id, c.case_type, c.d AS event_date,
       CAST(sum(v.n) FILTER (WHERE v.d > c.d - 7) AS BIGINT) AS n7, CAST(sum(v.n) AS BIGINT) AS n30,
       CAST(sum(v.billed) FILTER (WHERE v.d > c.d - 7) AS DOUBLE) AS b7,
       CAST(sum(v.pending) FILTER (WHERE v.d > c.d - 7) AS DOUBLE) AS p7
FROM visit_calendar_v c
LEFT JOIN visit_daily_v v ON v.facility_id = c.facility_id AND v.case_type = c.case_type AND v.d <= c.d AND v.d > c.d - 30
GROUP BY ALL
""")

view("settlement_grid_v", """
SELECT attorney_id, case_type, d FROM (SELECT DISTINCT attorney_id, case_type FROM settlements_v),
     (SELECT CAST(unnest(generate_series(min(open_date), greatest(max(open_date), max(close_date)), INTERVAL 7 DAY)) AS DATE) AS d
      FROM settlements_v)
""")

view("settlement_features_v", """
SELECT attorney_id, case_type, d AS event_date, open_settlements_count, settlements_closed_30d,
       CASE WHEN closed90 > 0 THEN days90 / closed90 END AS avg_days_to_settlement_90d,
       CASE WHEN before30 > 0 THEN (settlements_closed_30d - before30) / before30 END AS settlement_velocity_change_30d,
       high_value_open_count
FROM (
  SELECT g.attorney_id, g.case_type, g.d,
         count(*) FILTER (WHERE s.open_date <= g.d AND (s.close_date IS NULL OR s.close_date > g.d)) AS open_settlements_count,
         count(*) FILTER (WHERE s.open_date <= g.d AND (s.close_date IS NULL OR s.close_date > g.d)
                            AND s.settlement_amount > 50000) AS high_value_open_count,
         count(*) FILTER (WHERE s.close_date > g.d - 30 AND s.close_date <= g.d) AS settlements_closed_30d,
         count(*) FILTER (WHERE s.close_date > g.d - 60 AND s.close_date <= g.d - 30) AS before30,
         count(*) FILTER (WHERE s.close_date > g.d - 90 AND s.close_date <= g.d) AS closed90,
         CAST(sum(s.close_date - s.open_date) FILTER (WHERE s.close_date > g.d - 90 AND s.close_date <= g.d) AS DOUBLE) AS days90
  FROM settlement_grid_v g
  JOIN settlements_v s ON s.attorney_id = g.attorney_id AND s.case_type = g.case_type
  GROUP BY ALL)
""")

view("lop_grid_v", """
SELECT facility_id, d FROM (SELECT DISTINCT facility_id FROM lop_v),
     (SELECT CAST(unnest(generate_series(min(issued_date), greatest(max(issued_date), max(returned_date)), INTERVAL 7 DAY)) AS DATE) AS d
      FROM lop_v)
""")

view("lop_features_v", """
SELECT g.facility_id, g.d AS event_date,
       count(*) FILTER (WHERE l.issued_date > g.d - 7 AND l.issued_date <= g.d) AS lop_issued_7d,
       count(*) FILTER (WHERE l.returned_date > g.d - 7 AND l.returned_date <= g.d) AS lop_returned_7d,
       coalesce(avg(CASE WHEN l.status = 'rejected' THEN 1.0 ELSE 0.0 END)
                FILTER (WHERE l.returned_date > g.d - 30 AND l.returned_date <= g.d), 0) AS lop_rejection_rate_30d,
       quantile_cont(l.returned_date - l.issued_date, 0.5)
                FILTER (WHERE l.returned_date > g.d - 30 AND l.returned_date <= g.d) AS lop_turnaround_days_p50,
       quantile_cont(l.returned_date - l.issued_date, 0.9)
                FILTER (WHERE l.returned_date > g.d - 30 AND l.returned_date <= g.d) AS lop_turnaround_days_p90,
       count(*) FILTER (WHERE l.issued_date <= g.d - 60 AND (l.returned_date IS NULL OR l.returned_date > g.d)) AS lop_backlog_count
FROM lop_grid_v g JOIN lop_v l ON l.facility_id = g.facility_id
GROUP BY ALL
""")

from ledgerwind import fixed_values as fv  # noqa: E402
from ledgerwind.sources.questions import CUSTOMER_QUESTION, LOG_QUESTION, LOG_SQL  # noqa: E402

view("questions_v", f"""
SELECT concat('c-', c_custkey) AS question_id, {CUSTOMER_QUESTION} AS question
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
UNION ALL
SELECT concat('t-', conv_id, '-', turn), text FROM conversations WHERE role = 'user'
""")

view("query_log_v", f"""
SELECT o_orderkey AS log_id, {LOG_QUESTION} AS question, {LOG_SQL} AS sql_text,
       CAST(floor(o_totalprice) AS BIGINT) AS row_count, CAST(o_orderdate AS DATE) AS asked_on
FROM orders
""")


def literal_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def folded(text: str) -> str:
    """Text whose non-ASCII letters are ``_`` (a word character) and other non-ASCII ``.``.

    RE2's word boundary only knows ASCII; this gives it the Unicode meaning.
    """
    return rf"regexp_replace(regexp_replace({text}, '[^\x00-\x7F\p{{L}}\p{{N}}]', '.', 'g'), '[^\x00-\x7F]', '_', 'g')"


def names_sql(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all({folded(text)}, '{fv.PROPER_NAME_PATTERN}'), "
        rf"lambda m: NOT list_has_any(regexp_split_to_array(lower(m), '\s+'), {literal_list(fv.ALLOWED_NAME_WORDS)}))"
    )


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def scan_sql(text: str) -> str:
    rules = " ".join(
        f"WHEN regexp_matches({text}, {quoted(pattern)}) THEN '{label}'" for label, pattern in fv.PHI_PATTERNS
    )
    return f"CASE {rules} WHEN len({names_sql(text)}) > 0 THEN '{fv.PERSON_LABEL}' END"


def cleaned_sql(text: str) -> str:
    for _, pattern in fv.PHI_PATTERNS:
        text = f"regexp_replace({text}, {quoted(pattern)}, '{fv.REDACTED}', 'g')"
    return text


def normal_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))"


view("daily3_v", """
SELECT 'facility' AS entity_type, facility_id AS entity_id, collection_date AS d, sum(amount_collected) AS y FROM collections_v GROUP BY ALL
UNION ALL
SELECT 'attorney', attorney_id, collection_date, sum(amount_collected) FROM collections_v GROUP BY ALL
UNION ALL
SELECT 'case_type', case_type, collection_date, sum(amount_collected) FROM collections_v GROUP BY ALL
""")

view("dense3_v", """
SELECT g.entity_type, g.entity_id, g.d, g.t, g.n, coalesce(f.y, 0) AS y
FROM (SELECT entity_type, entity_id, n, d0 + CAST(i AS INTEGER) AS d, CAST(i AS BIGINT) AS t
      FROM (SELECT entity_type, entity_id, min(d) AS d0, datediff('day', min(d), max(d)) + 1 AS n,
                   unnest(generate_series(0, datediff('day', min(d), max(d)))) AS i
            FROM daily3_v GROUP BY entity_type, entity_id)) g
LEFT JOIN daily3_v f ON f.entity_type = g.entity_type AND f.entity_id = g.entity_id AND f.d = g.d
""")

# run 2 is the whole series, run 1 stops a year earlier
view("runs_v", """
SELECT 2 AS run, entity_type, entity_id, d, t, n, y FROM dense3_v
UNION ALL
SELECT 1, entity_type, entity_id, d, t, n - 365, y FROM dense3_v WHERE t < n - 365
""")

view("train_v", """
SELECT run, entity_type, entity_id, -1 AS fold, d, t, y FROM runs_v WHERE run = 2
UNION ALL
SELECT run, entity_type, entity_id, f.fold, d, t, y FROM runs_v, (SELECT unnest([0, 1, 2, 3]) AS fold) f
WHERE n - (f.fold + 1) * 30 >= 30 AND t < n - (f.fold + 1) * 30
  AND f.fold < CASE WHEN n < 90 THEN greatest(1, floor((n - 30) / 30.0) - 1) ELSE 4 END
""")

view("line_v", """
SELECT run, entity_type, entity_id, fold, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept,
       count(*) AS n, max(d) AS last_d
FROM train_v GROUP BY ALL
""")

view("detrended_v", """
SELECT t.run, t.entity_type, t.entity_id, t.fold, isodow(t.d) - 1 AS wd, month(t.d) AS mo, t.y - (l.slope * t.t + l.intercept) AS e
FROM train_v t JOIN line_v l USING (run, entity_type, entity_id, fold)
""")

view("weekday_v", "SELECT run, entity_type, entity_id, fold, wd, avg(e) AS off FROM detrended_v GROUP BY ALL")

view("deseasoned_v", """
SELECT run, entity_type, entity_id, fold, mo, e - w.off AS e FROM detrended_v JOIN weekday_v w USING (run, entity_type, entity_id, fold, wd)
""")

view("monthly_v", "SELECT run, entity_type, entity_id, fold, mo, avg(e) AS off FROM deseasoned_v GROUP BY ALL")

view("resid_v", """
SELECT run, entity_type, entity_id, fold, stddev_pop(e - m.off) AS sigma
FROM deseasoned_v JOIN monthly_v m USING (run, entity_type, entity_id, fold, mo) GROUP BY ALL
""")

view("ahead_v", """
SELECT l.run, l.entity_type, l.entity_id, l.fold, i.i, l.last_d + CAST(i.i AS INTEGER) AS d,
       greatest(0, l.slope * (l.n + i.i - 1) + l.intercept + coalesce(w.off, 0) + coalesce(m.off, 0)) AS predicted
FROM line_v l
JOIN (SELECT unnest(generate_series(1, 90)) AS i) i ON l.fold = -1 OR i.i <= 30
LEFT JOIN weekday_v w ON w.run = l.run AND w.entity_type = l.entity_type AND w.entity_id = l.entity_id AND w.fold = l.fold
      AND w.wd = isodow(l.last_d + CAST(i.i AS INTEGER)) - 1
LEFT JOIN monthly_v m ON m.run = l.run AND m.entity_type = l.entity_type AND m.entity_id = l.entity_id AND m.fold = l.fold
      AND m.mo = month(l.last_d + CAST(i.i AS INTEGER))
""")

view("bands_v", """
SELECT run, entity_type, entity_id, fold, h AS horizon_days, last_d, round(total, 2) AS predicted,
       round(greatest(0, total - 1.2816 * sigma * sqrt(h)), 2) AS ci_lower, round(total + 1.2816 * sigma * sqrt(h), 2) AS ci_upper,
       round(total + 1.96 * sigma * sqrt(h), 2) AS p95
FROM (SELECT run, entity_type, entity_id, fold, CAST(h AS INTEGER) AS h, max(l.last_d) AS last_d, sum(predicted) AS total
      FROM ahead_v JOIN line_v l USING (run, entity_type, entity_id, fold), (SELECT unnest([30, 60, 90]) AS h)
      WHERE i <= h AND (fold = -1 OR h = 30) GROUP BY ALL) JOIN resid_v USING (run, entity_type, entity_id, fold)
""")

view("fold_results_v", """
SELECT b.run, b.entity_type, b.entity_id, b.fold, a.actual, b.predicted, b.ci_lower, b.ci_upper
FROM bands_v b
JOIN (SELECT run, entity_type, entity_id, f.fold, sum(y) AS actual FROM runs_v, (SELECT unnest([0, 1, 2, 3]) AS fold) f
      WHERE t >= n - (f.fold + 1) * 30 AND t < n - f.fold * 30 GROUP BY ALL) a USING (run, entity_type, entity_id, fold)
WHERE b.fold >= 0 AND a.actual > 0
""")

view("backtest_v", """
SELECT r.run, r.entity_type, r.entity_id, CAST(r.n AS BIGINT) AS history_days, f.mape, f.rmse, f.coverage, f.bias, coalesce(f.folds, 0) AS folds
FROM (SELECT DISTINCT run, entity_type, entity_id, n FROM runs_v) r
LEFT JOIN (SELECT run, entity_type, entity_id, avg(abs(predicted - actual) / actual) AS mape,
                  sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse,
                  avg(CASE WHEN actual BETWEEN ci_lower AND ci_upper THEN 1.0 ELSE 0.0 END) AS coverage,
                  avg((predicted - actual) / actual) AS bias, count(*) AS folds
           FROM fold_results_v GROUP BY ALL) f USING (run, entity_type, entity_id)
""")

view("gate_v", """
SELECT 'collections_' || n.entity_type || '_' || n.entity_id AS model_name, 2 AS version, n.mape, o.mape AS champion_mape,
       CASE WHEN n.mape IS NOT NULL AND o.mape IS NOT NULL THEN (n.mape - o.mape) * 100 <= 1.0
            ELSE o.mape IS NULL AND n.mape IS NOT NULL END AS promoted,
       coalesce((n.mape - o.mape) * 100 > 3.0, false) AS blocked
FROM backtest_v n JOIN backtest_v o ON o.entity_type = n.entity_type AND o.entity_id = n.entity_id AND o.run = 1
WHERE n.run = 2
""")

view("registry_v", """
SELECT 'collections_' || entity_type || '_' || entity_id AS model_name, 1 AS version,
       CASE WHEN g.promoted THEN 'Archived' ELSE 'Production' END AS stage, b.mape, b.coverage
FROM backtest_v b JOIN gate_v g ON g.model_name = 'collections_' || entity_type || '_' || entity_id WHERE b.run = 1
UNION ALL
SELECT model_name, 2, CASE WHEN promoted THEN 'Production' ELSE 'Staging' END, b.mape, b.coverage
FROM gate_v JOIN backtest_v b ON model_name = 'collections_' || entity_type || '_' || entity_id AND b.run = 2
""")


view("deviation_v", """
SELECT s.entity_type, s.entity_id, 'collections_7d' AS metric, 'forecast_deviation' AS detector, f.predicted * (7.0 / 30.0) AS expected,
       s.actual, (s.actual - f.predicted * (7.0 / 30.0)) / (f.predicted * (7.0 / 30.0)) AS deviation_pct, CAST(NULL AS DOUBLE) AS score
FROM (SELECT entity_type, entity_id, sum(y) AS actual FROM dense3_v WHERE n >= 7 AND t >= n - 7 GROUP BY ALL) s
JOIN (SELECT entity_type, entity_id, CAST(predicted AS DOUBLE) AS predicted FROM bands_v WHERE fold = -1 AND horizon_days = 30) f USING (entity_type, entity_id)
WHERE f.predicted > 0
""")

view("deviation_findings_v", """
SELECT d.*, CASE WHEN deviation_pct <= forecast_deviation_p1_pct THEN 'P1' ELSE 'P2' END AS severity
FROM deviation_v d JOIN thresholds_v USING (entity_type, entity_id) WHERE deviation_pct <= forecast_deviation_p2_pct
""")

view("cusum_ref_v", """
SELECT entity_type, entity_id, avg(y) AS mu, stddev_samp(y) AS sigma
FROM dense3_v WHERE n - t > 90 AND n - t <= 180 AND n >= 100 GROUP BY ALL
""")

view("cusum_z_v", """
SELECT entity_type, entity_id, t - (n - 90) AS i, y, mu, (y - mu) / sigma + 0.5 AS step
FROM dense3_v JOIN cusum_ref_v USING (entity_type, entity_id) WHERE n - t <= 90 AND sigma > 0
""")

# the recurrence itself, one step per level of recursion
view("cusum_walk_v", """
SELECT entity_type, entity_id, i, y, mu, least(0, step) AS s FROM cusum_z_v WHERE i = 0
UNION ALL
SELECT z.entity_type, z.entity_id, z.i, z.y, z.mu, least(0, w.s + z.step)
FROM cusum_walk_v w JOIN cusum_z_v z ON z.entity_type = w.entity_type AND z.entity_id = w.entity_id AND z.i = w.i + 1
""")

view("cusum_v", """
SELECT entity_type, entity_id, max(mu) AS expected, arg_max(y, i) AS actual, abs(min(s)) AS score FROM cusum_walk_v GROUP BY ALL
""")

view("cusum_findings_v", """
SELECT entity_type, entity_id, 'collections_1d_cusum' AS metric, 'cusum' AS detector, expected, actual,
       CAST(NULL AS DOUBLE) AS deviation_pct, score, CASE WHEN score >= cusum_p1_sigma THEN 'P1' ELSE 'P2' END AS severity
FROM cusum_v JOIN thresholds_v USING (entity_type, entity_id) WHERE score >= cusum_p2_sigma
""")

view("findings_v", """
SELECT 1 AS place, entity_type, entity_id, metric, detector, expected, actual, deviation_pct, score, severity FROM deviation_findings_v
UNION ALL
SELECT 2, entity_type, entity_id, metric, detector, expected, actual, deviation_pct, score, severity FROM cusum_findings_v
""")

view("combined_v", """
SELECT b.entity_type, b.entity_id, b.metric, b.detector, b.expected, b.actual, b.deviation_pct, b.score,
       CASE WHEN c.k >= 2 AND b.severity <> 'P1' THEN 'P1' ELSE b.severity END AS severity,
       c.k >= 2 AND b.severity <> 'P1' AS escalated, CASE WHEN c.k >= 2 AND b.severity <> 'P1' THEN c.names END AS agreeing_detectors
FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY severity, place) AS rn FROM findings_v) b
JOIN (SELECT entity_type, entity_id, count(*) AS k, string_agg(detector, ',' ORDER BY place) AS names FROM findings_v
      WHERE severity IN ('P1', 'P2') GROUP BY ALL) c USING (entity_type, entity_id)
WHERE rn = 1
""")


def title_sql(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '([A-Za-z]+|[^A-Za-z]+)'), "
        "lambda r: upper(r[1]) || lower(r[2:])), '')"
    )


def whole_sql(value: str) -> str:
    return f"format('{{:,}}', CAST(printf('%.0f', round({value}, 4)) AS BIGINT))"


view("velocity_latest_v", f"""
SELECT settlement_velocity_change_30d AS v, 'settlement velocity down ' || printf('%.0f', round(abs(settlement_velocity_change_30d) * 100, 4)) || '% (Attorney ' ||
       {title_sql('attorney_id')} || ')' AS text
FROM settlement_features_v f
WHERE event_date = (SELECT max(event_date) FROM settlement_features_v g WHERE g.attorney_id = f.attorney_id AND g.case_type = f.case_type)
  AND settlement_velocity_change_30d < -0.15
""")

view("turnaround_latest_v", f"""
SELECT facility_id AS entity_id, -lop_turnaround_days_p50 AS v, 'LOP turnaround elevated at ' || printf('%.0f', round(lop_turnaround_days_p50, 4)) || ' days median' AS text
FROM lop_features_v f WHERE event_date = (SELECT max(event_date) FROM lop_features_v g WHERE g.facility_id = f.facility_id)
  AND lop_turnaround_days_p50 > 45
""")

view("driver_v", """
SELECT entity_type, entity_id, coalesce('Likely driver: ' || (
         SELECT text FROM (SELECT v, text FROM velocity_latest_v UNION ALL SELECT v, text FROM turnaround_latest_v t WHERE t.entity_id = e.entity_id)
         ORDER BY v, text LIMIT 1) || '.', 'No single dominant driver identified in current feature signals.') AS driver_narrative
FROM entities_v e
""")


view("corpus_alerts_v", """
SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY alert_id) AS copy
FROM alerts_v
""")

view("corpus_v", f"""
SELECT 'facility_collections_' || facility_id || '_' || strftime(event_date, '%Y-%m-%d') AS source_doc_id, 'facility' AS entity_type, facility_id AS entity_id, event_date AS date,
       'Facility ' || {title_sql("replace(facility_id, '_', ' ')")} || ' collections summary as of ' || strftime(event_date, '%Y-%m-%d') || ': latest day $' || {whole_sql('collections_1d')}
       || ', 7-day rolling $' || {whole_sql('collections_7d_rolling')} || ', 30-day rolling $' || {whole_sql('collections_30d_rolling')}
       || '. Month-over-month growth ' || printf('%.1f', round(coalesce(collections_mom_growth, 0) * 100, 4)) || '%.' AS text, 'facility_collections' AS feature_group
FROM facility_features_v f WHERE event_date = (SELECT max(event_date) FROM facility_features_v g WHERE g.facility_id = f.facility_id)
UNION ALL
SELECT 'attorney_aging_' || attorney_id || '_' || strftime(event_date, '%Y-%m-%d'), 'attorney', attorney_id, event_date,
       'Attorney ' || {title_sql('attorney_id')} || ' aging report as of ' || strftime(event_date, '%Y-%m-%d') || ': total outstanding $' || {whole_sql('total_outstanding')}
       || '; 180+ day bucket $' || {whole_sql('bucket_180_plus_balance')} || ' (' || printf('%.1f', round(pct_180_plus * 100, 4)) || '% of total); average days outstanding '
       || printf('%.0f', round(avg_days_outstanding, 4)) || '.', 'attorney_aging'
FROM attorney_features_v f WHERE event_date = (SELECT max(event_date) FROM attorney_features_v g WHERE g.attorney_id = f.attorney_id)
UNION ALL
SELECT 'forecast_' || entity_type || '_' || entity_id || '_' || strftime(run_d, '%Y-%m-%d'), entity_type, entity_id, run_d,
       '30-day collections forecast for ' || entity_type || ' ' || entity_id || ' generated ' || strftime(run_d, '%Y-%m-%d') || ': predicted $' || {whole_sql('predicted')}
       || ' (80% CI $' || {whole_sql('ci_lower')} || '–$' || {whole_sql('ci_upper')} || ').', 'forecast'
FROM bands_v, (SELECT max(collection_date) + 1 AS run_d FROM collections_v) WHERE fold = -1 AND horizon_days = 30
UNION ALL
SELECT 'alert_' || entity_id || '_' || strftime(created_at, '%Y-%m-%d') || CASE WHEN copy > 1 THEN '_' || copy ELSE '' END, entity_type, entity_id, CAST(created_at AS DATE),
       'Anomaly alert [' || severity || '] for ' || entity_id || ' on ' || strftime(created_at, '%Y-%m-%d') || ': metric ' || metric || ', expected $'
       || {whole_sql('coalesce(expected, 0)')} || ', actual $' || {whole_sql('coalesce(actual, 0)')} || '. ' || driver_narrative, 'alert'
FROM corpus_alerts_v
""")

view("doc_words_v", r"""
SELECT source_doc_id, CAST('0x' || right(md5(w), 2) AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS n
FROM (SELECT source_doc_id, unnest(regexp_split_to_array(lower(text), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS w FROM corpus_v) WHERE w <> '' GROUP BY ALL
""")
view("question_words_v", r"""
SELECT question_id, CAST('0x' || right(md5(w), 2) AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS n
FROM (SELECT question_id, unnest(regexp_split_to_array(lower(question), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS w FROM questions_v) WHERE w <> '' GROUP BY ALL
""")
view("doc_norm_v", "SELECT source_doc_id, sqrt(sum(n * n)) AS norm FROM doc_words_v GROUP BY ALL")
view("question_norm_v", "SELECT question_id, sqrt(sum(n * n)) AS norm FROM question_words_v GROUP BY ALL")

view("question_entity_v", f"""
SELECT question_id, arg_max(entity_id, (len(ne), entity_id)) AS entity_id
FROM (SELECT question_id, {normal_sql('question')} AS nq FROM questions_v),
     (SELECT DISTINCT entity_id, {normal_sql('entity_id')} AS ne FROM corpus_v)
WHERE contains(nq, ne) GROUP BY question_id
""")

view("screened_v", f"""
SELECT q.question_id, question, {scan_sql('question')} AS label, e.entity_id,
       list_has_any(string_split({normal_sql('question')}, ' '), {literal_list(fv.DOMAIN_TERMS)}) AS relevant
FROM questions_v q LEFT JOIN question_entity_v e USING (question_id)
""")

view("hits_v", """
SELECT * FROM (
  SELECT c.question_id, c.source_doc_id, c.score, row_number() OVER (PARTITION BY c.question_id ORDER BY c.score DESC, c.source_doc_id) AS rank
  FROM (SELECT p.question_id, p.source_doc_id, round(coalesce(s.dot, 0) / (1 + 1e-9), 9) AS score
        FROM (SELECT question_id, d.source_doc_id FROM screened_v q JOIN corpus_v d ON q.entity_id IS NULL OR d.entity_id = q.entity_id
              WHERE label IS NULL AND (q.entity_id IS NOT NULL OR relevant)) p
        LEFT JOIN (SELECT q.question_id, d.source_doc_id, sum(q.n * d.n) / (any_value(qn.norm) * any_value(dn.norm)) AS dot
                   FROM question_words_v q JOIN doc_words_v d USING (bucket)
                   JOIN question_norm_v qn ON qn.question_id = q.question_id JOIN doc_norm_v dn ON dn.source_doc_id = d.source_doc_id
                   GROUP BY q.question_id, d.source_doc_id) s USING (question_id, source_doc_id)) c)
WHERE rank <= 8
""")

view("gated_v", """
SELECT q.question_id, q.question, q.entity_id AS entity_filter, coalesce(h.score, 0) AS top_score, h.source_doc_id AS top_doc,
       CASE WHEN label IS NOT NULL THEN 'input_phi_blocked'
            WHEN q.entity_id IS NULL AND NOT relevant THEN 'outside_financial_domain'
            WHEN h.question_id IS NULL THEN 'no_hits'
            WHEN h.score < 0.15 AND q.entity_id IS NULL THEN 'below_similarity_threshold'
            WHEN q.entity_id IS NOT NULL THEN 'entity_filter_match' ELSE 'threshold_passed' END AS reason
FROM screened_v q LEFT JOIN hits_v h ON h.question_id = q.question_id AND h.rank = 1
""")
