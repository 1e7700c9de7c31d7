"""Registered queries: request-limit replay over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerwind.operators.ratelimit import replay
from ledgerwind.plans.catalog import register
from ledgerwind.plans.oracle_views import view
from ledgerwind.sources.tables import Lake

view("requests_v", """
SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
""")


def _walk(name: str, limit: int, seconds: int) -> str:
    span = seconds * 1_000_000
    view(name, f"""
SELECT user_id, i, event_id, true AS admitted, [us] AS log FROM requests_v WHERE i = 1
UNION ALL
SELECT user_id, i, event_id, len(log) < {limit} AS admitted, CASE WHEN len(log) < {limit} THEN list_append(log, us) ELSE log END AS log
FROM (SELECT r.user_id, r.i, r.event_id, r.us, list_filter(w.log, lambda t: r.us - t <= {span}) AS log
      FROM {name} w JOIN requests_v r ON r.user_id = w.user_id AND r.i = w.i + 1)
""")
    return f"SELECT event_id, user_id, admitted FROM {name}"


@register("rate_limit_replay", _walk("walk_default_v", 120, 60))
def _default(lake: Lake) -> DataFrame:
    return replay(lake.table("events"), "user_id", "ts", "event_id").drop("ts")


@register("rate_limit_tight", _walk("walk_tight_v", 2, 6 * 3600))
def _tight(lake: Lake) -> DataFrame:
    return replay(lake.table("events"), "user_id", "ts", "event_id", limit=2, seconds=6 * 3600).drop("ts")
