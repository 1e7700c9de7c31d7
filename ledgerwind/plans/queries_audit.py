"""Registered queries: audit chains and compliance events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.functions import phi
from ledgerwind.operators import audit
from ledgerwind.plans.catalog import register
from ledgerwind.plans.oracle_views import scan_sql, view
from ledgerwind.sources.questions import questions
from ledgerwind.sources.tables import Lake

FIELDS = ["conv_id", "role", "text", "turn"]

view("chain_rows_v", """
SELECT conv_id, turn, role, text, to_json({'conv_id': conv_id, 'role': role, 'text': text, 'turn': turn}) AS canon FROM conversations
""")
view("chain_ordered_v", "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM chain_rows_v")
view("chain_v", """
SELECT conv_id, turn, role, i, '' AS prev_hash, sha256('' || canon) AS row_hash FROM chain_ordered_v WHERE i = 1
UNION ALL
SELECT r.conv_id, r.turn, r.role, r.i, c.row_hash, sha256(c.row_hash || r.canon)
FROM chain_v c JOIN chain_ordered_v r ON r.conv_id = c.conv_id AND r.i = c.i + 1
""")


EVENT_FIELDS = ["event_id", "event_type", "user_id"]

view("event_rows_v", """
SELECT event_id, event_type, to_json({'event_id': event_id, 'event_type': event_type, 'user_id': user_id}) AS canon,
       row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events
""")
view("event_chain_v", """
SELECT event_id, event_type, i, '' AS prev_hash, sha256('' || canon) AS row_hash FROM event_rows_v WHERE i = 1
UNION ALL
SELECT r.event_id, r.event_type, r.i, c.row_hash, sha256(c.row_hash || r.canon)
FROM event_chain_v c JOIN event_rows_v r ON r.event_type = c.event_type AND r.i = c.i + 1
""")


def long_chains(lake: Lake) -> DataFrame:
    rows = lake.table("events").select(*EVENT_FIELDS)
    return audit.build_chain(rows, "event_type", "event_id", EVENT_FIELDS)


@register("chain_long", "SELECT event_id, event_type, prev_hash, row_hash FROM event_chain_v")
def _long(lake: Lake) -> DataFrame:
    return long_chains(lake).select("event_id", "event_type", "prev_hash", "row_hash")


@register(
    "chain_long_deletions",
    """SELECT event_type, event_id FROM (
         SELECT event_type, event_id, gone, lag(gone) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM (
           SELECT event_type, event_id, i BETWEEN 6 AND 10 OR i BETWEEN 991 AND 1000 OR i BETWEEN 1101 AND 2000 AS gone FROM event_rows_v))
       WHERE before AND NOT gone""",
)
def _long_deletions(lake: Lake) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    gone = F.col("_i").between(6, 10) | F.col("_i").between(991, 1000) | F.col("_i").between(1101, 2000)
    kept = long_chains(lake).withColumn("_i", place).filter(~gone).drop("_i")
    return audit.broken_rows(kept, "event_type", "event_id", EVENT_FIELDS).select("event_type", "event_id")


def chained(lake: Lake) -> DataFrame:
    return audit.build_chain(lake.table("conversations"), "conv_id", "turn", FIELDS)


@register("chain_build", "SELECT conv_id, turn, role, prev_hash, row_hash FROM chain_v")
def _build(lake: Lake) -> DataFrame:
    return chained(lake).select("conv_id", "turn", "role", "prev_hash", "row_hash")


@register(
    "chain_verify",
    """SELECT c.conv_id, bool_and(NOT bad) AS is_intact, coalesce(min(c.turn) FILTER (WHERE bad), -1) AS first_broken
       FROM (SELECT conv_id, turn, conv_id % 3 = 0 AND turn = 2 AS bad FROM conversations) c GROUP BY c.conv_id""",
)
def _verify(lake: Lake) -> DataFrame:
    edited = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 2), F.lit("edited")).otherwise(F.col("role"))
    return audit.verify_chain(chained(lake).withColumn("role", edited), "conv_id", "turn", FIELDS)


@register(
    "chain_deletions",
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
       WHERE p = 1 AND conv_id % 2 = 0
         AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)""",
)
def _deletions(lake: Lake) -> DataFrame:
    kept = chained(lake).filter(~((F.col("conv_id") % 2 == 0) & (F.col("turn") == 1)))
    return audit.broken_rows(kept, "conv_id", "turn", FIELDS).select("conv_id", "turn")


@register(
    "chain_seals",
    """SELECT conv_id, CAST(0 AS BIGINT) AS segment, arg_max(row_hash, turn) AS tail_hash, count(*) AS rows,
              sha256(to_json({'rows': count(*), 'tail_hash': arg_max(row_hash, turn)})) AS row_hash FROM chain_v GROUP BY conv_id""",
)
def _seals(lake: Lake) -> DataFrame:
    seals = audit.chain_seals(chained(lake), "conv_id", "turn")
    return seals.select("conv_id", F.lit(0).cast("bigint").alias("segment"), "tail_hash", "rows", "row_hash")


@register(
    "compliance_events",
    f"""SELECT question_id AS session_id, 'PHI_DETECTED_INPUT' AS action, 'blocked' AS input_phi_scan,
               '{{"matches":["' || label || '"],"compliance_alert":true}}' AS detail_json, sha256('chatbot|INPUT|' || question_id) AS event_id
        FROM (SELECT question_id, {scan_sql('question')} AS label FROM questions_v) WHERE label IS NOT NULL""",
)
def _compliance(lake: Lake) -> DataFrame:
    labels = F.array_compact(F.array(phi.scan_input(F.col("question"))))
    scanned = questions(lake).withColumn("labels", labels)
    events = audit.compliance_events(scanned, "question_id", "labels", "INPUT", "chatbot")
    return events.select("session_id", "action", "input_phi_scan", "detail_json", "event_id")


@register("query_hashes", "SELECT conv_id, turn, sha256(text) AS query_hash FROM conversations")
def _hashes(lake: Lake) -> DataFrame:
    return lake.table("conversations").select("conv_id", "turn", F.sha2("text", 256).alias("query_hash"))
