"""Registered queries: corpus, vector search, question gate, answers, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.operators import audit, retrieval as rt, store
from ledgerwind.plans import queries_alerts as qa
from ledgerwind.plans import queries_features as qf
from ledgerwind.plans import queries_forecast as qc
from ledgerwind.operators import alerts as al
from ledgerwind.operators import forecast as fc
from ledgerwind.plans.catalog import register
from ledgerwind.plans.oracle_views import view
from ledgerwind.session import materialise
from ledgerwind.sources.questions import questions
from ledgerwind.sources.tables import Lake


def corpus(lake: Lake) -> DataFrame:
    series = qa.stored_series(lake)
    forecasts = fc.forecast_batch(fc.fit_seasonal_trend(series.filter("n >= 30"), fc.ENTITY), qc.run_date_of(series), [30])
    facility = store.latest(qf.facility_features(lake).drop("mom_growth_to_date"), ["facility_id"])
    attorney = store.latest(qf.aging_features(lake), ["attorney_id"])
    return rt.build_corpus(facility, attorney, fc.latest_forecast(forecasts, 30), al.deliverable(qa.alerts(lake, series=series)))


def stored_index(lake: Lake) -> DataFrame:
    """The embedded corpus, written once; search, gate and citations read it."""
    return materialise(rt.index_documents(materialise(corpus(lake), "corpus")), "index")


@register("corpus_documents", "SELECT source_doc_id, entity_type, entity_id, date, text, feature_group FROM corpus_v")
def _corpus(lake: Lake) -> DataFrame:
    return corpus(lake).withColumn("feature_group", F.col("metadata")["feature_group"]).drop("metadata")


@register(
    "vector_records",
    """SELECT source_doc_id AS id, entity_type, entity_id, CAST(date AS VARCHAR) AS date, text, feature_group,
              CAST(CASE feature_group WHEN 'forecast' THEN 7 WHEN 'alert' THEN 7 ELSE 6 END AS BIGINT) AS n_metadata FROM corpus_v""",
)
def _records(lake: Lake) -> DataFrame:
    records = rt.to_record(stored_index(lake))
    back = rt.from_record(records)
    counts = records.select("id", F.size("metadata").cast("bigint").alias("n_metadata"))
    return back.join(counts, back.source_doc_id == counts.id).select(
        "id", "entity_type", "entity_id", "date", "text", F.col("metadata")["feature_group"].alias("feature_group"), "n_metadata"
    )


def label_centroids(lake: Lake) -> DataFrame:
    """Mean vector of every label, as one query per label."""
    cells = lake.table("embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = cells.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("vector")
    )


view("centroid_v", """
SELECT label, list(x ORDER BY pos) AS vector FROM (
  SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY ALL) GROUP BY label
""")

_TOPK = """
SELECT question_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT question_id, doc_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM (SELECT CAST(c.label AS VARCHAR) AS question_id, CAST(e.vec_id AS VARCHAR) AS doc_id,
               round(list_dot_product(c.vector, CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(c.vector, c.vector)) *
                     sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) + 1e-9), 9) AS score
        FROM centroid_v c JOIN embeddings e ON {condition})) WHERE rank <= 8"""


def _topk(lake: Lake, wanted) -> DataFrame:
    asked = label_centroids(lake).select(F.col("label").alias("question_id"), "vector", wanted.alias("entity_filter"))
    held = lake.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("entity_id"))
    return rt.search(asked, held).withColumn("score", F.round("score", 6))


@register("cosine_topk", _TOPK.format(condition="true"))
def _cosine(lake: Lake) -> DataFrame:
    return _topk(lake, F.lit(None).cast("string"))


# odd labels ask for an entity that exists, even ones for one that does not
@register("cosine_topk_filtered", _TOPK.format(condition="c.label % 2 = 0 OR e.label = c.label"))
def _cosine_filtered(lake: Lake) -> DataFrame:
    missing = F.concat(F.lit("missing-"), F.col("label"))
    return _topk(lake, F.when(F.col("label") % 2 == 1, F.col("label").cast("string")).otherwise(missing))


def screened(lake: Lake, index: DataFrame) -> DataFrame:
    return rt.screen(questions(lake), index.select("entity_id").distinct())


@register("entity_match", "SELECT question_id, entity_id AS entity_filter FROM question_entity_v")
def _match(lake: Lake) -> DataFrame:
    from ledgerwind.plans.queries_ingest import entities

    return rt.match_entities(questions(lake), entities(lake).select("entity_id").distinct())


@register("question_hits", "SELECT question_id, source_doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits_v")
def _hits(lake: Lake) -> DataFrame:
    index = stored_index(lake)
    asked = materialise(screened(lake, index), "screened")
    return rt.retrieve(asked, index).withColumn("score", F.round("score", 6))


def answers(lake: Lake) -> DataFrame:
    index = stored_index(lake)
    asked = materialise(screened(lake, index), "screened")
    return rt.answer(asked, rt.retrieve(asked, index), index)


@register(
    "answer_gate",
    """SELECT question_id, entity_filter, reason, reason = 'input_phi_blocked' AS blocked,
              CASE WHEN reason IN ('entity_filter_match', 'threshold_passed') THEN 'grounded' WHEN reason = 'input_phi_blocked' THEN 'skipped'
                   ELSE 'insufficient' END AS status, round(top_score, 6) AS top_score FROM gated_v""",
)
def _gate(lake: Lake) -> DataFrame:
    return answers(lake).select(
        "question_id", "entity_filter", "reason", "blocked", "status", F.round("top_score", 6).alias("top_score")
    )


view("answer_text_v", r"""
SELECT question_id, reason, CASE WHEN reason IN ('entity_filter_match', 'threshold_passed')
         THEN d.text || ' [Source: ' || source_doc_id || ', ' || strftime(d.date, '%Y-%m-%d') || ']'
         WHEN reason = 'input_phi_blocked' THEN 'This request appears to ask for individual patient information, which I can''t provide. Please ask about aggregated financial metrics.'
         ELSE 'I don''t have enough information to answer this reliably. Please check with the DA team.' END AS raw
FROM gated_v g LEFT JOIN corpus_v d ON d.source_doc_id = g.top_doc
""")


def _answers_check() -> str:
    from ledgerwind import fixed_values as fv
    from ledgerwind.plans.oracle_views import cleaned_sql, names_sql

    return f"""
SELECT question_id, list_reduce([cleaned] || list_distinct({names_sql('cleaned')}), lambda body, name: replace(body, name, '{fv.REDACTED}')) AS answer,
       cleaned <> raw OR len({names_sql('cleaned')}) > 0 AS phi_redacted
FROM (SELECT question_id, raw, {cleaned_sql('raw')} AS cleaned FROM answer_text_v)"""


@register("answer_text", _answers_check())
def _answer(lake: Lake) -> DataFrame:
    return answers(lake).select("question_id", "answer", "phi_redacted")


@register(
    "answer_citations",
    """SELECT h.question_id, CAST(h.rank AS INTEGER) AS place, h.source_doc_id, strftime(d.date, '%Y-%m-%d') AS date, d.entity_type, d.entity_id, round(h.score, 3) AS score
       FROM hits_v h JOIN gated_v g USING (question_id) JOIN corpus_v d ON d.source_doc_id = h.source_doc_id
       WHERE h.rank <= 4 AND g.reason IN ('entity_filter_match', 'threshold_passed')""",
)
def _citations(lake: Lake) -> DataFrame:
    rows = answers(lake).select("question_id", F.posexplode("citations").alias("at", "c"))
    return rows.select("question_id", (F.col("at") + 1).alias("place"), "c.*")


@register(
    "answer_context",
    """SELECT h.question_id, string_agg('[' || h.source_doc_id || ' | ' || strftime(d.date, '%Y-%m-%d') || '] ' || d.text, chr(10) ORDER BY h.rank) AS context
       FROM hits_v h JOIN gated_v g USING (question_id) JOIN corpus_v d ON d.source_doc_id = h.source_doc_id
       WHERE h.rank <= 4 AND g.reason IN ('entity_filter_match', 'threshold_passed') GROUP BY h.question_id""",
)
def _context(lake: Lake) -> DataFrame:
    return answers(lake).filter("context is not null").select("question_id", "context")


@register(
    "answer_audit",
    f"""SELECT question_id AS session_id, CASE WHEN reason IN ('entity_filter_match', 'threshold_passed') THEN 'answer'
              WHEN reason = 'input_phi_blocked' THEN 'PHI_DETECTED_INPUT' ELSE 'insufficient' END AS action,
              CASE WHEN reason <> 'input_phi_blocked' THEN sha256(question) END AS query_hash,
              CASE WHEN reason = 'input_phi_blocked' THEN 'blocked' ELSE 'clean' END AS input_phi_scan,
              CASE WHEN phi_redacted THEN 'redacted' ELSE 'clean' END AS output_phi_scan,
              coalesce(sources, '[]') AS retrieved_sources
       FROM gated_v JOIN ({_answers_check()}) USING (question_id)
       LEFT JOIN (SELECT question_id, CAST(to_json(list(source_doc_id ORDER BY rank)) AS VARCHAR) AS sources FROM hits_v WHERE rank <= 4 GROUP BY question_id)
       USING (question_id)""",
)
def _audit(lake: Lake) -> DataFrame:
    rows = answers(lake)
    action = (
        F.when(F.col("status") == "grounded", "answer").when(F.col("blocked"), "PHI_DETECTED_INPUT").otherwise("insufficient")
    )
    events = audit.audit_events(
        rows,
        session_id=F.col("question_id"),
        service=F.lit("chatbot"),
        action=action,
        query_hash=F.when(~F.col("blocked"), F.sha2("question", 256)),
        input_phi_scan=F.when(F.col("blocked"), "blocked").otherwise("clean"),
        output_phi_scan=F.when(F.col("phi_redacted"), "redacted").otherwise("clean"),
        retrieved_sources=F.to_json("sources"),
    )
    return events.select("session_id", "action", "query_hash", "input_phi_scan", "output_phi_scan", "retrieved_sources")


CASES = [
    "question_id AS id",
    "substr(question_id, 1, 2) = 'c-' AND CAST(split_part(question_id, '-', 2) AS BIGINT) % 8 IN (2, 3, 5) AS expect_blocked",
    "substr(question_id, 1, 2) = 'c-' AND CAST(split_part(question_id, '-', 2) AS BIGINT) % 8 IN (0, 1, 6) AS expect_citation",
    "CAST(length(question) AS BIGINT) AS latency_ms",
]


@register(
    "eval_rollup",
    f"""SELECT count(*) FILTER (WHERE ok) AS passed, count(*) AS total, round(count(*) FILTER (WHERE ok) / count(*), 3) AS pass_rate,
               round(avg(latency_ms), 1) AS avg_latency_ms
        FROM (SELECT (reason = 'input_phi_blocked') = expect_blocked AND (reason IN ('entity_filter_match', 'threshold_passed')) = expect_citation AS ok,
                     latency_ms FROM (SELECT {', '.join(CASES)} FROM questions_v) JOIN gated_v ON question_id = id)""",
)
def _rollup(lake: Lake) -> DataFrame:
    cases = questions(lake).selectExpr(*CASES)
    return rt.roll_up(rt.evaluate(answers(lake), cases))
