import datetime as dt

import numpy as np
import pytest

from ledgerwind.functions.text import embed_text
from ledgerwind.operators import retrieval as rt

DOCS = "source_doc_id string, entity_type string, entity_id string, date date, text string, metadata map<string,string>"


def index(spark, *docs):
    rows = [(i, t, e, dt.date(2026, 5, 28), x, {"feature_group": "g"}) for i, t, e, x in docs]
    return rt.index_documents(spark.createDataFrame(rows, DOCS))


@pytest.fixture
def corpus(spark):
    return index(
        spark,
        ("d1", "facility", "round_rock", "Facility Round Rock collections summary latest day $10"),
        ("d2", "facility", "cedar_park", "Facility Cedar Park collections summary latest day $20"),
        ("d3", "attorney", "johnson", "Attorney Johnson aging report total outstanding $30"),
    )


def ask(spark, corpus, *texts):
    rows = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "question_id string, question string")
    screened = rt.screen(rows, corpus.select("entity_id").distinct())
    return rt.answer(screened, rt.retrieve(screened, corpus), corpus).orderBy("question_id").collect()


def test_gate_reasons(spark, corpus):
    rows = ask(
        spark, corpus,
        "How is Round Rock performing?", "What is the capital of France?", "Show me patient John Doe's balance",
        "zzz yyy xxx payments", "attorney aging report total outstanding",
    )
    assert [r.reason for r in rows] == [
        "entity_filter_match", "outside_financial_domain", "input_phi_blocked", "below_similarity_threshold", "threshold_passed",
    ]
    assert rows[0].citations[0].source_doc_id == "d1" and "[Source: d1, 2026-05-28]" in rows[0].answer
    assert rows[0].context == "[d1 | 2026-05-28] Facility Round Rock collections summary latest day $10"
    assert rows[1].answer.startswith("I don't have enough") and rows[1].citations == []
    assert rows[2].blocked and rows[2].citations == []
    assert rows[4].citations[0].source_doc_id == "d3"


def test_evaluation_cases(spark, corpus):
    rows = ask(
        spark, corpus, "How is Round Rock performing?", "How is Attorney Johnson performing?",
        "Show me patient John Doe's balance", "What is the capital of France?",
    )
    answers = spark.createDataFrame([(r.question_id, r.blocked, [c.source_doc_id for c in r.citations]) for r in rows], "question_id string, blocked boolean, citations array<string>")
    cases = spark.createDataFrame(
        [("q0", False, True, 4), ("q1", False, True, 6), ("q2", True, False, 2), ("q3", False, True, 0)],
        "id string, expect_blocked boolean, expect_citation boolean, latency_ms int",
    )
    total = rt.roll_up(rt.evaluate(answers, cases)).first()
    assert (total.passed, total.total, total.pass_rate, total.avg_latency_ms) == (3, 4, 0.75, 3.0)


def test_grounded_answers_are_redacted(spark):
    row = ask(spark, index(spark, ("d", "facility", "round_rock", "Round Rock owes Jane Roe")), "round_rock?")[0]
    assert row.phi_redacted and "Jane" not in row.answer


def test_longest_name_wins(spark):
    names = spark.createDataFrame([("nation_1",), ("nation_12",), ("Nation 12",), ("pi",), ("--",)], "entity_id string")
    asked = spark.createDataFrame([("a", "how is NATION-12 doing"), ("b", "a copilot"), ("c", "none"), ("d", "nation 1")], "question_id string, question string")
    found = {r.question_id: r.entity_filter for r in rt.match_entities(asked, names).collect()}
    assert found == {"a": "nation_12", "b": "pi", "d": "nation_1"}


def test_search_agrees_with_numpy(spark):
    rng = np.random.default_rng(0)
    d, q = rng.normal(size=(70, 6)), rng.normal(size=(23, 6))
    d[10] = d[20]
    docs = spark.createDataFrame([(f"d{i:02}", [float(x) for x in v], f"e{i % 3}") for i, v in enumerate(d)], "doc_id string, vector array<double>, entity_id string")
    wants = [None, "e1", "absent"]
    asked = spark.createDataFrame([(f"q{i:02}", [float(x) for x in v], wants[i % 3]) for i, v in enumerate(q)], "question_id string, vector array<double>, entity_filter string")
    rows = lambda f: sorted((r.question_id, r["rank"], r.doc_id, r.score) for r in f.collect())
    paths = [rows(rt.search(asked, docs, 5)), rows(rt.search(asked, docs, 5, block_rows=10))]
    assert paths[0] == paths[1]
    want = []
    for i, v in enumerate(q):
        scores = np.round(d @ v / (np.linalg.norm(d, axis=1) * np.linalg.norm(v) + 1e-9), 9)
        pool = [j for j in range(70) if wants[i % 3] != "e1" or j % 3 == 1]
        best = sorted(pool, key=lambda j: (-scores[j], j))[:5]
        want += [(f"q{i:02}", k + 1, f"d{j:02}") for k, j in enumerate(best)]
    assert [p[:3] for p in paths[0]] == want
    strict = rt.search(asked, docs, 5, fall_back=False).filter("question_id = 'q02'")
    assert strict.isEmpty()


def clustered(rng, rows, dim, clusters, sparse):
    centres = rng.normal(size=(clusters, dim))
    if sparse:
        centres = np.where(rng.random((clusters, dim)) < 0.15, np.abs(centres) + 0.5, 0.0)
    out = centres[rng.integers(clusters, size=rows)] * (1 + 0.02 * rng.normal(size=(rows, dim)))
    return np.where(rng.random(rows) < 0.05, 0.0, 1.0)[:, None] * out if sparse else out


@pytest.mark.parametrize("sparse", [True, False])
def test_skipped_blocks_change_nothing(spark, sparse):
    rng = np.random.default_rng(3)
    d, q = clustered(rng, 600, 24, 30, sparse), clustered(rng, 40, 24, 12, sparse)
    q[0] = 0.0
    if sparse:
        q[1] = 0.0
        q[1, np.flatnonzero(d.max(axis=0) == 0)[:1]] = 1.0  # shares no bucket, if there is such a one
        d[5, 3], q[2, 4] = -0.7, -0.2  # a negative entry among others without
    docs = spark.createDataFrame([(f"d{i:03}", [float(x) for x in v]) for i, v in enumerate(d)], "doc_id string, vector array<double>")
    asked = spark.createDataFrame([(f"q{i:02}", [float(x) for x in v], None) for i, v in enumerate(q)], "question_id string, vector array<double>, entity_filter string")
    got = rt.search(asked, docs.withColumn("entity_id", rt.F.lit("e")), 5, block_rows=16).collect()
    want = []
    for i, v in enumerate(q):
        scores = np.round(d @ v / (np.linalg.norm(d, axis=1) * np.linalg.norm(v) + 1e-9), 9) + 0.0
        want += [(f"q{i:02}", n + 1, f"d{j:03}", scores[j]) for n, j in enumerate(sorted(range(len(d)), key=lambda j: (-scores[j], j))[:5])]
    found = sorted((r.question_id, r["rank"], r.doc_id, r.score) for r in got)
    assert [f[3] for f in found] == pytest.approx([w[3] for w in want], abs=2e-9)
    assert [f[:3] for f in found] == [w[:3] for w in want]
    _, bounds, done = rt.search_plan(asked, docs, 5, block_rows=16)
    share = done.agg(rt.F.sum("rows")).first()[0] / (len(q) * len(d))
    assert share < 0.35, share


def test_record_round_trip(spark, corpus):
    records = rt.to_record(corpus)
    record = records.filter("id = 'd1'").first()
    assert record.metadata["text"].startswith("Facility") and record.metadata["feature_group"] == "g"
    back = rt.from_record(records).filter("source_doc_id = 'd1'").first()
    assert back.metadata == {"feature_group": "g"} and back.entity_id == "round_rock"


def test_equal_texts_share_an_embedding(spark):
    frame = spark.createDataFrame([("a", "x y"), ("b", "Y  x")], "k string, t string")
    assert embed_text(frame, "k", "t").select("vector").distinct().count() == 1


def test_words_part_at_blanks_of_any_script(spark):
    frame = spark.createDataFrame([("a", "x\u00a0y\u3000z\x1fw"), ("b", "x y z w")], "k string, t string")
    assert embed_text(frame, "k", "t").select("vector").distinct().count() == 1


def test_every_alert_is_described(spark):
    import datetime

    none = {c: spark.createDataFrame([], t) for c, t in {
        "facility": "facility_id string, event_date date, collections_1d double, collections_7d_rolling double, collections_30d_rolling double, collections_mom_growth double",
        "attorney": "attorney_id string, event_date date, total_outstanding double, bucket_180_plus_balance double, pct_180_plus double, avg_days_outstanding double",
        "forecast": "entity_type string, entity_id string, forecast_date date, predicted double, ci_lower double, ci_upper double",
    }.items()}
    rows = [(f"a{i}", "facility", "f", datetime.datetime(2026, 1, 1), "P1", "m", 1.0, 2.0, "n") for i in range(130)]
    alerts = spark.createDataFrame(rows, "alert_id string, entity_type string, entity_id string, created_at timestamp, severity string, metric string, expected double, actual double, driver_narrative string")
    documents = rt.build_corpus(none["facility"], none["attorney"], none["forecast"], alerts)
    assert documents.select("source_doc_id").distinct().count() == 130


def test_matching_equals_brute_force_and_shuffles_no_pieces(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(3)
    make = lambda n: "".join(draw.choice(list("abc -"), n))
    wanted = [make(int(draw.integers(1, 12))) for _ in range(60)] + ["", None, "a", "abcabcabcabcabcab"]
    texts = [make(int(n)) for n in draw.integers(0, 40, 60)] + ["xabcabcabcabcabcabx", None, ""]
    # a table whose estimated size is large, though few names are in it
    picked = F.array(*[F.lit(w) for w in wanted])
    names = spark.range(20000).select(F.get(picked, (F.col("id") % len(wanted)).cast("int")).alias("entity_id"))
    asked = spark.createDataFrame(list(enumerate(texts)), "question_id string, question string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        frame = rt.match_entities(asked, names)
        assert "SortMergeJoin" not in frame._jdf.queryExecution().sparkPlan().toString()
        found = {r.question_id: r.entity_filter for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {}
    for i, text in enumerate(texts):
        inside = [(len(plain(w)), w) for w in wanted if w and plain(w) and plain(w) in plain(text or "")]
        if inside:
            want[str(i)] = max(inside)[1]
    assert found == want


def test_entities_of_repeated_and_unknown_keys(spark, tmp_path):
    from ledgerwind.plans.queries_ingest import entities
    from ledgerwind.sources.tables import SCHEMAS, Lake

    def put(name, *rows):
        wide = [c.strip().split()[0] for c in SCHEMAS[name].split(",")]
        full = [tuple(r.get(c) for c in wide) for r in rows]
        spark.createDataFrame(full, SCHEMAS[name]).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("region", {"r_regionkey": 1, "r_name": "EAST"})
    put("nation", {"n_nationkey": 1, "n_name": "UTOPIA", "n_regionkey": 1}, {"n_nationkey": 2, "n_name": "LOST", "n_regionkey": 9})
    put("supplier", {"s_suppkey": 1, "s_nationkey": 1}, {"s_suppkey": 1, "s_nationkey": 2}, {"s_suppkey": 3, "s_nationkey": 1})
    put("customer", {"c_custkey": 1, "c_mktsegment": "A"}, {"c_custkey": 1, "c_mktsegment": "B"}, {"c_custkey": 2, "c_mktsegment": "C"})
    put("orders", {"o_orderkey": 1, "o_custkey": 1}, {"o_orderkey": 1, "o_custkey": 1}, {"o_orderkey": 5, "o_custkey": 2})
    put("lineitem", {"l_orderkey": 1, "l_suppkey": 1}, {"l_orderkey": 1, "l_suppkey": 1}, {"l_orderkey": None, "l_suppkey": 8})
    got = [(r.entity_type, r.entity_id) for r in entities(Lake(spark, str(tmp_path))).collect()]
    want = [("facility", "EAST"), ("facility", None), ("attorney", "UTOPIA"), ("attorney", "LOST"), ("attorney", None)]
    want += [("case_type", "A"), ("case_type", "B"), ("case_type", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_question_hits_screens_the_questions_once(monkeypatch):
    from unittest.mock import MagicMock

    from ledgerwind.plans import queries_retrieval as qr

    stored = {}
    monkeypatch.setattr(qr, "stored_index", MagicMock())
    monkeypatch.setattr(qr, "screened", lambda lake, index: "asked")
    monkeypatch.setattr(qr, "materialise", lambda frame, name: stored.setdefault(frame, f"stored {frame}"))
    monkeypatch.setattr(qr.rt, "retrieve", found := MagicMock())
    qr._hits(MagicMock())
    assert found.call_args.args[0] == "stored asked"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_questions_are_dealt_over_the_cores(spark, tmp_path):
    from ledgerwind.sources.questions import questions
    from ledgerwind.sources.tables import SCHEMAS, Lake

    rows = {
        "region": [(0, "ASIA")], "nation": [(0, "CHINA", 0)],
        "customer": [(i % 50, f"C{i}", None if i == 7 else 0, 1.0, "AUTO") for i in range(100)] + [(None, None, 0, 1.0, None)],
        "conversations": [(i, 1, "user", f"text {i}") for i in range(30)] + [(None, None, "user", None), (1, 2, "assistant", "no")],
    }
    for name, held in rows.items():
        spark.createDataFrame(held, SCHEMAS[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    asked = questions(Lake(spark, str(tmp_path)))
    assert asked.count() == 132
    assert asked.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_few_documents_are_one_block(spark):
    rng = np.random.default_rng(5)
    d, q = np.abs(rng.normal(size=(40, 12))), np.abs(rng.normal(size=(9, 12)))
    docs = spark.createDataFrame([(f"d{i:02}", [float(x) for x in v]) for i, v in enumerate(d)], "doc_id string, vector array<double>")
    asked = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(q)], "question_id string, vector array<double>")
    hits, _, done = rt.search_plan(asked, docs, 5, block_rows=40)
    assert (done.count(), done.agg(rt.F.sum("rows")).first()[0]) == (9, 360)
    assert hits.count() == 45
    assert rt.search_plan(asked, docs, 5, block_rows=39)[2].count() > 9
    odd = spark.createDataFrame([("x", None), ("y", [])], docs.schema)
    got = rt.search(asked.withColumn("entity_filter", rt.F.lit(None).cast("string")), docs.unionByName(odd).withColumn("entity_id", rt.F.lit("e")), 5)
    assert {(r.question_id, r.doc_id) for r in got.filter("rank = 1").collect()} == {(r.question_id, r.doc_id) for r in hits.withColumn("n", rt.F.max("score").over(rt.Window.partitionBy("question_id"))).filter("score = n").collect()}
    assert rt._blocks(docs.unionByName(odd), 50).select("block").distinct().count() > 1


def test_lengths_are_taken_once_a_text(spark):
    frame = spark.createDataFrame([("a", "x y y"), ("b", "")], "k string, t string")
    rows = embed_text(frame, "k", "t")
    assert sorted(x for x in rows.first().vector if x) == [1 / 5**0.5, 2 / 5**0.5]
    assert "lambdafunction" not in plan(rows).partition("map_from_entries")[0]
    units = rt._with_unit(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "vector array<double>"))
    assert [r.unit for r in units.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert "CASE WHEN" in plan(units) and "sqrt" not in plan(units).partition("CASE WHEN")[2]


def test_matrix_of_vectors():
    chunks = rt.pa.chunked_array([[[1.0, None], [2.0, 3.0]], [[4.0, 5.0]]])
    got = rt._matrix(chunks.slice(1))
    assert got.tolist() == [[2.0, 3.0], [4.0, 5.0]] and np.isnan(rt._matrix(chunks)[0, 1])
    with pytest.raises(ValueError):
        rt._matrix(rt.pa.chunked_array([[[1.0], [1.0, 2.0, 3.0]]]))


def test_the_output_scan_runs_once_a_document(spark, corpus, monkeypatch):
    seen, scan = [], rt.phi.scan_output
    monkeypatch.setattr(rt.phi, "scan_output", lambda frame, text: seen.append(frame) or scan(frame, text))
    screened = spark.createDataFrame(
        [(f"q{k:03}", f"question {k}", "facility", None, True) for k in range(200)] + [("p", "blocked", None, "SSN", True), ("n", "none", None, None, False)],
        "question_id string, question string, entity_filter string, phi_label string, relevant boolean",
    )
    ids = sorted(r.source_doc_id for r in corpus.collect())
    hits = spark.createDataFrame([(f"q{k:03}", ids[(k + n) % len(ids)], 0.5, n + 1) for k in range(200) for n in range(2)], "question_id string, source_doc_id string, score double, rank int")
    rows = {r.question_id: r for r in rt.answer(screened, hits, corpus).collect()}
    assert sum(frame.count() for frame in seen) <= len(ids) + 2
    texts = {r.source_doc_id: f"{r.text} [Source: {r.source_doc_id}, {r.date}]" for r in corpus.collect()}
    want = spark.createDataFrame([(f"q{k:03}", texts[ids[k % len(ids)]]) for k in range(200)] + [("p", rt.fv.BLOCKED), ("n", rt.fv.INSUFFICIENT)], "question_id string, raw string")
    for r in scan(want, "raw").collect():
        got = rows[r.question_id]
        assert (got.answer, got.phi_redacted, got.phi_matches) == (r.redacted_text, r.phi_detected, r.phi_matches)


def test_names_are_found_across_the_stretches_of_a_long_question(spark, monkeypatch):
    monkeypatch.setattr(rt, "PLACES_AT_ONCE", 3)
    names = spark.createDataFrame([("a",), ("b c",), ("de",), ("longest of all",), ("--",)], "entity_id string")
    texts = [*("x" * k + " longest of all " + "y" * k for k in range(40)), *("z" * k + "De" for k in range(20)), "", "--", None, "B  C", "q" * 500 + "b c" + "q" * 500, "cba"]
    asked = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "question_id string, question string")
    got = {r.question_id: r.entity_filter for r in rt.match_entities(asked, names).collect()}
    plain = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split())
    want = {}
    for k, t in enumerate(texts):
        inside = [n for n in ("a", "b c", "de", "longest of all") if n in plain(t or "")]
        if inside:
            want[f"q{k}"] = max(inside, key=len)
    assert got == want
    none = rt.match_entities(asked, names.limit(0))
    assert none.count() == 0
