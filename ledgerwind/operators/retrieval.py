"""Batch retrieval over aggregate documents: corpus, search, gate, answers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv
from ledgerwind.functions import phi
from ledgerwind.functions.text import (
    dollars,
    embed_text,
    is_domain_question,
    normalise_entity,
    percent,
    spaced,
    title_case,
    whole_plain,
)
from ledgerwind.session import materialise

BLOCK_ROWS = 8192
PLACES_AT_ONCE = 64  # places of a question that share one stretch of its text


def _document(doc_id: Column, entity_type: Column, entity_id: Column, date: Column, text: Column, **metadata: Column) -> list[Column]:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v)]
    return [
        doc_id.alias("source_doc_id"), entity_type.alias("entity_type"), entity_id.alias("entity_id"),
        date.alias("date"), text.alias("text"), F.create_map(*pairs).alias("metadata"),
    ]


def build_corpus(facility: DataFrame, attorney: DataFrame, forecasts30: DataFrame, alerts: DataFrame) -> DataFrame:
    """Documents from the latest features, 30-day forecasts and all alerts given.

    Only aggregates are described; nothing about a single patient is indexed.
    """
    day = F.date_format("event_date", "yyyy-MM-dd")
    facility_docs = facility.select(
        *_document(
            F.concat(F.lit("facility_collections_"), "facility_id", F.lit("_"), day),
            F.lit("facility"), F.col("facility_id"), F.col("event_date"),
            F.concat(
                F.lit("Facility "), title_case(spaced(F.col("facility_id"))), F.lit(" collections summary as of "), day,
                F.lit(": latest day "), dollars(F.col("collections_1d")),
                F.lit(", 7-day rolling "), dollars(F.col("collections_7d_rolling")),
                F.lit(", 30-day rolling "), dollars(F.col("collections_30d_rolling")),
                F.lit(". Month-over-month growth "), percent(F.coalesce("collections_mom_growth", F.lit(0.0))), F.lit("."),
            ),
            feature_group=F.lit("facility_collections"),
        )
    )
    attorney_docs = attorney.select(
        *_document(
            F.concat(F.lit("attorney_aging_"), "attorney_id", F.lit("_"), day),
            F.lit("attorney"), F.col("attorney_id"), F.col("event_date"),
            F.concat(
                F.lit("Attorney "), title_case(F.col("attorney_id")), F.lit(" aging report as of "), day,
                F.lit(": total outstanding "), dollars(F.col("total_outstanding")),
                F.lit("; 180+ day bucket "), dollars(F.col("bucket_180_plus_balance")),
                F.lit(" ("), percent(F.col("pct_180_plus")), F.lit(" of total); average days outstanding "),
                whole_plain(F.col("avg_days_outstanding")), F.lit("."),
            ),
            feature_group=F.lit("attorney_aging"),
        )
    )
    made = F.date_format("forecast_date", "yyyy-MM-dd")
    forecast_docs = forecasts30.select(
        *_document(
            F.concat_ws("_", F.lit("forecast"), "entity_type", "entity_id", made),
            F.col("entity_type"), F.col("entity_id"), F.col("forecast_date"),
            F.concat(
                F.lit("30-day collections forecast for "), "entity_type", F.lit(" "), "entity_id", F.lit(" generated "), made,
                F.lit(": predicted "), dollars(F.col("predicted")), F.lit(" (80% CI "), dollars(F.col("ci_lower")),
                F.lit("–"), dollars(F.col("ci_upper")), F.lit(")."),
            ),
            feature_group=F.lit("forecast"), horizon=F.lit("30"),
        )
    )
    raised = F.date_format("created_at", "yyyy-MM-dd")
    again = F.row_number().over(Window.partitionBy("entity_id", F.to_date("created_at")).orderBy("alert_id"))
    newest = alerts.withColumn("_copy", again)
    suffix = F.when(F.col("_copy") > 1, F.concat(F.lit("_"), F.col("_copy").cast("string"))).otherwise("")
    alert_docs = newest.select(
        *_document(
            F.concat(F.lit("alert_"), "entity_id", F.lit("_"), raised, suffix),
            F.col("entity_type"), F.col("entity_id"), F.to_date("created_at"),
            F.concat(
                F.lit("Anomaly alert ["), "severity", F.lit("] for "), "entity_id", F.lit(" on "), raised,
                F.lit(": metric "), "metric", F.lit(", expected "), dollars(F.coalesce("expected", F.lit(0.0))),
                F.lit(", actual "), dollars(F.coalesce("actual", F.lit(0.0))), F.lit(". "), "driver_narrative",
            ),
            feature_group=F.lit("alert"), severity=F.col("severity"),
        )
    )
    return reduce(DataFrame.unionByName, [facility_docs, attorney_docs, forecast_docs, alert_docs])


def index_documents(corpus: DataFrame) -> DataFrame:
    """The corpus with its embedding; write it once and search it many times."""
    return corpus.join(embed_text(corpus, "source_doc_id", "text"), "source_doc_id")


def to_record(documents: DataFrame) -> DataFrame:
    """Vector-table layout: id, values and one flat metadata map.

    A metadata entry overrides a document field of the same name.
    """
    fields = F.create_map(*[x for c in fv.RECORD_FIELDS for x in (F.lit(c), F.col(c).cast("string"))])
    own = F.map_filter(fields, lambda k, _: ~F.array_contains(F.map_keys("metadata"), k))
    return documents.select(
        F.col("source_doc_id").alias("id"), F.col("vector").alias("values"), F.map_concat(own, "metadata").alias("metadata")
    )


def from_record(records: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(c) for c in fv.RECORD_FIELDS])
    rest = F.map_filter("metadata", lambda k, _: ~F.array_contains(names, k))
    values = [F.coalesce(F.col("metadata")[c], F.lit("")).alias(c) for c in fv.RECORD_FIELDS if c != "source_doc_id"]
    return records.select(
        F.coalesce(F.col("metadata")["source_doc_id"], F.col("id")).alias("source_doc_id"), *values,
        rest.alias("metadata"), F.col("values").alias("vector"),
    )


def match_entities(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """Longest entity name contained in each question: ``(question_id, entity_filter)``.

    Names are met by exact equi-joins, so no question is paired with every name.  The head
    of a name is its longest start of 1, 2, 4, 8, ... characters.  At every place of a
    question the pieces of those lengths are looked up among the heads; only where one is
    found are the pieces looked up that are as long as the names with that head.  Names
    are stored first: Spark then knows their size, and while it is small enough to be
    broadcast no piece is shuffled.  A question is first cut into stretches of bounded
    length, each with the characters that a name begun in it may still take: a piece is
    found by counting characters from the start of its stretch, not of the question.
    """
    names = entities.select("entity_id", normalise_entity(F.col("entity_id")).alias("_name")).filter("_name <> ''").distinct()
    names = materialise(names, "entity-names")
    head = F.expr("cast(pow(2, length(bin(length(_name))) - 1) as int)")
    heads = names.select(F.substring(F.col("_name"), F.lit(1), head).alias("_head"), F.length("_name").alias("_size"))
    heads = heads.groupBy("_head").agg(F.collect_set("_size").alias("_sizes"))
    widths = names.agg(F.collect_set(head)).scalar()
    longest = names.agg(F.max(F.length("_name"))).scalar()
    step = F.greatest(F.lit(PLACES_AT_ONCE), longest)
    asked = questions.select("question_id", normalise_entity(F.col("question")).alias("_whole"))
    cut = asked.select("question_id", "_whole", F.explode(F.sequence(F.lit(0), F.greatest(F.length("_whole") - 1, F.lit(0)), step)).alias("_start"))
    cut = cut.select("question_id", F.substring(F.col("_whole"), F.col("_start") + 1, step + longest - 1).alias("_asked"))
    placed = cut.select("question_id", "_asked", F.explode(widths).alias("_width")).filter(F.length("_asked") >= F.col("_width"))
    last = F.least(step, F.length("_asked") - F.col("_width") + 1)
    placed = placed.select("*", F.explode(F.sequence(F.lit(1), last)).alias("_at"))
    opened = placed.withColumn("_head", F.substring(F.col("_asked"), F.col("_at"), F.col("_width"))).join(heads, "_head")
    pieces = opened.select("question_id", "_asked", "_at", F.explode("_sizes").alias("_size"))
    pieces = pieces.filter(F.col("_at") + F.col("_size") - 1 <= F.length("_asked"))
    found = pieces.select("question_id", F.substring(F.col("_asked"), F.col("_at"), F.col("_size")).alias("_name")).join(names, "_name")
    return found.groupBy("question_id").agg(
        F.max(F.struct(F.length("_name").alias("size"), "entity_id")).alias("_best")
    ).select("question_id", F.col("_best.entity_id").alias("entity_filter"))


_HIT = "question_id string, doc_id string, score double"
_ROWS_AT_ONCE = 256


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    whole = pa.concat_arrays(vectors.chunks)
    if whole.null_count == 0 and len(set(whole.value_lengths().to_numpy())) == 1:  # without an object per number
        return whole.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(whole), -1)
    return np.array(vectors.to_pylist(), dtype=float).reshape(len(vectors), -1)


def _best(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """Exact top ``k`` of every question over the documents of one block."""
    questions, documents, scores = [], [], []
    if len(asked) and len(held):
        held = held.sort_by("doc_id")
        d, names = _matrix(held.column("vector")), held.column("doc_id").to_pylist()
        d_length = np.linalg.norm(d, axis=1)
        for start in range(0, len(asked), _ROWS_AT_ONCE):
            some = asked.slice(start, _ROWS_AT_ONCE)
            q = _matrix(some.column("vector"))
            lengths = np.linalg.norm(q, axis=1)[:, None] * d_length[None, :]
            # rounded so that equal texts tie exactly and the id decides
            cosines = np.round((q @ d.T) / (lengths + 1e-9), 9)
            best = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
            for row, question in enumerate(some.column("question_id").to_pylist()):
                questions += [question] * best.shape[1]
                documents += [names[i] for i in best[row]]
                scores += cosines[row, best[row]].tolist()
    return pa.table({"question_id": pa.array(questions, pa.string()), "doc_id": pa.array(documents, pa.string()), "score": pa.array(scores, pa.float64())})


def _length(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def search(
    questions: DataFrame, documents: DataFrame, k: int = fv.TOP_K, fall_back: bool = True, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact cosine top ``k`` per question: ``(question_id, doc_id, score, rank)``.

    ``questions`` carry ``question_id``, ``vector`` and ``entity_filter`` (null
    for all documents); ``documents`` carry ``doc_id``, ``vector`` and
    ``entity_id``.  A question with a filter meets its entity's documents by an
    equi-join.  Those without one meet the blocks of documents that their bounds
    leave (:func:`search_plan`).  With ``fall_back`` a filter that no document
    satisfies is ignored.
    """
    asked = questions.select(
        F.col("question_id").cast("string").alias("question_id"), F.col("vector").cast("array<double>").alias("vector"), "entity_filter"
    )
    held = documents.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"), "entity_id"
    )
    if fall_back:
        present = held.select(F.col("entity_id").alias("entity_filter"), F.lit(True).alias("_known")).distinct()
        known = asked.join(present, "entity_filter", "left")
        asked = known.select("question_id", "vector", F.when(F.col("_known"), F.col("entity_filter")).alias("entity_filter"))
    asked = materialise(asked, "asked")
    mine = asked.filter("entity_filter is not null").select("question_id", F.col("vector").alias("q"), _length("vector").alias("ql"), "entity_filter")
    theirs = held.select("doc_id", F.col("vector").alias("d"), _length("vector").alias("dl"), "entity_id")
    product = F.aggregate(F.zip_with("q", "d", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    # rounded so that equal texts tie exactly and the id decides
    scored = mine.join(theirs, mine.entity_filter == theirs.entity_id).select(
        "question_id", "doc_id", F.round(product / (F.col("ql") * F.col("dl") + 1e-9), 9).alias("score")
    )
    partial = scored.unionByName(search_plan(asked.filter("entity_filter is null"), held, k, block_rows)[0])
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(held: DataFrame, block_rows: int) -> DataFrame:
    """``held`` with ``unit`` (its vector at length one) and the ``block`` it belongs to.

    Vectors that point the same way share a block: those with the same heaviest bucket,
    split by the second heaviest where they are too many, and by hash beyond that.  No more
    rows than one block holds are one block, if all are finite and of one length: a question
    then meets them once.
    """
    heaviest = F.array_sort(F.transform("unit", lambda x, i: F.struct((-F.abs(x)).alias("w"), i.alias("i"))))
    rows = _with_unit(held).withColumn("_heavy", heaviest)
    rows = rows.select(*held.columns, "unit", F.get("_heavy", F.lit(0))["i"].alias("_b1"), F.get("_heavy", F.lit(1))["i"].alias("_b2"))
    sizes = rows.groupBy("_b1", "_b2").agg(F.count("*").alias("_n2"))
    sizes = sizes.withColumn("_n1", F.sum("_n2").over(Window.partitionBy("_b1")))  # at most one row per second bucket
    sizes = sizes.select(F.col("_b1").alias("_c1"), F.col("_b2").alias("_c2"), "_n1", "_n2")
    same = F.col("_b1").eqNullSafe(F.col("_c1")) & F.col("_b2").eqNullSafe(F.col("_c2"))
    lot = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_n2") / block_rows))
    block = F.concat_ws(":", "_b1", F.when(F.col("_n1") > block_rows, F.concat_ws(":", "_b2", lot)))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    alike = F.bool_and(F.coalesce(finite, F.lit(False))) & (F.min(F.size("vector")) == F.max(F.size("vector"))) & (F.min(F.size("vector")) > 0)
    whole = held.agg((F.count("*") <= block_rows) & F.coalesce(alike, F.lit(False))).scalar()
    return rows.join(sizes, same).select(*held.columns, "unit", F.when(whole, "all").otherwise(block).alias("block"))


def _cells(vector: str) -> Column:
    """``(bucket, x)`` of a vector: its filled buckets, or all if it has a negative one or none is filled.

    So two vectors without a common bucket score zero and no less.
    """
    whole = F.exists(vector, lambda x: x < 0) | F.forall(vector, lambda x: x == 0)
    cells = F.transform(vector, lambda x, i: F.struct(i.alias("bucket"), x.alias("x")))
    return F.inline(F.when(whole, cells).otherwise(F.filter(cells, lambda c: c["x"] != 0)))


def _with_unit(frame: DataFrame) -> DataFrame:
    """``unit``, the vector at length one; the length is bound by an outer lambda, so that it is taken once."""
    unit = lambda n: F.transform("vector", lambda x: F.when(n > 0, x / n).otherwise(0.0))
    return frame.withColumn("unit", F.transform(F.array(_length("vector")), unit)[0])


def _bounds(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(question_id, block, rows, bound)``: no vector of the block scores higher than its bound.

    The inverted lists hold, per bucket and block, the largest and the least weight; a
    question meets the lists of its own buckets only.
    """
    of_block = blocks.groupBy("block").agg(F.count("*").alias("rows"))
    lists = blocks.select("block", _cells("unit")).groupBy("block", "bucket").agg(
        F.max("x").alias("most"), F.min("x").alias("least"), F.count("*").alias("n")
    )
    some = F.col("n") < F.col("rows")  # the others of the block weigh zero there
    lists = lists.join(of_block, "block").select(
        "block", "bucket", "rows",
        F.when(some, F.greatest("most", F.lit(0.0))).otherwise(F.col("most")).alias("most"),
        F.when(some, F.least("least", F.lit(0.0))).otherwise(F.col("least")).alias("least"),
    )
    cells = _with_unit(asked).select("question_id", _cells("unit"))
    most = F.greatest(F.col("x") * F.col("most"), F.col("x") * F.col("least"))
    return cells.join(lists, "bucket").groupBy("question_id", "block").agg(F.max("rows").alias("rows"), F.sum(most).alias("bound"))


def _scored(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, k: int, lots: Column) -> DataFrame:
    """The best ``k`` of each (question, block) pair; a block meets its questions in lots of bounded size."""
    dealt = pairs.select("question_id", "block", F.pmod(F.xxhash64("question_id"), lots).alias("lot"))
    left = dealt.join(asked.select("question_id", "vector"), "question_id")
    wanted = dealt.select(F.col("block").alias("of"), F.col("lot").alias("to")).distinct()
    right = blocks.select("doc_id", "vector", "block").join(wanted, F.col("block") == F.col("of"))
    return left.groupBy("block", "lot").cogroup(right.groupBy("of", "to")).applyInArrow(lambda a, h: _best(a, h, k), _HIT)


_SLACK = 1e-6  # of a bound, against rounding of scores


def search_plan(asked: DataFrame, held: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits that hold the best ``k`` of each question, all bounds, and the pairs of questions and blocks scored.

    A question first scores its most promising blocks, until they hold ``k`` documents; the
    ``k``-th score found is its bar.  Of the other blocks only those are scored whose bound
    reaches the bar.
    """
    lots = asked.agg(F.greatest(F.ceil(F.count("*") / block_rows), F.lit(1)).alias("lots")).scalar()
    blocks = materialise(_blocks(held, block_rows), "blocks")
    order = Window.partitionBy("question_id").orderBy(F.desc("bound"), "block")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = materialise(_bounds(asked, blocks).withColumn("first", before < k), "bounds")
    found = materialise(_scored(bounds.filter("first"), asked, blocks, k, lots), "first-hits")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score")))
    bars = found.withColumn("_place", place).filter(F.col("_place") == k).select("question_id", F.col("score").alias("bar"))
    rest = bounds.filter("not first").join(bars, "question_id", "left").filter(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - _SLACK))
    hits = materialise(found.unionByName(_scored(rest, asked, blocks, k, lots)), "hits")
    # a document without a common bucket scores zero: if less than k score more, the first 2 k ids decide
    plain = lambda f: f.filter(F.forall("vector", lambda x: x >= 0))
    ids = plain(blocks).select("doc_id").orderBy("doc_id").limit(2 * k).agg(F.collect_list("doc_id")).scalar()
    above = hits.filter("score > 0").groupBy("question_id").agg(F.count("*").alias("n"))
    short = plain(asked).join(above, "question_id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    zeros = short.select("question_id", F.explode(ids).alias("doc_id"), F.lit(0.0).alias("score"))
    hits = hits.unionByName(zeros.join(hits.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti"))
    done = bounds.filter("first").select("question_id", "block", "rows").unionByName(rest.select("question_id", "block", "rows"))
    return hits, bounds, done


def screen(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """Questions with what the gate needs before any retrieval."""
    matched = match_entities(questions, entities)
    return questions.join(matched, "question_id", "left").withColumns(
        {
            "phi_label": phi.scan_input(F.col("question")),
            "relevant": is_domain_question(F.col("question")),
        }
    )


def retrieve(screened: DataFrame, index: DataFrame, k: int = fv.TOP_K) -> DataFrame:
    """Hits of the questions that may be looked up at all.

    Equal questions share one embedding and one search.
    """
    eligible = screened.filter("phi_label is null and (entity_filter is not null or relevant)")
    texts = eligible.groupBy("question").agg(F.first("entity_filter").alias("entity_filter"))
    keyed = texts.withColumn("question_key", F.sha2("question", 256))
    vectors = embed_text(keyed, "question_key", "question")
    asked = keyed.join(vectors, "question_key").select(F.col("question_key").alias("question_id"), "vector", "entity_filter")
    asked = materialise(asked, "question-vectors")
    documents = index.select(F.col("source_doc_id").alias("doc_id"), "vector", "entity_id")
    hits = search(asked, documents, k).withColumnRenamed("question_id", "question_key")
    return (
        eligible.select("question_id", F.sha2("question", 256).alias("question_key"))
        .join(hits, "question_key")
        .select("question_id", F.col("doc_id").alias("source_doc_id"), "score", "rank")
    )


def gate_reason(threshold: float = fv.SIMILARITY_THRESHOLD) -> Column:
    no_entity = F.col("entity_filter").isNull()
    return (
        F.when(F.col("phi_label").isNotNull(), "input_phi_blocked")
        .when(no_entity & ~F.col("relevant"), "outside_financial_domain")
        .when(F.col("top_score").isNull(), "no_hits")
        .when(no_entity & (F.col("top_score") < threshold), "below_similarity_threshold")
        .when(no_entity, "threshold_passed")
        .otherwise("entity_filter_match")
    )


GROUNDED = ["entity_filter_match", "threshold_passed"]


def answer(screened: DataFrame, hits: DataFrame, index: DataFrame, context_k: int = fv.CONTEXT_K) -> DataFrame:
    """One row per question: reason, answer, context lines and citations.

    At most ``context_k`` hits per question are gathered, so the grouped lists
    are of fixed size.  An answer is a document's extract or a fixed text, so the output
    scan runs once for each of those and not for every question.
    """
    extract = F.concat("text", F.lit(" [Source: "), "source_doc_id", F.lit(", "), F.date_format("date", "yyyy-MM-dd"), F.lit("]"))
    documents = index.select("source_doc_id", "date", "entity_id", "entity_type", "text", extract.alias("extract"))
    scan = F.struct("redacted_text", "phi_matches").alias("scan")
    described = hits.filter(F.col("rank") <= context_k).join(phi.scan_output(documents, "extract").select("*", scan), "source_doc_id")
    fixed = lambda said: phi.scan_output(index.sparkSession.range(1).select(F.lit(said).alias("said")), "said").select(scan).scalar()
    hit = ["rank", "source_doc_id", "date", "entity_id", "entity_type", "score", "text"]
    gathered = described.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct(*hit))).alias("hits"),
        F.min(F.struct(*hit, "scan")).alias("top"),  # apart from the list, so that it is left out where no answer is asked for
    )
    day = lambda h: F.date_format(h["date"], "yyyy-MM-dd")
    line = lambda h: F.concat(F.lit("["), h["source_doc_id"], F.lit(" | "), day(h), F.lit("] "), h["text"])
    cite = lambda h: F.struct(
        h["source_doc_id"].alias("source_doc_id"), day(h).alias("date"), h["entity_id"].alias("entity_id"),
        h["entity_type"].alias("entity_type"), F.round(h["score"], 3).alias("score"),
    )
    joined = screened.join(gathered, "question_id", "left").withColumn("top_score", F.col("hits")[0]["score"])
    judged = joined.withColumn("reason", gate_reason()).withColumn("grounded", F.col("reason").isin(*GROUNDED))
    said = F.when(F.col("grounded"), F.col("top.scan")).when(F.col("phi_label").isNotNull(), fixed(fv.BLOCKED)).otherwise(fixed(fv.INSUFFICIENT))
    nothing = F.array()
    staged = judged.withColumns(
        {
            "said": said,
            "context": F.when(F.col("grounded"), F.array_join(F.transform("hits", line), "\n")),
            "citations": F.when(F.col("grounded"), F.transform("hits", cite)),
            "sources": F.coalesce(F.transform("hits", lambda h: h["source_doc_id"]), F.array().cast("array<string>")),
        }
    )
    return staged.select(
        "question_id",
        "question",
        "entity_filter",
        "reason",
        F.col("phi_label").isNotNull().alias("blocked"),
        F.when(F.col("grounded"), "grounded").when(F.col("phi_label").isNotNull(), "skipped").otherwise("insufficient").alias("status"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.col("said.redacted_text").alias("answer"),
        (F.size("said.phi_matches") > 0).alias("phi_redacted"),
        F.col("said.phi_matches").alias("phi_matches"),
        "context",
        "sources",
        F.coalesce("citations", nothing.cast(staged.schema["citations"].dataType)).alias("citations"),
    )


def evaluate(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """Per-case verdicts: ``(id, blocked_ok, citation_ok, ok, latency_ms)``."""
    joined = cases.join(answers, cases.id == answers.question_id)
    blocked_ok = F.col("blocked") == F.col("expect_blocked")
    citation_ok = (F.size("citations") > 0) == F.col("expect_citation")
    return joined.select(
        "id", blocked_ok.alias("blocked_ok"), citation_ok.alias("citation_ok"), (blocked_ok & citation_ok).alias("ok"), "latency_ms"
    )


def roll_up(verdicts: DataFrame) -> DataFrame:
    passed = F.sum(F.col("ok").cast("bigint"))
    return verdicts.agg(
        F.coalesce(passed, F.lit(0)).alias("passed"),
        F.count("*").alias("total"),
        F.round(F.coalesce(passed, F.lit(0)) / F.greatest(F.count("*"), F.lit(1)), 3).alias("pass_rate"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("avg_latency_ms"),
    )
