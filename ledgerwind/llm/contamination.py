"""Benchmark decontamination over a positional inverted index; DataFrame functions only.

*Index.* Training documents become postings (term, document, position), stored sorted by
term within every partition of documents, so an index grows by adding partitions and no
posting is ever shuffled to be stored.  Terms are those of the test items.  One more row per
document holds its number of words.

*Search.* Test items are cut into windows; equal windows are one.  The terms of a window are
put in order of the length of their lists.  The rarest list gives the candidates, as anchors;
the lists of the next terms, shifted by their offsets, are intersected one by one; what is
left meets all its other lists at once, of the documents still in question.  A window with a
term that has no list is nowhere.

A window is an *exact* match at a start if each of its words is at its place, and a *near*
match if each is within ``slop`` places of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.session import materialise

WINDOW = 10
SLOP = 1  # places of a near match
SINGLE_LISTS = 3  # lists taken one by one, the rarest included

#: Fixed value of the contract: words are ASCII letters, digits and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> F.Column:
    """The words of a text, none if it is null."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


@dataclass
class Windows:
    windows: DataFrame  # wid, words: every different window once
    items: DataFrame  # wid, item: which items hold it
    terms: DataFrame  # term, tid


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> Windows:
    """The windows of ``width`` consecutive words of each item; a shorter item is one window.

    Items without words have none.  Repeated items count once, a null id is the empty one.
    """
    if not 1 <= width <= 62:
        raise ValueError("a window has 1 to 62 words")
    cut = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = cut.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("words"))
    each = materialise(each.distinct(), "item-windows")
    windows = materialise(each.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    terms = windows.select(F.explode("words").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id())
    return Windows(windows, materialise(each.join(windows, "words").select("wid", "item"), "window-items"), materialise(terms, "terms"))


@dataclass
class Index:
    postings: DataFrame  # tid, rid, pos
    documents: DataFrame  # rid, doc_id, n_words


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Postings of ``terms`` (term, tid) in every whole text of ``docs``, and one row per document.

    A document is a row: repeated rows and ids, null ids and null texts each keep theirs.
    """
    # a document's own row goes along as a word that no text has, different for each document
    own = F.concat(F.lit("\x00"), F.col("rid").cast("string"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), words_of(text).alias("w"))
    rows = rows.select("rid", "doc_id", F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(own), F.col("w"))).alias("at", "word"))
    found = rows.join(terms, rows["word"] == terms["term"], "left").where("tid is not null or at = 0")
    header = F.col("at") == 0
    found = found.select(
        "tid", "rid", (F.col("at") - 1).alias("pos"),
        F.when(header, F.col("doc_id")).alias("doc_id"), F.when(header, F.col("n_words").cast("long")).alias("n_words"),
    )
    stored = materialise(found.sortWithinPartitions("tid", "rid", "pos"), "postings")
    return Index(stored.where("tid is not null").select("tid", "rid", "pos"), stored.where("tid is null").select("rid", "doc_id", "n_words"))


def _plans(index: Index, windows: Windows) -> DataFrame:
    """(wid, k, lists) of windows whose terms all have postings; ``lists`` are (n, off, tid), rarest first."""
    lengths = materialise(index.postings.groupBy("tid").agg(F.count("*").alias("n")), "list-lengths")
    each = windows.windows.select("wid", F.size("words").alias("k"), F.posexplode("words").alias("off", "term"))
    each = each.join(windows.terms, "term").join(lengths, "tid")
    lists = F.array_sort(F.collect_list(F.struct("n", "off", "tid")))  # as many as a window has words
    return materialise(each.groupBy("wid", "k").agg(lists.alias("lists")).where("size(lists) = k"), "plans")


def _intersected(candidates: DataFrame, postings: DataFrame, rank: int, slop: int) -> DataFrame:
    """Candidates whose term of this rank lies where the anchor lets it; those without such a term pass."""
    tid, shift = f"tid{rank}", f"shift{rank}"
    wanted = materialise(candidates.select(F.col(tid).alias("tid")).where("tid is not null").distinct(), "wanted-terms")
    lists = postings.join(wanted, "tid", "left_semi")
    place = F.col("anchor") + F.col(shift)
    probes = candidates.where(F.col(tid).isNotNull()).withColumn("p", F.explode(F.sequence(place - 2 * slop, place + 2 * slop)))
    met = (F.col(tid) == lists["tid"]) & (probes["rid"] == lists["rid"]) & (F.col("p") == lists["pos"])
    kept = probes.join(lists, met, "left_semi").drop("p")
    if slop:
        kept = kept.dropDuplicates(["rid", "wid", "anchor"])
    return materialise(kept.unionByName(candidates.where(F.col(tid).isNull())), "candidates")


def find(index: Index, windows: Windows, slop: int = 0) -> DataFrame:
    """(rid, wid, start, k, exact) of every match of a window in a document.

    Exact matches have the start of the window; near ones that of the window laid on its
    rarest word.  With ``slop`` 0 all matches are exact.
    """
    plans = _plans(index, windows)
    first = F.col("lists")[0]
    ranks = range(2, SINGLE_LISTS + 1)
    nth = {r: F.when(F.size("lists") >= r, F.get("lists", F.lit(r - 1))) for r in ranks}
    anchors = plans.select(
        "wid", first["tid"].alias("tid"),
        *[nth[r]["tid"].alias(f"tid{r}") for r in ranks], *[(nth[r]["off"] - first["off"]).alias(f"shift{r}") for r in ranks],
    )
    candidates = index.postings.join(anchors, "tid").withColumnRenamed("pos", "anchor").drop("tid")
    candidates = materialise(candidates, "candidates")
    for rank in ranks:
        candidates = _intersected(candidates, index.postings, rank, slop)
    candidates = candidates.select("rid", "wid", "anchor")

    reach = 2 * slop
    terms = plans.select("wid", "k", first["off"].alias("first"), F.explode("lists").alias("x")).select(
        "wid", "k", "first", "x.off", "x.tid", (F.col("x.off") - F.col("first")).alias("shift")
    )
    probes = candidates.join(terms, "wid").withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    probes = probes.withColumn("p", F.col("anchor") + F.col("shift") + F.col("d"))
    asked = materialise(candidates.select("rid").distinct(), "documents-in-question")
    lists = index.postings.join(asked, "rid", "left_semi").select("tid", F.col("rid").alias("of"), "pos")
    met = (probes["tid"] == lists["tid"]) & (probes["rid"] == lists["of"]) & (probes["p"] == lists["pos"])
    bit = F.expr("shiftleft(1L, off)")
    full = F.expr("shiftleft(1L, k) - 1")
    laid = {m: F.bit_or(F.when(F.abs(F.col("d") - m) <= slop, bit)).alias(f"near{m + slop}") for m in range(-slop, slop + 1)}
    met_all = probes.join(lists, met).groupBy("rid", "wid", "anchor", "k", "first").agg(
        F.bit_or(F.when(F.col("d") == 0, bit)).alias("exactly"), *laid.values()
    )
    near = F.lit(False)
    for m in laid:
        near = near | F.coalesce(F.col(f"near{m + slop}") == full, F.lit(False))
    return met_all.where(near).select(
        "rid", "wid", (F.col("anchor") - F.col("first")).alias("start"), "k", F.coalesce(F.col("exactly") == full, F.lit(False)).alias("exact")
    )


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WINDOW, slop: int = SLOP,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids as strings) and near_items.

    ``n_hit`` counts the words inside exact matches, ``items`` have an exact match and
    ``near_items`` counts those with a near or exact one.  Null texts have no words; an empty
    table of items leaves every document clean, one of documents gives an empty result.
    Columns besides the named ones are not read, whatever their names.
    """
    windows = item_windows(items, item_id, item_text, width)
    index = build_index(docs, windows.terms, doc_id, text)
    matches = materialise(find(index, windows, slop), "matches")
    spans = matches.where("exact").select("rid", "start", "k").distinct()
    places = spans.select("rid", F.explode(F.expr("sequence(start, start + k - 1)")).alias("pos")).distinct()
    hits = places.groupBy("rid").agg(F.count("*").alias("n_hit"))
    of_items = matches.join(windows.items, "wid").groupBy("rid", "item").agg(F.max("exact").alias("exact"))
    named = of_items.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count("*").alias("near_items")
    )
    none = F.array().cast("array<string>")
    return index.documents.join(hits, "rid", "left").join(named, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", F.lit(0)).alias("near_items"),
    )


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.col("near_items").alias("n_near_items"),
    )


#: DuckDB: windows against the same stretch of every document; near ones by all their words' places.
CONTAMINATION_SQL = rf"""
WITH item AS (
SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item, list_slice(w, i + 1, i + {WINDOW}) AS x FROM item, LATERAL (SELECT unnest(range(0, greatest(len(w) - {WINDOW - 1}, 1))) AS i) WHERE len(w) > 0),
uniq AS MATERIALIZED (SELECT x, len(x) AS k, row_number() OVER () AS wid FROM (SELECT DISTINCT x FROM win)),
doc AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
tok AS MATERIALIZED (SELECT rid, unnest(range(0, len(w))) AS p, unnest(w) AS t FROM doc),
slot AS MATERIALIZED (SELECT wid, k, unnest(range(0, k)) AS off, unnest(x) AS t FROM uniq),
hit AS MATERIALIZED (
SELECT tok.rid AS rid, wid, k, p FROM slot JOIN tok ON slot.t = tok.t AND off = 0 JOIN doc ON doc.rid = tok.rid JOIN uniq USING (wid, k) WHERE list_slice(doc.w, p + 1, p + k) = x),
place AS (SELECT DISTINCT rid, p + off AS p FROM hit JOIN slot USING (wid, k)),
freq AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
rare AS MATERIALIZED (SELECT wid, first(off ORDER BY coalesce(n, 0), off) AS off, first(t ORDER BY coalesce(n, 0), off) AS t FROM slot LEFT JOIN freq USING (t) GROUP BY wid),
laid AS (SELECT DISTINCT rid, wid, p - off + d AS s FROM rare JOIN tok USING (t), (SELECT unnest(range(-{SLOP}, {SLOP + 1})) AS d)),
near AS (
SELECT DISTINCT rid, wid FROM (
  SELECT laid.rid AS rid, laid.wid AS wid, s FROM laid JOIN slot ON slot.wid = laid.wid CROSS JOIN (SELECT unnest(range(-{SLOP}, {SLOP + 1})) AS d)
  JOIN tok ON tok.rid = laid.rid AND tok.t = slot.t AND tok.p = s + off + d GROUP BY laid.rid, laid.wid, s, k HAVING count(DISTINCT off) = k)),
named AS (
SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit JOIN uniq USING (wid) JOIN win ON win.x = uniq.x GROUP BY rid),
close AS (SELECT rid, count(DISTINCT item) AS n_near FROM near JOIN uniq USING (wid) JOIN win ON win.x = uniq.x GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM doc LEFT JOIN (SELECT rid, count(*) AS n_hit FROM place GROUP BY rid) USING (rid) LEFT JOIN named USING (rid) LEFT JOIN close USING (rid)"""
