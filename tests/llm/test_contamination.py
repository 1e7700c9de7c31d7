import hashlib
import random
import re

import pytest

from ledgerwind.llm import contamination as c

from .conftest import CLASHES


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def windows(items, width):
    out = {}
    for item, text in items:
        w = words(text)
        for at in range(max(1, len(w) - width + 1)) if w else ():
            out.setdefault(tuple(w[at : at + width]), set()).add("" if item is None else str(item))
    return out


def brute(docs, items, width, slop):
    found = []
    for doc, text in docs:
        w, hit, exact, near = words(text), set(), set(), set()
        for window, names in windows(items, width).items():
            k = len(window)
            for s in range(-slop, len(w) + slop):
                if tuple(w[max(s, 0) : s + k]) == window and s >= 0:
                    hit |= set(range(s, s + k))
                    exact |= names
                if all(any(0 <= p < len(w) and w[p] == x for p in range(s + j - slop, s + j + slop + 1)) for j, x in enumerate(window)):
                    near |= names
        found.append((doc, len(w), len(hit), sorted(exact), len(near)))
    return sorted(found, key=str)


def tables(seed=2):
    draw = random.Random(seed)
    common = ["the", "of", "Ünd", "x1"]
    rare = [f"w{k}" for k in range(60)]

    def text(n):
        return " ".join(draw.choice(common if draw.random() < 0.5 else rare) for _ in range(n))

    items = [(k, text(draw.choice([3, 9, 10, 11, 25]))) for k in range(20)]
    items += [(100, items[4][1]), (4, items[4][1]), (None, text(12)), (101, ""), (102, None), (103, "the"), (104, "the the the the of of"), (105, "nowhere the of")]
    docs = []
    for k in range(60):
        got = text(draw.choice([0, 5, 40, 200])).split()
        for _ in range(draw.choice([0, 0, 1, 2])):
            w = (draw.choice(items)[1] or "").split()
            if draw.random() < 0.4 and len(w) > 6:
                w.insert(draw.randrange(1, len(w)), draw.choice(["odd", "the"]))
            at = draw.randrange(len(got) + 1)
            got[at:at] = [x.upper() if draw.random() < 0.3 and x.isascii() else x for x in w]
        docs.append((k, draw.choice([" ", ", ", "\n", "--"]).join(got)))
    docs += [(7, docs[3][1]), (None, docs[5][1]), (70, None), (71, ""), (72, "!? ..."), (73, "the " * 500)]
    return docs, items


@pytest.mark.parametrize(("width", "slop"), [(10, 0), (10, 1), (4, 2), (1, 0)])
def test_equals_brute_force(spark, width, slop):
    docs, items = tables()
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    for name in ("tid", "rid", "term", "words", "lists", "wid", *CLASHES):
        left, right = left.withColumn(name, c.F.lit(1)), right.withColumn(name, c.F.lit(1))
    got = [(r.doc_id, r.n_words, r.n_hit, r.items, r.near_items) for r in c.contamination(left, right, width=width, slop=slop).collect()]
    assert sorted(got, key=str) == brute(docs, items, width, slop)


def test_same_without_broadcasts(spark):
    docs, items = tables(9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = c.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items, r.near_items) for r in frame.collect()), key=str) == brute(docs, items, 10, 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_digest_of_sorted_ids(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "clean words only")], "doc_id long, text string")
    items = spark.createDataFrame([(10, passage), (9, f"{passage} more")], "item_id long, text string")
    got = {r.doc_id: r for r in c.contamination_report(docs, items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (14, 12, 2, True)
    assert got[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest()
    assert (got[2].n_hit, got[2].contaminated, got[2].items_sha256) == (0, False, hashlib.sha256(b"").hexdigest())


def test_only_the_rarest_lists_make_candidates(spark):
    docs = [(k, "the " * 300 + f"u{k}") for k in range(20)]
    items = [(0, "the the the u3"), (1, "the the u5 the the the the the the the the")]
    windows = c.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    index = c.build_index(spark.createDataFrame(docs, "doc_id long, text string"), windows.terms)
    plans = c._plans(index, windows).collect()
    assert plans and all(p.lists[0].n == 1 for p in plans)
    assert [(m.k, m.exact) for m in c.find(index, windows).collect()] == [(4, True)]


def test_no_python_and_no_cross_join(spark):
    docs, items = tables()
    plan = c.contamination_report(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in c.contamination(docs, items).collect()] == [(1, 2, 0, [], 0)]
    assert c.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []
