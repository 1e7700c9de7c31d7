from ledgerwind.llm import urls

from .conftest import CLASHES

EDGES = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://COM"), (5, "http://com/"), (6, "HTTPS://WWW.Example.COM/en/a?x#y"), (7, "x://example.com/en/"),
    (8, "http://notexample.com/en/"), (9, "http://a.net/es/1"), (10, "http://a.net/es"), (11, "http://b?/es/"), (12, "http://b#://net/es/"),
    (13, "://net/fr/\nx"), (14, "http://h/" + "a/" * 500), (15, "http://É.net/es/"), (None, "http://a.net/fr/"), (9, "http://a.net/es/1"), (16, "http://c.com//x://y"),
]
WANT = {
    1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("com", "", None), 5: ("com", "/", "com/"),
    6: ("www.example.com", "/en/a", "www.example.com/en/"), 7: ("example.com", "/en/", "example.com/en/"), 8: ("notexample.com", "/en/", "com/"),
    9: ("a.net", "/es/1", "net/es/"), 10: ("a.net", "/es", None), 11: ("b", "", None), 12: ("b", "", None), 13: ("net", "/fr/\nx", "net/fr/"),
    14: ("h", "/" + "a/" * 500, None), 15: ("É.net", "/es/", "net/es/"), None: ("a.net", "/fr/", "net/fr/"), 16: ("c.com", "//x://y", "com/"),
}


def pages(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("host", "path", "template", "part", "n", *CLASHES):
        frame = frame.withColumn(name, urls.F.lit(1))
    return frame


def test_parts_and_rules(spark):
    rows = urls.url_verdicts(pages(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert (r.host, r.path, r.rule) == WANT[r.page_id], r
        assert r.verdict == ("block" if r.rule in ("example.com/en/", "net/es/", "net/fr/") else "allow")


def test_tree_generalises_merges_and_rejects(spark):
    rules = [("block", "h.org/bad/x"), ("allow", "h.org/good/x"), ("block", "h.org/ugly/x")]
    rows = []
    for kind in ("bad", "ugly", "good", "new"):
        rows += [f"http://h.org/{kind}/x{i}/{i}" for i in range(30)]
        rows += [f"http://h.org/{kind}/y{i}/{i}" for i in range(10)]
    frame = pages(spark, list(enumerate(rows)))
    got = {(r.path.split("/")[1], r.path.split("/")[2][0]): (r.verdict, r.template) for r in urls.url_verdicts(frame, rules).collect()}
    assert got["bad", "y"][0] == "block" and got["ugly", "y"][0] == "block"  # by the templates of their rule-blocked siblings
    assert got["good", "y"][0] == "allow" and got["new", "y"][0] == "allow"
    assert got["bad", "y"][1].startswith("/bad/*") and got["new", "x"][1].startswith("/new/*")


def test_similar_branches_merge(spark):
    rules = [("block", "h.org/a/"), ("block", "h.org/b/"), ("block", "h.org/c/1"), ("allow", "h.org/c/2")]
    rows = [f"http://h.org/{k}/{n}" for k in "abc" for n in range(10, 30)]
    got = {r.path[1]: r.template for r in urls.url_verdicts(pages(spark, list(enumerate(rows))), rules[:2]).collect()}
    assert got["a"].startswith("/~") and got["b"].startswith("/~") and got["c"].startswith("/c")


def test_plan_has_no_python_and_empty_tables_work(spark, capsys):
    frame = urls.url_verdicts(pages(spark, []))
    assert frame.collect() == []
    frame.explain("extended")
    assert not any(word in capsys.readouterr().out for word in ("Python", "Arrow", "Pandas"))


def test_templates_differ_below_any_depth(spark):
    deep = "http://h.org/a/b/c/d/e/f/g/h"
    rules = [("block", "h.org/a/b/c/d/e/f/g/h/bad"), ("allow", "h.org/a/b/c/d/e/f/g/h/good")]
    rows = [f"{deep}/{kind}/{i}" for kind in ("bad", "good", "new") for i in range(30)]
    rows += ["http://alone.org/1/2/3/4/5/6/7/8/9"] * 5
    got = urls.url_verdicts(pages(spark, list(enumerate(rows))), rules).collect()
    by_kind = {r.path.split("/")[9]: set() for r in got}
    for r in got:
        by_kind[r.path.split("/")[9]].add((r.verdict, r.template))
    assert {v for v, _ in by_kind["bad"]} == {"block"} and {v for v, _ in by_kind["good"]} == {"allow"}
    assert not {t for _, t in by_kind["bad"]} & {t for _, t in by_kind["good"]}
    assert by_kind["9"] == {("allow", "/1/2/3/4/5/6/7/8/9")}
