"""URL verdicts from rules and from a path-template tree; DataFrame functions only.

Rules decide first.  For the rest, every host's paths form a tree, built level by level:

* a node with many children generalises those that are rare among them into ``*``;
* of its other children, those whose labels don't differ from their siblings' pooled
  labels (a two-sided test of proportions) merge into the branch ``~``;
* children with too few labels to tell stay as they are.

A template is rejected if its share of blocked labels, smoothed towards the share of all
labels, reaches ``PURITY`` on at least ``MIN_LABELS`` labels.  Labels are the urls that
rules decide.  All tables of the tree have one row per distinct (host, path) at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.session import materialise

Rule = tuple[str, str]  # verdict, host and path

#: Fixed values of the query's contract.
RULES: tuple[Rule, ...] = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)

DEPTH = 6  # of the check statement, where deeper segments count as one
CHILDREN = 16  # a node with as many children has variable ones
RARE_PERCENT = 10  # a variable child has at most this share of its node's urls
Z = 1.96
MIN_LABELS = 5
SMOOTHING = 4.0
PURITY = 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host in lower case and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: F.Column, path: F.Column, rules: Sequence[Rule]) -> F.Column:
    """Struct (verdict, rule) of the longest fitting rule, or null; rules are a short parameter."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template) of ``urls`` (host, path, n, blocked, labels), one row per host and path.

    All segments count.  A node with one path left is closed in one step: it has no
    siblings to merge with, so the rounds end where the last two paths part.
    """
    parts = F.split(F.regexp_replace("path", "^/|/$", ""), "/")
    tree = materialise(urls.select("*", parts.alias("parts"), F.lit("").alias("template")), "url-tree")
    level = 0
    while (tree.agg(F.max(F.size("parts"))).first()[0] or 0) > level:
        open_ = tree.where(F.size("parts") > level).withColumn("part", F.col("parts")[level])
        # stored before they are joined, so that the nodes of one host are split over tasks
        child = materialise(open_.groupBy("host", "template", "part").agg(F.count("*").alias("paths"), *[F.sum(c).alias(c) for c in ("n", "blocked", "labels")]), "url-children")
        node = materialise(
            child.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("all_n"), (F.sum("paths") == 1).alias("alone")), "url-nodes"
        )
        sorted_out = child.join(node, ["host", "template"]).withColumn(
            "variable", (F.col("children") >= CHILDREN) & (100 * F.col("n") <= RARE_PERCENT * F.col("all_n"))
        )
        sorted_out = materialise(sorted_out, "url-sorted")
        pool = sorted_out.where("not variable").groupBy("host", "template").agg(F.sum("blocked").alias("pool_blocked"), F.sum("labels").alias("pool_labels"))
        pool = materialise(pool, "url-pools")
        b, m, pb, pm = (F.col(c).cast("double") for c in ("blocked", "labels", "pool_blocked", "pool_labels"))
        alike = (F.col("labels") >= MIN_LABELS) & (F.pow(b * pm - m * pb, F.lit(2.0)) <= F.lit(Z * Z) * m * pb * (pm - pb))
        step = F.when(F.col("variable"), F.lit("*")).when(alike, F.lit("~")).otherwise(F.col("part"))
        named = sorted_out.join(pool, ["host", "template"], "left").select(
            F.col("host").alias("ch"), F.col("template").alias("ct"), F.col("part").alias("cp"), F.concat("template", F.lit("/"), step).alias("longer"), "alone"
        )
        keyed = tree.withColumn("part", F.get("parts", F.lit(level)))
        same = (F.col("host") == F.col("ch")) & (F.col("template") == F.col("ct")) & (F.col("part") == F.col("cp"))
        named = materialise(named, "url-steps")
        # alone, a path merges with itself at every level if it has labels enough, and else stays as it is
        rest = F.slice("parts", level + 2, F.greatest(F.lit(0), F.size("parts") - (level + 1)))
        rest = F.transform(rest, lambda p: F.concat(F.lit("/"), F.when(F.col("labels") >= MIN_LABELS, F.lit("~")).otherwise(p)))
        longer = F.when(F.col("alone"), F.concat("longer", F.array_join(rest, ""))).otherwise(F.coalesce("longer", "template"))
        left = F.when(F.col("alone"), F.slice("parts", 1, level + 1)).otherwise(F.col("parts"))
        tree = materialise(
            keyed.join(named, same, "left").select("host", "path", "n", "blocked", "labels", left.alias("parts"), longer.alias("template")), "url-tree"
        )
        level += 1
    return tree.select("host", "path", "template", "n", "blocked", "labels")


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and the template of its path.

    Null urls have an empty host and path, which form a template like any other.  Null or
    repeated ids stay as rows; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(page_id).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    judged = split.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    urls = judged.groupBy("host", "path").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("found.verdict") == "block").alias("blocked"),
        F.count_if(F.col("found").isNotNull()).alias("labels"),
    )
    tree = templates(urls)
    by_template = tree.groupBy("host", "template").agg(F.sum("blocked").alias("tb"), F.sum("labels").alias("tl"))
    whole = tree.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("labels"), F.lit(0)).alias("m")).first()
    prior = (whole["b"] + 1.0) / (whole["m"] + 2.0)
    purity = (F.col("tb") + F.lit(SMOOTHING * prior)) / (F.col("tl") + F.lit(SMOOTHING))
    bad = by_template.where((F.col("tl") >= MIN_LABELS) & (purity >= PURITY)).select("host", "template", F.lit(True).alias("rejected"))
    bad = materialise(bad, "url-rejected")
    marked = tree.join(bad, ["host", "template"], "left").select(
        F.col("host").alias("th"), F.col("path").alias("tp"), "template", F.coalesce("rejected", F.lit(False)).alias("rejected")
    )
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.join(marked, (F.col("host") == F.col("th")) & (F.col("path") == F.col("tp"))).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template"
    )


def _sql_rule(column: int, rules: Sequence[Rule]) -> str:
    cases = []
    for rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule[1].partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') THEN '{rule[column]}'")
    return "CASE " + " ".join(cases) + " END"


def _sql_level(k: int) -> str:
    return f"""
c{k} AS (SELECT host, template, parts[{k + 1}] AS part, sum(n) AS n, sum(blocked) AS b, sum(labels) AS m FROM u{k} WHERE len(parts) > {k} GROUP BY ALL),
v{k} AS (SELECT *, count(*) OVER w >= {CHILDREN} AND 100 * n <= {RARE_PERCENT} * sum(n) OVER w AS var FROM c{k} WINDOW w AS (PARTITION BY host, template)),
q{k} AS (SELECT *, sum(b) FILTER (NOT var) OVER w AS pb, sum(m) FILTER (NOT var) OVER w AS pm FROM v{k} WINDOW w AS (PARTITION BY host, template)),
s{k} AS (SELECT host, template, part, template || '/' || CASE WHEN var THEN '*'
           WHEN m >= {MIN_LABELS} AND pow(CAST(b AS DOUBLE) * pm - CAST(m AS DOUBLE) * pb, 2.0) <= {Z * Z!r} * m * pb * (pm - pb) THEN '~' ELSE part END AS longer FROM q{k}),
u{k + 1} AS (SELECT u.host, u.path, u.n, u.blocked, u.labels, u.parts, coalesce(s.longer, u.template) AS template
           FROM u{k} u LEFT JOIN s{k} s ON u.host = s.host AND u.template = s.template AND u.parts[{k + 1}] = s.part)"""


#: DuckDB; the same tree, one set of tables per level.
URLS_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
j AS (SELECT *, {_sql_rule(1, RULES)} AS rule, {_sql_rule(0, RULES)} AS said FROM h),
p AS (SELECT host, path, count(*) AS n, count(*) FILTER (said = 'block') AS blocked, count(said) AS labels,
             string_split(regexp_replace(path, '^/|/$', '', 'g'), '/') AS raw FROM j GROUP BY host, path),
u0 AS (SELECT host, path, n, blocked, labels, CASE WHEN len(raw) > {DEPTH} THEN list_append(raw[1:{DEPTH - 1}], '**') ELSE raw END AS parts, '' AS template FROM p),
{",".join(_sql_level(k) for k in range(DEPTH))},
g AS (SELECT (sum(blocked) + 1.0) / (sum(labels) + 2.0) AS prior FROM p),
t AS (SELECT host, template, sum(labels) >= {MIN_LABELS} AND (sum(blocked) + {SMOOTHING} * max(prior)) / (sum(labels) + {SMOOTHING}) >= {PURITY} AS rejected
      FROM u{DEPTH}, g GROUP BY host, template)
SELECT page_id, j.host, j.path, rule, coalesce(said, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, u.template
FROM j JOIN u{DEPTH} u ON j.host = u.host AND j.path = u.path JOIN t ON t.host = u.host AND t.template = u.template"""
