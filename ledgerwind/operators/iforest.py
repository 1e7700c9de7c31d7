"""Isolation forest over every entity at once, as plain relational steps.

*Sample.*  The rows of an entity are numbered in an order given by a digest.  A tree takes
one row out of each of at most 256 equal stretches of that order, so a sample is a join on
(entity, number): no row is copied once per tree and ranked again.

*Growth.*  All trees of all entities grow together, level by level.  The bounds of a
node are windows over (entity, tree, node), which hold at most one sample.  Feature and
split are drawn from the digest of that key: a forest depends on its rows alone.

*Scoring.*  A tree's nodes are an array in breadth-first order, in which the k-th inner node
has its children at 2 k and 2 k + 1.  Rows meet the trees of their entity and walk down by
column expressions; only the mean depth of a row leaves the task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv
from ledgerwind.operators.detect import severity_below
from ledgerwind.operators.forecast import ENTITY
from ledgerwind.operators.thresholds import Overrides, with_thresholds
from ledgerwind.session import materialise

TREES = 100
SAMPLE_ROWS = 256
LEVELS = 8  # halvings of a full sample
LEVELS_AT_ONCE = 3  # grown in one plan
MINIMUM_ROWS = 60
PLACES = 4  # of the features, so that no tree hangs on the order of a summation
EULER_GAMMA = 0.5772156649015329

_TREE = ["entity_id", "tree"]
_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


def draw(*parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of ``parts``."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, _DIGITS)
    return F.conv(digits, 16, 10).cast("double") / float(16**_DIGITS)


def mean_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    rows = n.cast("double")
    return F.when(rows > 2, 2 * (F.log(rows - 1) + EULER_GAMMA) - 2 * (rows - 1) / rows).when(rows == 2, 1.0).otherwise(0.0)


def numbered(vectors: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows of entities with enough of them, numbered from 0 in digest order; ``n`` rows each."""
    whole = Window.partitionBy("entity_id")
    order = whole.orderBy(F.md5(F.concat_ws("|", "entity_id", F.col("event_date").cast("string"))), "event_date")
    rows = vectors.select("entity_id", "event_date", *[F.round(f, PLACES).alias(f) for f in features])
    rows = rows.withColumns({"number": F.row_number().over(order) - 1, "n": F.count("*").over(whole)})
    return rows.where(F.col("n") >= MINIMUM_ROWS)


def samples(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(entity_id, tree, rows, features): one row of every stretch for every tree."""
    sizes = rows.groupBy("entity_id").agg(F.max("n").alias("n")).withColumn("rows", F.least(F.col("n"), F.lit(SAMPLE_ROWS)))
    stretches = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "*", F.explode(F.expr("sequence(0L, rows - 1)")).alias("stretch")
    )
    first = F.expr("stretch * n div rows")
    width = F.expr("(stretch + 1) * n div rows") - first
    number = first + F.floor(draw("entity_id", "tree", "stretch") * width)
    return stretches.select(*_TREE, "rows", number.alias("number")).join(rows.select("entity_id", "number", *features), ["entity_id", "number"])


def _draw_sql(key: str, first_digit: int) -> str:
    return f"cast(conv(substring({key}, {first_digit}, {_DIGITS}), 16, 10) as double) / {float(16**_DIGITS)!r}D"


def _picked(values: Sequence[str], index: str) -> str:
    return "case " + " ".join(f"when {index} = {k} then {v}" for k, v in enumerate(values)) + " end"


def grow(sampled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Nodes (entity_id, tree, rows, node, feature, split, depth) of every tree.

    Node numbers are those of a heap (root 1, children of ``k`` at ``2 k`` and ``2 k + 1``).  A
    leaf has no feature; its ``depth`` includes the expected rest for the rows it holds.
    A few levels are one plan over one partitioning by (entity, tree), in which rows keep
    the nodes they have met; then they are stored, so plans do not grow with the depth.
    """
    count = range(len(features))
    own = ["entity_id", "tree", "rows", *[f"x{k}" for k in count]]
    per_node = "over (partition by entity_id, tree, node)"
    bounds = [f"{how}(x{k}) {per_node} as {how}{k}" for k in count for how in ("min", "max")]
    wide = ", ".join(f"case when max{k} > min{k} then {k} end" for k in count)
    low, high, value = (_picked([f"{name}{k}" for k in count], "feature") for name in ("min", "max", "x"))
    depth = mean_path(F.col("size")) + F.length(F.bin("node")) - 1
    no_path = "cast(array() as array<struct<node:bigint,feature:int,split:double,depth:double>>) as path"
    growing = sampled.selectExpr("entity_id", "tree", "rows", *[f"`{f}` as x{k}" for k, f in enumerate(features)], "1L as node", "true as open")
    met = []
    for level in range(LEVELS + 1):
        if level % LEVELS_AT_ONCE == 0:
            growing = growing.where("open").repartition(*_TREE).selectExpr(*own, "node", "open", no_path)
        bounded = growing.selectExpr(*own, "node", "open", "path", *bounds, f"count(*) {per_node} as size", "md5(concat_ws('|', entity_id, tree, node)) as digest")
        drawn = bounded.selectExpr(
            "*", f"case when open and size > 1 and length(bin(node)) <= length(bin(greatest(rows, 2L) - 1)) then array_compact(array({wide})) end as wide"
        ).selectExpr("*", f"get(wide, cast(floor({_draw_sql('digest', 1)} * size(wide)) as int)) as feature")
        split = drawn.selectExpr("*", f"{low} as low", f"{high} as high").selectExpr("*", f"low + {_draw_sql('digest', 1 + _DIGITS)} * (high - low) as drawn")
        split = split.selectExpr("*", "case when drawn < high then drawn else low end as split").withColumn("told", F.struct("node", "feature", "split", depth.alias("depth")))
        growing = split.selectExpr(
            *own, f"case when feature is null then node else 2 * node + cast({value} > split as int) end as node",
            "feature is not null as open", "case when open then concat(path, array(told)) else path end as path",
        )
        if level % LEVELS_AT_ONCE == LEVELS_AT_ONCE - 1 or level == LEVELS:
            growing = materialise(growing, "forest-levels")
            met.append(growing.select(*_TREE, "rows", F.inline("path")))
    return reduce(DataFrame.unionByName, met).dropDuplicates([*_TREE, "node"])


def fit_forests(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per entity and tree: its nodes as arrays in breadth-first order."""
    nodes = grow(samples(rows, features), features)
    order = Window.partitionBy(*_TREE).orderBy("node")
    ranked = nodes.withColumn("inner", F.count("feature").over(order))
    packed = F.array_sort(F.collect_list(F.struct("node", "feature", "split", "depth", "inner")))
    trees = ranked.groupBy(*_TREE, "rows").agg(packed.alias("nodes"))  # at most 2 * SAMPLE_ROWS nodes
    return trees.select(*_TREE, "rows", *[F.col(f"nodes.{c}") for c in ("feature", "split", "depth", "inner")])


def score_rows(rows: DataFrame, forests: DataFrame, features: Sequence[str]) -> DataFrame:
    """Raw score per row: minus two to the minus mean depth over expected depth."""
    walk = rows.select("entity_id", "event_date", *features).join(forests, "entity_id").withColumn("at", F.lit(0))
    for _ in range(LEVELS):
        walk = walk.withColumn("by", F.get("feature", "at"))
        value = reduce(lambda rest, k: F.when(F.col("by") == k, F.col(features[k])).otherwise(rest), reversed(range(len(features))), F.lit(None))
        child = 2 * F.get("inner", F.col("at")) - 1 + (value > F.get("split", F.col("at"))).cast("int")
        walk = walk.withColumn("at", F.when(F.col("by").isNull(), F.col("at")).otherwise(child))
    depths = walk.groupBy("entity_id", "event_date").agg(F.avg(F.get("depth", F.col("at"))).alias("depth"), F.max("rows").alias("rows"))
    return depths.select("entity_id", "event_date", (-F.pow(F.lit(2.0), -F.col("depth") / mean_path(F.col("rows")))).alias("raw_score"))


def anomaly_scores(vectors: DataFrame, features: Sequence[str], overrides: Overrides | None = None) -> DataFrame:
    """Score of every row, shifted so the most anomalous share lies below zero.

    The share is the entity's ``contamination``.  All configured shares are
    taken from one percentile aggregate and each entity picks its own.
    """
    rows = materialise(numbered(vectors, features), "numbered")
    forests = materialise(fit_forests(rows, features), "forests")
    raw = score_rows(rows, forests, features).withColumn("entity_type", F.lit("facility"))
    configured = {s["isolation_forest"]["contamination"] for s in (overrides or {}).values() if "contamination" in s.get("isolation_forest", {})}
    shares = F.array(*[F.lit(float(v)) for v in sorted({fv.DEFAULT_THRESHOLDS["isolation_forest"]["contamination"], *configured})])
    own = F.array_position(shares, F.col("isolation_forest_contamination")).cast("int")
    cut = F.element_at(F.percentile("raw_score", shares).over(Window.partitionBy("entity_id")), own)
    return (
        with_thresholds(raw, overrides)
        .withColumn("score", F.col("raw_score") - cut)
        .select(*ENTITY, "event_date", "raw_score", "score", "isolation_forest_p1_score", "isolation_forest_p2_score")
    )


def last_row_scores(vectors: DataFrame, features: Sequence[str], overrides: Overrides | None = None) -> DataFrame:
    """Score of every entity's last row, with a severity where it is isolated."""
    values = ["score", "isolation_forest_p1_score", "isolation_forest_p2_score"]
    last = anomaly_scores(vectors, features, overrides).groupBy(*ENTITY).agg(
        F.max_by(F.struct(*values), "event_date").alias("_row")
    )
    severity = severity_below(*[F.col(f"_row.{v}") for v in values])
    return last.select(*ENTITY, F.col("_row.score").alias("score"), severity.alias("severity"))


def isolation_forest(vectors: DataFrame, features: Sequence[str], overrides: Overrides | None = None) -> DataFrame:
    """Findings for entities whose last row is isolated; ``vectors`` carry ``entity_id``."""
    nothing = F.lit(None).cast("double")
    return last_row_scores(vectors, features, overrides).filter("severity is not null").select(
        *ENTITY,
        F.lit("multivariate").alias("metric"),
        F.lit("isolation_forest").alias("detector"),
        nothing.alias("expected"),
        nothing.alias("actual"),
        nothing.alias("deviation_pct"),
        "severity",
        "score",
    )
