"""Embedding near-duplicates by an exact metric range join.

Vectors link at a cosine of at least the threshold, that is within an angle ``r``.
Equal vectors are joined first: one of them stands for all, with their number.  Pivots,
picked far apart from a bounded sample, partition the rest by the nearest one.  A vector
is replicated into the cell of another pivot ``c`` only if the triangle inequality lets
that cell hold anything within ``r`` of it:

* its angle to ``c`` is at most the cell's radius plus ``r``;
* its angle to ``c`` is at most its angle to its own pivot plus ``2 r``; and
* its angle to the plane half-way between both pivots is at most ``r``.

So every cell has all partners of its own vectors and is joined by itself, in blocks of
bounded size.  A block gives the number of links of each own vector and star edges that
connect what is linked; pairs are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.llm.components import components
from ledgerwind.session import materialise

THRESHOLD = 0.9
SAMPLE_ROWS = 4096  # vectors the pivots are picked from
CELL_ROWS = 4096  # vectors of a cell aimed at
MOST_PIVOTS = 1024
OWN_BLOCK, MEMBER_BLOCK = 4096, 16384
PAIRS = 1 << 22  # pairs held at once
SLACK = 1e-9  # radians, against rounding of angles

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each further pivot is the sample's vector farthest from those before."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


class Cells:
    """Pivots and radii: which cells a vector belongs to."""

    def __init__(self, pivots: np.ndarray, radius: float) -> None:
        self.pivots, self.r = pivots, radius
        self.radii: np.ndarray | None = None
        gaps = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
        self.gaps = np.where(gaps > 0, gaps, 1.0)

    def own(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cos = np.clip(unit @ self.pivots.T, -1, 1)
        cell = cos.argmax(axis=1)
        return cell, cos, np.arccos(cos[np.arange(len(cell)), cell])

    def member(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cell of each row, and rows x cells: does the row go there?"""
        cell, cos, near = self.own(unit)
        angle = np.arccos(cos)
        half_way = (cos[np.arange(len(cell)), cell][:, None] - cos) / self.gaps[cell]
        goes = angle <= self.radii[None, :] + self.r + SLACK
        goes &= angle <= near[:, None] + 2 * self.r + SLACK
        goes &= half_way <= math.sin(self.r) + SLACK
        goes[np.arange(len(cell)), cell] = True
        return cell, goes


def _stars(own_ids: np.ndarray, part_ids: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    mine, least = own_ids.copy(), part_ids
    while True:
        least = np.minimum(part_ids, np.where(near, mine[:, None], part_ids[None, :]).min(axis=0))
        after = np.minimum(mine, np.where(near, least[None, :], mine[:, None]).min(axis=1))
        if (after == mine).all():
            break
        mine = after
    for nodes, labels in ((own_ids, mine), (part_ids, least)):
        moved = nodes != labels
        yield nodes[moved], labels[moved]


def _join_block(threshold: float):
    def join(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy() == 1
        ids, copies, unit = table.column("node").to_numpy(), table.column("copies").to_numpy(), _unit(_matrix(table.column("embedding")))
        mine, mine_ids, mine_copies = unit[own], ids[own], copies[own]
        rest, rest_ids, rest_copies = unit[~own], ids[~own], copies[~own]
        links, found = np.zeros(len(mine), dtype=np.int64), []
        margin = max(1e-5, 3e-7 * unit.shape[1])
        small, small_rest = mine.astype(np.float32), rest.astype(np.float32)
        step = max(1, PAIRS // max(1, len(mine)))
        for at in range(0, len(rest), step):
            cos = small @ small_rest[at : at + step].T
            near = cos >= np.float32(threshold + margin)
            i, j = np.nonzero((cos >= np.float32(threshold - margin)) & ~near)
            if len(i):  # too near the threshold for single precision
                near[i, j] = np.einsum("ij,ij->i", mine[i], rest[at + j]) >= threshold
            part_ids = rest_ids[at : at + step]
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(rows):
                continue
            near = near[np.ix_(rows, columns)]
            near |= mine_ids[rows][:, None] == part_ids[columns][None, :]
            links[rows] += near @ rest_copies[at : at + step][columns]
            same = np.isin(mine_ids[rows], part_ids)
            links[rows] -= np.where(same, 1, 0)  # the vector itself
            if len(columns) > 1 or len(rows) > 1:
                found += _stars(mine_ids[rows], part_ids[columns], near)
        nodes = np.concatenate([mine_ids, *(a for a, _ in found)])
        others = [None] * len(mine_ids) + [int(x) for _, b in found for x in b]
        counts = np.concatenate([links, np.zeros(len(nodes) - len(links), dtype=np.int64)])
        return pa.table({"a": nodes, "b": pa.array(others, pa.int64()), "links": counts})

    return join


def _linked(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): link counts of nodes (b null) and star edges, of ``vectors`` (node, copies, embedding).

    All vectors have one length here and are valid and different.
    """
    size = vectors.count()
    head = vectors.select("node", "embedding").orderBy(F.xxhash64("embedding"), "node").limit(SAMPLE_ROWS).collect()
    pivots = pick_pivots(_unit(np.array([r["embedding"] for r in head], dtype=np.float64)), min(MOST_PIVOTS, -(-size // CELL_ROWS)))
    cells = Cells(pivots, math.acos(threshold))
    count = len(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, radii = np.zeros(count, dtype=np.int64), np.full(count, -1.0)
        for batch in batches:
            cell, _, near = cells.own(_unit(_matrix(batch.column(0))))
            own += np.bincount(cell, minlength=count)
            np.maximum.at(radii, cell, near)
        yield pa.RecordBatch.from_arrays([pa.array(range(count)), pa.array(own), pa.array(radii)], names=["cell", "own", "radius"])

    only = vectors.select("embedding")
    told = only.mapInArrow(measure, "cell long, own long, radius double").groupBy("cell").agg(F.sum("own").alias("own"), F.max("radius").alias("radius"))
    told = sorted(told.collect())  # one row per pivot
    own = np.array([r["own"] for r in told])
    cells.radii = np.array([r["radius"] if r["own"] else -10.0 for r in told])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = np.zeros(count, dtype=np.int64)
        for batch in batches:
            members += cells.member(_unit(_matrix(batch.column(0))))[1].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(count)), pa.array(members)], names=["cell", "members"])

    many = sorted(only.mapInArrow(weigh, "cell long, members long").groupBy("cell").agg(F.sum("members").alias("members")).collect())
    own_deals = np.maximum(1, -(-own // OWN_BLOCK))
    member_deals = np.maximum(1, -(-np.array([r["members"] for r in many]) // MEMBER_BLOCK))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 1024) for at in range(0, len(whole), 1024)):
                nodes = batch.column("node").to_numpy()
                lot = (nodes.astype(np.uint64) * _MIX) >> np.uint64(33)
                cell, goes = cells.member(_unit(_matrix(batch.column("embedding"))))
                rows, into = np.nonzero(goes)
                out: list[tuple[np.ndarray, ...]] = []
                for j in range(int(member_deals[cell].max(initial=0))):
                    use = np.flatnonzero(member_deals[cell] > j)
                    out.append((use, cell[use], lot[use] % own_deals[cell[use]].astype(np.uint64), np.full(len(use), j), np.ones(len(use), np.int8)))
                for i in range(int(own_deals[into].max(initial=0))):
                    use = np.flatnonzero(own_deals[into] > i)
                    r, c = rows[use], into[use]
                    out.append((r, c, np.full(len(use), i), lot[r] % member_deals[c].astype(np.uint64), np.zeros(len(use), np.int8)))
                take, at, i, j, mine = (np.concatenate([o[k] for o in out]) for k in range(5))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(mine), *(batch.column(c).take(pa.array(take)) for c in ("node", "copies", "embedding"))],
                    names=["cell", "i", "j", "own", "node", "copies", "embedding"],
                )

    kind = vectors.schema["embedding"].dataType.simpleString()
    dealt = vectors.select("node", "copies", "embedding").mapInArrow(spread, f"cell long, i long, j long, own byte, node long, copies long, embedding {kind}")
    return dealt.groupBy("cell", "i", "j").applyInArrow(_join_block(threshold), "a long, b long, links long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    Vectors that are null, empty, zero or hold nulls, NaN or infinities link with nothing;
    nor do vectors of different lengths.  Copies of a vector link with each other.  A null
    id counts as a link; a component's id is its least id that is not null.  A row is kept
    if its id is its component's.  An empty table gives an empty result.
    """
    big = F.lit(float("inf"))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(embedding, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fine, F.col(embedding)).alias("embedding"))
    rows = materialise(rows, "vectors")
    distinct = rows.where("embedding is not null").groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    lengths = [r["d"] for r in distinct.select(F.size("embedding").alias("d")).distinct().collect()]
    parts = [_linked(distinct.where(F.size("embedding") == d), threshold) for d in lengths]
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "a long, b long, links long")
    for part in parts:
        found = found.unionByName(part)
    found = materialise(found, "vector-links")
    counts = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "of")
    known = distinct.join(counts, "node").join(roots, F.col("node") == F.col("of"), "left")
    known = known.select("embedding", "least", "links", F.coalesce("root", "node").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select(F.col("embedding").alias("e"), "links", F.col("component_id").alias("c"), F.lit(True).alias("known"))
    joined = rows.join(known, rows["embedding"] == known["e"], "left")
    component = F.when(F.col("known"), F.col("c")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


#: DuckDB; all pairs, so for small tables only.
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN comp USING (r) LEFT JOIN n USING (r)"""
