"""Vector code compression: product codes learnt by Lloyd rounds over resident members.

Components become integers, a vector is cut into equal parts, and every part position has
its own codebook.  The members (one row per vector and position) live in stored tables
whose files are laid out by (position, entry, salt); the salt splits an entry that draws
a large share of all parts.  A round is:

* *update*: each owner adds up its resident members; the sums of the salts meet in one
  small aggregate, and every entry becomes the floor of its mean;
* *assign*: each owner compares its residents with the new codebook where they lie, and
  writes those that stay apart from those that leave;
* *migrate*: only the leaving ones are shuffled, to their new owners.

The codebook has ``parts x entries`` rows, so it is carried by the tasks themselves.
All arithmetic is exact: integers below 2^53 in double precision, others as Python's.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.llm.names import fresh
from ledgerwind.session import materialise, shared_folder

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
SALT_ROWS = 1 << 16  # members of one owner aimed at
CHUNK = 4096  # parts compared at once
EXACT = 2.0**53
LONGEST = (1 << 63) - 1

MEMBER = "r long, position int, part array<double>, entry int"


@dataclass
class Codebooks:
    """``entries[position][entry]`` is a list of integers; all positions are equally wide."""

    entries: list[list[list[int]]]

    def digest(self) -> str:
        flat = ",".join(str(x) for position in self.entries for entry in position for x in entry)
        return hashlib.sha256(flat.encode()).hexdigest()


class _Book:
    """One position's codebook as numbers, those too large for doubles apart."""

    def __init__(self, entries: list[list[int]]) -> None:
        self.whole = entries
        width = max(1, len(entries[0]))
        self.limit = (EXACT / width) ** 0.5 / 2  # differences of two such numbers square and add up below 2^53
        small = [k for k, e in enumerate(entries) if all(abs(x) < self.limit for x in e)]
        self.small = np.array(small, dtype=np.int64)
        self.large = [k for k in range(len(entries)) if k not in set(small)]
        self.values = np.array([entries[k] for k in small], dtype=np.float64).reshape(len(small), -1)
        self.squares = (self.values**2).sum(axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Index of the nearest entry (lower index on ties) and the squared distance of each row."""
        entry, error = np.zeros(len(rows), dtype=np.int64), [0] * len(rows)
        plain = (np.abs(rows) < self.limit).all(axis=1) if len(self.small) else np.zeros(len(rows), dtype=bool)
        if plain.any():
            x = rows[plain]
            away = self.squares[None, :] - 2 * (x @ self.values.T) + (x**2).sum(axis=1)[:, None]
            best = away.argmin(axis=1)
            entry[plain] = self.small[best]
            least = away[np.arange(len(x)), best].astype(np.int64).tolist()
            for at, value in zip(np.flatnonzero(plain).tolist(), least, strict=True):
                error[at] = value
        if self.large or not plain.all():
            for at in range(len(rows)):
                row = [int(v) for v in rows[at]]
                others = self.large if plain[at] else range(len(self.whole))
                found = [(sum((a - b) ** 2 for a, b in zip(row, self.whole[k], strict=True)), k) for k in others]
                if plain[at]:
                    found.append((error[at], int(entry[at])))
                error[at], entry[at] = min(found)
        return entry, error


def _parts(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assigned(position: np.ndarray, rows: np.ndarray, books: list[_Book]) -> tuple[np.ndarray, list[int]]:
    entry, error = np.zeros(len(rows), dtype=np.int64), [0] * len(rows)
    for at in range(0, len(rows), CHUNK):
        for p in np.unique(position[at : at + CHUNK]):
            where = at + np.flatnonzero(position[at : at + CHUNK] == p)
            entry[where], found = books[p].nearest(rows[where])
            for k, value in zip(where.tolist(), found, strict=True):
                error[k] = value
    return entry, error


def _cut(parts: int, codebooks: Codebooks):
    """Whole vectors to members with their first entry."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [_Book(e) for e in codebooks.entries]
        for batch in batches:
            if not len(batch):
                continue
            rows = _parts(batch.column(1))
            width = rows.shape[1] // parts
            for p in range(parts):
                part = np.ascontiguousarray(rows[:, p * width : (p + 1) * width])
                entry, _ = _assigned(np.full(len(part), p), part, books)
                lists = pa.ListArray.from_arrays(pa.array(range(0, part.size + 1, width), pa.int32()), pa.array(part.ravel()))
                columns = [batch.column(0), pa.array(np.full(len(part), p, np.int32)), lists, pa.array(entry.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["r", "position", "part", "entry"])

    return cut


def _reassign(codebooks: Codebooks, last: bool):
    """Residents against a new codebook, where they lie; the last time with distances instead of parts."""

    def reassign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [_Book(e) for e in codebooks.entries]
        for batch in batches:
            if not len(batch):
                continue
            entry, error = _assigned(batch.column("position").to_numpy(), _parts(batch.column("part")), books)
            new = pa.array(entry.astype(np.int32))
            if last:
                errors = pa.array([e if e <= LONGEST else None for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("r"), batch.column("position"), new, errors], names=["r", "position", "entry", "error"])
            else:
                moved = pa.array(entry != batch.column("entry").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], new, moved], names=["r", "position", "part", "entry", "moved"])

    return reassign


def _resident_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(position, entry, members, sums) of what lies in this partition; sums as decimal digits."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        if not len(batch):
            continue
        rows, position, entry = _parts(batch.column("part")), batch.column("position").to_numpy(), batch.column("entry").to_numpy()
        key = position.astype(np.int64) << 32 | entry
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        small = len(rows) * np.abs(rows).max(initial=0.0) < EXACT
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            members = rows[order[a:b]]
            sums = [int(s) for s in members.sum(axis=0)] if small else [sum(int(x) for x in c) for c in members.T]
            k = int(key[order[a]])
            count, before = held.get((k >> 32, k & 0xFFFFFFFF), (0, [0] * len(sums)))
            held[k >> 32, k & 0xFFFFFFFF] = [count + int(b - a), [x + y for x, y in zip(before, sums, strict=True)]]
    if held:
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([[str(s) for s in held[k][1]] for k in keys])],
            names=["position", "entry", "members", "sums"],
        )


def _mean(table: pa.Table) -> pa.Table:
    """The partial sums of one (position, entry), one row per owner, to the floor of the mean."""
    count = sum(table.column("members").to_pylist())
    totals = [sum(map(int, column)) // count for column in zip(*table.column("sums").to_pylist(), strict=True)]
    return pa.table({"position": table.column("position")[:1], "entry": table.column("entry")[:1], "value": pa.array([[str(t) for t in totals]])})


def _updated(resident: DataFrame, codebooks: Codebooks) -> Codebooks:
    sums = resident.mapInArrow(_resident_sums, "position int, entry int, members long, sums array<string>")
    means = sums.groupBy("position", "entry").applyInArrow(_mean, "position int, entry int, value array<string>")
    entries = [list(position) for position in codebooks.entries]
    for row in means.collect():  # parts x entries rows at most
        entries[row["position"]][row["entry"]] = [int(v) for v in row["value"]]
    return Codebooks(entries)


def _to_owners(members: DataFrame, salts: int, name: str) -> DataFrame:
    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = members.repartition(width, "position", "entry", F.pmod(F.xxhash64("r"), F.lit(salts)))
    return materialise(placed, name)


def _migrated(resident: DataFrame, codebooks: Codebooks, salts: int) -> DataFrame:
    """Residents after an assignment: those that stay lie where they lay, the others have moved."""
    spark = resident.sparkSession
    path = f"{shared_folder(spark)}/stages/members-{uuid.uuid4().hex}"
    told = resident.mapInArrow(_reassign(codebooks, last=False), f"{MEMBER}, moved boolean")
    told.write.partitionBy("moved").parquet(path)
    stored = spark.read.schema(told.schema).parquet(path)
    stayed, leaving = (stored.where(c).drop("moved") for c in ("not moved", "moved"))
    return stayed.unionByName(_to_owners(leaving, salts, "migrated"))


def whole_numbers(embedding: str, scale: int = SCALE) -> F.Column:
    """floor(scale * x) of each component, as doubles (exact); null if the vector is null or one is null or not finite."""
    scaled = F.transform(embedding, lambda x: x.cast("double") * float(scale))
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(scaled, lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0)))


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """The rows of ``vectors`` with ``code`` (array of entry indexes) and ``error`` in place of the vector, and the codebooks.

    Rows whose vector is null or has a component that is null, or not finite once scaled, are
    left out.  All vectors of a product code have one length: the most frequent among those
    that ``parts`` divides (the shorter on ties).  Rows of another length, empty ones included,
    keep their place with null code and error.  The first codebook are the ``entries`` rows of
    least id (ties by vector; null ids come last); with fewer rows it is shorter.  Every
    repeated row counts.  An error beyond a long is null.  Columns called ``code`` or ``error``
    are replaced.  An empty table gives no rows and codebooks without entries.
    """
    kept = [c for c in vectors.columns if c.lower() not in {embedding.lower(), "code", "error"}]
    r, v = fresh(vectors, "r", "v")
    base = vectors.select(*kept, F.monotonically_increasing_id().alias(r), whole_numbers(embedding, scale).alias(v))
    base = materialise(base.where(F.col(v).isNotNull()), "whole-vectors")
    by_length = base.groupBy(F.size(v).alias("d")).count().where(f"d > 0 and d % {parts} = 0")
    length = by_length.orderBy(F.desc("count"), "d").first()
    fits = F.size(v) == (length["d"] if length else -1)
    seeds = base.where(fits).orderBy(F.col(vec_id).asc_nulls_last(), v).limit(entries).select(v).collect()
    if not seeds:
        none = [F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error")]
        return base.select(*kept, *none), Codebooks([[] for _ in range(parts)])
    width = length["d"] // parts
    codebooks = Codebooks([[[int(x) for x in row[0][p * width : (p + 1) * width]] for row in seeds] for p in range(parts)])
    salts = -(-base.count() // SALT_ROWS)

    first = base.where(fits).select(F.col(r).alias("r"), F.col(v).alias("v")).mapInArrow(_cut(parts, codebooks), MEMBER)
    resident = _to_owners(first, salts, "members")
    for done in range(rounds):
        if done:
            resident = _migrated(resident, codebooks, salts)
        codebooks = _updated(resident, codebooks)

    last = resident.mapInArrow(_reassign(codebooks, last=True), "r long, position int, entry int, error long")
    place = F.array_sort(F.collect_list(F.struct("position", "entry")))  # one row per position
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    coded = last.groupBy("r").agg(
        F.transform(place, lambda x: x["entry"]).alias("code"), F.when(F.count("error") == F.count("*"), total).alias("error")
    )
    coded = coded.withColumnRenamed("r", "of")
    return base.join(coded, F.col(r) == F.col("of"), "left").select(*kept, "code", "error"), codebooks


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of every vector of ``embeddings``."""
    coded, codebooks = compress(vectors.select("vec_id", "embedding", "label"))
    hexed = F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    rows = materialise(coded.select("vec_id", "label", hexed.alias("code"), "error"), "codes")
    of_label = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    of_label = materialise(of_label.withColumnRenamed("label", "of"), "label-errors")
    return rows.join(of_label, rows["label"].eqNullSafe(of_label["of"])).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256")
    )


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB: every part against every entry in each round, so for small tables only."""
    steps = [f"""WITH whole AS MATERIALIZED (
SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
SELECT r, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x FROM whole, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS entry, x AS value FROM part WHERE r <= {entries})"""]  # fmt: skip
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
SELECT r, part.p AS p, min({{'d': list_sum(list_transform(list_zip(x, value), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': entry}}) AS best
FROM part JOIN book{k} USING (p) GROUP BY r, part.p)""")
        if k < rounds:
            steps.append(f"""mean{k} AS MATERIALIZED (
SELECT p, entry, list(m ORDER BY place) AS value FROM (
  SELECT p, entry, place, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
    SELECT p, best.e AS entry, place, sum(x[place]) AS s, count(*) AS n
    FROM near{k} JOIN part USING (r, p), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS place) GROUP BY ALL)) GROUP BY p, entry),
book{k + 1} AS MATERIALIZED (
SELECT b.p AS p, b.entry AS entry, coalesce(m.value, b.value) AS value FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.entry = m.entry)""")
    return ",\n".join(steps) + f""",
code AS (
SELECT r, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
shown AS (SELECT vec_id, label, code, error FROM code JOIN whole USING (r)),
told AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM shown GROUP BY label),
book AS (SELECT sha256(string_agg(array_to_string(value, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM shown JOIN told ON shown.label IS NOT DISTINCT FROM told.label, book"""


CODES_SQL = codes_sql()
