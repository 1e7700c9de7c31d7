"""Near-duplicates by the exact Jaccard similarity of word shingles.

Two texts are near-duplicates if their sets of ``width``-word shingles share ``SHARE`` or
more of their union.  Candidates agree in one of ``BANDS`` bands of ``ROWS`` minima; a pair
at similarity s has none in common with probability (1 - s^5)^32, 3e-6 at 0.8 and less
above.  Every pair that becomes a link is counted on its whole shingle sets.

Texts with equal sets are one node, named by 128 bits.  A fixed number of steps joins them:

* all members of a bucket meet its least member, which unites most groups of copies;
* buckets whose members are then in several components are joined in blocks of bounded
  rows: the members outside the bucket's largest component against all its members.  A
  block skips what it has united already, drops pairs whose minima differ too much, counts
  the rest, and emits a forest of links, never pairs.

So no candidate that could still unite two groups is left out, and a template shared by
many texts costs one pass over its bucket however many of them are different.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from ledgerwind.llm.components import components
from ledgerwind.session import materialise

WIDTH = 5
SHARE = (4, 5)  # 0.8, as a fraction
BANDS, ROWS = 32, 5
LIKELY = 0.6  # share of equal minima below which a pair is not counted: 6 deviations below 0.8
BLOCK_ROWS = 1024
TEXTS_AT_ONCE = 1024  # of a batch: whole texts and their buckets are held for so many rows
SEED = 42

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:])], dtype=np.uint64))


def set_key(hashes: np.ndarray) -> str:
    """One name of 128 bits for a whole shingle set; zeros for an empty one."""
    return xxhash.xxh3_128_hexdigest(hashes.tobytes(), SEED) if len(hashes) else "0" * 32


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(_FLIP), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ _FLIP) * _TIMES).min(axis=0))
    return least


def bands(hashes: np.ndarray) -> list[int]:
    """The bucket of a shingle set in every band; an empty set has none."""
    if not len(hashes):
        return []
    raw = minima(hashes).tobytes()
    keys = [xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def alike(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two shingle sets share ``SHARE`` or more of their union."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return SHARE[1] * both >= SHARE[0] * (len(one) + len(two) - both)


def set_columns(text: str, width: int, key: str, buckets: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the key of the text's shingle set and its buckets to batches, ``TEXTS_AT_ONCE`` rows at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, TEXTS_AT_ONCE) for at in range(0, len(whole), TEXTS_AT_ONCE)):
                keys, found = [], []
                for value in batch.column(text).to_pylist():
                    hashes = shingles(value, width)
                    keys.append(set_key(hashes))
                    found.append(bands(hashes))
                columns = [*batch.columns, pa.array(keys, pa.string()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, key, buckets])

    return add


def set_fields(key: str, buckets: str) -> list[StructField]:
    """The columns that :func:`set_columns` adds."""
    return [StructField(key, StringType()), StructField(buckets, ArrayType(LongType()))]


def _payload(width: int):
    """Texts of sets to their marks (16 bits of every minimum) and whole sorted hashes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, len(whole), 256)):
                sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
                marks = [minima(h).astype(np.uint16).tobytes() for h in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("s"), pa.array(marks, pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["s", "marks", "hashes"]
                )

    return pack


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            near = (_marks(batch.column("marks_a")) == _marks(batch.column("marks_b"))).mean(axis=1) >= LIKELY
            yield batch.select(["a", "b"]).filter(pa.array(near))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("hashes_a").to_pylist(), batch.column("hashes_b").to_pylist(), strict=True)
        keep = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sets]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of set keys that are alike by the ``payload`` (s, marks, hashes) of their sets."""
    one, two = (payload.select(F.col("s").alias(x), F.col("marks").alias(f"marks_{x}"), F.col("hashes").alias(f"hashes_{x}")) for x in "ab")
    near = pairs.join(one.drop("hashes_a"), "a").join(two.drop("hashes_b"), "b").select("a", "b", "marks_a", "marks_b")
    likely = materialise(near.mapInArrow(_likely, "a string, b string"), "likely-pairs")
    whole = likely.join(one.drop("marks_a"), "a").join(two.drop("marks_b"), "b").select("a", "b", "hashes_a", "hashes_b")
    return whole.mapInArrow(_counted, "a string, b string")


def _block(table: pa.Table) -> pa.Table:
    """Links that unite the own rows of a block with its other rows and with each other."""
    names, roots, own = table.column("s").to_pylist(), table.column("root").to_pylist(), table.column("own").to_numpy()
    marks, raw = _marks(table.column("marks")), table.column("hashes")
    number = {root: k for k, root in enumerate(sorted(set(roots)))}
    group = np.array([number[r] for r in roots])
    held: dict[int, np.ndarray] = {}

    def whole(i: int) -> np.ndarray:
        if i not in held:
            held[i] = np.frombuffer(raw[i].as_py(), np.uint64)
        return held[i]

    one, two = [], []
    for i in np.flatnonzero(own == 1):
        apart = np.flatnonzero(group != group[i])
        near = apart[(marks[apart] == marks[i]).mean(axis=1) >= LIKELY] if len(apart) else apart
        for j in near:
            if group[j] != group[i] and alike(whole(i), whole(j)):
                one.append(names[i])
                two.append(names[j])
                group[group == group[j]] = group[i]
    return pa.table({"a": pa.array(one, pa.string()), "b": pa.array(two, pa.string())})


def _joined_blocks(member: DataFrame, payload: DataFrame) -> DataFrame:
    """Links within buckets of ``member`` (bucket, s, root) whose members have several roots."""
    parts = member.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    sides = parts.groupBy("bucket").agg(F.sum("m").alias("all"), F.max(F.struct("m", "root")).alias("main"), F.count("*").alias("roots"))
    lots = lambda rows: F.ceil(rows / BLOCK_ROWS).cast("int")
    open_ = sides.where("roots > 1").select(
        "bucket", F.col("main.root").alias("main"), lots(F.col("all") - F.col("main.m")).alias("own_lots"), lots(F.col("all")).alias("lots")
    )
    rows = member.join(materialise(open_, "open-buckets"), "bucket").join(payload, "s")
    lot = lambda n: F.pmod(F.xxhash64("s"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    places = F.transform(every("own_lots"), lambda i: F.struct(i.alias("i"), lot("lots").alias("j"), F.lit(0).alias("own")))
    mine = F.transform(every("lots"), lambda j: F.struct(lot("own_lots").alias("i"), j.alias("j"), F.lit(1).alias("own")))
    none = F.array().cast("array<struct<i:int,j:int,own:int>>")
    placed = F.concat(places, F.when(F.col("root") != F.col("main"), mine).otherwise(none))
    dealt = rows.select("bucket", "s", "root", "marks", "hashes", F.inline(placed))
    return dealt.groupBy("bucket", "i", "j").applyInArrow(_block, "a string, b string")


def set_groups(marked: DataFrame, key: str, buckets: str, text: str, row: str, width: int = WIDTH, more: DataFrame | None = None) -> DataFrame:
    """(s, root) of every shingle set in ``marked``, a stored table with a number ``row`` for each row.

    ``more`` (s, bucket) are buckets of sets beside those of the bands.
    """
    sets = materialise(marked.groupBy(F.col(key).alias("s")).agg(F.min(row).alias("r"), F.first(buckets).alias("in")), "shingle-sets")
    member = sets.select("s", "r", F.explode("in").alias("bucket"))
    if more is not None:
        member = member.unionByName(sets.select("s", "r").join(more, "s"))
    shared = member.groupBy("bucket").agg(F.min("s").alias("hub"), F.max("s").alias("high")).where("hub <> high")
    shared = materialise(shared.select(F.col("bucket").alias("at"), "hub"), "shared-buckets")
    member = materialise(member.join(shared, F.col("bucket") == F.col("at")).select("bucket", "s", "r", "hub"), "bucket-members")
    reps = member.select(F.col("r").alias("rep"), "s").distinct()
    texts = marked.select(row, F.col(text).alias("text")).join(reps, F.col(row) == F.col("rep")).select("s", "text")
    payload = materialise(texts.mapInArrow(_payload(width), "s string, marks binary, hashes binary"), "shared-sets")

    pairs = member.where("s <> hub").select(F.col("s").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialise(confirmed(pairs, payload), "hub-links")
    roots = materialise(components(links), "hub-roots").select(F.col("node").alias("of"), F.col("root").alias("now"))
    rooted = member.join(roots, F.col("s") == F.col("of"), "left").select("bucket", "s", F.coalesce("now", "s").alias("root"))
    more = materialise(_joined_blocks(materialise(rooted, "rooted-members"), payload), "block-links")
    parts = components(links.unionByName(more))
    return sets.join(parts, sets.s == parts.node, "left").select("s", F.coalesce("root", "s").alias("root"))
