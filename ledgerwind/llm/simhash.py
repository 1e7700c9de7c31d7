"""SimHash near-duplicates joined through the anchors of a covering code.

A fingerprint has 64 bits and links at 3 or fewer differing bits, so at least one of
its two 32-bit halves differs in one bit or none.  The anchors of a half are the
codewords of the perfect Hamming code of length 31 (covering radius 1), once for each
value of the spare top bit.  Every half goes to all anchors within covering radius plus
threshold (1 + 1 bits): at most 17.  The half's own (nearest) anchor then holds every
half one bit away, so comparing own rows with all rows of each anchor misses no link.
Two times 2^27 anchors keep the groups small; groups with many own rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerwind.llm.components import components
from ledgerwind.llm.jaccard import WIDTH, set_columns, set_fields, set_groups
from ledgerwind.llm.names import fresh
from ledgerwind.session import materialise

SEED = 42
MAX_DISTANCE = 3
OWN_ROWS = 4096  # own rows of one anchor compared in one group; more are dealt out
CELLS = 1 << 22  # pairs held at once

_TOP = np.uint64(1 << 31)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a text as a signed integer; no words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:])]
    counts = np.zeros(64, dtype=np.int64)
    whole = np.array(hashes, dtype=np.uint64)
    for at in range(0, len(whole), 65536):
        part = whole[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(whole), bitorder="little").view(np.int64)[0])


def print_column(text: str, width: int, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the fingerprint of the whole text to batches."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t, width) for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, column])

    return add


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 3, column: str = "fingerprint_bits") -> DataFrame:
    """All columns of ``docs`` and the fingerprint of the whole text as a long."""
    return docs.mapInArrow(print_column(text, width, column), StructType([*docs.schema.fields, StructField(column, LongType())]))


def with_sets_and_fingerprints(docs: DataFrame, text: str, width: int, key: str, buckets: str, column: str) -> DataFrame:
    """All columns of ``docs``, the key and buckets of the text's shingle set, and its fingerprint.

    One pass: two in a row would keep two Python workers busy for every task.
    """
    sets, prints = set_columns(text, width, key, buckets), print_column(text, 3, column)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from prints(sets(batches))

    return docs.mapInArrow(add, StructType([*docs.schema.fields, *set_fields(key, buckets), StructField(column, LongType())]))


def _syndrome_tables() -> np.ndarray:
    tables = np.zeros((4, 256), dtype=np.uint64)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                place = byte * 8 + bit + 1
                if value >> bit & 1 and place <= 31:
                    tables[byte, value] ^= np.uint64(place)
    return tables


def anchor_rows(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, own, fingerprint) of every anchor each fingerprint goes to."""
    tables, one = _syndrome_tables(), np.uint64(1)
    keys, owns, rows = [], [], []

    def put(key: np.ndarray, half: int, own: int, who: np.ndarray) -> None:
        keys.append(key | np.uint64(half << 32))
        owns.append(np.full(len(who), own, dtype=np.int8))
        rows.append(who)

    for half in (0, 1):
        x = prints >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        parts = [(x >> np.uint64(8 * k) & np.uint64(255)).astype(np.intp) for k in range(4)]
        syndrome = tables[0][parts[0]] ^ tables[1][parts[1]] ^ tables[2][parts[2]] ^ tables[3][parts[3]]
        nearest = np.where(syndrome > 0, x ^ (one << (np.maximum(syndrome, one) - one)), x)
        put(nearest, half, 1, prints)
        put(nearest ^ _TOP, half, 0, prints)
        for first in range(1, 32):
            second = syndrome ^ np.uint64(first)
            use = (syndrome > 0) & (second > first)
            put(x[use] ^ np.uint64(1 << first - 1) ^ (one << (second[use] - one)), half, 0, prints[use])
    return np.concatenate(keys), np.concatenate(owns), np.concatenate(rows)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(whole), 4096):
            keys, owns, rows = anchor_rows(whole[at : at + 4096])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(owns), pa.array(rows.view(np.int64))], names=["anchor", "own", "fp"]
            )


def _stars(own: np.ndarray, rest: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Star edges that connect what links between ``own`` rows and ``rest``."""
    stars = []
    for at in range(0, len(rest), max(1, CELLS // len(own))):
        part = rest[at : at + max(1, CELLS // len(own))]
        near = np.bitwise_count(own[:, None] ^ part[None, :]) <= MAX_DISTANCE
        mine = own.copy()
        while True:  # least label over the links, until it stays
            least = np.minimum(part, np.where(near, mine[:, None], part[None, :]).min(axis=0))
            after = np.minimum(mine, np.where(near, least[None, :], mine[:, None]).min(axis=1))
            if (after == mine).all():
                break
            mine = after
        for nodes, labels in ((own, mine), (part, least)):
            moved = nodes != labels
            stars.append((nodes[moved], labels[moved]))
    return stars


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, deal), own rows first: star edges of each group."""
    held: tuple[tuple[int, int], np.ndarray] | None = None  # own rows of a group that may go on
    for batch in batches:
        key = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("anchor", "deal")])
        own = batch.column("own").to_numpy(zero_copy_only=False) == 1
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        ends = np.append(starts[1:], len(fp))
        first = (int(key[0, 0]), int(key[1, 0]))
        found = []
        worth = (ends - starts > 1) & own[starts]
        worth[0] = worth[-1] = True
        for a, b in zip(starts[worth], ends[worth], strict=True):
            mine = fp[a:b][own[a:b]]
            if a == 0 and held and held[0] == first:
                if len(mine):
                    found += _stars(mine, np.concatenate((held[1], mine)))
                    found += _stars(held[1], fp[a:b])
                    found += _stars(mine, fp[a:b])
                else:
                    found += _stars(held[1], fp[a:b])
                mine = np.concatenate((held[1], mine))
            elif len(mine) and b - a > 1:
                found += _stars(mine, fp[a:b])
            if b == len(fp):
                held = ((int(key[0, a]), int(key[1, a])), mine) if len(mine) else None
        if found:
            one, two = (np.concatenate([pair[k] for pair in found]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["a", "b"])


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Star edges (a, b) connecting all fingerprints ``fp`` (distinct longs) within the distance."""
    spark = prints.sparkSession
    rows = prints.select("fp").mapInArrow(_spread, "anchor long, own byte, fp long")
    crowded = (
        rows.where("own = 1").groupBy("anchor").count().where(F.col("count") > OWN_ROWS)
        .select(F.col("anchor").alias("at"), F.ceil(F.col("count") / OWN_ROWS).cast("int").alias("deals"))
    )
    dealt = rows.join(crowded, rows.anchor == crowded.at, "left").select(
        "anchor", "own", "fp",
        F.explode(
            F.when(F.col("deals").isNull(), F.array(F.lit(0)))
            .when(F.col("own") == 1, F.array(F.pmod(F.xxhash64("fp"), F.col("deals")).cast("int")))
            .otherwise(F.sequence(F.lit(0), F.col("deals") - 1))
        ).alias("deal"),
        "deals",
    )
    # in a crowded group the own rows of one deal must also meet those of the others
    others = dealt.where("deals is not null and own = 1").select(
        "anchor", F.lit(0).cast("byte").alias("own"), "fp", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal")
    )
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = dealt.drop("deals").unionByName(others.select("anchor", "own", "fp", "deal")).repartition(width, "anchor", "deal")
    return laid.sortWithinPartitions("anchor", "deal", F.desc("own")).mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (hex) and ``component_id``.

    Null and empty texts have fingerprint zero, which links like any other.  A null id
    gets a fingerprint; a component's id is its least id that is not null, or null if
    it has none.  Repeated rows stay.  An empty table gives an empty result.
    """
    skinny = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialise(with_fingerprints(skinny, "text", width, "fp").select("doc_id", "fp"), "fingerprints")
    return prints.join(fingerprint_groups(prints), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def fingerprint_groups(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in ``prints`` (doc_id, fp)."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-prints")
    parts = components(fingerprint_links(distinct))
    linked = distinct.join(parts, distinct.fp == parts.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return linked.join(least, "root").select("fp", "root", "component_id")


def _print_members(marked: DataFrame, key: str, bits: str) -> DataFrame:
    """(s, bucket) of every shingle set: its rows' fingerprints, by the group that their links put them in."""
    held = materialise(marked.where(F.col(key) != "0" * 32).select(F.col(key).alias("s"), F.col(bits).alias("fp")).distinct(), "set-prints")
    parts = components(fingerprint_links(materialise(held.select("fp").distinct(), "distinct-prints")))
    group = F.coalesce("root", "fp")
    members = held.join(parts, held.fp == parts.node, "left").select("s", F.xxhash64(F.lit("fingerprints"), group).alias("bucket"))
    return materialise(members.distinct(), "print-members")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the least id.

    Groups join texts that share 0.8 or more of their ``width``-word shingles.  Candidates
    are the groups of fingerprints linked through their anchors, as in ``near_duplicates``,
    and, for pairs that differ in more bits, the bands of ``jaccard``; every link is then
    counted exactly.  Texts without words are one group.  Ids that are null come last, equal
    ids are told apart by text, and of repeated rows one stays.  All columns are kept; an
    empty table gives an empty result.
    """
    f, h, b, r, g, gf, wf, wh, wn, wd, many, p = fresh(
        docs, "fp", "th", "bands", "number", "group", "gfp", "wfp", "wth", "wnull", "wid", "many", "print"
    )
    marked = with_sets_and_fingerprints(docs, text, width, f, b, p)
    marked = marked.withColumns({h: F.xxhash64(F.lit(1), text), r: F.monotonically_increasing_id()})
    marked = materialise(marked, "shingled")
    groups = set_groups(marked, f, b, text, r, width, _print_members(marked, f, p)).select(F.col("s").alias(gf), F.col("root").alias(g))
    rank = F.struct(F.col(doc_id).isNull().alias("n"), F.coalesce(doc_id, F.lit(0)).alias("d"), F.col(h).alias("h"), F.col(f).alias("f"))
    rows = marked.select(doc_id, f, h).join(groups, F.col(f) == F.col(gf))
    least = rows.groupBy(g).agg(F.min(rank).alias("w"), F.count("*").alias(many))
    chosen = materialise(least.select(F.col("w.f").alias(wf), F.col("w.h").alias(wh), F.col("w.n").alias(wn), F.col("w.d").alias(wd), many), "winners")
    same_id = (F.col(wn) & F.col(doc_id).isNull()) | (~F.col(wn) & (F.col(wd) == F.col(doc_id)))
    left = marked.drop(b, r, p).join(chosen, (F.col(f) == F.col(wf)) & (F.col(h) == F.col(wh)) & same_id)
    alone = left.where(F.col(many) == 1).select(docs.columns)
    # within larger groups only rows with the same id and text are left: one of them stays
    repeated = left.where(F.col(many) > 1).dropDuplicates([f]).select(docs.columns)
    return alone.unionByName(repeated)
