"""Removing repeated passages: prefix doubling over a sampled suffix array.

A string of ``LENGTH`` bytes that starts in two places holds, in both, the same anchor:
the leftmost least hash of its ``WINDOW`` seeds of ``SEED_BYTES`` bytes.  So instead of
all suffixes only anchors (about one byte in 64) get ranks, and a string is named by its
anchor and its offset from it.  Ranks are fingerprints of growing stretches around the
anchor; Spark counts them, and what is alone in its rank leaves after every round:

1. the seed itself: 50 bytes.  Unique anchors leave.
2. the whole context of an anchor, 350 bytes: if it repeats, so do all strings named by
   the anchor, and they are decided.
3. zones of 19 offsets.  If the 182 bytes that a zone's strings share are unique, the zone
   leaves; if the 218 bytes that hold them all repeat, it is decided.
4. the strings themselves, 200 bytes, for the offsets still open.

What is decided together still has to be met by the others: one of each repeated rank
goes on as its representative, where anything open has the seed or core.  Equal texts are
worked on once.  Texts are stored once, bucketed, so that no round shuffles them again.
Fingerprints have 64 bits; equal fingerprints count as equal strings.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwind.session import materialise, shared_folder

LENGTH = 200
SEED_BYTES = 50
WINDOW = LENGTH - SEED_BYTES + 1
REACH = WINDOW - 1  # largest offset of a string's start before its anchor
ZONE = 19
SEGMENT = 1 << 20  # bytes of a text hashed at once

_BASE = 0x9E3779B97F4A7C15 | 1
_ROOM = SEGMENT + 1024


def _powers(base: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(_ROOM, base, dtype=np.uint64))))


class _Tables:
    """Powers of the hash base, made once in each Python worker."""

    up: np.ndarray | None = None
    down: np.ndarray | None = None

    @classmethod
    def ready(cls) -> None:
        if cls.up is None:
            cls.up, cls.down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _Tables.up[: len(raw)], out=sums[1:])
    return sums


def fingerprints(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of ``length`` bytes (1024 at most) from each start in ``raw``."""
    _Tables.ready()
    out = np.zeros(len(starts), dtype=np.uint64)
    segment = starts // SEGMENT
    for k in np.unique(segment):
        here = np.flatnonzero(segment == k)
        at = starts[here] - k * SEGMENT
        low = int(at.min())
        sums = _sums(raw[k * SEGMENT + low : k * SEGMENT + int(at.max()) + length])
        at = at - low
        out[here] = mixed((sums[at + length] - sums[at]) * _Tables.down[at])
    return out


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, end): anchors in order and the range of string starts each one names."""
    _Tables.ready()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    strings = len(raw) - LENGTH + 1
    for begin in range(0, max(0, strings), SEGMENT):
        stop = min(strings, begin + SEGMENT)
        sums = _sums(raw[begin : stop + LENGTH - 1])
        seeds = mixed((sums[SEED_BYTES:] - sums[:-SEED_BYTES]) * _Tables.down[: len(sums) - SEED_BYTES])
        # the high 40 bits decide; the place below them makes the leftmost win
        least = (seeds >> np.uint64(24) << np.uint64(24)) | np.arange(len(seeds), dtype=np.uint64)
        for shift in (1, 2, 4, 8, 16, 32, 64):
            least = np.minimum(least[:-shift], least[shift:])
        least = np.minimum(least[: stop - begin], least[WINDOW - 128 : WINDOW - 128 + stop - begin])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        place, end = place[first] + begin, np.append(first[1:], stop - begin) + begin
        first = first + begin
        if found and found[-1][0][-1] == place[0]:  # one anchor on both sides of the cut
            first[0] = found[-1][1][-1]
            found[-1] = tuple(x[:-1] for x in found[-1])
        found.append((place, first, end))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _optional(values: np.ndarray, use: np.ndarray) -> pa.Array:
    return pa.array(_signed(values), pa.int64(), mask=~use)


def _bytes_of(value: bytes | None) -> np.ndarray:
    return np.frombuffer(value or b"", dtype=np.uint8)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, value in zip(batch.column("k").to_pylist(), batch.column("data"), strict=True):
            raw = _bytes_of(value.as_py())
            at, first, end = anchors(raw)
            if not len(at):
                continue
            whole = (at >= REACH) & (at + LENGTH <= len(raw))
            context = np.zeros(len(at), dtype=np.uint64)
            context[whole] = fingerprints(raw, at[whole] - REACH, REACH + LENGTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k)), pa.array(at), pa.array((at - end + 1).astype(np.int16)), pa.array((at - first + 1).astype(np.int16)),
                 pa.array(_signed(fingerprints(raw, at, SEED_BYTES))), _optional(context, whole)],
                names=["k", "a", "lo", "hi", "seed", "context"],
            )


_ANCHORS = "k long, a long, lo short, hi short, seed long, context long"  # offsets lo <= o < hi; strings start at a - o


def _items(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    for row in range(len(batch)):
        structs = batch.column("items")[row].values
        yield (
            batch.column("k")[row].as_py(), _bytes_of(batch.column("data")[row].as_py()),
            {n: structs.field(n).to_numpy(zero_copy_only=False) for n in names},
        )


def _find_zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zones = -(-(REACH + 1) // ZONE)
    for batch in batches:
        for k, raw, item in _items(batch, ("a", "lo", "hi", "seed", "rep")):
            i, z = np.nonzero((item["lo"][:, None] < ZONE * (np.arange(zones) + 1)[None, :]) & (item["hi"][:, None] > ZONE * np.arange(zones)[None, :]))
            a, low, high = item["a"][i].astype(np.int64), ZONE * z, ZONE * z + ZONE
            tag = mixed(item["seed"][i].astype(np.int64).view(np.uint64) + z.astype(np.uint64))
            core = fingerprints(raw, a - low, LENGTH - ZONE + 1)
            fits = (a - high + 1 >= 0) & (a - low + LENGTH <= len(raw))
            hull = np.zeros(len(a), dtype=np.uint64)
            hull[fits] = fingerprints(raw, (a - high + 1)[fits], LENGTH + ZONE - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), k)), pa.array(a), pa.array(np.maximum(item["lo"][i], low).astype(np.int16)), pa.array(np.minimum(item["hi"][i], high).astype(np.int16)),
                 pa.array(item["rep"][i].astype(bool)), pa.array(_signed(mixed(core ^ tag))), _optional(mixed(hull ^ tag), fits)],
                names=["k", "a", "lo", "hi", "rep", "core", "hull"],
            )


_ZONES = "k long, a long, lo short, hi short, rep boolean, core long, hull long"


def _find_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, raw, item in _items(batch, ("a", "lo", "hi", "rep")):
            many = (item["hi"] - item["lo"]).astype(np.int64)
            i = np.repeat(np.arange(len(many)), many)
            offset = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + item["lo"][i]
            start = item["a"][i].astype(np.int64) - offset
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), k)), pa.array(start), pa.array(item["rep"][i].astype(bool)), pa.array(_signed(fingerprints(raw, start, LENGTH)))],
                names=["k", "start", "rep", "string"],
            )


_STRINGS = "k long, start long, rep boolean, string long"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k, copies, value, items in zip(*(batch.column(c) for c in ("k", "copies", "data", "items")), strict=True):
            raw = value.as_py() or b""
            steps = np.zeros(len(raw) + 1, dtype=np.int64)
            if copies.as_py() > 1 and len(raw) >= LENGTH:
                steps[0], steps[-1] = 1, -1
            elif items.is_valid:
                first, end = (items.values.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("first", "end"))
                np.add.at(steps, first, 1)
                np.add.at(steps, end + LENGTH - 1, -1)
            gone = np.cumsum(steps)[:-1] > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = _bytes_of(raw)[~gone].tobytes()
            rows.append((k.as_py(), len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows)) or [()] * 6
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _stored(texts: DataFrame, buckets: int) -> DataFrame:
    """``texts`` written once to the shared folder, bucketed by k."""
    spark = texts.sparkSession
    name = f"repeat_texts_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/stages/{name}"
    texts.write.bucketBy(buckets, "k").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _repeated(rows: DataFrame, rank: str, weight: F.Column) -> DataFrame:
    """Ranks that two or more places have, each with its representative."""
    told = rows.where(F.col(rank).isNotNull()).groupBy(rank).agg(F.sum(weight).alias("w"), F.min(F.struct("k", "a")).alias("first"))
    return _list(told.where("w > 1").select(F.col(rank).alias(f"{rank}_r"), "first"))


def _asked(rows: DataFrame, rank: str, weight: F.Column) -> DataFrame:
    """Ranks of two or more places, one of them still open."""
    told = rows.groupBy(rank).agg(F.sum(weight).alias("w"), F.bool_or(~F.col("rep")).alias("asked"))
    return _list(told.where("w > 1 and asked").select(F.col(rank).alias(f"{rank}_r")))


def _list(ranks: DataFrame) -> DataFrame:
    """Stored before it is joined: a rank that many places have is split over tasks then."""
    return materialise(ranks, "ranks")


def _per_text(items: DataFrame, *names: str) -> DataFrame:
    return items.groupBy("k").agg(F.collect_list(F.struct(*names)).alias("items"))  # bounded by the text's length


def repeated_strings(texts: DataFrame) -> DataFrame:
    """(k, first, end): ranges of starts of repeated strings, over stored ``texts`` (k, data)."""
    one, two = F.lit(1), F.when(F.col("rep"), 2).otherwise(1)
    found = materialise(texts.select("k", "data").mapInArrow(_find_anchors, _ANCHORS), "anchors")
    seeds = _list(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select(F.col("seed").alias("seed_r")))
    matched = materialise(found.join(seeds, found["seed"] == seeds["seed_r"]).drop("seed_r"), "anchors-matched")
    contexts = _repeated(matched, "context", one)
    ranked = materialise(matched.join(contexts, matched["context"] == contexts["context_r"], "left"), "anchors-ranked")
    sure = ranked.where("first is not null").select("k", (F.col("a") - F.col("hi") + 1).alias("first"), (F.col("a") - F.col("lo") + 1).alias("end"))
    open_ = ranked.where("first is null").withColumn("rep", F.lit(False))
    dirty = _list(open_.select(F.col("seed").alias("dirty")).distinct())
    stand_in = ranked.where("first = struct(k, a)").withColumn("rep", F.lit(True))
    stand_in = stand_in.join(dirty, stand_in["seed"] == dirty["dirty"], "left_semi")
    names = ("a", "lo", "hi", "seed", "rep")
    state = _per_text(open_.select("k", *names).unionByName(stand_in.select("k", *names)), *names)

    zones = materialise(texts.select("k", "data").join(state, "k").mapInArrow(_find_zones, _ZONES), "zones")
    cores = _asked(zones, "core", two)
    hulls = _repeated(zones, "hull", two)
    left = zones.join(cores, zones["core"] == cores["core_r"]).drop("core_r")
    left = materialise(left.join(hulls, left["hull"] == hulls["hull_r"], "left"), "zones-ranked")
    sure_zones = left.where("first is not null and not rep").select("k", (F.col("a") - F.col("hi") + 1).alias("first"), (F.col("a") - F.col("lo") + 1).alias("end"))
    open_zones = left.where("first is null and not rep")
    dirty = _list(open_zones.select(F.col("core").alias("dirty")).distinct())
    stand_in = left.where("(first is null and rep) or first = struct(k, a)").withColumn("rep", F.lit(True))
    stand_in = stand_in.join(dirty, stand_in["core"] == dirty["dirty"], "left_semi")
    names = ("a", "lo", "hi", "rep")
    state = _per_text(open_zones.select("k", *names).unionByName(stand_in.select("k", *names)), *names)

    strings = materialise(texts.select("k", "data").join(state, "k").mapInArrow(_find_strings, _STRINGS), "strings")
    many = _asked(strings, "string", two)
    single = strings.where("not rep").join(many, strings["string"] == many["string_r"]).select("k", F.col("start").alias("first"), (F.col("start") + 1).alias("end"))
    return sure.unionByName(sure_zones).unionByName(single)


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, texts): doc_id and k of each document, and what is left of each different text.

    The second has k, n_bytes, n_removed, n_spans, kept_sha256 and the ``kept`` bytes.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("k"), whole.cast("binary").alias("data"))
    ids = materialise(keyed.select("doc_id", "k"), "repeat-ids")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _stored(keyed.groupBy("k").agg(F.count("*").alias("copies"), F.first("data").alias("data")), buckets)
    ranges = _per_text(repeated_strings(texts), "first", "end")
    kept = texts.join(ranges, "k", "left").mapInArrow(_remove, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return ids, kept


def removal_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans and kept_sha256.

    A null text is empty.  Repeated rows and equal texts of ``LENGTH`` bytes or more are
    removed whole, each.  Null ids stay as rows; an empty table gives an empty result.
    """
    ids, kept = cleaned(docs, doc_id, text)
    told = materialise(kept.drop("kept"), "repeat-texts").withColumnRenamed("k", "of")
    return ids.join(told, ids["k"] == told["of"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
