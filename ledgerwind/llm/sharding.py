"""Shards of nearly equal bytes from sampled splitters.

Records are ordered by (id, row).  A size-weighted sample of keys (priority sampling:
the least exponential draws divided by size, a bounded number of rows) gives quantile
boundaries of equal bytes, and rows go to the ranges between them.  Ranges that turn out
overfull in rows or bytes get splitters of their own from a sample of their rows, until
none is left.  Running sums inside each range, offset by the totals of the ranges before
it, then place every record: a shard is a contiguous piece of the order and differs from
the even share by less than its border records.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.llm.names import fresh
from ledgerwind.session import materialise

SHARDS = 16
ROWS_PER_RANGE = 200_000
LEAST_RANGES, MOST_RANGES = 64, 65_536  # bounds what the driver holds of splitters
DRAWS = 16  # sampled keys per range
OVERFULL = 3.0  # times the even share
NULL_KEY = -(2**63)

Key = tuple[int, int]


def _sample(rows: DataFrame, draws: int) -> list[Key]:
    """Keys of a size-weighted sample in order; which rows are drawn is decided by hash."""
    uniform = (F.pmod(F.xxhash64("tie", F.lit("draw")), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    drawn = rows.select("key", "tie", (-F.log(uniform) / F.col("size")).alias("at")).orderBy("at", "key", "tie").limit(draws)
    return sorted((r["key"], r["tie"]) for r in drawn.select("key", "tie").collect())


def _quantiles(sample: list[Key], pieces: int) -> list[Key]:
    return [sample[len(sample) * k // pieces] for k in range(1, pieces)] if sample else []


def _ranges(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    """``rows`` with the number of splitters at or before each key as ``range``."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = np.array([k for k, _ in splitters], dtype=np.int64)
        for batch in batches:
            low, high = (np.searchsorted(keys, batch["key"].to_numpy(), side=side) for side in ("left", "right"))
            for i in np.flatnonzero(low != high):  # rows whose id is a splitter's id
                low[i] = bisect_right(splitters, (int(batch["key"].iat[i]), int(batch["tie"].iat[i])), int(low[i]), int(high[i]))
            yield batch.assign(range=low.astype("int32"))

    return rows.mapInPandas(place, "doc_id long, size long, crc long, tie long, key long, range int")


def laid_out(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (doc_id, size, crc, tie; stored, tie unique) with ``shard`` and ``slot``.

    Null ids come first.  Repeated ids are told apart by row.  An empty table gives an
    empty result.
    """
    keyed = rows.select("doc_id", "size", "crc", "tie", F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"))
    total = keyed.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    pieces = min(MOST_RANGES, max(LEAST_RANGES, -(-total["n"] // ROWS_PER_RANGE)))
    splitters = sorted(set(_quantiles(_sample(keyed, DRAWS * pieces), pieces)))
    most_rows, most_bytes = OVERFULL * total["n"] / pieces, OVERFULL * total["bytes"] / pieces
    while True:
        ranged = materialise(_ranges(keyed, splitters), "ranged")
        stats = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
        full = stats.where((F.col("n") > max(1.0, most_rows)) | ((F.col("bytes") > most_bytes) & (F.col("n") > 1) & (F.col("largest") < 0.5 * F.col("bytes"))))
        overfull = sorted((r["range"], max(r["n"] / max(most_rows, 1.0), r["bytes"] / most_bytes)) for r in full.collect())
        more: set[Key] = set()
        for start in range(0, len(overfull), 256):  # few at a time, so that each is drawn from well
            some = overfull[start : start + 256]
            inside = ranged.where(F.col("range").isin([k for k, _ in some]))
            drawn = _sample(inside.withColumn("size", F.col("size") + F.lit(total["bytes"] / max(1, total["n"]))), DRAWS * 4 * len(some))
            for at, times in some:
                own = [key for key in drawn if bisect_right(splitters, key) == at]
                more |= set(_quantiles(own, min(len(own), int(2 * OVERFULL * times) + 2)))
        more -= set(splitters)
        if not more:
            break
        splitters = sorted({*splitters, *more})
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(
        F.col("range").alias("at"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(whole), F.lit(0)).alias("bytes_before"),
    )
    inside = Window.partitionBy("range").orderBy("key", "tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = ranged.withColumn("row", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(upto))
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    placed = materialise(
        spread.join(offsets, spread["range"] == offsets["at"]).select(
            "doc_id", "size", "crc", "tie", (F.col("rows_before") + F.col("row") - 1).alias("place"),
            F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards / max(1, total["bytes"])))).cast("int").alias("shard"),
        ),
        "placed",
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first")).withColumnRenamed("shard", "of")
    # one row per shard, and shards is a parameter: small whatever the data
    return placed.join(F.broadcast(firsts), placed["shard"] == firsts["of"]).select(
        "doc_id", "size", "crc", "tie", "shard", (F.col("place") - F.col("first")).alias("slot")
    )


def _measured(docs: DataFrame, doc_id: str, text: str) -> list:
    whole = F.coalesce(F.col(text), F.lit(""))
    return [
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("tie"),
    ]


def shards_by_bytes(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot and grown_shard (null).

    A null text has no bytes; the size is the bytes plus 1.
    """
    laid = laid_out(materialise(docs.select(*_measured(docs, doc_id, text)), "shard-rows"), shards)
    return laid.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", rows_per_file: int = 100_000) -> None:
    """Write ``docs``, all columns, as Parquet under ``path``/shard=K, in slot order inside each file."""
    helpers = fresh(docs, "id", "size", "crc", "tie", "at", "shard", "slot", "file")
    names, (at, shard, slot, file) = helpers[:4], helpers[4:]
    marked = materialise(docs.select("*", *[c.alias(n) for c, n in zip(_measured(docs, doc_id, text), names)]), "shard-documents")
    laid = laid_out(marked.select(*[F.col(n).alias(to) for n, to in zip(names, ("doc_id", "size", "crc", "tie"))]), shards)
    laid = laid.select(F.col("tie").alias(at), F.col("shard").alias(shard), F.col("slot").alias(slot), F.floor(F.col("slot") / rows_per_file).alias(file))
    joined = marked.join(laid, F.col(names[3]) == F.col(at)).repartition(shard, file).sortWithinPartitions(shard, slot)
    joined.select(*docs.columns, slot, shard).write.partitionBy(shard).parquet(path)
