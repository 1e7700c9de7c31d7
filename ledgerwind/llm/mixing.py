"""Mixing sources to target weights by entropy balancing.

A document of ``s`` words gets the rate ``cap / (1 + (cap - 1) exp(-l s / m))``: its
prior rate 1, exponentially tilted by its words and bounded by ``cap`` (the entropy is
that of Fermi and Dirac; ``m`` is the source's token-weighted mean size).  The dual has
one multiplier ``l`` per source, for the constraint that the source's expected words
meet its target.  Newton's method solves it in rounds over Spark tables: the gradient
and curvature are sums over (source, size) cells, and a bracket guards every step.

Rates become copies per cell, largest documents first, each cell taking what the words
so far fall short of; so a source misses its target by about its smallest document.
Which rows of a cell get the further copy is decided by hash, in sub-cells of a bounded
number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.llm.names import fresh
from ledgerwind.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
TOLERANCE = 1e-9
ROUNDS = 60
SUB_CELL = 256


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(key, source_size, target) from ``sizes`` (key, source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn.  A target stops at
    ``cap`` times its source's size and the excess is shared again by weight: the capped
    sources are those with the least room per weight, so one sorted pass finds them.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "key")
    place = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.get(listed, place.cast("int")))
    roomy = weighed.withColumn("limit", F.col("source_size") * F.lit(cap)).withColumn("room", F.col("limit") / F.col("weight"))
    whole = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        roomy.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("filled", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open_weight"))
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "level"))).over(whole))
    )
    target = F.least("limit", F.coalesce(F.col("water.level"), F.lit(float("inf"))) * F.col("weight"))
    return levels.select("key", "source_size", target.alias("target"))


def _rate(cap: float):
    """The tilted rate of a cell, from its size and its source's state."""
    tilt = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("multiplier") * F.col("size") / F.col("mean_size")))
    return F.when(F.col("fixed").isNotNull(), F.col("fixed")).otherwise(F.lit(cap) / (1 + F.lit(cap - 1) * F.exp(-tilt)))


def balance(cells: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """(key, multiplier, fixed, mean_size) solving every source's token constraint.

    ``cells`` has (key, size, n).  ``fixed`` is the rate of sources whose target is zero
    or all they may give; the others' multipliers converge to ``TOLERANCE``.
    """
    moments = cells.groupBy("key").agg(
        F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")).alias("squares"),
        F.sum(F.col("n") * F.col("size")).alias("words"),
    )
    fixed = (
        F.when(F.col("words") == 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0))
        .when(F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("words"), F.lit(cap))
    )
    state = materialise(
        goals.join(moments, "key").select(
            "key", "target", fixed.alias("fixed"), F.when(F.col("words") > 0, F.col("squares") / F.col("words")).otherwise(1.0).alias("mean_size"),
            F.lit(0.0).alias("multiplier"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), F.col("words").cast("double").alias("words"),
        ),
        "multipliers",
    )
    for _ in range(ROUNDS):
        rate, z = _rate(cap), F.col("size") / F.col("mean_size")
        sums = cells.join(state.select("key", "mean_size", "multiplier", "fixed"), "key").groupBy("key").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("now"),
            F.sum(F.col("n") * F.col("size") * z * rate * (1 - rate / F.lit(cap))).alias("slope"),
        )
        gap = F.col("target") - F.col("now")
        low = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("high")).otherwise(F.col("multiplier"))
        newton = F.col("multiplier") + F.try_divide(gap, F.col("slope"))
        inside = (newton > low) & (newton < high)
        done = F.col("fixed").isNotNull() | (F.abs(gap) <= F.lit(TOLERANCE) * F.col("words"))
        state = materialise(
            state.join(sums, "key").select(
                "key", "target", "fixed", "mean_size", "words", low.alias("low"), high.alias("high"), done.alias("done"),
                F.when(done, F.col("multiplier")).when(inside, newton).otherwise((low + high) / 2).alias("multiplier"),
            ),
            "multipliers",
        )
        if state.where("not done").isEmpty():
            break
    return state


def _round(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies beyond the whole part of the rate, for the cells of one source (one row per size)."""
    cells = cells.sort_values("size", ascending=False, ignore_index=True)
    owed, extra = 0.0, []
    for size, n, part in zip(cells["size"], cells["n"], cells["part"], strict=True):
        wish = n * part * size
        k = 0 if size == 0 or part == 0 else int(min(n, max(0, round((owed + wish) / size))))
        extra.append(k)
        owed += wish - k * size
    return cells.assign(extra=extra)[["key", "size", "n", "whole", "extra"]]


def mix(rows: DataFrame, order: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``rows`` (a stored table with columns source, size and ``order``) with what the mix takes.

    Adds source_size, target, copies and taken (copies times size).  A null source is a
    source of its own.  Repeated rows may get different copies; which of them is left
    open, all else depends on the data alone.  Empty tables give empty results.
    """
    keyed = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))
    cells = materialise(keyed.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "mix-cells")
    goals = materialise(targets(cells.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap), "mix-goals")
    state = balance(cells, goals, cap)
    rated = cells.join(state.select("key", "mean_size", "multiplier", "fixed"), "key").withColumn("rate", _rate(cap))
    parts = rated.select("key", "size", "n", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"))
    rounded = parts.groupBy("key").applyInPandas(_round, "key string, size long, n long, whole long, extra long")
    rounded = materialise(rounded, "mix-rounded")
    subs = F.greatest(F.lit(1), F.ceil(F.col("n") / SUB_CELL))
    dealt = (
        keyed.join(rounded, ["key", "size"])
        .withColumn("lot", F.xxhash64(order, F.lit("lot")))
        .withColumn("sub", F.pmod("lot", subs))
        .repartition("key", "size", "sub")
    )
    counts = dealt.groupBy("key", "size", "sub", "n", "extra").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("key", "size").orderBy("sub")
    share_of = F.floor(F.col("extra") * F.sum("m").over(upto) / F.col("n"))
    quota = counts.select(
        F.col("key").alias("qk"), F.col("size").alias("qs"), F.col("sub").alias("qb"),
        (share_of - F.floor(F.col("extra") * (F.sum("m").over(upto) - F.col("m")) / F.col("n"))).alias("quota"),
    )
    same = (F.col("key") == F.col("qk")) & (F.col("size") == F.col("qs")) & (F.col("sub") == F.col("qb"))
    ranked = dealt.join(quota, same).withColumn(
        "place", F.row_number().over(Window.partitionBy("key", "size", "sub").orderBy("lot", order))
    )
    copies = F.col("whole") + F.when(F.col("place") <= F.col("quota"), 1).otherwise(0)
    chosen = ranked.withColumn("copies", copies).withColumn("taken", copies * F.col("size"))
    return chosen.join(goals, "key").select(*rows.columns, "source_size", "target", "copies", "taken")


def mixed_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target and the words taken.

    Size counts ``[^\\x20\\x09-\\x0D]+``; a null text has none.  Ids may be null or repeat.
    """
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    skinny = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    mixed = mix(materialise(skinny, "mix-rows"), "doc_id")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def repeat_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to 2 times), all columns kept."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    row, words, copies, at, copy = fresh(docs, "row", "words", "copies", "at", "copy")
    marked = materialise(docs.select("*", size.alias(words), F.monotonically_increasing_id().alias(row)), "mix-documents")
    skinny = marked.select(F.col(row).alias("mix_row"), F.col(source).alias("source"), F.col(words).alias("size"))
    taken = mix(skinny, "mix_row").where("copies > 0").select(F.col("mix_row").alias(at), F.col("copies").cast("int").alias(copies))
    joined = marked.join(taken, F.col(row) == F.col(at))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
