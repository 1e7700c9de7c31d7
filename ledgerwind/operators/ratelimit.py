"""Sliding-log request limit, replayed over a table of requests.

A request is admitted while fewer than ``limit`` admitted requests of its client
lie within the last ``seconds``; refused requests do not count.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv


def admit(log: deque, now: int, limit: int, span: int) -> bool:
    """One step of the log; ``log`` holds at most ``limit`` admitted times."""
    while log and now - log[0] > span:
        log.popleft()
    if len(log) >= limit:
        return False
    log.append(now)
    return True


def replay(
    requests: DataFrame,
    client: str,
    ts: str,
    request_id: str,
    limit: int = fv.RATE_LIMIT_REQUESTS,
    seconds: int = fv.RATE_LIMIT_SECONDS,
) -> DataFrame:
    """``(request_id, client, ts, admitted)`` for every request.

    Requests are counted per client and time slot of ``seconds``.  An empty slot
    empties the log, so runs of adjacent slots ("islands") are independent, and
    an island whose every two adjacent slots hold at most ``limit`` requests
    admits them all without looking at them.  Only the others are walked in
    order, each island on its own, with a log of at most ``limit`` times.
    """
    span = seconds * 1_000_000
    timed = requests.select(request_id, client, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    timed = timed.withColumn("_slot", F.floor(F.col("_at") / span))
    slots = timed.groupBy(client, "_slot").agg(F.count("*").alias("_n"))
    by_slot = Window.partitionBy(client).orderBy("_slot")
    adjacent = F.col("_slot") - F.lag("_slot").over(by_slot) == 1
    joined = slots.withColumns(
        {
            "_starts": F.when(adjacent, 0).otherwise(1),
            "_load": F.col("_n") + F.when(adjacent, F.lag("_n").over(by_slot)).otherwise(0),
        }
    ).withColumn("_island", F.sum("_starts").over(by_slot.rowsBetween(Window.unboundedPreceding, 0)))
    heaviest = F.max("_load").over(Window.partitionBy(client, "_island"))
    busy = joined.withColumn("_heaviest", heaviest).filter(F.col("_heaviest") > limit).select(client, "_slot", "_island")
    placed = timed.join(busy, [client, "_slot"], "left")
    kept = [request_id, client, ts]
    calm = placed.filter("_island is null").select(*kept, F.lit(True).alias("admitted"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for batch in batches:
            verdicts = []
            for owner, island, at in zip(batch[client], batch["_island"], batch["_at"], strict=True):
                if (owner, island) != current:
                    current, log = (owner, island), deque()
                verdicts.append(admit(log, at, limit, span))
            yield batch[kept].assign(admitted=verdicts)

    schema = calm.schema
    walked = (
        placed.filter("_island is not null")
        .repartition(client, "_island")
        .sortWithinPartitions(client, "_island", "_at", request_id)
        .mapInPandas(walk, schema)
    )
    return calm.unionByName(walked)
