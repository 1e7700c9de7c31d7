"""Incremental ingest: each micro-batch of new files becomes a delta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerwind.operators.ingest import run_ingest
from ledgerwind.session import shared_folder
from ledgerwind.sources.snapshots import SnapshotStore


def ingest_stream(
    spark: SparkSession, feed: DataFrame, entity: str, store: SnapshotStore, phi_key: str, order: str = "_ord"
) -> StreamingQuery:
    """Run the ingest for every micro-batch of a streaming feed, until no files are left.

    A batch that passes is published as a delta behind all earlier commits, whatever
    its size; readers see the earlier rows and its own.  A batch that is rejected
    goes to ``quarantine/<entity>``, so no row is lost when the stream moves on.  A
    batch that was committed before a failure is not committed again; a stream with a new
    checkpoint counts from 0 again, so the stream's own id is part of its run ids.
    """

    def one_batch(rows: DataFrame, batch: int) -> None:
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        run_id = f"stream-{entity}-{stream}-{batch}"
        if store.committed(run_id):
            return
        sequence = store.next_sequence()
        report = run_ingest(spark, {entity: rows}, store, run_id, sequence, phi_key, order, delta=True)
        if report.aborted:
            name = f"quarantine/{entity}"
            path = store.stage(rows, name, run_id)
            store.commit(run_id, sequence, {name: (path, spark.read.parquet(path).count())}, "delta")

    return (
        feed.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", f"{store.root or shared_folder(spark)}/_stream/{entity}")
        .trigger(availableNow=True)
        .start()
    )
