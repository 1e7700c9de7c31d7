"""Session settings and the shared work folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # daily frames are small in bytes but heavy in window work: keep them spread
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName("ledgerwind")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets one scratch
    folder for its lifetime.  On a cluster a missing setting is an error, because
    a machine-local folder would vanish with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_scratch(context.applicationId)


@lru_cache
def _local_scratch(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"ledgerwind-{application_id}-")


_written: list[str] = []


def written() -> int:
    """How many tables this process has materialised so far; a mark for :func:`release`."""
    return len(_written)


def release(spark: SparkSession, since: int, until: int) -> None:
    """Remove the tables materialised between two marks, and let go of shuffle files nobody reads.

    Only for a step whose result has been written elsewhere: frames that still read such a
    table fail.  Tables of other processes in the same folder are not touched.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for at in range(since, min(until, len(_written))):
        if _written[at]:
            path = jvm.org.apache.hadoop.fs.Path(_written[at])
            path.getFileSystem(conf).delete(path, True)
            _written[at] = ""
    gc.collect()
    jvm.System.gc()  # Spark removes the shuffle files of plans that are gone


def materialise(frame: DataFrame, name: str) -> DataFrame:
    """Write a small result once to the shared folder and read it back.

    Used where several later steps read the same derived frame; the files
    survive lost executors, so nothing upstream is recomputed.
    """
    path = f"{shared_folder(frame.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
