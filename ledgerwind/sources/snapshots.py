"""Tables as immutable snapshots behind a commit list.

Every attempt at a run writes each table into a new folder and then appends one
commit that names them all.  Readers follow the newest commit, so they see either
all of a run or none of it; a run that fails or is repeated touches no file that
anybody reads, and leaves only unused ones behind.

A commit holds a whole table or a delta.  A reader of a table with deltas gets the
newest whole one and all deltas after it; where the table has key columns, the row
of the last layer wins.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_SCHEMA = (
    "run_id string, sequence bigint, table_name string, path string, row_count bigint, attempt bigint, kind string, key_columns array<string>"
)


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def stage(self, frame: DataFrame, table: str, run_id: str) -> str:
        """Write a table for one attempt of a run; nobody reads it until the run commits."""
        path = f"{self.root}/{table}/run={run_id}/attempt={uuid.uuid4().hex}"
        frame.write.mode("error").parquet(path)
        return path

    def commit(
        self, run_id: str, sequence: int, tables: dict[str, tuple[str, int]], kind: str = "whole", keys: dict[str, list[str]] | None = None
    ) -> None:
        """Publish all staged tables of a run with one append."""
        attempt = time.time_ns()
        rows = [
            (run_id, sequence, name, path, count, attempt, kind, (keys or {}).get(name)) for name, (path, count) in sorted(tables.items())
        ]
        self.spark.createDataFrame(rows, COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/_commits")

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.root}/_commits")

    def _newest(self, where: str) -> dict[str, tuple[str, int]]:
        order = F.struct("sequence", "run_id", "attempt")
        newest = F.max_by(F.struct("path", "row_count"), order).alias("newest")
        try:
            rows = self.commits().filter(where).groupBy("table_name").agg(newest).collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return {}
            raise
        return {r.table_name: (r.newest.path, r.newest.row_count) for r in rows}

    def current(self) -> dict[str, tuple[str, int]]:
        """Newest whole table's path and row count per name (one small row per table)."""
        return self._newest("kind = 'whole'")

    def next_sequence(self) -> int:
        try:
            return (self.commits().agg(F.max("sequence")).first()[0] or 0) + 1
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return 1
            raise

    def committed(self, run_id: str) -> bool:
        try:
            return not self.commits().filter(F.col("run_id") == run_id).isEmpty()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return False
            raise

    def layers(self, table: str) -> list[tuple[str, list[str] | None]]:
        """Paths and key columns to read, oldest first: a whole table and the deltas after it."""
        rows = self.commits().filter(F.col("table_name") == table).collect()  # one small row per commit of the table
        rows.sort(key=lambda r: (r.sequence, r.run_id, r.attempt))
        whole = max((i for i, r in enumerate(rows) if r.kind == "whole"), default=0)
        return [(r.path, r.key_columns) for r in rows[whole:]]

    def read(self, table: str) -> DataFrame:
        layers = self.layers(table)
        if not layers:
            raise KeyError(table)
        if len(layers) == 1:
            return self.spark.read.parquet(layers[0][0])
        keys = layers[-1][1]
        parts = [self.spark.read.parquet(path).withColumn("_layer", F.lit(i)) for i, (path, _) in enumerate(layers)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        if not keys:
            return rows.drop("_layer")
        # only the key and the layer meet to find the winner; the rows follow by an equi-join
        last = rows.groupBy(*keys).agg(F.max("_layer").alias("_last")).withColumnsRenamed({k: f"_key_{k}" for k in keys})
        same = F.col("_layer") == F.col("_last")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        return rows.join(last, same).drop("_layer", "_last", *[f"_key_{k}" for k in keys])

    def read_all(self, prefix: str) -> DataFrame | None:
        """The current tables whose names start with ``prefix``/, as one frame; None without any."""
        paths = [path for name, (path, _) in sorted(self.current().items()) if name.startswith(f"{prefix}/")]
        return self.spark.read.parquet(*paths) if paths else None


def write_partitions(frame: DataFrame, path: str, *columns: str) -> None:
    """Replace only the partitions present in the frame."""
    frame.write.partitionBy(*columns).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    """Distributed CSV export, a header in every part."""
    frame.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


CASE_SCHEMA = "id string, query string, expect_blocked boolean, expect_citation boolean"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one JSON object per line."""
    return spark.read.schema(CASE_SCHEMA).json(path)
