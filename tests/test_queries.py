"""Registered queries against their DuckDB statements.

The default run covers one query of every family; LEDGERWIND_ALL=1 runs all.
"""

import os

import pytest

import __spark_entry__ as entry
import check_queries
from ledgerwind.plans import catalog

SF = "/root/testdata/sf0.001"
FAMILIES = [
    "facility_features", "settlement_features", "lop_features", "point_in_time_features", "validate_rows", "dedup_last_wins",
    "phi_redact", "hash_embedding", "forecast_backtest", "champion_gate", "combined_severity", "isolation_forest_scores", "alert_sweep_events", "answer_gate", "cosine_topk_filtered",
    "chain_build", "chain_long_deletions", "text_chunks", "settlement_features_missing_amounts", "answer_audit", "rate_limit_tight", "capped_result", "retention",
]
NAMES = list(catalog.QUERIES) if os.environ.get("LEDGERWIND_ALL") else FAMILIES


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_statement(spark, con, name):
    ok, note = check_queries.compare(spark, con, name, SF)
    assert ok, note


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.oracle_sql())


def test_flagship(spark):
    frame = entry.entry(spark)
    assert "collections_30d_rolling" in frame.columns and not frame.isEmpty()


@pytest.mark.parametrize("name", ["facility_features", "lop_features", "rate_limit_tight"])
def test_results_do_not_depend_on_partition_count(spark, name):
    def rows(partitions):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            return sorted(map(str, entry.queries()[name](spark, SF).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    assert rows("1") == rows("5")
