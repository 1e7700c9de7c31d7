"""The registered queries over the smallest table, beside their DuckDB statements."""

import pytest

import __spark_entry__ as entry
import check_queries

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]


def test_all_queries_are_registered():
    assert len(NAMES) == 14 and {n.split("_")[0] for n in NAMES} == {"pipeline", *(f"op{k}" for k in range(1, 14))}


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_query_equals_its_statement(spark, name):
    ok, note = check_queries.compare(spark, check_queries.connect(SF), name, SF)
    assert ok, note


def test_every_document_has_a_row(spark):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    for name in ("op1_secret_scan", "op3_simhash_anchors", "op5_mixing", "op6_sentencepiece", "op7_sharding", "op8_repeated_passages"):
        assert sorted(r.doc_id for r in entry.queries()[name](spark, SF).select("doc_id").collect()) == ids, name
