"""Untyped feeds with planted defects, for validation and quality rules.

The raw tables are clean, so defects are planted by key: the same expression
text runs in Spark and in the check statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerwind.sources.tables import Lake

COLLECTION_FEED = [
    "concat_ws('-', l_orderkey, l_linenumber) AS collection_id",
    "CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE concat('S', l_suppkey) END AS facility_id",
    "concat('A', l_partkey) AS attorney_id",
    "l_returnflag AS case_type",
    "CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS collection_date",
    "CASE WHEN l_orderkey % 97 = 0 THEN 'n/a' WHEN l_orderkey % 101 = 0 THEN concat('-', CAST(l_quantity AS STRING)) "
    "ELSE CAST(l_quantity AS STRING) END AS amount_collected",
    "CASE WHEN l_orderkey % 83 = 0 THEN 'x' WHEN l_orderkey % 79 = 0 THEN NULL ELSE CAST(l_linenumber AS STRING) END AS days_outstanding",
    "l_orderkey * 10 + l_linenumber AS row_ord",
]

VISIT_FEED = [
    "CAST(o_orderkey AS STRING) AS visit_id",
    "concat('F', o_custkey % 7) AS facility_id",
    "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderstatus END AS case_type",
    "CAST(CAST(o_orderdate AS DATE) AS STRING) AS visit_date",
    "CASE WHEN o_orderkey % 37 = 0 THEN 'lost' WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'unpaid' END AS billing_status",
    "CASE WHEN o_orderkey % 61 = 0 THEN 'unknown' ELSE CAST(o_totalprice AS STRING) END AS billed_amount",
    "CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE '0' END AS paid_amount",
    "o_orderpriority AS provider_id",
    "concat('Patient ', o_custkey) AS patient_name",
    "o_orderkey AS row_ord",
]


def collection_feed(lake: Lake) -> DataFrame:
    return lake.spread("lineitem").selectExpr(*COLLECTION_FEED)


def visit_feed(lake: Lake) -> DataFrame:
    return lake.spread("orders").selectExpr(*VISIT_FEED)
