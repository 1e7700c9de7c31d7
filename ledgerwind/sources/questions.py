"""Question and query-log tables derived from the raw tables.

The raw tables hold no analyst questions, so they are phrased from customers
(one each, in eight wordings) and joined by the user turns of conversations.
The query log is phrased from orders in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerwind.sources.business import geography
from ledgerwind.sources.tables import Lake

CUSTOMER_QUESTION = """
CASE c_custkey % 8
  WHEN 0 THEN concat('How is ', n_name, ' performing on collections?')
  WHEN 1 THEN concat('Total collected by facility ', r_name)
  WHEN 2 THEN concat('show ', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-45-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))
  WHEN 3 THEN concat('what does Jane Roe owe, see ', c_name)
  WHEN 4 THEN concat('What is the capital of France? asks ', c_name)
  WHEN 5 THEN concat('date of birth of ', c_name)
  WHEN 6 THEN concat('Which settlement visits need attention in segment ', lower(c_mktsegment), '?')
  ELSE concat('payments outstanding overview for Attorney Garcia ', c_name)
END"""

LOG_QUESTION = """
CASE o_orderkey % 6
  WHEN 0 THEN concat('please DELETE  from collections where order = ', CAST(o_orderkey AS STRING))
  WHEN 1 THEN 'DROP TABLE collections'
  WHEN 2 THEN 'Show total collected by facility'
  WHEN 3 THEN concat('Unpaid visits with priority ', o_orderpriority)
  WHEN 4 THEN 'update visits set billing_status = done'
  ELSE 'Top attorneys by 180+ aging'
END"""

# The fence, label and terminator wordings that a logged statement may carry.
LOG_SQL = """
CASE o_orderkey % 4
  WHEN 0 THEN concat('```sql', chr(10), 'SELECT facility_id FROM collections WHERE k = ', CAST(o_orderkey % 10 AS STRING), ';', chr(10), '```')
  WHEN 1 THEN concat('SQL: SELECT attorney_id FROM attorney_aging WHERE k = ', CAST(o_orderkey % 10 AS STRING), ' ;;')
  WHEN 2 THEN concat('  SELECT visit_id FROM visits WHERE k = ', CAST(o_orderkey % 10 AS STRING), ';', chr(10))
  ELSE concat('```', chr(10), 'SELECT lop_id FROM lop WHERE k = ', CAST(o_orderkey % 10 AS STRING), chr(10), '```')
END"""


def questions(lake: Lake) -> DataFrame:
    geo = geography(lake)
    customer = lake.spread("customer")  # every text is scanned and cut into pieces
    asked = customer.join(geo, customer.c_nationkey == geo.n_nationkey, "left").selectExpr(
        "concat('c-', c_custkey) AS question_id", f"{CUSTOMER_QUESTION} AS question"
    )
    said = lake.spread("conversations").filter("role = 'user'").selectExpr(
        "concat('t-', conv_id, '-', turn) AS question_id", "text AS question"
    )
    return asked.unionByName(said)


def query_log(lake: Lake) -> DataFrame:
    return lake.table("orders").selectExpr(
        "o_orderkey AS log_id",
        f"{LOG_QUESTION} AS question",
        f"{LOG_SQL} AS sql_text",
        "CAST(floor(o_totalprice) AS BIGINT) AS row_count",
        "to_date(o_orderdate) AS asked_on",
    )
