"""Registered queries: fixed reports, capped results, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.functions.numeric import rounded
from ledgerwind.operators import reports
from ledgerwind.plans.catalog import register
from ledgerwind.sources import business
from ledgerwind.sources.tables import Lake


@register(
    "top_aging",
    """SELECT attorney_id, facility_id, report_date, round(bucket_180_plus, 2) AS bucket_180_plus FROM aging_v
       ORDER BY aging_v.bucket_180_plus DESC, attorney_id, facility_id, report_date LIMIT 10""",
)
def _top_aging(lake: Lake) -> DataFrame:
    return rounded(reports.top_aging(business.aging(lake)), {"bucket_180_plus": 2})


@register(
    "unpaid_visits",
    "SELECT visit_id, facility_id, billed_amount FROM visits_v WHERE billing_status = 'unpaid' ORDER BY visit_id LIMIT 100",
)
def _unpaid(lake: Lake) -> DataFrame:
    return reports.unpaid_visits(business.visits(lake, "visit_id", "facility_id", "billing_status", "billed_amount"))


@register(
    "pending_by_attorney",
    """SELECT attorney_id, round(sum(bucket_0_30 + bucket_31_60 + bucket_61_90 + bucket_91_180 + bucket_180_plus), 2) AS total_pending_payment
       FROM aging_v GROUP BY attorney_id""",
)
def _pending(lake: Lake) -> DataFrame:
    return rounded(reports.pending_by_attorney(business.aging(lake)), {"total_pending_payment": 2})


@register("collected_by_attorney", "SELECT attorney_id, round(sum(amount_collected), 4) AS total FROM collections_v GROUP BY attorney_id")
def _by_attorney(lake: Lake) -> DataFrame:
    rows = business.collections(lake, "attorney_id", "amount_collected")
    return rounded(reports.collected_by(rows, "attorney_id"), {"total": 4})


@register("collected_by_facility", "SELECT facility_id, round(sum(amount_collected), 4) AS total FROM collections_v GROUP BY facility_id")
def _by_facility(lake: Lake) -> DataFrame:
    rows = business.collections(lake, "facility_id", "amount_collected")
    return rounded(reports.collected_by(rows, "facility_id"), {"total": 4})


@register(
    "capped_result",
    """SELECT visit_id, billed_amount, (SELECT count(*) FROM visits_v) > 10000 AS truncated
       FROM visits_v ORDER BY billed_amount DESC, visit_id LIMIT 10000""",
)
def _capped(lake: Lake) -> DataFrame:
    rows, truncated = reports.capped(
        business.visits(lake, "visit_id", "billed_amount"), [F.desc("billed_amount"), F.col("visit_id")]
    )
    return rows.withColumn("truncated", truncated)


@register(
    "preview_result",
    """SELECT settlement_id, settlement_amount, (SELECT count(*) FROM settlements_v WHERE settlement_amount > 50000) > 200 AS truncated
       FROM settlements_v WHERE settlement_amount > 50000 ORDER BY settlement_id LIMIT 200""",
)
def _preview(lake: Lake) -> DataFrame:
    high = business.settlements(lake, "settlement_id", "settlement_amount").filter("settlement_amount > 50000")
    rows, truncated = reports.capped(high, [F.col("settlement_id")], 200)
    return rows.withColumn("truncated", truncated)


@register(
    "semi_join_report",
    """SELECT visit_id, billed_amount FROM visits_v WHERE visit_id IN
         (SELECT settlement_id FROM settlements_v WHERE close_date IS NOT NULL AND settlement_amount > 400000)""",
)
def _semi(lake: Lake) -> DataFrame:
    closed = business.settlements(lake, "settlement_id", "close_date", "settlement_amount").filter(
        "close_date is not null and settlement_amount > 400000"
    )
    visits = business.visits(lake, "visit_id", "billed_amount")
    return visits.join(closed, visits.visit_id == closed.settlement_id, "left_semi")


@register(
    "multi_join_report",
    """SELECT v.facility_id, s.settlement_status, count(*) AS visits, round(sum(v.billed_amount), 2) AS billed
       FROM visits_v v JOIN settlements_v s ON s.settlement_id = v.visit_id AND s.settlement_amount >= v.paid_amount GROUP BY ALL""",
)
def _multi(lake: Lake) -> DataFrame:
    visits = business.visits(lake, "visit_id", "facility_id", "billed_amount", "paid_amount")
    settled = business.settlements(lake, "settlement_id", "settlement_amount", "settlement_status")
    joined = visits.join(
        settled, (settled.settlement_id == visits.visit_id) & (settled.settlement_amount >= visits.paid_amount)
    )
    return joined.groupBy("facility_id", "settlement_status").agg(
        F.count("*").alias("visits"), F.round(F.sum("billed_amount"), 2).alias("billed")
    )
