"""The fixed reports and the capped result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv


def top_aging(aging: DataFrame, limit: int = 10) -> DataFrame:
    """Largest 180+ balances over all snapshots."""
    return (
        aging.select("attorney_id", "facility_id", "report_date", "bucket_180_plus")
        .orderBy(F.desc("bucket_180_plus"), "attorney_id", "facility_id", "report_date")
        .limit(limit)
    )


def unpaid_visits(visits: DataFrame, limit: int = 100) -> DataFrame:
    return (
        visits.filter("billing_status = 'unpaid'")
        .select("visit_id", "facility_id", "billed_amount")
        .orderBy("visit_id")
        .limit(limit)
    )


def pending_by_attorney(aging: DataFrame) -> DataFrame:
    total = sum((F.col(b) for b in fv.AGING_BUCKETS[1:]), F.col(fv.AGING_BUCKETS[0]))
    return (
        aging.groupBy("attorney_id").agg(F.sum(total).alias("total_pending_payment")).orderBy(F.desc("total_pending_payment"))
    )


def collected_by(collections: DataFrame, dimension: str) -> DataFrame:
    return collections.groupBy(dimension).agg(F.sum("amount_collected").alias("total")).orderBy(F.desc("total"))


def capped(frame: DataFrame, order: list[Column | str], cap: int = fv.ROW_CAP) -> tuple[DataFrame, Column]:
    """The first ``cap`` rows and, lazily, whether there were more.

    One row beyond the cap is read, which is all that is needed to know.
    """
    fetched = frame.orderBy(*order).limit(cap + 1)
    truncated = fetched.agg((F.count("*") > cap).alias("truncated")).scalar()
    return frame.orderBy(*order).limit(cap), truncated
