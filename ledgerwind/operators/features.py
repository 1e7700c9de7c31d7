"""The five feature groups.

Each group reduces facts to one row per entity and day with partial (map-side)
aggregation, then derives everything else with windows that share that one
hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv
from ledgerwind.functions.numeric import ratio_if_positive
from ledgerwind.operators.timeseries import (
    by_day,
    densify,
    grid_points_covering,
    month_index,
    on_weekly_grid,
    rolling_count,
    rolling_sum,
    trailing_count,
)
from ledgerwind.session import materialise


def daily_collections(collections: DataFrame, keys: list[str]) -> DataFrame:
    return collections.groupBy(*keys, F.col("collection_date").alias("event_date")).agg(
        F.sum("amount_collected").alias("collections_1d")
    )


def facility_collections(collections: DataFrame) -> DataFrame:
    """Daily, rolling, month-over-month and year-over-year collections per facility.

    Month growth compares whole calendar months and is shown on every day of the
    month; ``mom_growth_to_date`` is the variant that only looks backwards.
    """
    keys = ["facility_id"]
    dense = densify(daily_collections(collections, keys), keys, "event_date", ["collections_1d"])
    series = dense.withColumns(
        {
            "_month": month_index("event_date"),
            "collections_7d_rolling": rolling_sum("collections_1d", keys, "event_date", 7),
            "collections_30d_rolling": rolling_sum("collections_1d", keys, "event_date", 30),
        }
    )
    this_month = Window.partitionBy(*keys, "_month")
    so_far = this_month.orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    series = series.withColumns(
        {
            "_month_total": F.sum("collections_1d").over(this_month),
            "_month_to_date": F.sum("collections_1d").over(so_far),
            "_year_ago": F.lag("collections_30d_rolling", 365).over(by_day(keys, "event_date")),
        }
    )
    previous = F.max("_month_total").over(Window.partitionBy(*keys).orderBy("_month").rangeBetween(-1, -1))
    series = series.withColumn("_previous", previous)
    growth = lambda now, then: ratio_if_positive(F.col(now) - F.col(then), F.col(then))
    return series.select(
        "facility_id",
        "event_date",
        "collections_1d",
        "collections_7d_rolling",
        "collections_30d_rolling",
        growth("_month_total", "_previous").alias("collections_mom_growth"),
        growth("collections_30d_rolling", "_year_ago").alias("collections_yoy_growth"),
        F.weekday("event_date").alias("day_of_week"),
        F.month("event_date").alias("month"),
        (F.dayofmonth("event_date") >= fv.MONTH_END_FROM_DAY).alias("is_month_end"),
        growth("_month_to_date", "_previous").alias("mom_growth_to_date"),
    )


def month_totals(collections: DataFrame) -> DataFrame:
    """Calendar-month totals with growth over the month before."""
    keys = ["facility_id"]
    months = collections.groupBy(*keys, F.to_date(F.trunc("collection_date", "MM")).alias("month_start")).agg(
        F.sum("amount_collected").alias("month_total")
    )
    filled = months.withColumn("_month", month_index("month_start"))
    spec = Window.partitionBy(*keys).orderBy("_month").rangeBetween(-1, -1)
    return filled.withColumn("previous_total", F.max("month_total").over(spec)).select(
        *keys,
        "month_start",
        "month_total",
        ratio_if_positive(F.col("month_total") - F.col("previous_total"), F.col("previous_total")).alias("mom_growth"),
    )


def attorney_aging(aging: DataFrame) -> DataFrame:
    """Bucket balances, long-tail share, weighted age and its four-snapshot drift."""
    keys = ["attorney_id"]
    summed = aging.groupBy(*keys, F.col("report_date").alias("event_date")).agg(
        *[F.sum(b).alias(b) for b in fv.AGING_BUCKETS]
    )
    total = sum((F.col(b) for b in fv.AGING_BUCKETS[1:]), F.col(fv.AGING_BUCKETS[0]))
    weighted = sum(
        (F.col(b) * m for b, m in zip(fv.AGING_BUCKETS[1:], fv.AGING_BUCKET_MIDPOINT_DAYS[1:], strict=True)),
        F.col(fv.AGING_BUCKETS[0]) * fv.AGING_BUCKET_MIDPOINT_DAYS[0],
    )
    share = F.coalesce(ratio_if_positive(F.col("bucket_180_plus"), F.col("total_outstanding")), F.lit(0.0))
    age = F.coalesce(ratio_if_positive(weighted, F.col("total_outstanding")), F.lit(0.0))
    shaped = summed.withColumn("total_outstanding", total).withColumns(
        {"pct_180_plus": share, "avg_days_outstanding": age}
    )
    earlier = F.lag("pct_180_plus", 4).over(by_day(keys, "event_date"))
    return shaped.select(
        *keys,
        "event_date",
        *[F.col(b).alias(f"{b}_balance") for b in fv.AGING_BUCKETS],
        "total_outstanding",
        "pct_180_plus",
        "avg_days_outstanding",
        (F.col("pct_180_plus") - earlier).alias("aging_migration_rate_30d"),
    )


def visit_velocity(visits: DataFrame) -> DataFrame:
    """Trailing visit counts and billing rates per facility and case type."""
    keys = ["facility_id", "case_type"]
    daily = visits.groupBy(*keys, F.col("visit_date").alias("event_date")).agg(
        F.count("*").alias("n"),
        F.sum((F.col("billed_amount") > 0).cast("bigint")).alias("billed"),
        F.sum((F.col("billing_status") == "pending").cast("bigint")).alias("pending"),
    )
    dense = densify(daily, keys, "event_date", ["n", "billed", "pending"])
    last7 = dense.select(
        *keys,
        "event_date",
        rolling_count("n", keys, "event_date", 7).alias("new_visits_7d"),
        rolling_count("n", keys, "event_date", 30).alias("new_visits_30d"),
        rolling_count("billed", keys, "event_date", 7).alias("_billed"),
        rolling_count("pending", keys, "event_date", 7).alias("_pending"),
    )
    rate = lambda c: F.coalesce(ratio_if_positive(F.col(c), F.col("new_visits_7d")), F.lit(0.0))
    return last7.select(
        *keys,
        "event_date",
        "new_visits_7d",
        "new_visits_30d",
        rate("_pending").alias("visit_cancellation_rate_7d"),
        (F.col("new_visits_7d") / F.lit(7.0)).alias("new_case_open_rate_7d"),
        rate("_billed").alias("visit_billing_conversion_rate"),
    )


def span_of(frame: DataFrame, earliest: Column, latest: Column, measures: list[str]) -> tuple[Column, Column]:
    """First and last date of an aggregated frame, as lazy one-value subqueries.

    The dates are taken under a condition on every measure.  It always holds,
    also for null and NaN, but it keeps the measures in the subquery, which then
    reads the shuffle files of the frame itself instead of scanning the facts again.
    """
    present = F.lit(True)
    for m in measures:
        present = present & F.coalesce(F.abs(m) >= 0, F.lit(True))
    span = frame.agg(F.min(F.when(present, earliest)).alias("first"), F.max(F.when(present, latest)).alias("last"))
    return span.select("first").scalar(), span.select("last").scalar()


def settlement_pipeline(settlements: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Open counts, closings, days to close and velocity on a weekly grid.

    An opening adds one and a closing takes one away, so the number open on any
    date is a running sum of daily deltas.  The grid runs from the first opening
    to ``as_of``, by default the last opening or closing.
    """
    keys = ["attorney_id", "case_type"]
    large = F.coalesce((F.col("settlement_amount") > fv.HIGH_VALUE_SETTLEMENT).cast("bigint"), F.lit(0))
    days = F.datediff("close_date", "open_date")

    def change(day, opened, closed):
        return F.struct(
            day.alias("day"),
            (F.lit(opened) - F.lit(closed)).cast("bigint").alias("open_delta"),
            ((F.lit(opened) - F.lit(closed)) * large).alias("large_delta"),
            F.lit(closed).cast("bigint").alias("closed"),
            (F.lit(closed) * F.coalesce(days, F.lit(0))).cast("bigint").alias("close_days"),
        )

    changes = settlements.select(
        *keys, F.inline(F.array(change(F.col("open_date"), 1, 0), change(F.col("close_date"), 0, 1)))
    ).filter("day is not null")
    measures = ["open_delta", "large_delta", "closed", "close_days"]
    daily = changes.groupBy(*keys, "day").agg(*[F.sum(m).alias(m) for m in measures])
    first, last = span_of(daily, F.col("day"), F.col("day"), measures)
    points = on_weekly_grid(daily, keys, "day", first, last if as_of is None else as_of, measures)
    within = lambda m, oldest, newest=0: trailing_count(m, keys, "day", oldest, newest)
    framed = points.select(
        *keys,
        F.col("day").alias("event_date"),
        "on_grid",
        within("open_delta", None).alias("open_settlements_count"),
        within("large_delta", None).alias("high_value_open_count"),
        within("closed", 29).alias("settlements_closed_30d"),
        within("closed", 59, 30).alias("_before"),
        within("closed", 89).alias("_closed90"),
        within("close_days", 89).alias("_days90"),
    ).filter("on_grid")
    return framed.select(
        *keys,
        "event_date",
        "open_settlements_count",
        "settlements_closed_30d",
        ratio_if_positive(F.col("_days90"), F.col("_closed90")).alias("avg_days_to_settlement_90d"),
        ratio_if_positive(F.col("settlements_closed_30d") - F.col("_before"), F.col("_before")).alias(
            "settlement_velocity_change_30d"
        ),
        "high_value_open_count",
    )


def lop_histogram(letters: DataFrame) -> DataFrame:
    """Letters counted by facility, issue date, return date and rejection.

    Both halves of the LOP features read this frame, whose size is bounded by
    the calendar, so the facts are scanned and shuffled once.
    """
    return letters.groupBy(
        "facility_id", "issued_date", "returned_date", (F.col("status") == "rejected").alias("rejected")
    ).agg(F.count("*").alias("n"))


def lop_dates(histogram: DataFrame) -> tuple[Column, Column]:
    """First issue date and the last issue or return date."""
    return span_of(histogram, F.col("issued_date"), F.greatest("issued_date", "returned_date"), ["n"])


def lop_turnaround(histogram: DataFrame, first: Column, last: Column) -> DataFrame:
    """Exact p50/p90 of turnaround over the trailing 30 days at each grid date.

    Each return day lies inside at most five grid windows; it is copied to those
    and the percentiles are taken over value counts, whose number is bounded by
    the calendar.
    """
    copies = histogram.select(
        "facility_id",
        F.datediff("returned_date", "issued_date").alias("days"),
        "n",
        F.explode_outer(grid_points_covering("returned_date", first, last, 30)).alias("event_date"),
    ).filter("event_date is not null")
    both = F.percentile("days", F.array(F.lit(0.5), F.lit(0.9)), F.col("n"))
    counted = copies.groupBy("facility_id", "event_date", "days").agg(F.sum("n").alias("n"))
    return (
        counted.groupBy("facility_id", "event_date")
        .agg(both.alias("p"))
        .select(
            "facility_id",
            "event_date",
            F.col("p")[0].alias("lop_turnaround_days_p50"),
            F.col("p")[1].alias("lop_turnaround_days_p90"),
        )
    )


def lop_counts(histogram: DataFrame, first: Column, last: Column) -> DataFrame:
    """Issued, returned, rejection rate and backlog at each grid date.

    A letter is backlog from sixty days after issue until it returns, so it
    contributes +1 and -1 deltas unless it returned before that.
    """
    keys = ["facility_id"]
    overdue_from = F.date_add("issued_date", 60)
    becomes_overdue = F.col("returned_date").isNull() | (F.col("returned_date") > overdue_from)
    n, none = F.col("n"), F.lit(0).cast("bigint")

    def change(day, issued=none, returned=none, rejected=none, overdue=none):
        return F.struct(
            day.alias("day"), issued.alias("issued"), returned.alias("returned"),
            rejected.alias("rejections"), overdue.alias("overdue"),
        )

    changes = histogram.select(
        *keys,
        F.inline(
            F.array(
                change(F.col("issued_date"), issued=n),
                change(
                    F.col("returned_date"),
                    returned=n,
                    rejected=F.when(F.col("rejected"), n).otherwise(none),
                    overdue=F.when(becomes_overdue, -n).otherwise(none),
                ),
                change(F.when(becomes_overdue, overdue_from), overdue=n),
            )
        ),
    ).filter("day is not null")
    measures = ["issued", "returned", "rejections", "overdue"]
    daily = changes.groupBy(*keys, "day").agg(*[F.sum(m).alias(m) for m in measures])
    points = on_weekly_grid(daily, keys, "day", first, last, measures)
    within = lambda m, oldest: trailing_count(m, keys, "day", oldest)
    return (
        points.select(
            *keys,
            F.col("day").alias("event_date"),
            "on_grid",
            within("issued", 6).alias("lop_issued_7d"),
            within("returned", 6).alias("lop_returned_7d"),
            within("returned", 29).alias("_returned30"),
            within("rejections", 29).alias("_rejected30"),
            within("overdue", None).alias("lop_backlog_count"),
        )
        .filter("on_grid")
        .select(
            *keys,
            "event_date",
            "lop_issued_7d",
            "lop_returned_7d",
            F.coalesce(ratio_if_positive(F.col("_rejected30"), F.col("_returned30")), F.lit(0.0)).alias(
                "lop_rejection_rate_30d"
            ),
            "lop_backlog_count",
        )
    )


def lop_metrics(letters: DataFrame, as_of: Column | None = None) -> DataFrame:
    # dates, counts and turnaround all read it: written once
    histogram = materialise(lop_histogram(letters), "letters-by-day")
    first, last = lop_dates(histogram)
    last = last if as_of is None else as_of
    counts = lop_counts(histogram, first, last)
    turnaround = lop_turnaround(histogram, first, last)
    return counts.join(turnaround, ["facility_id", "event_date"], "left").select(
        "facility_id", "event_date", *fv.FEATURE_NAMES["lop_metrics"]
    )
