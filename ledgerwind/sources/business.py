"""The five business tables, defined over the raw tables.

Dimensions are attached with left joins on unique keys, which never change the
number of rows.  A caller that does not ask for a dimension column therefore
gets the same rows without paying for that join.  No side is hinted: Spark
broadcasts a dimension only when its measured size is below the session limit
and sort-merges (with skew splitting) beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwind.sources.tables import Lake

AGING_STEP_DAYS = 7


def geography(lake: Lake) -> DataFrame:
    """Nation with its region: one row per nation."""
    nation = lake.table("nation")
    region = lake.table("region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        "n_nationkey", "n_name", "r_name"
    )


def _with_supplier(rows: DataFrame, lake: Lake) -> DataFrame:
    """Add the supplier's region and nation.

    Dimensions are joined one after another, so Spark judges each by its own
    file size instead of by an estimate for a joined pair.
    """
    supplier = lake.table("supplier").select("s_suppkey", "s_nationkey")
    geo = geography(lake)
    placed = rows.join(supplier, rows.l_suppkey == supplier.s_suppkey, "left")
    return placed.join(geo, placed.s_nationkey == geo.n_nationkey, "left").withColumns(
        {"facility_id": F.col("r_name"), "attorney_id": F.col("n_name")}
    )


def _with_customer(rows: DataFrame, lake: Lake) -> DataFrame:
    """Add the customer's segment, nation and region."""
    customer = lake.table("customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("case_type"))
    geo = geography(lake)
    placed = rows.join(customer, rows.o_custkey == customer.c_custkey, "left")
    return placed.join(geo, placed.c_nationkey == geo.n_nationkey, "left").withColumns(
        {"facility_id": F.col("r_name"), "attorney_id": F.col("n_name")}
    )


def _with_segment(rows: DataFrame, lake: Lake) -> DataFrame:
    customer = lake.table("customer").select("c_custkey", F.col("c_mktsegment").alias("case_type"))
    return rows.join(customer, rows.o_custkey == customer.c_custkey, "left")


def _order_id() -> Column:
    return F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))


def collections(lake: Lake, *columns: str) -> DataFrame:
    """Cash received: one row per line item, dated by its ship date."""
    wanted = columns or (
        "collection_id", "facility_id", "attorney_id", "case_type",
        "collection_date", "amount_collected", "days_outstanding",
    )
    rows = lake.table("lineitem").select(
        "l_orderkey",
        "l_suppkey",
        _order_id().alias("collection_id"),
        F.to_date("l_shipdate").alias("collection_date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount_collected"),
    )
    if {"facility_id", "attorney_id"} & set(wanted):
        rows = _with_supplier(rows, lake)
    if {"case_type", "days_outstanding"} & set(wanted):
        orders = lake.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("ordered"))
        if "case_type" in wanted:  # before the join, so that the lines are shuffled once
            orders = _with_segment(orders, lake)
        rows = rows.join(orders, rows.l_orderkey == orders.o_orderkey, "left").withColumn(
            "days_outstanding", F.datediff("collection_date", "ordered")
        )
    return rows.select(*wanted)


def places(lake: Lake) -> DataFrame:
    """Distinct facility and attorney pairs of the collections; the lines are reduced to their suppliers before the join."""
    lines = lake.table("lineitem").select("l_suppkey").distinct()
    return _with_supplier(lines, lake).select("facility_id", "attorney_id").distinct()


def case_types(lake: Lake) -> DataFrame:
    """Distinct case types of the collections; keys are reduced before each join."""
    lines = lake.table("lineitem").select("l_orderkey").distinct()
    orders = lake.table("orders").select("o_orderkey", "o_custkey")
    buyers = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left").select("o_custkey").distinct()
    return _with_segment(buyers, lake).select("case_type").distinct()


def visits(lake: Lake, *columns: str) -> DataFrame:
    """Visits: one row per order."""
    wanted = columns or (
        "visit_id", "facility_id", "case_type", "visit_date",
        "billing_status", "billed_amount", "paid_amount", "provider_id",
    )
    status = F.col("o_orderstatus")
    rows = lake.table("orders").select(
        F.col("o_orderkey").alias("visit_id"),
        "o_custkey",
        F.to_date("o_orderdate").alias("visit_date"),
        F.when(status == "F", "paid").when(status == "O", "unpaid").otherwise("pending").alias("billing_status"),
        F.col("o_totalprice").alias("billed_amount"),
        F.when(status == "F", F.col("o_totalprice")).otherwise(0.0).alias("paid_amount"),
        F.col("o_orderpriority").alias("provider_id"),
    )
    if {"facility_id", "case_type"} & set(wanted):
        rows = _with_customer(rows, lake)
    return rows.select(*wanted)


def settlements(lake: Lake, *columns: str) -> DataFrame:
    """Settlements: one row per order, closed by its last shipment on or after it."""
    wanted = columns or (
        "settlement_id", "attorney_id", "case_type", "open_date",
        "close_date", "settlement_amount", "settlement_status",
    )
    orders = lake.table("orders").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("open_date"),
        F.col("o_totalprice").alias("settlement_amount"),
    )
    rows = orders
    if {"close_date", "settlement_status"} & set(wanted):
        shipped = lake.table("lineitem").groupBy("l_orderkey").agg(
            F.to_date(F.max("l_shipdate")).alias("last_shipped")
        )
        closed = F.when(F.col("last_shipped") >= F.col("open_date"), F.col("last_shipped"))
        rows = (
            orders.join(shipped, orders.o_orderkey == shipped.l_orderkey, "left")
            .withColumn("close_date", closed)
            .withColumn("settlement_status", F.when(F.col("close_date").isNull(), "open").otherwise("closed"))
        )
    if {"attorney_id", "case_type"} & set(wanted):
        rows = _with_customer(rows, lake)
    return rows.withColumn("settlement_id", F.col("o_orderkey")).select(*wanted)


def letters(lake: Lake, *columns: str) -> DataFrame:
    """Letters of protection: one row per line item of a known order."""
    wanted = columns or (
        "lop_id", "facility_id", "case_type", "issued_date", "returned_date", "status", "rejection_reason",
    )
    lines = lake.table("lineitem").select(
        "l_orderkey", "l_suppkey", _order_id().alias("lop_id"), "l_returnflag", "l_linestatus",
        F.to_date("l_shipdate").alias("shipped"),
    )
    orders = lake.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("issued_date"))
    returned = F.when(F.col("shipped") >= F.col("issued_date"), F.col("shipped"))
    rows = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .withColumn("returned_date", returned)
        .withColumn(
            "status",
            F.when(F.col("returned_date").isNull(), "open")
            .when(F.col("l_returnflag") == "R", "rejected")
            .otherwise("returned"),
        )
        .withColumn("rejection_reason", F.when(F.col("status") == "rejected", F.col("l_linestatus")))
    )
    if "facility_id" in wanted:
        rows = _with_supplier(rows, lake)
    if "case_type" in wanted:
        rows = _with_segment(rows, lake)
    return rows.select(*wanted)


def aging(lake: Lake) -> DataFrame:
    """Weekly snapshots of each attorney's unpaid balance by age.

    Orders are reduced to one row per attorney and day first; the buckets are
    then framed sums over that daily frame, so no snapshot is joined to orders.
    """
    from ledgerwind.operators.features import span_of
    from ledgerwind.operators.timeseries import on_weekly_grid, trailing

    status = F.col("o_orderstatus")
    orders = lake.table("orders").select(
        "o_custkey",
        F.to_date("o_orderdate").alias("day"),
        F.when(status == "F", 0.0).otherwise(F.col("o_totalprice")).alias("balance"),
    )
    keys = ["attorney_id", "facility_id"]
    daily = _with_customer(orders, lake).groupBy(*keys, "day").agg(F.sum("balance").alias("balance"))
    first, last = span_of(daily, F.col("day"), F.col("day"), ["balance"])
    points = on_weekly_grid(daily, keys, "day", first, last, ["balance"])
    spans = {
        "bucket_0_30": (30, 0), "bucket_31_60": (60, 31), "bucket_61_90": (90, 61),
        "bucket_91_180": (180, 91), "bucket_180_plus": (None, 181),
    }
    buckets = [
        F.coalesce(trailing(F.sum("balance"), keys, "day", oldest, newest), F.lit(0.0)).alias(name)
        for name, (oldest, newest) in spans.items()
    ]
    return (
        points.select(*keys, F.col("day").alias("report_date"), "on_grid", *buckets).filter("on_grid").drop("on_grid")
    )


def all_business(lake: Lake) -> dict[str, DataFrame]:
    return {
        "visits": visits(lake),
        "collections": collections(lake),
        "attorney_aging": aging(lake),
        "settlements": settlements(lake),
        "lop": letters(lake),
    }
