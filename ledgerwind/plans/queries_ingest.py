"""Registered queries: validation, quality rules, de-duplication, audit, thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind import contracts
from ledgerwind import fixed_values as fv
from ledgerwind.functions.numeric import rounded
from ledgerwind.operators import quality
from ledgerwind.operators.ingest import curate
from ledgerwind.operators.thresholds import flat_names, with_thresholds
from ledgerwind.plans.catalog import register
from ledgerwind.plans.oracle_views import view
from ledgerwind.plans.queries_text import DEMO_KEY, _hmac_check
from ledgerwind.sources import business
from ledgerwind.sources.feeds import COLLECTION_FEED, VISIT_FEED, collection_feed, visit_feed
from ledgerwind.sources.tables import Lake

view("collection_feed_v", f"SELECT {', '.join(COLLECTION_FEED)} FROM lineitem")
view("visit_feed_v", f"SELECT {', '.join(VISIT_FEED)} FROM orders")


def _field_check(field: contracts.Field) -> str:
    missing = f"WHEN {field.name} IS NULL THEN '{field.name}: {contracts.MISSING}'" if field.required else ""
    if field.kind == "str":
        return f"CASE {missing} ELSE NULL END" if missing else "NULL"
    message, kind = (contracts.BAD_INTEGER, "BIGINT") if field.kind == "int" else (contracts.BAD_NUMBER, "DOUBLE")
    return f"CASE {missing} WHEN {field.name} IS NOT NULL AND TRY_CAST({field.name} AS {kind}) IS NULL THEN '{field.name}: {message}' END"


def _validated_check(entity: str, source: str, skip: tuple[str, ...] = ()) -> str:
    declared = [f for f in contracts.fields(entity) if f.name not in skip]
    errors = ", ".join(_field_check(f) for f in declared)
    typed = ", ".join(f"TRY_CAST({f.name} AS {'VARCHAR' if f.kind == 'str' else f.sql_type}) AS {f.name}" for f in declared)
    return f"SELECT row_ord, {typed}, list_filter([{errors}], lambda e: e IS NOT NULL) AS errors FROM {source}"


view("valid_collections_v", _validated_check("collections", "collection_feed_v"))
view("valid_visits_v", _validated_check("visits", "visit_feed_v", ("patient_dob", "patient_ssn_last4", "patient_address")))


def checked_collections(lake: Lake) -> DataFrame:
    return quality.validate(collection_feed(lake), "collections")


def checked_visits(lake: Lake) -> DataFrame:
    return quality.validate(visit_feed(lake), "visits")


@register(
    "validate_rows",
    """SELECT 'collections' AS entity, collection_id AS row_key, len(errors) = 0 AS is_valid, array_to_string(errors, '; ') AS errors,
              amount_collected AS amount FROM valid_collections_v
       UNION ALL
       SELECT 'visits', visit_id, len(errors) = 0, array_to_string(errors, '; '), billed_amount FROM valid_visits_v""",
)
def _validate(lake: Lake) -> DataFrame:
    def shape(frame: DataFrame, entity: str, key: str, amount: str) -> DataFrame:
        return frame.select(
            F.lit(entity).alias("entity"),
            F.col(key).alias("row_key"),
            (F.size("errors") == 0).alias("is_valid"),
            F.array_join("errors", "; ").alias("errors"),
            F.col(amount).alias("amount"),
        )

    return shape(checked_collections(lake), "collections", "collection_id", "amount_collected").unionByName(
        shape(checked_visits(lake), "visits", "visit_id", "billed_amount")
    )


_SAMPLES = """SELECT '{entity}' AS entity, CAST(row_number() OVER (ORDER BY o, p, message) AS INTEGER) AS sample, message
FROM (SELECT message, min(row_ord) AS o, arg_min(p, (row_ord, p)) AS p
      FROM (SELECT row_ord, unnest(errors) AS message, generate_subscripts(errors, 1) AS p FROM {source})
      GROUP BY message ORDER BY 2, 3, 1 LIMIT 5)"""


@register(
    "error_samples",
    f"SELECT * FROM ({_SAMPLES.format(entity='collections', source='valid_collections_v')}) UNION ALL "
    f"SELECT * FROM ({_SAMPLES.format(entity='visits', source='valid_visits_v')})",
)
def _samples(lake: Lake) -> DataFrame:
    return quality.error_samples(checked_collections(lake), "collections", "row_ord").unionByName(
        quality.error_samples(checked_visits(lake), "visits", "row_ord")
    )


def _rules_check(entity: str, source: str, columns: list[str], domains: dict[str, list[str]]) -> str:
    parts = []
    for c in fv.NOT_NULL_RULES[entity]:
        parts.append((c, "null_rate", f"count(*) FILTER (WHERE {c} IS NULL) / count(*)", fv.MAX_NULL_RATE))
    for c in fv.NOT_NEGATIVE_RULES[entity]:
        parts.append((c, "negative_rows", f"CAST(count(*) FILTER (WHERE {c} < 0) AS DOUBLE)", 0.0))
    for c, allowed in domains.items():
        inside = ", ".join(f"'{a}'" for a in allowed)
        parts.append((c, "outside_domain_rows", f"CAST(count(*) FILTER (WHERE {c} NOT IN ({inside})) AS DOUBLE)", 0.0))
    return " UNION ALL ".join(
        f"""SELECT '{entity}' AS entity, '{c}' AS "column", '{rule}' AS rule, round({expr}, 6) AS observed,
                   CAST({limit} AS DOUBLE) AS "limit", CASE WHEN {expr} > {limit} THEN 'failed' ELSE 'passed' END AS status FROM {source}"""
        for c, rule, expr, limit in parts
    )


BILLING_DOMAIN = {"billing_status": ["paid", "unpaid", "pending"]}


@register(
    "schema_quality_report",
    _rules_check("collections", "valid_collections_v", [], {})
    + " UNION ALL "
    + _rules_check("visits", "valid_visits_v", [], BILLING_DOMAIN),
)
def _quality(lake: Lake) -> DataFrame:
    report = quality.quality_report(checked_collections(lake), "collections").unionByName(
        quality.quality_report(checked_visits(lake), "visits", BILLING_DOMAIN)
    )
    return rounded(report, {"observed": 6})


@register(
    "duplicate_keys",
    "SELECT collection_id, count(*) AS copies FROM collections_v GROUP BY collection_id HAVING count(*) > 1",
)
def _duplicates(lake: Lake) -> DataFrame:
    return quality.duplicate_keys(business.collections(lake, "collection_id"), ["collection_id"])


_TOTAL_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@register(
    "dedup_last_wins",
    f"""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_date, l_partkey, l_suppkey, l_quantity, l_extendedprice
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                           ORDER BY {', '.join(c + ' DESC' for c in _TOTAL_ORDER)}) AS rn FROM lineitem) WHERE rn = 1""",
)
def _dedup(lake: Lake) -> DataFrame:
    kept = quality.last_row_wins(lake.table("lineitem"), ["l_orderkey", "l_linenumber"], _TOTAL_ORDER)
    return kept.select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship_date"),
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )


@register(
    "vector_upsert",
    """SELECT id, arg_max(vec_id, vec_id) AS version, round(arg_max(embedding[1], vec_id), 6) AS first_value,
              CAST(arg_max(len(embedding), vec_id) AS BIGINT) AS dims
       FROM (SELECT concat('v-', label, '-', vec_id % 50) AS id, vec_id, embedding FROM embeddings) GROUP BY id""",
)
def _upsert(lake: Lake) -> DataFrame:
    records = lake.table("embeddings").selectExpr("concat('v-', label, '-', vec_id % 50) AS id", "vec_id", "embedding")
    kept = quality.last_row_wins(records, ["id"], ["vec_id"])
    return kept.select(
        "id", F.col("vec_id").alias("version"), F.round(F.col("embedding")[0], 6).alias("first_value"),
        F.size("embedding").cast("bigint").alias("dims"),
    )


@register(
    "curated_visits",
    """SELECT visit_id, facility_id, case_type, visit_date, billing_status, round(billed_amount, 2) AS billed_amount,
              paid_amount, provider_id FROM valid_visits_v WHERE len(errors) = 0""",
)
def _curated(lake: Lake) -> DataFrame:
    valid = quality.valid_rows(checked_visits(lake))
    return rounded(curate(valid, "visits", DEMO_KEY, ["row_ord"]), {"billed_amount": 2})


@register(
    "raw_visits_masked",
    f"""SELECT visit_id, 'tok_' || substr({_hmac_check('patient_name', DEMO_KEY)}, 1, 16) AS patient_name
        FROM valid_visits_v WHERE len(errors) = 0""",
)
def _raw_masked(lake: Lake) -> DataFrame:
    from ledgerwind.functions import phi

    valid = quality.valid_rows(checked_visits(lake))
    return phi.mask(valid, "visits", DEMO_KEY).select("visit_id", "patient_name")


YEARLY = {
    "visits": (lambda lake: business.visits(lake, "visit_date"), "visit_date", "visits_v"),
    "collections": (lambda lake: business.collections(lake, "collection_date"), "collection_date", "collections_v"),
    "settlements": (lambda lake: business.settlements(lake, "open_date"), "open_date", "settlements_v"),
    "lop": (lambda lake: business.letters(lake, "issued_date"), "issued_date", "lop_v"),
}

view("yearly_counts_v", " UNION ALL ".join(
    f"SELECT '{e}' AS entity, CAST(year({day}) AS INTEGER) AS year, count(*) AS row_count FROM {v} GROUP BY ALL"
    for e, (_, day, v) in YEARLY.items()
))


def yearly_counts(lake: Lake) -> DataFrame:
    parts = [
        build(lake).groupBy(F.year(day).alias("year")).agg(F.count("*").alias("row_count")).withColumn("entity", F.lit(entity))
        for entity, (build, day, _) in YEARLY.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@register("prior_counts", "SELECT entity, year + 1 AS for_year, row_count AS prior_rows FROM yearly_counts_v")
def _prior(lake: Lake) -> DataFrame:
    return yearly_counts(lake).select("entity", (F.col("year") + 1).alias("for_year"), F.col("row_count").alias("prior_rows"))


@register(
    "record_count_drop",
    """SELECT c.entity, c.year, c.row_count, p.row_count AS prior_rows, round((p.row_count - c.row_count) / p.row_count, 6) AS drop_rate,
              CASE WHEN (p.row_count - c.row_count) / p.row_count > 0.20 THEN 'failed' ELSE 'passed' END AS status
       FROM yearly_counts_v c LEFT JOIN yearly_counts_v p ON p.entity = c.entity AND p.year = c.year - 1""",
)
def _drop(lake: Lake) -> DataFrame:
    counts = yearly_counts(lake)
    prior = yearly_counts(lake).withColumn("year", F.col("year") + 1)
    return rounded(quality.record_drop(counts, prior, ["entity", "year"]), {"drop_rate": 6})


@register(
    "ingest_audit",
    """SELECT entity, count(*) AS source_records, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed,
              count(*) FILTER (WHERE ok AND personal) AS phi_masked
       FROM (SELECT 'collections' AS entity, len(errors) = 0 AS ok, false AS personal FROM valid_collections_v
             UNION ALL SELECT 'visits', len(errors) = 0, patient_name <> '' FROM valid_visits_v) GROUP BY entity""",
)
def _audit(lake: Lake) -> DataFrame:
    ok = F.size("errors") == 0
    count = lambda c: F.sum(c.cast("bigint"))

    def row(frame: DataFrame, entity: str, personal) -> DataFrame:
        return frame.agg(
            F.count("*").alias("source_records"), count(ok).alias("passed"), count(~ok).alias("failed"),
            count(ok & personal).alias("phi_masked"),
        ).withColumn("entity", F.lit(entity))

    return row(checked_collections(lake), "collections", F.lit(False)).unionByName(
        row(checked_visits(lake), "visits", F.coalesce(F.col("patient_name") != "", F.lit(False)))
    )


OVERRIDES = {
    ("facility", "ASIA"): {"forecast_deviation": {"p2_pct": -0.22, "p1_pct": -0.35}},
    ("attorney", "NATION_3"): {"cusum": {"p1_sigma": 9.0}},
}
view("entities_v", """
SELECT DISTINCT 'facility' AS entity_type, facility_id AS entity_id FROM collections_v
UNION ALL SELECT DISTINCT 'attorney', attorney_id FROM collections_v
UNION ALL SELECT DISTINCT 'case_type', case_type FROM collections_v
""")
view("thresholds_v", "SELECT entity_type, entity_id, " + ", ".join(
    {
        "forecast_deviation_p2_pct": "CAST(CASE WHEN entity_type = 'facility' AND entity_id = 'ASIA' THEN -0.22 ELSE -0.15 END AS DOUBLE) AS forecast_deviation_p2_pct",
        "forecast_deviation_p1_pct": "CAST(CASE WHEN entity_type = 'facility' AND entity_id = 'ASIA' THEN -0.35 ELSE -0.25 END AS DOUBLE) AS forecast_deviation_p1_pct",
        "cusum_p1_sigma": "CAST(CASE WHEN entity_type = 'attorney' AND entity_id = 'NATION_3' THEN 9 ELSE 6 END AS DOUBLE) AS cusum_p1_sigma",
    }.get(n, f"CAST({v} AS DOUBLE) AS {n}")
    for n, v in flat_names().items()
) + " FROM entities_v")


def entities(lake: Lake) -> DataFrame:
    """Distinct entities of every type that the collections name."""
    pairs = F.array(*[
        F.struct(F.lit(t).alias("entity_type"), F.col(c).alias("entity_id")) for t, c in fv.ENTITY_DIMENSIONS.items() if c != "case_type"
    ])
    places = business.places(lake).select(F.inline(pairs)).distinct()
    return places.unionByName(business.case_types(lake).select(F.lit("case_type").alias("entity_type"), F.col("case_type").alias("entity_id")))


@register("entity_list", "SELECT entity_type, entity_id FROM entities_v")
def _entities(lake: Lake) -> DataFrame:
    return entities(lake).orderBy("entity_type", "entity_id")


@register("threshold_config", "SELECT * FROM thresholds_v")
def _thresholds(lake: Lake) -> DataFrame:
    return with_thresholds(entities(lake), OVERRIDES)
