"""Model registry as snapshots: registration gate, promotion, version lists.

Every operation reads a registry frame and returns the next one; nothing is
updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv

REGISTRY_SCHEMA = (
    "model_name string, version bigint, stage string, mape double, rmse double, coverage double, bias double"
)


def next_versions(registry: DataFrame) -> DataFrame:
    return registry.groupBy("model_name").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def champions(registry: DataFrame) -> DataFrame:
    """Newest production row per model."""
    rest = [c for c in registry.columns if c != "model_name"]
    newest = F.max_by(F.struct(*rest), "version").alias("_row")
    return registry.filter("stage = 'Production'").groupBy("model_name").agg(newest).select("model_name", "_row.*")


def _standing(registry: DataFrame) -> DataFrame:
    """Last version and champion per model from one aggregate."""
    crowned = F.when(F.col("stage") == "Production", F.col("version"))
    return registry.groupBy("model_name").agg(
        F.max("version").alias("_last"),
        F.max(crowned).alias("_champion"),
        F.max_by(F.when(F.col("stage") == "Production", F.col("mape")), crowned).alias("champion_mape"),
    )


def gate(registry: DataFrame, challengers: DataFrame) -> DataFrame:
    """Decide the stage of each challenger against its champion.

    The first model of a name goes to production.  A challenger at most one
    point worse replaces the champion, one to three points worse waits, more
    than three is blocked.  An unmeasured champion yields to a measured one.
    """
    delta = (F.col("mape") - F.col("champion_mape")) * 100.0
    first = F.col("_champion").isNull()
    both = F.col("mape").isNotNull() & F.col("champion_mape").isNotNull()
    promoted: Column = (
        F.when(first, True)
        .when(both, delta <= fv.PROMOTE_WITHIN_PP)
        .otherwise(F.col("champion_mape").isNull() & F.col("mape").isNotNull())
    )
    blocked = F.when(~first & both, delta > fv.BLOCK_BEYOND_PP).otherwise(False)
    judged = challengers.join(_standing(registry), "model_name", "left").withColumns(
        {"promoted": promoted, "blocked": blocked, "version": F.coalesce("_last", F.lit(0)) + 1}
    )
    return judged.withColumn("stage", F.when(F.col("promoted"), "Production").otherwise("Staging")).drop("_last", "_champion")


def register(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """The registry after the decisions: old champions archived, challengers added."""
    dethroned = decisions.filter("promoted").select("model_name", F.lit(True).alias("_replaced"))
    kept = (
        registry.join(dethroned, "model_name", "left")
        .withColumn("stage", F.when(F.col("_replaced") & (F.col("stage") == "Production"), "Archived").otherwise(F.col("stage")))
        .drop("_replaced")
    )
    added = [c if c in decisions.columns else F.lit(None).cast(registry.schema[c].dataType).alias(c) for c in registry.columns]
    return kept.unionByName(decisions.select(*added))


def set_production(registry: DataFrame, choices: DataFrame) -> DataFrame:
    """Promote the chosen ``(model_name, version)`` rows, archiving what they replace.

    A choice that is not registered changes nothing; :func:`unknown_versions`
    lists those.
    """
    chosen = registry.select("model_name", "version").join(choices, ["model_name", "version"], "left_semi")
    target = chosen.withColumnRenamed("version", "_target")
    return (
        registry.join(target, "model_name", "left")
        .withColumn(
            "stage",
            F.when(F.col("version") == F.col("_target"), "Production")
            .when(F.col("_target").isNotNull() & (F.col("stage") == "Production"), "Archived")
            .otherwise(F.col("stage")),
        )
        .drop("_target")
    )


def unknown_versions(registry: DataFrame, choices: DataFrame) -> DataFrame:
    return choices.join(registry, ["model_name", "version"], "left_anti")


def promote(registry: DataFrame, model_name: str, version: int) -> DataFrame:
    """Single-model form of :func:`set_production`; raises for an unknown version."""
    choices = registry.sparkSession.createDataFrame([(model_name, version)], "model_name string, version bigint")
    if not unknown_versions(registry, choices).isEmpty():
        raise ValueError(f"{model_name} v{version} not found")
    return set_production(registry, choices)


def versions(registry: DataFrame, model_name: str | None = None) -> DataFrame:
    """Registered versions, newest first."""
    rows = registry if model_name is None else registry.filter(F.col("model_name") == model_name)
    return rows.orderBy("model_name", F.desc("version"))
