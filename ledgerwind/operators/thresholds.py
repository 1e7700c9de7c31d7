"""Detector thresholds: defaults with per-entity overrides, as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv

Overrides = dict[tuple[str, str], dict[str, dict[str, float]]]


def flat_names() -> dict[str, float]:
    """``section_key`` column names with their default values."""
    return {f"{s}_{k}": float(v) for s, keys in fv.DEFAULT_THRESHOLDS.items() for k, v in keys.items()}


def with_thresholds(entities: DataFrame, overrides: Overrides | None = None) -> DataFrame:
    """Attach every threshold to rows carrying ``entity_type`` and ``entity_id``.

    Overrides are configuration (a handful of entries typed by a person) and
    replace single values; every other value keeps its default.
    """
    defaults = flat_names()
    if not overrides:
        return entities.withColumns({n: F.lit(v) for n, v in defaults.items()})
    rows = []
    for (entity_type, entity_id), sections in overrides.items():
        given = {f"{s}_{k}": float(v) for s, keys in sections.items() for k, v in keys.items()}
        rows.append((entity_type, entity_id, *[given.get(n) for n in defaults]))
    schema = "entity_type string, entity_id string, " + ", ".join(f"_{n} double" for n in defaults)
    given_rows = entities.sparkSession.createDataFrame(rows, schema)
    merged = entities.join(given_rows, ["entity_type", "entity_id"], "left")
    return merged.withColumns({n: F.coalesce(F.col(f"_{n}"), F.lit(v)) for n, v in defaults.items()}).drop(
        *[f"_{n}" for n in defaults]
    )
