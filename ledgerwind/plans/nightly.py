"""The nightly run over stored tables: features, forecasts, alerts, index.

Every stage reads what earlier stages wrote and writes its own snapshots, so a
stage is one lazy plan, nothing is computed twice, and a stage can be run again
alone: it replaces what the same date published and leaves all older rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.operators import alerts as al
from ledgerwind.operators import detect, features, forecast, registry, retrieval, store
from ledgerwind.operators.iforest import isolation_forest
from ledgerwind.operators.thresholds import Overrides
from ledgerwind.session import materialise
from ledgerwind.sources.snapshots import SnapshotStore, read_cases

# --- fixed values: date columns stored as ISO text in the curated zone ---------
DATE_COLUMNS = {
    "visits": ["visit_date"],
    "collections": ["collection_date"],
    "attorney_aging": ["report_date"],
    "settlements": ["open_date", "close_date"],
    "lop": ["issued_date", "returned_date"],
}
VECTOR = ["collections_1d", "lop_turnaround_days_p50", "lop_backlog_count"]

__all__ = ["Nightly", "read_cases"]


class Nightly:
    """Stages of one run date over a snapshot store that ingest has filled."""

    def __init__(self, snapshots: SnapshotStore, run_date: str, sequence: int, overrides: Overrides | None = None) -> None:
        self.snapshots = snapshots
        self.spark = snapshots.spark
        self.run_date = run_date
        self.sequence = sequence
        self.overrides = overrides
        self.date = F.to_date(F.lit(run_date))

    def curated(self, entity: str) -> DataFrame:
        rows = self.snapshots.read(f"curated/{entity}")
        return rows.withColumns({c: F.col(c).cast("date") for c in DATE_COLUMNS[entity]})

    def _publish(self, frames: dict[str, DataFrame]) -> None:
        staged = {}
        for name, frame in frames.items():
            path = self.snapshots.stage(frame, name, self.run_date)
            staged[name] = (path, self.spark.read.parquet(path).count())
        self.snapshots.commit(self.run_date, self.sequence, staged)

    def features(self) -> None:
        """All feature groups, as typed tables and as feature-store rows."""
        frames = {
            "facility_collections": features.facility_collections(self.curated("collections")).drop("mom_growth_to_date"),
            "attorney_aging": features.attorney_aging(self.curated("attorney_aging")),
            "visit_velocity": features.visit_velocity(self.curated("visits")),
            "settlement_pipeline": features.settlement_pipeline(self.curated("settlements"), self.date),
            "lop_metrics": features.lop_metrics(self.curated("lop"), self.date),
        }
        self._publish({f"features/{g}": f for g, f in frames.items()})
        rows = {g: store.to_rows(self.snapshots.read(f"features/{g}"), g, F.current_timestamp()) for g in frames}
        # a group without rows publishes an empty table, which clears what it had
        self._publish({f"feature_values/{g}": r for g, r in rows.items()})

    def registry(self) -> DataFrame:
        if "registry" in self.snapshots.current():
            return self.snapshots.read("registry")
        return self.spark.createDataFrame([], registry.REGISTRY_SCHEMA)

    def forecasts(self) -> None:
        """Train, judge and register one model per entity; forecast with the champions."""
        series = forecast.dense_series(forecast.daily_totals(self.curated("collections")))
        self._publish({"series": series})
        trained = self.snapshots.read("series").filter(F.col("n") >= 30)
        models = forecast.fit_seasonal_trend(trained, forecast.ENTITY).withColumn("model_name", forecast.model_name())
        metrics = forecast.backtest(trained).withColumn("model_name", forecast.model_name())
        metrics = materialise(metrics.select("model_name", "mape", "rmse", "coverage", "bias"), "metrics")
        before = self.registry()
        decisions = materialise(registry.gate(before, metrics), "decisions")
        after = registry.register(before, decisions)
        versions = decisions.select("model_name", "version")
        kept = models.join(versions, "model_name")
        if "models" in self.snapshots.current():
            kept = self.snapshots.read("models").unionByName(kept)
        self._publish({"registry": after, "models": kept})
        champions = registry.champions(self.snapshots.read("registry")).select("model_name", "version")
        serving = self.snapshots.read("models").join(champions, ["model_name", "version"])
        # one table per date: a rerun replaces its date's batch, also by an empty one
        self._publish({f"forecasts/{self.run_date}": forecast.forecast_batch(serving, self.date)})

    def stored_forecasts(self) -> DataFrame:
        batches = self.snapshots.read_all("forecasts")
        if batches is None:
            raise KeyError("forecasts")
        return batches

    def feature_values(self) -> DataFrame | None:
        return self.snapshots.read_all("feature_values")

    def detection(self) -> dict[str, int]:
        """Run every detector over the facilities and write the alerts of the day."""
        series = self.snapshots.read("series").filter("entity_type = 'facility'")
        latest = forecast.latest_forecast(self.stored_forecasts(), 30)
        facility, lop = self.snapshots.read("features/facility_collections"), self.snapshots.read("features/lop_metrics")
        vectors = detect.facility_vectors(facility, lop).withColumnRenamed("facility_id", "entity_id")
        findings = (
            detect.forecast_deviation(series, latest, self.overrides)
            .unionByName(detect.cusum(series, self.overrides))
            .unionByName(isolation_forest(vectors, VECTOR, self.overrides))
        )
        settled = self.snapshots.read("features/settlement_pipeline")
        rows = al.alert_rows(al.combine(findings), settled, lop, self.date.cast("timestamp"))
        self._publish({"alert_candidates": rows})
        candidates = self.snapshots.read("alert_candidates")
        fresh = al.deliverable(candidates)
        if "alerts" in self.snapshots.current():
            older = self.snapshots.read("alerts")
            fresh = older.unionByName(fresh.join(older, "alert_id", "left_anti"))
        # one table per date, as with forecasts: a rerun replaces its date's events
        self._publish({"alerts": fresh, f"sweep_events/{self.run_date}": al.sweep_events(candidates, self.date.cast("timestamp"))})
        return al.summary(candidates).first().asDict()

    def index(self) -> None:
        """Describe the newest aggregates and write the searchable index."""
        facility = store.latest(self.snapshots.read("features/facility_collections"), ["facility_id"])
        attorney = store.latest(self.snapshots.read("features/attorney_aging"), ["attorney_id"])
        latest = forecast.latest_forecast(self.stored_forecasts(), 30)
        corpus = retrieval.build_corpus(facility, attorney, latest, self.snapshots.read("alerts"))
        self._publish({"index": retrieval.index_documents(materialise(corpus, "corpus"))})

    def answer(self, questions: DataFrame) -> DataFrame:
        """Answers to a table of ``(question_id, question)``."""
        index = self.snapshots.read("index")
        screened = materialise(retrieval.screen(questions, index.select("entity_id").distinct()), "screened")
        return retrieval.answer(screened, retrieval.retrieve(screened, index), index)
