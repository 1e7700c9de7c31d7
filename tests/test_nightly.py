from pyspark.sql import functions as F

from ledgerwind.operators.ingest import run_ingest
from ledgerwind.plans.nightly import Nightly
from ledgerwind.sources import business
from ledgerwind.sources.snapshots import SnapshotStore
from ledgerwind.sources.tables import Lake


def feed(frame):
    """A business table as an untyped feed with a row order."""
    text = frame.select(*[F.col(c).cast("string").alias(c) for c in frame.columns])
    return text.withColumn("_ord", F.xxhash64(*text.columns))


def test_one_night_from_feeds_to_answers(spark, tmp_path):
    lake = Lake(spark, "/root/testdata/sf0.001")
    snapshots = SnapshotStore(spark, str(tmp_path))
    report = run_ingest(spark, {e: feed(f) for e, f in business.all_business(lake).items()}, snapshots, "ingest-1", 1, "key")
    assert not report.aborted, report.failures

    night = Nightly(snapshots, "2001-11-05", 2)
    night.features()
    night.forecasts()
    assert night.stored_forecasts().groupBy("entity_type").agg(F.countDistinct("horizon_days").alias("h")).filter("h = 3").count() == 3
    assert night.registry().filter("stage <> 'Production'").isEmpty()
    counts = night.detection()
    assert counts["alerts_generated"] == counts["p1"] + counts["p2"] + counts["p3"]
    night.index()
    asked = spark.createDataFrame([("a", "How is ASIA performing?"), ("b", "capital of France")], "question_id string, question string")
    a, b = night.answer(asked).orderBy("question_id").collect()
    assert a.status == "grounded" and a.citations and b.reason == "outside_financial_domain"

    second = Nightly(snapshots, "2001-11-06", 3)
    second.forecasts()
    stages = {r.stage: r.k for r in second.registry().groupBy("stage").agg(F.count("*").alias("k")).collect()}
    assert stages["Archived"] == stages["Production"]

    def counts_of(date):
        batches = night.stored_forecasts()
        return batches.filter(F.col("forecast_date") == date).count(), batches.count(), night.snapshots.read("alerts").count()

    before, values = counts_of("2001-11-05"), night.feature_values().count()
    again = Nightly(snapshots, "2001-11-05", 2)  # every stage once more for a date that is there
    again.features()
    again.forecasts()
    again.detection()
    assert counts_of("2001-11-05") == before and before[1] > before[0] and night.feature_values().count() == values
    again.index()
