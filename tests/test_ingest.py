import pytest
from pyspark.sql import functions as F

from ledgerwind import contracts
from ledgerwind.operators import quality
from ledgerwind.operators.ingest import run_ingest
from ledgerwind.sources.snapshots import SnapshotStore, read_cases, read_csv, write_csv

COLLECTION = "_ord bigint, collection_id string, facility_id string, attorney_id string, case_type string, collection_date string, amount_collected string, days_outstanding string"


def collections(spark, *rows):
    return spark.createDataFrame(list(rows), COLLECTION)


GOOD = (1, "c1", "f", "a", "PI", "2026-01-01", "12.5", "3")


def test_validation_counts_and_names_the_field(spark):
    bad = (2, "c2", "f", "a", "PI", "2026-01-01", None, "3")
    checked = quality.validate(collections(spark, GOOD, bad), "collections")
    assert quality.valid_rows(checked).count() == 1
    (sample,) = quality.error_samples(checked, "collections", "_ord").collect()
    assert sample.message == "amount_collected: Field required"


@pytest.mark.parametrize(
    "text, ok", [("1", True), (" 2.5 ", True), ("1e3", True), ("1d", False), ("2.f", False), ("x", False), ("", False), ("nan", True)]
)
def test_number_reading(spark, text, ok):
    row = collections(spark, (*GOOD[:6], text, "3"))
    assert (quality.valid_rows(quality.validate(row, "collections")).count() == 1) is ok


@pytest.mark.parametrize("text, ok", [("7", True), ("7.0", True), ("-7", True), ("7.5", False), ("1e3", False)])
def test_integer_reading(spark, text, ok):
    row = collections(spark, (*GOOD[:7], text))
    assert (quality.valid_rows(quality.validate(row, "collections")).count() == 1) is ok


def test_samples_are_distinct_and_capped(spark):
    rows = [(i, None, None, None, None, None, "x", "y") for i in range(50)]
    samples = quality.error_samples(quality.validate(collections(spark, *rows), "collections"), "collections", "_ord").collect()
    assert len(samples) == 5 and len({s.message for s in samples}) == 5
    assert samples[0].message.startswith("collection_id")


def test_contract_reports_missing_and_extra():
    columns = [f.name for f in contracts.fields("collections") if f.name != "amount_collected"] + ["surprise_col"]
    missing, extra = quality.schema_failures(columns, "collections")
    assert "amount_collected" in missing and "surprise_col" in extra
    optional = [f.name for f in contracts.fields("lop") if f.required]
    assert quality.schema_failures(optional, "lop") == []


def test_quality_rules(spark):
    rows = [(i, f"c{i}", None if i < 2 else "f", "a", "PI", "2026-01-01", str(v), "1") for i, v in enumerate([-1, 2, 3])]
    report = quality.quality_report(quality.validate(collections(spark, *rows), "collections"), "collections").collect()
    status = {(r.column, r.rule): r.status for r in report}
    assert status["amount_collected", "negative_rows"] == "failed"
    assert status["facility_id", "null_rate"] == "failed"
    assert status["collection_date", "null_rate"] == "passed"


def test_null_rate_limit_is_strict(spark):
    rows = [(i, f"c{i}", None if i == 0 else "f", "a", "PI", "2026-01-01", "1", "1") for i in range(50)]
    report = quality.quality_report(quality.validate(collections(spark, *rows), "collections"), "collections")
    assert report.filter("column = 'facility_id'").first().status == "passed"


def test_record_drop(spark):
    now = spark.createDataFrame([("e", 50)], "entity string, row_count bigint")
    before = spark.createDataFrame([("e", 100)], "entity string, row_count bigint")
    zero = spark.createDataFrame([("e", 0)], "entity string, row_count bigint")
    assert quality.record_drop(now, before, ["entity"]).first().status == "failed"
    assert quality.record_drop(now, before, ["entity"], blocking=False).first().status == "warning"
    assert quality.record_drop(now, zero, ["entity"]).first().status == "passed"


def test_last_row_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), ("b", 1, "q")], "k string, o int, v string")
    kept = {r.k: (r.o, r.v) for r in quality.last_row_wins(rows, ["k"], ["o"]).collect()}
    assert kept == {"a": (3, None), "b": (1, "q")}


def visit(i, **other):
    row = dict(
        _ord=i, visit_id=f"v{i}", facility_id="f", case_type="PI", visit_date="2026-01-01", billing_status="paid",
        billed_amount="10", paid_amount="10", provider_id="p", patient_name="John Doe", patient_dob="1980-01-01",
        patient_ssn_last4=None, patient_address="",
    )
    return {**row, **other}


VISIT = "_ord bigint, " + ", ".join(f"{f.name} string" for f in contracts.fields("visits"))


def test_run_publishes_masks_and_audits(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    feed = spark.createDataFrame([visit(1), visit(2), visit(3, visit_id="v2", facility_id="g"), visit(4, paid_amount="x")], VISIT)
    report = run_ingest(spark, {"visits": feed}, store, "r1", 1, "key")
    assert not report.aborted and (report.source_records, report.passed, report.failed, report.masked) == (4, 3, 1, 3)
    curated = store.read("curated/visits")
    assert set(curated.columns) == set(contracts.curated_columns("visits"))
    assert curated.filter("visit_id = 'v2'").first().facility_id == "g"
    assert store.read("raw/visits").first().patient_name == "John Doe"
    assert report.validation_errors["visits"] == [f"paid_amount: {contracts.BAD_NUMBER}"]
    audit = spark.read.parquet(f"{tmp_path}/ingest_audit").first()
    assert audit.source_record_count == 4 and not audit.detail.aborted


def test_gate_keeps_the_prior_snapshot(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    visits = spark.createDataFrame([visit(i) for i in range(10)], VISIT)
    run_ingest(spark, {"visits": visits, "collections": collections(spark, GOOD)}, store, "r1", 1, "key")
    more = spark.createDataFrame([visit(i) for i in range(20)], VISIT)
    report = run_ingest(spark, {"visits": more, "collections": collections(spark)}, store, "r2", 2, "key")
    assert report.aborted and not report.schema_ok
    assert store.read("curated/visits").count() == 10 and store.read("raw/visits").count() == 10
    allowed = run_ingest(spark, {"visits": more, "collections": collections(spark)}, store, "r3", 3, "key", permissive=True)
    assert not allowed.aborted and allowed.warnings and store.read("curated/visits").count() == 20
    fewer = run_ingest(spark, {"visits": spark.createDataFrame([visit(1)], VISIT)}, store, "r4", 4, "key")
    assert fewer.aborted and "dropped 95.0%" in fewer.failures[0]


def test_bad_schema_blocks_everything(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    extra = collections(spark, GOOD).withColumn("surprise_col", F.lit(1))
    report = run_ingest(spark, {"collections": extra, "visits": spark.createDataFrame([visit(1)], VISIT)}, store, "r1", 1, "key")
    assert report.aborted and store.current() == {}


def test_csv_and_cases(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    write_csv(frame.coalesce(1), str(tmp_path / "csv"))
    (part,) = [p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv"]
    assert part.read_text().splitlines() == ["a,b", "1,2", "3,4"]
    assert read_csv(spark, str(tmp_path / "csv"), "a int, b int").count() == 2
    (tmp_path / "cases.jsonl").write_text('{"id": "1", "query": "q", "expect_blocked": true, "expect_citation": false}\n')
    assert read_cases(spark, str(tmp_path / "cases.jsonl")).first().expect_blocked is True


def test_stream_ingest_runs_per_drop(spark, tmp_path):
    from ledgerwind.streaming.ingest import ingest_stream

    store = SnapshotStore(spark, str(tmp_path / "store"))
    spark.createDataFrame([visit(i) for i in range(5)], VISIT).coalesce(1).write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(VISIT).parquet(str(tmp_path / "feed"))
    ingest_stream(spark, feed, "visits", store, "key").awaitTermination(120)
    assert store.read("curated/visits").count() == 5


def test_stream_keeps_every_batch(spark, tmp_path):
    from ledgerwind.streaming.ingest import ingest_stream

    store = SnapshotStore(spark, str(tmp_path / "store"))
    run_ingest(spark, {"visits": spark.createDataFrame([visit(100), visit(0, facility_id="old")], VISIT)}, store, "night", 7, "key")
    drops = [[visit(i) for i in range(20)], [visit(20 + i) for i in range(3)], [visit(30, paid_amount="-5")], [visit(1, facility_id="newer")]]
    feed = spark.readStream.schema(VISIT).option("recursiveFileLookup", True)
    for k, rows in enumerate(drops):
        spark.createDataFrame(rows, VISIT).coalesce(1).write.parquet(str(tmp_path / f"feed/{k}"))
        ingest_stream(spark, feed.parquet(str(tmp_path / "feed")), "visits", store, "key").awaitTermination(120)
    rows = {r.visit_id: r.facility_id for r in store.read("curated/visits").collect()}
    assert len(rows) == store.read("curated/visits").count() == 24
    assert rows["v1"] == "newer" and rows["v0"] == "f" and "v100" in rows and "v30" not in rows
    assert store.read("quarantine/visits").count() == 1
    again = [visit(i) for i in range(30)]
    report = run_ingest(spark, {"visits": spark.createDataFrame(again, VISIT)}, store, "later", store.next_sequence(), "key")
    assert not report.aborted and store.read("curated/visits").count() == 30


def test_stream_with_a_new_checkpoint_skips_nothing(spark, tmp_path):
    from ledgerwind.streaming.ingest import ingest_stream

    store = SnapshotStore(spark, str(tmp_path / "store"))
    for k in range(2):
        spark.createDataFrame([visit(10 * k + i) for i in range(3)], VISIT).coalesce(1).write.parquet(str(tmp_path / f"feed{k}"))
        feed = spark.readStream.schema(VISIT).parquet(str(tmp_path / f"feed{k}"))
        ingest_stream(spark, feed, "visits", store, "key").awaitTermination(120)
        (tmp_path / "store/_stream").rename(tmp_path / f"gone{k}")
    ids = {r.visit_id for r in store.read("curated/visits").collect()}
    assert len(ids) == 6


def test_rules_see_replaced_rows_and_samples_come_in_order(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    rows = [visit(1, visit_id="v", paid_amount="-5"), visit(2, visit_id="v"), visit(3, paid_amount="x"), visit(4, billed_amount="y"), visit(5, paid_amount="z")]
    report = run_ingest(spark, {"visits": spark.createDataFrame(rows, VISIT)}, store, "r1", 1, "key")
    assert report.aborted and report.failures == ["[visits.paid_amount] contains negative values"]
    checked = quality.validate(spark.createDataFrame(rows, VISIT), "visits")
    want = [r.message for r in quality.error_samples(checked, "visits", "_ord").orderBy("sample").collect()]
    assert report.validation_errors["visits"] == want and len(want) == 2


def test_aborted_run_with_a_used_id_changes_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    run_ingest(spark, {"visits": spark.createDataFrame([visit(i) for i in range(10)], VISIT)}, store, "r1", 1, "key")
    report = run_ingest(spark, {"visits": spark.createDataFrame([visit(1)], VISIT)}, store, "r1", 1, "key")
    assert report.aborted and store.read("curated/visits").count() == 10 and store.read("raw/visits").count() == 10
