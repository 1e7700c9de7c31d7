import datetime as dt
import hashlib
import json
import random
from collections import deque

from pyspark.sql import functions as F

from ledgerwind.operators import audit
from ledgerwind.operators.ratelimit import replay
from ledgerwind.streaming.ratelimit import limit_stream

FIELDS = ["service", "action", "note"]


def log_rows(spark, n, chains=("s",)):
    rows = [(c, i, "chat", f"åction {i}", None if i % 2 else "n") for c in chains for i in range(n)]
    return spark.createDataFrame(rows, "session string, ord bigint, service string, action string, note string")


def test_chain_equals_python(spark):
    got = audit.build_chain(log_rows(spark, 3), "session", "ord", FIELDS).orderBy("ord").collect()
    previous = ""
    for r in got:
        text = json.dumps({k: r[k] for k in FIELDS}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.prev_hash == previous
        previous = hashlib.sha256((previous + text).encode()).hexdigest()
        assert r.row_hash == previous


def test_tampering_is_located(spark):
    chained = audit.build_chain(log_rows(spark, 3), "session", "ord", FIELDS)
    clean = audit.verify_chain(chained, "session", "ord", FIELDS).first()
    assert (clean.is_intact, clean.first_broken) == (True, -1)
    edited = chained.withColumn("action", F.when(F.col("ord") == 1, "x").otherwise(F.col("action")))
    broken = audit.verify_chain(edited, "session", "ord", FIELDS).first()
    assert (broken.is_intact, broken.first_broken) == (False, 1)
    deleted = audit.verify_chain(chained.filter("ord <> 1"), "session", "ord", FIELDS).first()
    assert deleted.first_broken == 2


def test_long_chains_are_unbroken(spark):
    chained = audit.build_chain(log_rows(spark, 2500, ("a", "b")), "session", "ord", FIELDS).persist()
    assert audit.verify_chain(chained, "session", "ord", FIELDS).filter("is_intact").count() == 2
    for low, high in ((990, 999), (1000, 1999)):
        less = chained.filter(f"session = 'a' or ord not between {low} and {high}")
        rows = {r.session: r.first_broken for r in audit.verify_chain(less, "session", "ord", FIELDS).collect()}
        assert rows == {"a": -1, "b": high + 1}
    edited = chained.withColumn("note", F.when((F.col("ord") == 1012) & (F.col("session") == "b"), "x").otherwise(F.col("note")))
    assert [(r.session, r.ord) for r in audit.broken_rows(edited, "session", "ord", FIELDS).collect()] == [("b", 1012)]
    chained.unpersist()


def test_moved_repeated_and_cut_rows_are_found(spark):
    chained = audit.build_chain(log_rows(spark, 6), "session", "ord", FIELDS).persist()
    swapped = chained.withColumn("ord", F.when(F.col("ord") == 3, 4).when(F.col("ord") == 4, 3).otherwise(F.col("ord")))
    assert audit.verify_chain(swapped, "session", "ord", FIELDS).first().first_broken == 3
    again = chained.unionByName(chained.filter("ord = 2").withColumn("ord", F.lit(9).cast("bigint")))
    assert audit.verify_chain(again, "session", "ord", FIELDS).first().first_broken == 9
    assert audit.verify_chain(chained.filter("ord > 0"), "session", "ord", FIELDS).first().first_broken == 1
    seals = audit.chain_seals(chained, "session", "ord")
    assert audit.cut_tails(chained, seals, "session", "ord").isEmpty()
    assert audit.cut_tails(chained.filter("ord < 5"), seals, "session", "ord").count() == 1
    chained.unpersist()


def python_replay(events, limit, seconds):
    logs, verdict = {}, {}
    for event_id, user, ts in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        log = logs.setdefault(user, deque())
        while log and (ts - log[0]).total_seconds() > seconds:
            log.popleft()
        verdict[event_id] = len(log) < limit
        if verdict[event_id]:
            log.append(ts)
    return verdict


def make_events(seed, n=400, users=4):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(i, rng.randrange(users) if i % 3 else 0, start + dt.timedelta(seconds=rng.randrange(3000), milliseconds=rng.randrange(1000))) for i in range(n)]


def test_replay_equals_a_python_replay(spark):
    for seed, limit in ((1, 2), (2, 5), (3, 120)):
        events = make_events(seed)
        frame = spark.createDataFrame(events, "event_id bigint, user_id bigint, ts timestamp_ntz").repartition(5)
        got = {r.event_id: r.admitted for r in replay(frame, "user_id", "ts", "event_id", limit, 60).collect()}
        assert got == python_replay(events, limit, 60)


def test_replay_boundary_is_inclusive(spark):
    start = dt.datetime(2024, 1, 1)
    events = [(i, 1, start + dt.timedelta(seconds=s)) for i, s in enumerate((0, 60, 60.5))]
    frame = spark.createDataFrame(events, "event_id bigint, user_id bigint, ts timestamp_ntz")
    got = {r.event_id: r.admitted for r in replay(frame, "user_id", "ts", "event_id", 1, 60).collect()}
    assert got == {0: True, 1: False, 2: True}


def test_stream_equals_the_replay(spark, tmp_path):
    events = sorted(make_events(7), key=lambda e: e[2])
    schema = "event_id bigint, user_id bigint, ts timestamp_ntz"
    for part, rows in enumerate((events[:200], events[200:])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = (
        limit_stream(stream, 3, 60).writeStream.format("memory").queryName("verdicts").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    got = {r.event_id: r.admitted for r in spark.sql("select * from verdicts").collect()}
    assert got == python_replay(events, 3, 60)
