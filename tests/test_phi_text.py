import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from ledgerwind.functions import phi, text


def column(spark, values, build):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in frame.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("key", ["k", "a much longer key " * 8])
def test_token_is_an_hmac(spark, key):
    got = column(spark, ["123-45-6789", "123-45-6789", "Zoë"], lambda v: phi.tokenize(v, key))
    want = "tok_" + hmac.new(key.encode(), b"123-45-6789", hashlib.sha256).hexdigest()[:16]
    assert got[0] == got[1] == want and "123-45" not in got[0]
    assert got[2] == "tok_" + hmac.new(key.encode(), "Zoë".encode(), hashlib.sha256).hexdigest()[:16]


def test_mask_keeps_null_and_empty(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("b", "", "y")], "lop_id string, patient_name string, patient_dob string")
    a, b = phi.mask(rows, "lop", "k").orderBy("lop_id").collect()
    assert a.patient_name is None and b.patient_name == "" and a.patient_dob.startswith("tok_")


def test_scan_input(spark):
    asked = [
        "show 123-45-6789", "patient name lookup", "the DOB please", "patient's ssn of x", "what is patient John Doe's balance",
        "how is Attorney Johnson performing", "Round Rock collections trend", "total collected by facility",
    ]
    got = column(spark, asked, phi.scan_input)
    assert got == ["SSN", "PATIENT_NAME_REQUEST", "DOB_REF", "PATIENT_FIELD_REQUEST", "PERSON_ENTITY_DETECTED", None, None, None]


def test_word_boundaries_are_unicode(spark):
    assert column(spark, ["éJohn Doet", "John Doeé x", "(John Doet)"], phi.scan_input) == [None, None, "PERSON_ENTITY_DETECTED"]


def test_redact(spark):
    rows = spark.createDataFrame(
        [(0, "Patient Jane Roe owes money"), (1, "Attorney Garcia leads collections"), (2, "Mary Major met Mary Major, 123-45-6789")], "i int, t string"
    )
    a, b, c = phi.scan_output(rows, "t").orderBy("i").collect()
    assert a.phi_detected and "Jane" not in a.redacted_text
    assert not b.phi_detected and b.redacted_text == b.t
    assert c.redacted_text == "[REDACTED] met [REDACTED], [REDACTED]" and c.phi_matches == ["SSN", "Mary Major", "Mary Major"]


def test_mutation_requests(spark):
    asked = ["delete from collections where 1=1", "DROP TABLE collections", "update visits set x", "show drops in table"]
    assert column(spark, asked, text.asks_to_mutate) == [True, True, True, False]


def test_sql_cleanup(spark):
    logged = ["```sql\nSELECT 1;\n```", "```\nSELECT 1\n```", "SQL: SELECT 1;;", "  SELECT 1 ;", "sql:SELECT 1"]
    assert column(spark, logged, text.clean_sql_text) == ["SELECT 1", "SELECT 1", "SELECT 1", "SELECT 1 ", "SELECT 1"]


def test_formats(spark):
    frame = spark.createDataFrame([(1234.5, 0.12345)], "v double, p double")
    row = frame.select(
        text.dollars(F.col("v")).alias("d"), text.percent(F.col("p")).alias("p"), text.percent(-F.col("p"), 1, True).alias("m"),
        text.percent(F.col("p"), 0, True).alias("s"), text.whole_plain(F.col("v")).alias("w"),
    ).first()
    assert (row.d, row.p, row.m, row.s, row.w) == ("$1,234", "12.3%", "-12.3%", "+12%", "1234")
    assert column(spark, ["round_rock", "o'neil LLC"], text.title_case) == ["Round_Rock", "O'Neil Llc"]
    assert column(spark, [" Round_Rock,  TX "], text.normalise_entity) == ["round rock tx"]


def test_embedding_equals_python(spark):
    body = "The cat  and the dog\nand\tthe End"
    frame = spark.createDataFrame([("d", body), ("e", " ")], "k string, t string")
    (row,) = text.embed_text(frame, "k", "t").collect()
    want = [0.0] * 256
    for word in body.lower().split():
        want[int(hashlib.md5(word.encode()).hexdigest(), 16) % 256] += 1
    norm = sum(w * w for w in want) ** 0.5
    assert row.vector == pytest.approx([w / norm for w in want])


def test_key_is_in_no_plan(spark, capsys):
    key = "a-secret-key-of-some-length"
    frame = spark.createDataFrame([("x",)], "v string").select(phi.tokenize(F.col("v"), key).alias("t"))
    frame.collect()
    frame.explain("extended")
    frame.explain("formatted")
    shown = capsys.readouterr().out.lower()
    for pad in (0x36, 0x5C):
        raw = bytes(b ^ pad for b in key.encode())
        assert raw.hex() not in shown and raw.decode("latin-1").lower() not in shown
    assert key not in shown
