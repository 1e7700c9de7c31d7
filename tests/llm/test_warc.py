import hashlib
from base64 import b32encode

import pytest

from ledgerwind.llm import warc

from .conftest import CLASHES, prose

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/\r\nX: y", "<p>same</p>"), (3, None, None), (4, "http://d/", ""), (5, "u", FAKE * 3 + "tail"),
    (6, "u", "WARC/1.0\r\n"), (7, "u", "x" + FAKE), (8, "ü", "ünï" + "\r\n\r\nWARC/1.0\r\n\r\n"), (None, "n", "nameless"), (None, "n", "<p>same</p>"),
    (9, "u", FAKE[10:]), (10, "long", prose(1, 20000)), (11, "r", "twice"), (11, "r", "twice"),
] + [(100 + i, f"http://h/{i}", prose(i % 50, 30)) for i in range(300)]


def want(pages):
    best = {}
    for page, _, html in pages:
        if page is not None:
            best[html or ""] = max(page, best.get(html or "", page))
    out = []
    for page, _, html in pages:
        raw, first = (html or "").encode(), best.get(html or "")
        revisit = first is not None and page != first
        out.append((page, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("compression", "split"), [("gzip", "128m"), ("none", "8k"), ("none", "999")])
def test_round_trip_with_magic_inside_payloads(spark, compression, split):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    for name, value in CLASHES.items():
        frame = frame.withColumn(name, warc.F.lit(value))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = warc.round_trip(frame, compression).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted(map(tuple, got), key=str) == want(PAGES)


def test_urls_come_back_and_broken_tails_end_the_chain(spark, tmp_path):
    frame = spark.createDataFrame(PAGES[:5], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(frame, str(tmp_path / "a"), compression="none")
    urls = {r.page_id: r.url for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert urls[1] == "http://a/" and urls[2] == "http://b/%0D%0AX: y" and urls[3] is None
    (part,) = (tmp_path / "a").glob("part-*")
    raw = part.read_bytes()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "cut.warc").write_bytes(raw[: len(raw) // 2])
    (tmp_path / "b" / "junk.warc").write_bytes(b"junk" + raw)
    cut = {r.page_id for r in warc.read_archives(spark, str(tmp_path / "b")).collect()}
    assert cut < set(urls) and 999 not in cut


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
