import zlib

import pytest

from ledgerwind.llm import sharding

from .conftest import CLASHES, prose

ROWS = [(i, prose(i, 3 + i * 37 % 60)) for i in range(400)] + [(None, None), (None, ""), (5, prose(5, 20)), (-3, "é" * 30), (1000, prose(1, 3000))] + [(77, "copy")] * 100


def check(rows, data, shards=16):
    assert len(rows) == len(data)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for shard in range(shards):
        mine = [r for r in rows if r.shard == shard]
        assert abs(sum(r["size"] for r in mine) - total / shards) <= largest
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        order = [r.doc_id if r.doc_id is not None else -(2**63) for r in sorted(mine, key=lambda r: r.slot)]
        assert order == sorted(order)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in data)
    assert sorted((r["size"], r.text_crc32) for r in rows) == want


def test_even_gapless_and_in_order(docs):
    rows = sharding.shards_by_bytes(docs(ROWS, **CLASHES)).collect()
    check(rows, ROWS)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_overfull_ranges_are_subdivided(docs, monkeypatch):
    monkeypatch.setattr(sharding, "DRAWS", 1)
    monkeypatch.setattr(sharding, "OVERFULL", 1.2)
    calls = []
    ranges = sharding._ranges
    monkeypatch.setattr(sharding, "_ranges", lambda rows, splitters: calls.append(len(splitters)) or ranges(rows, splitters))
    check(sharding.shards_by_bytes(docs(ROWS)).collect(), ROWS)
    assert len(calls) > 1 and calls == sorted(calls)


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    frame = docs(ROWS, **CLASHES)
    sharding.write_shards(frame, str(tmp_path / "out"), shards=4, rows_per_file=50)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and set(frame.columns) <= set(back.columns)


@pytest.mark.parametrize("data", [[], [(1, "one")]])
def test_tiny_tables(docs, data):
    assert len(sharding.shards_by_bytes(docs(data)).collect()) == len(data)
