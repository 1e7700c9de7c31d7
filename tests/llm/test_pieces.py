import os

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from ledgerwind.llm import pieces
from ledgerwind.llm.vocabularies import FOLDER, PIECE_MODEL, default_model

from .conftest import CLASHES, prose

PATH = os.path.join(FOLDER, PIECE_MODEL)
TEXTS = [
    None, "", " ", "  ", "   a  b ", "Hello  world", "\n\t x\r\n", "ünïcödé 漢字 😀   x", "aaaaaaaa" * 40, "supercalifragilistic" * 9, "1234567890" * 30,
    "don't stop!!! ... (really?) http://example.com/a_b-c?d=e&f=g", "▁▁ literal", "<0x0A> <s> </s> <unk>", prose(1, 300), "\x00\x7f", "x" * 3000 + " " + "é" * 300,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(docs, library):
    frame = docs([(i, t) for i, t in enumerate(TEXTS)] + [(14, TEXTS[14]), (None, "no id")], **CLASHES, pieces=3)
    out = pieces.encode(frame, default_model())
    assert set(frame.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.pieces == library.encode(r.text or ""), r.text
        assert r.round_trip == (library.decode(r.pieces) == (r.text or "")) or "▁" in r.text
    texts = {r.doc_id: r.decoded for r in pieces.decode(out, default_model()).collect()}
    for i, text in enumerate(TEXTS):
        assert texts[i] == library.decode(library.encode(text or ""))


def test_viterbi_fold_equals_the_library_for_a_unigram_model(spark, tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = pieces.UNIGRAM
    for k, piece in enumerate(proto.pieces):
        piece.score = -3.0 - k % 977 / 100.0 - len(piece.piece) / 50.0 if piece.type == pieces.NORMAL else piece.score
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    model, library = pieces.Model.load(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["the quick brown fox", "internationalisation", "unbelievable", "aaaaaaa", "x" * 90, "Ünder"]
    units = sorted({u for t in texts for u in model.units.findall(model.escaped(t))})
    got = {r.unit: model.resolved(r.ids) for r in pieces.encoded_units(spark.createDataFrame([(u,) for u in units], "unit string"), model).collect()}
    score = lambda ids: sum(proto.pieces[k].score for k in ids)
    for text in texts:
        mine = [k for u in model.units.findall(model.escaped(text)) for k in got[u]]
        want = library.encode(text)
        assert mine == want or (model.decoded(mine) == text and abs(score(mine) - score(want)) < 1e-4)


def test_fold_equals_heap(spark):
    model = default_model()
    units = sorted({u for t in TEXTS for u in model.units.findall(model.escaped(t or "")) if len(u) <= pieces.LONGEST})
    rows = pieces.encoded_units(spark.createDataFrame([(u,) for u in units], "unit string"), model).collect()
    assert len(rows) == len(units) and all(model.resolved(r.ids) == model.merged(r.unit) for r in rows)


def test_no_piece_crosses_a_unit():
    model = default_model()
    for piece in model.ids:
        assert len(model.units.findall(piece)) == 1, piece
    for text in TEXTS:
        assert "".join(model.units.findall(model.escaped(text or ""))) == model.escaped(text or "")


def test_empty_table(docs):
    out = pieces.encode(docs([]), default_model())
    assert out.collect() == []
    assert pieces.decode(out, default_model(), column="text").columns == [*(c for c in out.columns if c != "text"), "text"]
    assert pieces.decode(out, default_model()).collect() == []


def test_many_units_over_many_blocks(spark, docs, library, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(pieces, "REPLY_UNITS", 500)
    texts = [prose(i, 120) + (" " + "z" * (60 + i) if i % 3 == 0 else "") for i in range(60)]
    rows = pieces.encode(docs(list(enumerate(texts))).repartition(3), default_model()).collect()
    assert sorted(r.doc_id for r in rows) == list(range(60))
    assert all(r.pieces == library.encode(r.text) and r.round_trip for r in rows)


def test_one_pass_is_left_where_a_better_piece_holds_a_worse_one():
    ranks = {"bc": 10, "ab": 20, "cd": 30, "abcd": 300, "abc": 500}
    model = pieces.Model(pieces.BPE, tuple((p, -float(r), pieces.NORMAL) for p, r in ranks.items()), False)
    assert model.contained == {"abc"}


def test_late_better_piece_is_merged_before_later_ones(spark):
    ranks = {"bc": 10, "ab": 20, "cd": 30, "abcd": 300, "abc": 500, "de": 600}
    chars = [(c, -9000.0 - k, pieces.NORMAL) for k, c in enumerate("abcde")]
    model = pieces.Model(pieces.BPE, (*((p, -float(r), pieces.NORMAL) for p, r in ranks.items()), *chars), False)
    units = ["abcd", "abcde", "abc", "cde", "e", "abab", "bcabcd"]
    got = {r.unit: model.resolved(r.ids) for r in pieces.encoded_units(spark.createDataFrame([(u,) for u in units], "unit string"), model).collect()}
    assert got == {u: model.merged(u) for u in units}
    assert got["abcde"] == [model.ids["abcd"], model.ids["e"]]


def test_a_block_is_held_compressed_and_the_piece_table_needs_no_python_workers(spark):
    import pyarrow as pa

    text = " ".join(str(k) for k in range(20_000))
    base, grown = pa.total_allocated_bytes(), []

    def batches():
        for k in range(256):
            grown.append(pa.total_allocated_bytes() - base)
            yield pa.record_batch({"doc_id": pa.array([k]), "text": pa.array([text])})

    blocks = [b.column("packed")[0] for b in pieces._pack("text")(batches())]
    assert max(grown) < pieces.BLOCK_BYTES // 2
    rows = [r for b in blocks for part in pieces._unpacked(b) for r in part.to_pylist()]
    assert rows == [{"doc_id": k, "text": text} for k in range(256)]
    model = pieces.Model(pieces.BPE, (("<unk>", 0.0, pieces.UNKNOWN), ("a", -1.0, pieces.NORMAL), ("b", -2.0, pieces.NORMAL), ("ab", -0.5, pieces.NORMAL)))
    table = pieces.piece_table(spark, model)
    assert "ExistingRDD" not in table._jdf.queryExecution().toString()
    assert sorted(map(tuple, table.collect())) == [("a", 1, 1, -1.0, 0), ("ab", 3, 0, -0.5, 0), ("b", 2, 2, -2.0, 0)]
    assert table.schema.simpleString() == "struct<piece:string,id:int,rank:int,score:double,inside:int>"
