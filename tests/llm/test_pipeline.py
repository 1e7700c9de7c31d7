import os

import pytest
import sentencepiece

import corpus_pipeline
from ledgerwind.llm import quality, secrets
from ledgerwind.llm.vocabularies import FOLDER, PIECE_MODEL

from .conftest import prose
from .test_jaccard import plain_kept

HEX40 = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def rows():
    out = [(i, prose(i, 60 + i), f"s{i % 3}" if i % 7 else None) for i in range(40)]
    out += [(100, prose(1, 61), "s1"), (101, prose(1, 61), "s2"), (102, prose(2, 62) + " end", "s1")]  # copies
    out += [(200, "too short", "s1"), (201, None, "s1"), (202, "### " * 80, "s2"), (203, "a b c " * 60, "s2")]  # junk
    return out + [(300, prose(77, 70) + f' token = "{HEX40}" ' + prose(78, 20), "s0"), (301, prose(80, 900), "s0"), (None, prose(81, 90), "s0")]


@pytest.fixture
def folder(docs, tmp_path):
    docs(rows(), root=1, fp=2, spans=3, row=4, pieces=5).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_every_stage_takes_effect(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "mix_sources", "sentence_pieces"]
    out = corpus_pipeline.run(spark, folder).collect()
    good = [r for r in rows() if quality.first_rejection(quality.Facts(r[1]), quality.BASE_RULES + quality.MORE_RULES) is None]
    numbers = {10**9 if doc is None else doc: (doc, text) for doc, text, _ in good}
    kept = [numbers[n] for n in plain_kept([(n, text) for n, (_, text) in numbers.items()])]
    texts = {}
    for doc, text in kept:
        base, _ = secrets.scan(text)
        texts[doc] = secrets.masked(text, [dict(zip(("kind", "start", "end"), s)) for s in base], "[SECRET]") if base else text
    assert 201 not in texts and 100 not in texts and 102 not in texts and HEX40 not in texts[300]
    library = sentencepiece.SentencePieceProcessor(model_file=os.path.join(FOLDER, PIECE_MODEL))
    copies = {}
    for r in out:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id] and r.n_chars == len(r.text) and r.round_trip and r.pieces == library.encode(r.text)
    assert max(copies.values()) <= 2 and set(copies) <= set(texts)
    words = {d: len(t.split()) for d, t in texts.items()}
    assert sum(words[d] * n for d, n in copies.items()) == pytest.approx(1.5 * sum(words.values()), rel=0.03)


def test_stages_return_the_columns_of_documents_and_take_empty_tables(spark, docs):
    empty = docs([])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, empty, "")
        assert got.columns == empty.columns and got.collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").collect() == []
