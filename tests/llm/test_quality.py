import re

import numpy as np
import pytest

from ledgerwind.llm import quality
from ledgerwind.llm.quality import Facts

from .conftest import CLASHES, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n ", prose(1, 60), prose(1, 49), "a b c " * 40, prose(2, 60) + " ###" * 10, "\n".join([prose(3, 30)] * 2 + [prose(4, 30)]),
    "1 2 3 4 5 " * 3 + prose(5, 40), "\x85é x " + prose(6, 55), "line\n" * 60 + prose(7, 60), prose(8, 20000), "x" * 50000, "- " + prose(9, 60),
]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if len(grams) < 500 and grams.count(g) > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)
    )


@pytest.mark.parametrize("text", [t for t in TEXTS if len(t or "") < 5000])
def test_counts(text):
    f = Facts(text)
    assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == plain(text)


def test_report_over_edge_cases(docs):
    frame = docs([(i if i else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])], **CLASHES)
    rows = quality.quality_report(frame).collect()
    assert len(rows) == len(TEXTS) + 1
    by = {r.doc_id: r for r in rows}
    assert by[None].n_words == 0 and by[None].base_failed and not by[None].kept
    assert by[3].kept and not by[4].kept and by[5].base_failed and not by[6].kept and not by[6].base_failed
    assert by[11].n_words == 20000 and by[11].kept


def test_order_does_not_change_the_verdict(docs):
    rules = quality.BASE_RULES + quality.MORE_RULES
    for text in TEXTS:
        verdicts = {quality.first_rejection(Facts(text), order) is None for order in (rules, rules[::-1])}
        assert len(verdicts) == 1
    frame = docs([(i, t) for i, t in enumerate(TEXTS)], **CLASHES)
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns
    want = {i for i, t in enumerate(TEXTS) if quality.first_rejection(Facts(t), rules) is None}
    assert {r.doc_id for r in kept.collect()} == want
    named = quality.rejected_by(frame).collect()
    assert {r.doc_id for r in named if r.rejected_by is None} == want


def test_greedy_order_is_rejection_per_cost():
    rejected = np.array([[1, 1, 1, 1, 0, 0], [1, 1, 1, 0, 0, 0], [0, 0, 0, 0, 1, 0]], dtype=bool)
    assert quality.greedy_order([4.0, 1.0, 1.0], rejected) == [1, 2, 0]


def test_sample_is_bounded_and_empty_tables_work(docs):
    frame = docs([(i, prose(i, 55)) for i in range(40)])
    assert len(quality.ordered_rules(frame, quality.MORE_RULES, rows=5)) == len(quality.MORE_RULES)
    assert quality.quality_report(docs([])).collect() == [] and quality.keep_good(docs([])).collect() == []
