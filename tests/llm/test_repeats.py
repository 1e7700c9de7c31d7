import hashlib
import random

import numpy as np
import pytest

from ledgerwind.llm import repeats

from .conftest import CLASHES, prose


def passage(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice("abcdefghij klmnop éü") for _ in range(n))


def corpus():
    shared, short = passage(1, 700), passage(2, 199).encode()[:199].decode("utf-8", "ignore")
    rows = [(i, passage(10 + i, 300) + shared[i * 7 : 700 - i * 11] + passage(40 + i, 250)) for i in range(20)]
    rows += [(30, prose(3, 200)), (31, prose(3, 200)), (31, prose(3, 200)), (32, prose(3, 200)[:600] + "!" + prose(3, 200)[600:])]
    rows += [(40, short + passage(80, 100)), (41, short + passage(81, 100)), (42, "ab" * 400), (43, "x" * 199), (44, "x" * 199), (45, "y" * 201), (46, None), (47, "")]
    rows += [(None, passage(90, 500)), (48, passage(90, 500)), (49, passage(91, 150) + shared[100:301] + passage(92, 60)), (50, passage(93, 900) + passage(93, 900)[50:300])]
    return rows


def brute(rows):
    seen, out = {}, []
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for p in range(len(raw) - 199):
            seen[raw[p : p + 200]] = seen.get(raw[p : p + 200], 0) + 1
    for (doc, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - 199):
            if seen[raw[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [1 << 20, 257])
def test_equals_brute_force(docs, monkeypatch, segment):
    if segment < 1000:  # many cuts inside each text; the workers get the value by import
        at, first, end = repeats.anchors(np.frombuffer(corpus()[0][1].encode(), dtype=np.uint8))
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        for one, two in zip((at, first, end), repeats.anchors(np.frombuffer(corpus()[0][1].encode(), dtype=np.uint8))):
            assert (one == two).all()
        return
    frame = docs(corpus(), **CLASHES)
    assert sorted(map(tuple, repeats.removal_report(frame).collect()), key=str) == brute(corpus())


def test_every_string_has_one_anchor_and_equal_strings_the_same_offset():
    raw = np.frombuffer((passage(1, 900) + passage(2, 100) + passage(1, 900)[200:700]).encode(), dtype=np.uint8)
    at, first, end = repeats.anchors(raw)
    named = np.concatenate([np.arange(a, b) for a, b in zip(first, end)])
    assert (named == np.arange(len(raw) - 199)).all()
    offset = {}
    for a, b, c in zip(at, first, end):
        for p in range(b, c):
            assert 0 <= a - p <= repeats.REACH
            assert offset.setdefault(raw[p : p + 200].tobytes(), a - p) == a - p


def test_fingerprints_do_not_depend_on_place_or_segment():
    raw = np.frombuffer(random.Random(1).randbytes(5000) * 2, dtype=np.uint8)
    one = repeats.fingerprints(raw, np.arange(0, 4000), 200)
    assert (one == repeats.fingerprints(raw, np.arange(5000, 9000), 200)).all() and len(set(one.tolist())) == 4000


def test_long_text_and_empty_table(docs):
    text = passage(7, 1_300_000)
    rows = [(1, text), (2, text[900_000:1_200_000])]
    got = {r.doc_id: r for r in repeats.removal_report(docs(rows)).collect()}
    assert got[2].n_removed == got[2].n_bytes == got[1].n_removed and got[1].n_spans == 1
    assert repeats.removal_report(docs([])).collect() == []
