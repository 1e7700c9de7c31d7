import numpy as np
import pytest
import xxhash

from ledgerwind.llm import jaccard, simhash
from ledgerwind.llm.components import components

from .conftest import CLASHES, prose


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


ROWS = [
    (1, prose(1, 300)), (2, prose(1, 300)), (3, prose(1, 300) + " end"), (4, prose(2, 60)), (5, None), (6, ""), (7, " \t\n"), (8, "One"),
    (9, "one"), (10, "ÀB cd ef"), (10, "ÀB cd ef"), (None, prose(1, 300)), (None, "alone and nameless"), (11, prose(3, 30000)),
]


def test_equals_brute_force(docs):
    rows = simhash.near_duplicates(docs(ROWS, **CLASHES)).collect()
    prints = [plain_fingerprint(t) for _, t in ROWS]
    groups = plain_groups(prints)
    want = []
    for (doc, _), value, group in zip(ROWS, prints, groups):
        ids = [d for (d, _), g in zip(ROWS, groups) if g == group and d is not None]
        want.append((doc, format(value, "016x"), min(ids, default=None)))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_no_close_pair_escapes_its_anchors():
    draw = np.random.default_rng(5)
    ones = draw.integers(0, 2**64, 500, dtype=np.uint64)
    twos = ones.copy()
    for i in range(500):
        for bit in draw.choice(64, i % 4, replace=False):
            twos[i] ^= np.uint64(1) << np.uint64(bit)
    one, two = simhash.anchor_rows(ones), simhash.anchor_rows(twos)
    for i in range(500):
        own = set(one[0][(one[2] == ones[i]) & (one[1] == 1)].tolist())
        assert own & set(two[0][two[2] == twos[i]].tolist())
    assert len(one[0]) <= 34 * 500


def test_crowded_anchor_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "OWN_ROWS", 8)
    draw = np.random.default_rng(1)
    values = {int(v) << 32 for v in draw.integers(0, 2**31, 40)}
    values |= {v ^ 1 << 33 for v in list(values)[:20]} | {v ^ 7 for v in list(values)[:5]}
    values = sorted(values)
    frame = spark.createDataFrame([(v if v < 2**63 else v - 2**64,) for v in values], "fp long")
    got = {r.node: r.root for r in components(simhash.fingerprint_links(frame)).collect()}
    groups = plain_groups(values)
    signed = [v if v < 2**63 else v - 2**64 for v in values]
    for i, v in enumerate(signed):
        for j, w in enumerate(signed):
            assert (got.get(v, v) == got.get(w, w)) == (groups[i] == groups[j])


def test_one_of_each_group_stays(docs):
    frame = docs(ROWS, **CLASHES)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 1), (False, 4), (False, 5), (False, 8), (False, 10), (False, 11), (True, 0)
    ]


@pytest.mark.parametrize("operator", [simhash.near_duplicates, simhash.keep_one])
def test_empty_table(docs, operator):
    assert operator(docs([])).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 300)} == {7} and 5 not in got


def test_near_copies_meet_through_their_anchors(docs, monkeypatch):
    # no bands: what is left are the groups of linked fingerprints, counted exactly
    monkeypatch.setattr(jaccard, "bands", lambda hashes: [])
    rows = [(1, prose(1, 300)), (2, prose(1, 300) + " end"), (3, prose(4, 300)), (4, prose(4, 300) + " end one"), (5, prose(2, 60))]
    near = [(plain_fingerprint(rows[i][1]) ^ plain_fingerprint(rows[i + 1][1])).bit_count() <= 3 for i in (0, 2)]
    assert near == [True, True]
    assert sorted(r.doc_id for r in simhash.keep_one(docs(rows, **CLASHES)).collect()) == [1, 3, 5]


def test_linked_fingerprints_of_unlike_texts_stay(docs, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint", lambda text, width=3: 7)
    rows = [(1, prose(1, 300)), (2, prose(1, 300) + " end"), (3, prose(4, 300)), (4, prose(5, 300))]
    assert sorted(r.doc_id for r in simhash.keep_one(docs(rows)).collect()) == [1, 3, 4]


def test_texts_are_read_by_one_python_pass(docs, monkeypatch):
    frames, store = {}, simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda frame, name: frames.setdefault(name, frame) and store(frame, name))
    monkeypatch.setattr(jaccard, "TEXTS_AT_ONCE", 4)
    kept = simhash.keep_one(docs(ROWS, **CLASHES)).collect()
    plan = frames["shingled"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    # two passes one after the other, on whole batches
    rows = {r.text: (r["key"], r["buckets"], r["print"]) for r in simhash.with_sets_and_fingerprints(docs(ROWS), "text", 5, "key", "buckets", "print").collect()}
    assert rows == {t: (jaccard.set_key(h), jaccard.bands(h), simhash.fingerprint(t)) for t, h in ((t, jaccard.shingles(t)) for _, t in ROWS)}
    assert len(kept) == len({(r.doc_id, r.text) for r in kept})
