import random

import numpy as np
import pytest

from ledgerwind.llm import jaccard, simhash

from .conftest import prose


def plain_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The least id of every component of pairs with similarity 0.8 or more."""
    sets, group = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if group[i] != group[j] and 5 * both >= 4 * union:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted({min(d for (d, _), g in zip(rows, group) if g == name) for name in group})


def edited(text, seed, changes):
    draw, words = random.Random(seed), text.split()
    for at in draw.sample(range(len(words)), changes):
        words[at] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


def rows():
    """Copies with 0 to 9 changed words in texts of 60 to 400, and unrelated texts."""
    out = []
    for k in range(40):
        text = prose(1000 + k, random.Random(k).choice([60, 120, 250, 400]))
        out += [(10 * k, text), *((10 * k + j, edited(text, 100 * k + j, random.Random(k + j).randrange(10))) for j in range(1, 4))]
    return out


def test_near_copies_that_differ_in_many_bits_go(docs):
    base = prose(5, 200)
    pairs = [(i, edited(base, i, 4)) for i in range(1, 30)]
    far = [(i, t) for i, t in pairs if (simhash.fingerprint(base) ^ simhash.fingerprint(t)).bit_count() > 3]
    both = [(i, t) for i, t in far if jaccard.alike(jaccard.shingles(base), jaccard.shingles(t))]
    assert both
    assert [r.doc_id for r in simhash.keep_one(docs([(0, base), *both])).collect()] == [0]


def test_keeps_what_brute_force_keeps(docs):
    table = rows()
    assert sorted(r.doc_id for r in simhash.keep_one(docs(table)).collect()) == plain_kept(table)


@pytest.mark.parametrize("block", [1024, 5])
def test_a_group_without_a_common_hub_is_joined_in_blocks(spark, docs, monkeypatch, block):
    # one bucket for all: the candidates are then all pairs
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard, "BANDS", 1)
    monkeypatch.setattr(jaccard, "bands", lambda hashes: [7] if len(hashes) else [])
    table = rows()[:24]
    marked = [(jaccard.set_key(jaccard.shingles(t)), [7], t, i) for i, t in table]
    frame = spark.createDataFrame(marked, "k string, b array<long>, text string, row long")
    got = {r.s: r.root for r in jaccard.set_groups(frame, "k", "b", "text", "row").collect()}
    least = {}
    for (i, _), (key, *_) in zip(table, marked):
        least[got[key]] = min(i, least.get(got[key], i))
    assert sorted(least.values()) == plain_kept(table)


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_bands_meet_at_the_threshold(share):
    draw, missed = np.random.default_rng(3), 0
    for _ in range(300):
        n = int(draw.integers(20, 400))
        both = draw.integers(0, 1 << 64, n, dtype=np.uint64)
        more = draw.integers(0, 1 << 64, int(n / share) - n, dtype=np.uint64)
        missed += not set(jaccard.bands(both)) & set(jaccard.bands(np.concatenate((both, more))))
    assert missed == 0


def test_one_template_takes_a_fixed_number_of_tables(docs, monkeypatch):
    tables = []
    real = jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda f, name: tables.append(name) or real(f, name))
    shared = prose(9, 150)
    template = [(k, f"{shared} {prose(3000 + k, 50)}") for k in range(2000)]
    kept = [r.doc_id for r in simhash.keep_one(docs([*template, (5000, template[7][1]), (5001, edited(template[8][1], 1, 2))])).collect()]
    assert sorted(kept) == list(range(2000))
    assert len(tables) <= 10


def test_set_keys_have_128_bits():
    assert len(jaccard.set_key(jaccard.shingles("a b c d e f"))) == 32 and jaccard.set_key(jaccard.shingles("")) == "0" * 32
