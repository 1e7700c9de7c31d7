import hashlib
import math
import random

import pytest

from ledgerwind.llm import codes

from .conftest import CLASHES


def brute(rows, parts, entries, rounds):
    """Lloyd with Python integers, one row after the other."""
    whole = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v in whole if v and len(v) % parts == 0]
    d = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    ints = [(i, [math.floor(codes.SCALE * x) for x in v]) for i, v in whole if len(v) == d]
    w = d // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v in ints]
    seeds = sorted(range(len(ints)), key=lambda k: (ints[k][0] is None, ints[k][0] or 0, ints[k][1]))[:entries]
    books = [[cut[k][p] for k in seeds] for p in range(parts)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[near(x[p], p)[1] for p in range(parts)] for x in cut]
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            for k in range(len(seeds)):
                mine = [x[p] for x, a in zip(cut, at) if a[p] == k]
                if mine:
                    new[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
        books = new
    out = [(i, [near(x[p], p)[1] for p in range(parts)], sum(near(x[p], p)[0] for p in range(parts))) for (i, _), x in zip(ints, cut)]
    out = [(i, c, e if e < 2**63 else None) for i, c, e in out]
    return out + [(i, None, None) for i, v in whole if len(v) != d], books


def rows(wide=False):
    draw = random.Random(5)
    centres = [[draw.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    out = [(k, [float(x + draw.gauss(0, 0.2)) for x in draw.choice(centres)]) for k in range(150)]
    out += [(k, out[3][1]) for k in range(150, 200)]  # a hot entry
    out += [(7, out[7][1]), (7, out[9][1]), (None, out[1][1]), (300, None), (301, []), (302, [1.0] * 7), (303, [0.0] * 4)]
    out += [(304, [float("nan")] * 8), (305, [None] + [0.0] * 7), (306, [float("inf")] * 8)]
    if wide:
        out += [(-1, [1e30] * 8), (307, [1e30] * 7 + [-2e30]), (308, [3e5] * 8)]
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_equals_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(codes, "SALT_ROWS", 16)
    monkeypatch.setattr(codes, "CHUNK", 7)
    data = rows(wide)
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    for name in ("code", "r", "v", "position", "entry", "part", *CLASHES):
        frame = frame.withColumn(name, codes.F.lit(1))
    got, books = codes.compress(frame, parts=4, entries=12, rounds=3)
    want, want_books = brute(data, 4, 12, 3)
    assert books.entries == want_books
    found = [(x.vec_id, x.code, x.error) for x in got.select("vec_id", "code", "error").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert set(CLASHES) <= set(got.columns)


def test_report_sums_labels_and_names_the_codebooks(spark):
    data = [(i, v, [None, 1, 2][n % 3]) for n, (i, v) in enumerate(rows()) if v is None or len(v) == 8]
    got = codes.code_report(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()
    floats = [(i, v and [None if x is None else spark_float(x) for x in v]) for i, v, _ in data]
    want, books = brute(floats, 4, 256, 4)
    assert sorted((r.vec_id, r.code, r.error) for r in got if r.vec_id is not None) == sorted(
        (i, "".join(f"{k:02x}" for k in c), e) for i, c, e in want if i is not None
    )
    flat = ",".join(str(x) for b in books for e in b for x in e)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(flat.encode()).hexdigest()}
    label = {i: n for i, _, n in data}
    totals = {}
    for r in got:
        if r.vec_id not in (7, None):
            totals.setdefault(label[r.vec_id], set()).add(r.label_error)
    assert all(len(t) == 1 for t in totals.values()) and len(totals) == 3


def spark_float(x):
    import numpy as np

    return float(np.float32(x))


def test_only_movers_are_shuffled(spark, monkeypatch):
    moved = []
    real = codes._to_owners
    monkeypatch.setattr(codes, "_to_owners", lambda m, s, name: moved.append(out := real(m, s, name)) or out)
    codes.compress(spark.createDataFrame(rows(), "vec_id long, embedding array<double>"), entries=12)
    first, *later = [f.count() for f in moved]
    assert first == 4 * 203 and len(later) == 3 and sum(later) < first and later[-1] < later[0]


def test_empty_table(spark):
    got, books = codes.compress(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>"))
    assert got.collect() == [] and books.entries == [[], [], [], []]
    assert codes.code_report(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
