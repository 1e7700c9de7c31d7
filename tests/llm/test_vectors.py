import numpy as np
import pytest

from ledgerwind.llm import vectors

from .conftest import CLASHES


def rows(clusters=6, each=12, dim=16, seed=3):
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(clusters):
        centre = draw.normal(size=dim)
        for _ in range(each):
            out.append((centre + draw.normal(size=dim) * draw.choice([0.05, 0.25, 0.5])).astype(np.float32).tolist())
    out += [draw.normal(size=dim).astype(np.float32).tolist() for _ in range(60)]
    out += [out[0]] * 15 + [[2 * x for x in out[1]]]
    odd = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0], [1e-30] * dim, [1e30] * dim]
    return list(enumerate([*out, *odd])) + [(None, out[0]), (5, out[5])]


def brute(data):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, dtype=np.float64)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in data]
    group, links = list(range(len(data))), [0] * len(data)
    for i in range(len(data)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9:
                links[i] += 1
                links[j] += 1
                if group[i] != group[j]:
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    out = []
    for k, (vec, _) in enumerate(data):
        least = min((v for (v, _), g in zip(data, group) if g == group[k] and v is not None), default=None)
        out.append((vec, links[k], least, vec is not None and vec == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [10_000, 20])
def test_equals_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell)
    if cell == 20:
        monkeypatch.setattr(vectors, "OWN_BLOCK", 16)
        monkeypatch.setattr(vectors, "MEMBER_BLOCK", 32)
        monkeypatch.setattr(vectors, "PAIRS", 64)
    frame = spark.createDataFrame(rows(), "vec_id long, embedding array<float>").repartition(3)
    for name in ("label", "links", "copies", "least", "root", *CLASHES):
        frame = frame.withColumn(name, vectors.F.lit(1)) if name not in frame.columns else frame
    assert sorted(map(tuple, vectors.near_vectors(frame).collect()), key=str) == brute(rows())


def test_cells_hold_all_partners_and_prune(spark):
    draw = np.random.default_rng(0)
    units = vectors._unit(np.concatenate([c + 0.1 * draw.normal(size=(40, 8)) for c in draw.normal(size=(12, 8))]))
    cells = vectors.Cells(vectors.pick_pivots(units, 12), np.arccos(0.9))
    cell, _, near = cells.own(units)
    cells.radii = np.array([near[cell == c].max(initial=-10.0) for c in range(12)])
    own, goes = cells.member(units)
    i, j = np.nonzero(units @ units.T >= 0.9)
    assert goes[j, own[i]].all()
    assert goes.mean() < 0.5


def test_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
