import pytest

from ledgerwind.llm import mixing

from .conftest import CLASHES, prose


def rows():
    out = [(i, prose(i, 5 + i * 7 % 90), ("big", "b", None, "a", "Z")[0 if i % 3 == 0 else i % 5]) for i in range(240)]
    return out + [(500, None, "a"), (501, "", "empty"), (None, "no id here", "b"), (600, prose(7, 54), "b"), (600, prose(7, 54), "b")] + [(601, "same same", "b")] * 40


def plain_targets(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), [3, 1, 2] * 9))
    total, out, left = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        rest, weight = total - sum(out.values()), sum(weights[s] for s in left)
        over = {s for s in left if rest * weights[s] / weight > 2 * sizes[s]}
        if not over:
            return out | {s: rest * weights[s] / weight for s in left}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= over


def test_targets_are_met_and_reruns_agree(docs):
    data = rows()
    frame = docs(data, **CLASHES)
    got = mixing.mixed_sizes(frame).collect()
    assert len(got) == len(data)
    size, source = {}, {}
    sums = {}
    for d, t, s in data:
        sums[s] = sums.get(s, 0) + len((t or "").split())
        size[d], source[d] = len((t or "").split()), s
    want, taken = plain_targets(sums), {}
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sums[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s in sums:
        assert abs(taken[s] - want[s]) <= max(5, 0.01 * want[s]), s
    again = mixing.mixed_sizes(frame.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_dual_is_solved(spark):
    cells = spark.createDataFrame([("s", n, 3) for n in range(1, 50)], "key string, size long, n long")
    total = sum(3 * n for n in range(1, 50))
    for target in (0.0, 0.2 * total, 1.0 * total, 1.9 * total, 2.0 * total):
        goals = spark.createDataFrame([("s", total, target)], "key string, source_size long, target double")
        state = mixing.balance(cells, goals)
        words = cells.join(state, "key").select((mixing._rate(2.0) * mixing.F.col("size") * mixing.F.col("n")).alias("w"))
        assert words.agg({"w": "sum"}).first()[0] == pytest.approx(target, abs=1e-4)


def test_repeated_documents_are_whole_rows(docs):
    frame = docs(rows(), **CLASHES)
    out = mixing.repeat_documents(frame)
    assert out.columns == frame.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == pytest.approx(1.5 * sum(len((t or "").split()) for _, t, _ in rows()), rel=0.01)


def test_empty_table(docs):
    assert mixing.mixed_sizes(docs([])).collect() == [] and mixing.repeat_documents(docs([])).collect() == []
