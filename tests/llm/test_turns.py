import hashlib
import heapq
import random
import re
import zlib

import pytest

from ledgerwind.llm import turns

from .conftest import CLASHES

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Best-first search over (cost, audit) of whole edit sequences; ``rows`` are (role, text, lost, cut)."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (at, state) in seen:
            continue
        seen.add((at, state))
        other = {"u": "user", "a": "assistant"}[NEXT[state]]
        heapq.heappush(heap, (cost + 5, audit + "I", at, NEXT[state], (*out, f"{other}:")))
        if at < len(rows):
            role, text, lost, cut = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
            if not lost:
                extra = 5 * cut
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", at + 1, NEXT[state], (*out, f"{other}:{text}")))
                if role[:1] == NEXT[state] or (role[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[:1], (*out, f"{role}:{text}")))
    raise AssertionError


def hurt(data):
    out = []
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def brute(data, damage=hurt):
    found = {}
    for conv in {r[0] for r in data}:
        rows = sorted((r for r in damage(data) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))
        seen, told, counts = set(), [], [0, 0, 0]
        for _, _, role, text in rows:
            blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
            cut = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
            kind = 0 if blank else 1 if again else 2 if cut else None
            if kind is not None:
                counts[kind] += 1
            seen.add((role, text))
            told.append((role, text, blank or again, cut))
        numbers = [r[1] for r in rows if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, out = cheapest(told)
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def conversations(seed=1, count=60):
    draw, out = random.Random(seed), []
    for conv in range(count):
        for turn in range(draw.choice([1, 2, 3, 6, 9, 25])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "summary", "", None])
            text = draw.choice(["Yes.", "Well then", f"Turn {turn}.", f"Turn {turn}!  ", f"Open {turn}", " \t", "", None, "Wait?\n", "a" * 50 + "."])
            out.append((conv, draw.choice([turn, turn, turn, turn + 3, None]), role, text))
    out += [(None, k, ("user", "assistant")[k % 2], f"n{k}.") for k in range(5)] + [(900, 0, "user", "lone.")] * 40
    return out + [(901, k, "user", f"same role {k}.") for k in range(70)] + [(902, None, "assistant", None)]


@pytest.mark.parametrize("rows_in_block", [4096, 3])
def test_equals_search_over_all_edits(spark, monkeypatch, rows_in_block):
    monkeypatch.setattr(turns, "BLOCK_ROWS", rows_in_block)
    data = conversations()
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    for name in ("conv", "symbol", "part", "seq", "rid", "lot", *CLASHES):
        frame = frame.withColumn(name, turns.F.lit(1))
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair_report(frame).collect()}
    assert got == brute(data)


def test_the_data_splits_into_blocks_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK_ROWS", 3)
    done = turns.repair(turns.damaged(spark.createDataFrame(conversations(), SCHEMA)))
    assert done.rows.where("not only").select("conv", "part").distinct().groupBy("conv").count().where("count > 1").count() > 0


def test_powers_equal_single_steps():
    draw = random.Random(4)
    for _ in range(300):
        runs = tuple((draw.randrange(12), draw.choice([1, 2, 3, 7, 64, 100])) for _ in range(draw.randrange(1, 5)))
        end = tuple(draw.choice([0, 5, 10, 3]) for _ in range(4))
        slow = end
        for symbol, rows in reversed(runs):
            for _ in range(rows):
                slow = turns._onto(turns._power(symbol, 0), slow)
        assert turns._onto(turns.block_matrix(runs), end) == slow
        single = tuple((s, 1) for s, n in runs for _ in range(n))
        for state in range(4):
            assert turns.unroll(runs, end, state) == turns.unroll(single, end, state)


def test_long_runs_need_few_powers():
    turns._power.cache_clear()
    turns.block_matrix(((1, 1_000_000), (2, 1_000_000)))
    assert turns._power.cache_info().currsize <= 40


def test_repaired_rows_are_sound(spark):
    got = turns.repair(spark.createDataFrame(conversations(7), SCHEMA)).rows.collect()
    by_conv = {}
    for r in sorted(got, key=lambda r: (r.part, r.seq, r.place)):
        by_conv.setdefault(r.conv, []).append(r.role[0])
    assert by_conv and all(re.fullmatch("s?(ua)+", "".join(roles)) for roles in by_conv.values())


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.repair_report(empty).collect() == [] and turns.repair(empty).rows.collect() == []
