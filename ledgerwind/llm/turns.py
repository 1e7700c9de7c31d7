"""Conversation structure repair: a run-length dynamic programme over turns.

Every row becomes a symbol: the class of its role's initial and its first fault.  Roles of
a sound conversation spell ``(s?(ua)+)?``, and four states tell how far a prefix of it has
got.  A symbol is a 4 x 4 min-plus matrix of the cheapest edits from state to state, and
equal consecutive symbols are one run, whose matrix is made of cached binary powers.

Conversations are cut into blocks of bounded rows and bytes, laid out by a range partition
of (conversation, turn), so one long conversation spreads over many tasks:

1. a block multiplies its runs to one matrix;
2. a stream over the blocks of each conversation, last one first, gives the cheapest cost
   from every state at each block's end;
3. with these costs a block tells to which state its cheapest edits lead from each state;
4. a stream from the first block on gives the state each block starts in;
5. every block unrolls its own edits, halving its runs by the same powers.

The streams see one small row per block and hold one of them at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.session import materialise

#: Fixed values of the contract: costs of edits, ASCII blanks and closing signs.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NOT_BLANK = r"[^\x20\x09-\x0D]"
CLOSING = r"[.!?]"

BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
TIE_CHARS = 32  # of the text, in the order of rows with one turn and role

FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, after s, after u, after a
FOLLOWED_BY = (USER, USER, ASSISTANT, USER)  # state after the next legal user or assistant
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
AT_END = (0, 2 * INSERT, INSERT, 0)  # inserts that complete the conversation
OTHER = 3  # role classes: s, u, a, others
FINE, LOST, CUT = range(3)  # faults: none, blank or duplicate, truncated; a symbol is class + 4 * fault

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


# --- min-plus algebra of symbols ---


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _onto(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


def _keeping(symbol: int, state: int) -> tuple[int, int] | None:
    """(state after, cost) of keeping a row, if that is allowed."""
    fault, role = divmod(symbol, 4)
    after = KEPT.get((state, role))
    return None if after is None or fault == LOST else (after, TRUNCATED * (fault == CUT))


@cache
def _power(symbol: int, k: int) -> Matrix:
    """The matrix of 2^k rows of one symbol, with inserts in front of each."""
    if k:
        half = _power(symbol, k - 1)
        return _times(half, half)
    fault = symbol // 4
    row = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        row[state][state] = DELETE
        if fault != LOST:
            after = FOLLOWED_BY[state]
            row[state][after] = min(row[state][after], REROLE + TRUNCATED * (fault == CUT))
        if kept := _keeping(symbol, state):
            row[state][kept[0]] = min(row[state][kept[0]], kept[1])
    inserts = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        inserts[state][state], at = 0, state
        for n in (1, 2):
            at = FOLLOWED_BY[at]
            inserts[state][at] = min(inserts[state][at], n * INSERT)
    return _times(tuple(map(tuple, inserts)), tuple(map(tuple, row)))


def _ahead(symbol: int, rows: int, v: Vector) -> Vector:
    """Costs before ``rows`` rows of a symbol from those behind them."""
    k = 0
    while rows:
        if rows & 1:
            v = _onto(_power(symbol, k), v)
        rows, k = rows >> 1, k + 1
    return v


@lru_cache(maxsize=1 << 14)
def block_matrix(runs: tuple[tuple[int, int], ...]) -> Matrix:
    whole: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
    for symbol, rows in runs:
        k = 0
        while rows:
            if rows & 1:
                whole = _times(whole, _power(symbol, k))
            rows, k = rows >> 1, k + 1
    return whole


def _behind(symbol: int, rows: int, end: Vector) -> Iterator[Vector]:
    """Costs behind each of ``rows`` rows, first row first; halves hold log(rows) vectors."""
    if rows == 1:
        yield end
        return
    k = (rows - 1).bit_length() - 1
    yield from _behind(symbol, rows - (1 << k), _onto(_power(symbol, k), end))
    yield from _behind(symbol, 1 << k, end)


@lru_cache(maxsize=1 << 14)
def unroll(runs: tuple[tuple[int, int], ...], end: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits of a block from ``state``, and the state it ends in."""
    ends = [end]
    for symbol, rows in reversed(runs[1:]):
        ends.append(_ahead(symbol, rows, ends[-1]))
    edits = []
    for (symbol, rows), run_end in zip(runs, reversed(ends), strict=True):
        for after in _behind(symbol, rows, run_end):
            now = _onto(_power(symbol, 0), after)
            while DELETE + after[state] != now[state] and INSERT + now[FOLLOWED_BY[state]] == now[state]:
                edits.append("I")
                state = FOLLOWED_BY[state]
            kept = _keeping(symbol, state)
            if DELETE + after[state] == now[state]:
                edits.append("D")
            elif kept and kept[1] + after[kept[0]] == now[state]:
                edits.append("K")
                state = kept[0]
            else:
                edits.append("R")
                state = FOLLOWED_BY[state]
    return "".join(edits), state


def closing_inserts(state: int) -> int:
    return AT_END[state] // INSERT


# --- blocks ---


class _Block:
    def __init__(self, conv: object, seq: int) -> None:
        self.conv, self.seq = conv, seq
        self.rids: list[int] = []
        self.symbols: list[int] = []
        self.turns: list[int | None] = []
        self.lost = [0, 0]  # blank, duplicate
        self.bytes = 0

    def add(self, rids: list[int], symbols: list[int], turns: list[int | None], blank: int, duplicate: int, size: int) -> None:
        self.rids += rids
        self.symbols += symbols
        self.turns += turns
        self.lost[0] += blank
        self.lost[1] += duplicate
        self.bytes += size

    def row(self, part: int) -> tuple:
        runs: list[list[int]] = []
        for s in self.symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        key = tuple((s, n) for s, n in runs)
        pairs = zip(self.symbols, self.symbols[1:])
        illegal = sum(not _legal(a % 4, b % 4) for a, b in pairs)
        turns = [t for t in self.turns if t is not None]
        return (
            self.conv, part, self.seq, self.rids, [s for s, _ in runs], [n for _, n in runs],
            [min(x, FAR) for line in block_matrix(key) for x in line],
            *self.lost, sum(s // 4 == CUT for s in self.symbols), illegal, self.symbols[0] % 4, self.symbols[-1] % 4,
            turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)),
        )


BLOCK = (
    "part int, seq int, rids array<long>, symbols array<int>, lengths array<int>, matrix array<long>, blank long, duplicate long, truncated long, "
    "illegal long, first_role int, last_role int, first_turn long, last_turn long, turns long"
)


def _legal(a: int, b: int) -> bool:
    return (a, b) in {(0, 1), (1, 2), (2, 1)}


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _encode(fields: pa.Schema, most_rows: int, most_bytes: int):
    """Rows in order to blocks; ``fields`` is the schema of a block with its conversation."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if not len(batch):
                continue
            convs = batch.column("conv")
            code = convs.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            columns = {n: batch.column(n).to_pylist() for n in ("rid", "symbol", "turn", "blank", "duplicate", "size")}
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(batch)]
            done = []
            for a, b in zip(cuts, cuts[1:]):
                conv = convs[a].as_py()
                if held and held.conv != conv:
                    done.append(held.row(part))
                    held = None
                for at in range(a, b):
                    if held and (len(held.rids) >= most_rows or held.bytes >= most_bytes):
                        done.append(held.row(part))
                        held = _Block(conv, held.seq + 1)
                    held = held or _Block(conv, 0)
                    held.add(*([columns[n][at]] for n in ("rid", "symbol", "turn")), *(columns[n][at] for n in ("blank", "duplicate", "size")))
            if done:
                yield _batch(done, fields)
        if held:
            yield _batch([held.row(part)], fields)

    return encode


def _per_row(fields: pa.Schema, make: Callable[[], Callable[[dict], tuple]]):
    """A task that turns each row into one of ``fields``; ``make`` gives it a function with a state of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if len(batch):
                yield _batch([step(row) for row in batch.to_pylist()], fields)

    return run


def _costs_behind() -> Callable[[dict], tuple]:
    """Blocks of each conversation, last first: the block, its costs behind, whether it is the last, and its cost from the start."""
    held: list = [None, AT_END]

    def step(b: dict) -> tuple:
        last = held[0] is None or held[0][0] != b["conv"]
        end = AT_END if last else held[1]
        m = b["matrix"]
        ahead = _onto(tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)), end)
        held[0], held[1] = (b["conv"],), ahead
        return (*b.values(), list(end), last, ahead[START])

    return step


def _exits() -> Callable[[dict], tuple]:
    def step(b: dict) -> tuple:
        runs = tuple(zip(b["symbols"], b["lengths"], strict=True))
        end = tuple(b["behind"])
        return (*b.values(), [unroll(runs, end, state)[1] for state in range(4)])

    return step


def _states() -> Callable[[dict], tuple]:
    """Blocks in order: the state each starts in, and what the seams between blocks add."""
    held: list[dict | None] = [None]

    def step(b: dict) -> tuple:
        before = held[0]
        if before is not None and before["conv"] != b["conv"]:
            before = None
        state = before["leads_to"] if before else START
        illegal = int(before is not None and not _legal(before["last_role"], b["first_role"]))
        known = before["seen_turn"] if before else None
        again = int(known is not None and known == b["first_turn"])
        held[0] = {
            "conv": b["conv"], "leads_to": b["exits"][state], "last_role": b["last_role"],
            "seen_turn": known if b["last_turn"] is None else b["last_turn"],
        }
        return (*b.values(), state, before is None, illegal, again)

    return step


def _unrolled() -> Callable[[dict], tuple]:
    """The edits of a block as letters; with them the rows they concern and their new roles."""

    def step(b: dict) -> tuple:
        edits, state = unroll(tuple(zip(b["symbols"], b["lengths"], strict=True)), tuple(b["behind"]), b["state"])
        roles: list[str | None] = []
        rids: list[int | None] = []
        rows, at = iter(b["rids"]), b["state"]
        classes = iter([s for s, n in zip(b["symbols"], b["lengths"], strict=True) for _ in range(n)])
        for e in edits:
            if e == "I":
                rids.append(None)
            else:
                rids.append(next(rows))
                symbol = next(classes)
            if e == "D":
                roles.append(None)
                continue
            at = _keeping(symbol, at)[0] if e == "K" else FOLLOWED_BY[at]
            roles.append(None if e == "K" else ("user", "assistant")[at - USER])
        if b["last"]:
            for _ in range(closing_inserts(state)):
                edits, at = edits + "I", FOLLOWED_BY[at]
                rids.append(None)
                roles.append(("user", "assistant")[at - USER])
        b.pop("rids")
        return (*b.values(), edits, rids, roles)

    return step


# --- the operator ---


@dataclass
class Repaired:
    """``conversations``: one row per conversation with rows; ``rows``: the repaired turns."""

    conversations: DataFrame  # conv, gaps, blank, duplicate, truncated, illegal, cost, audit
    rows: DataFrame  # conv, part, seq, place (their order), only, edit, turn, role, text


def with_faults(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without texts (symbol, faults, order), and the stored rows they stand for by ``rid``."""
    rows = turns.select(
        "conv", "turn", "role", "text", F.monotonically_increasing_id().alias("rid"), F.sha2("text", 256).alias("digest"),
        (~F.col("text").rlike(NOT_BLANK)).alias("blank"), (~F.col("text").rlike(rf"{CLOSING}[\x20\x09-\x0D]*\z")).alias("cut"),
    )
    rows = materialise(rows, "turns")
    order = F.struct(F.col("turn").isNotNull().alias("a"), "turn", "rid")
    # a row is a duplicate unless it is the first of its conversation, role and text
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min(order)["rid"].alias("first"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    seen = F.col("first").isNull()
    fault = F.when(F.col("blank") | seen, LOST).when(F.col("cut"), CUT).otherwise(FINE)
    skinny = rows.select("conv", "turn", "role", F.substring("text", 1, TIE_CHARS).alias("tie"), "digest", "rid", "blank", "cut", F.octet_length("text").alias("size"))
    marked = skinny.join(firsts.select("first"), F.col("rid") == F.col("first"), "left").select(
        "conv", "turn", "role", "tie", "digest", "rid", "size", (role + 4 * fault).alias("symbol"),
        F.col("blank").cast("int").alias("blank"), (~F.col("blank") & seen).cast("int").alias("duplicate"),
    )
    return marked, rows


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """The cheapest repair of every conversation in ``turns``.

    Rows are taken by turn (nulls first; ties by role, the text's start, then its digest); a
    null role or text is one blank, null conversations are one conversation.  Repeated rows are
    duplicates, and of several rows with one role and text the first stays.  Other columns are
    not read, whatever their names.  An empty table gives empty results.
    """
    plain = turns.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    spark = turns.sparkSession
    skinny, stored = with_faults(plain)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "tie", "digest", "rid"]
    laid = skinny.repartitionByRange(width, *order).sortWithinPartitions(*order)
    kind = plain.schema["conv"].dataType.simpleString()

    def step(frame: DataFrame, add: str, make: Callable[[], Callable[[dict], tuple]], drop: tuple[str, ...] = ()) -> DataFrame:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name not in drop) + f", {add}"
        return frame.mapInArrow(_per_row(_arrow(spark, ddl), make), ddl)

    def streamed(frame: DataFrame, *by: F.Column) -> DataFrame:
        return frame.repartition(width, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *by)

    schema = f"conv {kind}, {BLOCK}"
    blocks = materialise(laid.mapInArrow(_encode(_arrow(spark, schema), BLOCK_ROWS, BLOCK_BYTES), schema), "blocks")
    behind = step(streamed(blocks, F.desc("part"), F.desc("seq")), "behind array<long>, last boolean, ahead long", _costs_behind)
    exits = step(behind.repartition(width, "part", "seq", F.xxhash64("rids")), "exits array<int>", _exits)
    states = step(streamed(exits, F.asc("part"), F.asc("seq")), "state int, starts boolean, seam_illegal int, seam_turns int", _states)
    done = step(states.repartition(width, "part", "seq", F.xxhash64("rids")), "edits string, of array<long>, roles array<string>", _unrolled, ("rids",))
    done = materialise(done, "edits")

    pieces = F.array_sort(F.collect_list(F.struct("part", "seq", "edits")))  # the audit, as long as the conversation
    span = F.max("last_turn") - F.min("first_turn") + 1 - F.sum(F.col("turns") - F.col("seam_turns"))
    conversations = done.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.col("seam_illegal")).alias("illegal"), F.sum(F.when(F.col("starts"), F.col("ahead"))).alias("cost"),
        F.array_join(F.transform(pieces, lambda p: p["edits"]), "").alias("audit"),
    )

    each = done.select("conv", "part", "seq", (F.col("starts") & F.col("last")).alias("only"), "edits", F.posexplode(F.arrays_zip("of", "roles")).alias("place", "x"))
    each = each.select("conv", "part", "seq", "only", "place", F.substring("edits", F.col("place") + 1, F.lit(1)).alias("edit"), "x.of", F.col("x.roles").alias("new"))
    each = each.where("edit <> 'D'")
    shown = ["conv", "part", "seq", "place", "only", "edit", "turn"]
    texts = stored.select("rid", "turn", "role", "text")
    kept = each.where("edit <> 'I'").join(texts, F.col("of") == F.col("rid")).select(*shown, F.coalesce("new", "role").alias("role"), "text")
    put = each.where("edit = 'I'").select(*shown[:-1], F.lit(None).cast("long").alias("turn"), F.col("new").alias("role"), F.lit("").alias("text"))
    return Repaired(conversations, kept.unionByName(put))


def _hashed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Bodies of blocks in order: the digest of each conversation."""
    held, digest, out = None, None, []
    for batch in batches:
        for conv, body in zip(batch.column("conv").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if held is None or held[0] != conv:
                if held:
                    out.append((held[0], digest.hexdigest()))
                held, digest = (conv,), hashlib.sha256(body.encode())
            else:
                digest.update(f"\n{body}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out])], names=["conv", "repaired_sha256"])
            out = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])


def conversation_digests(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repaired ``rows``: SHA-256 of ``role:text`` lines.

    A digest is sequential: conversations of several blocks send one body per block to one
    task, which streams them; all others are hashed with their only block.
    """
    piece = F.struct("place", F.concat_ws(":", "role", "text").alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["line"]), "\n")
    bodies = rows.groupBy("conv", "part", "seq", "only").agg(body.alias("body"))  # a block's rows and bytes are bounded
    bodies = materialise(bodies.select("conv", "part", "seq", "only", F.when(F.col("only"), F.sha2("body", 256)).otherwise(F.col("body")).alias("body")), "bodies")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = _arrow(rows.sparkSession, f"conv {rows.schema['conv'].dataType.simpleString()}").field(0).type
    long = bodies.where("not only").repartition(width, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "seq")
    streamed = long.mapInArrow(lambda batches: _hashed(batches, kind), f"conv {rows.schema['conv'].dataType.simpleString()}, repaired_sha256 string")
    return bodies.where("only").select("conv", F.col("body").alias("repaired_sha256")).unionByName(streamed)


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with the faults of the contract, by crc32 of ``conv_id:turn``; nulls count as one blank."""
    blank = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    lot = F.crc32(key) % 20
    changed = rows.withColumn("lot", lot).where("lot <> 0").select(
        "conv_id", "turn", F.when(F.col("lot") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.regexp_replace("text", CLOSING, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return changed.drop("copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` with the figures, the audit and the digest of its repair."""
    found = repair(damaged(conversations))
    ids = conversations.select("conv_id").distinct()
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    told = ids.join(found.conversations, ids["conv_id"].eqNullSafe(F.col("conv")), "left").drop("conv")
    digests = conversation_digests(found.rows)
    return told.join(digests, told["conv_id"].eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in figures],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: DuckDB: one row after the other from the last, each state with its least (cost, audit) and repaired text.
TURNS_SQL = r"""
WITH RECURSIVE keyed AS (
SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
lots AS (
SELECT *, xor(list_reduce([4294967295] || list_transform(range(1, len(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT)),
  lambda c, b: list_reduce([xor(CAST(c AS BIGINT), CAST(b AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(CAST(x AS BIGINT) >> 1, (CAST(x AS BIGINT) & 1) * 3988292384))), 4294967295) % 20 AS lot FROM keyed),
hurt AS (
SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
FROM lots JOIN (VALUES (0), (1)) t(copy) ON copy = 0 OR lot = 3 WHERE lot <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM hurt),
told AS (
SELECT *, left(role, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS h FROM placed),
figures AS (
SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (h || i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last FROM told GROUP BY conv_id),
walk AS (
SELECT conv_id, last AS n, {'c': 0, 'e': '', 't': ''} AS b0, {'c': 10, 'e': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS b1,
  {'c': 5, 'e': 'I', 't': chr(10) || 'assistant:'} AS b2, {'c': 0, 'e': '', 't': ''} AS b3 FROM figures
UNION ALL
SELECT conv_id, n, least(o0, a0, aa0), least(o1, a0, aa0), least(o2, {'c': 5 + o3.c, 'e': 'I' || o3.e, 't': ia || o3.t}, {'c': 10 + o2.c, 'e': 'II' || o2.e, 't': ia || iu || o2.t}), least(o3, a0, aa0)
FROM (SELECT *, {'c': 5 + o2.c, 'e': 'I' || o2.e, 't': iu || o2.t} AS a0, {'c': 10 + o3.c, 'e': 'II' || o3.e, 't': iu || ia || o3.t} AS aa0
FROM (SELECT conv_id, n - 1 AS n, iu, ia,
  least({'c': 2 + b0.c, 'e': 'D' || b0.e, 't': b0.t}, CASE WHEN NOT gone THEN {'c': 1 + p + b2.c, 'e': 'R' || b2.e, 't': iu || text || b2.t} END,
    CASE WHEN NOT gone AND i = 's' THEN {'c': p + b1.c, 'e': 'K' || b1.e, 't': own || b1.t} WHEN NOT gone AND i = 'u' THEN {'c': p + b2.c, 'e': 'K' || b2.e, 't': own || b2.t} END) AS o0,
  least({'c': 2 + b1.c, 'e': 'D' || b1.e, 't': b1.t}, CASE WHEN NOT gone THEN {'c': 1 + p + b2.c, 'e': 'R' || b2.e, 't': iu || text || b2.t} END,
    CASE WHEN NOT gone AND i = 'u' THEN {'c': p + b2.c, 'e': 'K' || b2.e, 't': own || b2.t} END) AS o1,
  least({'c': 2 + b2.c, 'e': 'D' || b2.e, 't': b2.t}, CASE WHEN NOT gone THEN {'c': 1 + p + b3.c, 'e': 'R' || b3.e, 't': ia || text || b3.t} END,
    CASE WHEN NOT gone AND i = 'a' THEN {'c': p + b3.c, 'e': 'K' || b3.e, 't': own || b3.t} END) AS o2,
  least({'c': 2 + b3.c, 'e': 'D' || b3.e, 't': b3.t}, CASE WHEN NOT gone THEN {'c': 1 + p + b2.c, 'e': 'R' || b2.e, 't': iu || text || b2.t} END,
    CASE WHEN NOT gone AND i = 'u' THEN {'c': p + b2.c, 'e': 'K' || b2.e, 't': own || b2.t} END) AS o3
FROM (SELECT w.*, t.i, t.text, t.blank OR t.again AS gone, CASE WHEN t.cut THEN 5 ELSE 0 END AS p, chr(10) || t.role || ':' || t.text AS own, chr(10) || 'user:' AS iu, chr(10) || 'assistant:' AS ia
  FROM walk w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n))))
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b0.c, 0) AS BIGINT) AS cost, coalesce(b0.e, '') AS audit, sha256(substr(coalesce(b0.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM ids.conv_id AND w.n = 0"""
