"""SentencePiece encoding and decoding over a relational lattice.

A text (blanks written as U+2581, one put in front) is cut into units where no piece can
cross: between two characters that stand side by side in no piece.  Different units are
encoded once:

* substrings of bounded length are exploded and equi-joined to the piece table, a file
  of fixed size, which is broadcast;
* the edges found are grouped by unit, in the partitions the units are in already;
* a Spark higher-order ``aggregate`` folds the edges into the segmentation.

For unigram models the fold is Viterbi's.  For BPE models Viterbi over the scores gives
other pieces than the model means, so the fold makes the model's merges instead: a bit
mask of the open boundaries, from which each step takes the inner boundary of the best
edge that joins two neighbours (best score, then leftmost).  One pass over the edges,
best first, makes these merges unless it takes a piece that a better one contains at its
start or end; such units go edge by edge again from the best after every merge.  Units of
more than 62 characters run the same merges over a heap, in the block they stand in.

Documents are packed into compressed blocks of bounded size.  A block numbers its units by
first appearance and sends each once, with its places; the ids come back under the same
numbers, so no dictionary is broadcast or collected, and a block then maps its texts
through its own units.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ledgerwind.session import shared_folder

BLANK = "▁"
BLOCK_BYTES = 32 << 20
LISTED_BITS = 33 + 12  # block numbers that differ in these bits only (4,096 writing tasks) share a list
REPLY_UNITS = 1 << 18  # unit places that are packed into replies at once
SENT_UNITS = 1 << 15  # units that a block sends at once
LONGEST = 62  # characters of a unit whose boundaries fit the mask
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6


@dataclass(frozen=True)
class Model:
    """What a model file says: pieces with scores and types, model type and options."""

    kind: int
    pieces: tuple[tuple[str, float, int], ...]
    prefix: bool = True

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        normal = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or normal.precompiled_charsmap or normal.remove_extra_whitespaces:
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix or not normal.escape_whitespaces:
            raise ValueError("blanks must be escaped and stand in front of words")
        return cls(proto.trainer_spec.model_type, tuple((p.piece, p.score, p.type) for p in proto.pieces), normal.add_dummy_prefix)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {piece: k for k, (piece, _, kind) in enumerate(self.pieces) if kind == NORMAL}

    @cached_property
    def ranks(self) -> dict[str, int]:
        """Pieces by descending score; equal scores have equal ranks."""
        scores = sorted({self.pieces[k][1] for k in self.ids.values()}, reverse=True)
        place = {score: k for k, score in enumerate(scores)}
        return {piece: place[self.pieces[k][1]] for piece, k in self.ids.items()}

    @cached_property
    def contained(self) -> set[str]:
        """Pieces that a better piece holds at its start or end, beside a piece or character."""
        found: set[str] = set()
        for piece, rank in self.ranks.items():
            for at in range(1, len(piece)):
                for part, rest in ((piece[:at], piece[at:]), (piece[at:], piece[:at])):
                    if len(part) > 1 and self.ranks.get(part, -1) >= rank and (len(rest) == 1 or rest in self.ranks):
                        found.add(part)
        return found

    @cached_property
    def byte_ids(self) -> list[int]:
        found = {int(piece[3:5], 16): k for k, (piece, _, kind) in enumerate(self.pieces) if kind == BYTE}
        return [found[b] for b in range(256)] if len(found) == 256 else []

    @cached_property
    def unknown(self) -> int:
        return next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def resolved(self, ids: list[int]) -> list[int]:
        """``ids`` with the characters among them (-1 minus their code points) given their own ids."""
        if min(ids, default=0) >= 0:
            return ids
        out: list[int] = []
        for k in ids:
            char = chr(-1 - k) if k < 0 else ""
            out += [k] if k >= 0 else [self.ids[char]] if char in self.ids else self.fallback(char)
        return out

    @cached_property
    def units(self) -> re.Pattern[str]:
        """Matches the units of a text: cut where two characters are neighbours in no piece.

        Characters with the same neighbours in the pieces form a class; the pattern joins
        characters whose classes may meet.
        """
        inner = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        letters = sorted({c for pair in inner for c in pair if c.isalpha()})
        others = sorted({c for pair in inner for c in pair if not c.isalpha() and c != BLANK})
        mixed = any(a.isalpha() != b.isalpha() for a, b in inner if BLANK not in (a, b))
        after_blank = any(b == BLANK and a != BLANK for a, b in inner)
        if after_blank:
            return re.compile(r"(?s).+")
        letter_set, other_set = ("".join(map(re.escape, s)) for s in (letters, others))
        if mixed:
            return re.compile(f"(?s){BLANK}*[{letter_set}{other_set}]+|{BLANK}*[^{BLANK}]|{BLANK}+")
        parts = [f"{BLANK}*[{s}]+" for s in (letter_set, other_set) if s]
        return re.compile("(?s)" + "|".join([*parts, f"{BLANK}*[^{BLANK}]", f"{BLANK}+"]))

    def escaped(self, text: str) -> str:
        return (BLANK if self.prefix else "") + text.replace(" ", BLANK) if text else ""

    def merged(self, unit: str) -> list[int]:
        """The BPE merges of one unit over a heap; what the fold does, for units of any length."""
        symbols: list[str | None] = list(unit)
        after, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        ranks, heap = self.ranks, []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(symbols):
                rank = ranks.get(symbols[left] + symbols[right])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, symbols[left], symbols[right]))

        for left in range(len(symbols) - 1):
            offer(left)
        while heap:
            _, left, one, two = heapq.heappop(heap)
            right = after[left]
            if symbols[left] != one or right >= len(symbols) or symbols[right] != two:
                continue
            symbols[left], symbols[right], after[left] = one + two, None, after[right]
            if after[right] < len(symbols):
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        out: list[int] = []
        for symbol in symbols:
            if symbol is not None:
                out += [self.ids[symbol]] if symbol in self.ids else self.fallback(symbol)
        return out

    def spelled(self, ids: list[int]) -> str:
        """The pieces of ``ids`` side by side; bytes that are no UTF-8 become U+FFFD."""
        out, raw = [], bytearray()
        for k in ids:
            piece, _, kind = self.pieces[k]
            if kind == BYTE:
                raw.append(int(piece[3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kind == NORMAL:
                out.append(piece)
            elif kind == UNKNOWN:
                out.append(" ⁇ ")
        return "".join([*out, raw.decode("utf-8", "replace")])

    def decoded(self, ids: list[int]) -> str:
        """The text of a sequence of ids."""
        text = self.spelled(ids).replace(BLANK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, rank, score, inside) of the normal pieces; as many rows as the model has."""
    inside = model.contained if model.kind == BPE else set()
    columns = {
        "piece": pa.array(list(model.ids), pa.string()),
        "id": pa.array(list(model.ids.values()), pa.int32()),
        "rank": pa.array([model.ranks[piece] for piece in model.ids], pa.int32()),
        "score": pa.array([model.pieces[k][1] for k in model.ids.values()], pa.float64()),
        "inside": pa.array([int(piece in inside) for piece in model.ids], pa.int32()),
    }
    return spark.createDataFrame(pa.table(columns))  # from Arrow: rows would keep Python workers on every executor


def _spans(units: DataFrame, model: Model, least: int, carried: list[str]) -> DataFrame:
    """(u, n, s, l, first, carried, piece columns): substrings of ``least`` to the longest piece's characters.

    The first character's row carries the unit and its other columns, so that they are not
    copied for every substring that is a piece.  ``n`` tells units of the same hash ``u``
    apart; rows that lie by ``u`` are grouped by both without moving again.
    """
    size = F.char_length("unit")
    numbered = units.withColumn("n", F.monotonically_increasing_id())
    starts = numbered.select("*", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(model.longest), size - F.col("s")))
    first = (F.col("s") == 0) & (F.col("l") == 1)
    spans = starts.select("*", F.explode(lengths).alias("l")).where((F.col("l") >= least) | first)
    parts = spans.select(
        "u", "n", "s", "l", first.alias("first"), F.substring("unit", F.col("s") + 1, F.col("l")).alias("part"),
        *(F.when(first, F.col(c)).alias(c) for c in carried),
    )
    return parts.join(F.broadcast(piece_table(units.sparkSession, model)), F.col("part") == F.col("piece"), "left")


def _grouped(found: DataFrame, edge: F.Column, carried: list[str]) -> DataFrame:
    """(u, carried, edges): the edges of each unit in ascending order; nulls are not collected."""
    rows = found.select("u", "n", *carried, edge.alias("edge"))
    lists = rows.groupBy("u", "n").agg(*(F.first(c, ignorenulls=True).alias(c) for c in carried), F.collect_list("edge").alias("edges"))
    return lists.select("u", *carried, F.sort_array("edges").alias("edges"))


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """``units`` and their edges: all pieces inside each unit, and single characters without a piece."""
    carried = [c for c in units.columns if c != "u"]
    found = _spans(units, model, 1, carried).where("id is not null or l = 1")
    lowest = min((p[1] for p in model.pieces if p[2] == NORMAL), default=0.0) - 10.0
    edge = F.struct(
        (F.col("s") + F.col("l")).alias("e"), F.col("s"), F.coalesce("score", F.lit(lowest)).alias("score"),
        F.coalesce("id", -1 - F.expr("ascii(part)")).alias("id"),
    )
    return _grouped(found, edge, carried)


def merge_lattice(units: DataFrame, model: Model) -> DataFrame:
    """``units`` and their edges: the pieces of two and more characters inside each unit, best first.

    An edge is one number: rank, start, end, inside and id in 20, 6, 6, 1 and 20 bits.  A
    unit without any has an empty list.
    """
    carried = [c for c in units.columns if c != "u"]
    found = _spans(units, model, 2, carried).where("id is not null or first")
    rank, start, end, inside = (F.col(c).cast("long") for c in ("rank", "s", "e", "inside"))
    packed = F.shiftleft(rank, 33).bitwiseOR(F.shiftleft(start, 27)).bitwiseOR(F.shiftleft(end, 21)).bitwiseOR(F.shiftleft(inside, 20))
    edge = F.when(F.col("id").isNotNull() & (F.col("l") > 1), packed.bitwiseOR(F.col("id").cast("long")))
    return _grouped(found.withColumn("e", F.col("s") + F.col("l")), edge, carried)


def _bit(n: F.Column) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def merge_fold(lattice: DataFrame) -> DataFrame:
    """``lattice`` with ``ids`` by the model's merges in place of its edges; what stays a single character is coded.

    Each step is a column of its own: inside a lambda Spark would compute it again for
    every element.
    """
    size = F.char_length("unit")
    kept = [c for c in lattice.columns if c != "edges"]
    long = lambda n: F.lit(n).cast("long")

    def open_edge(x: F.Column) -> F.Column:
        s, e = (F.shiftright(x, k).bitwiseAND(long(63)).cast("int") for k in (27, 21))
        return F.struct(
            s.alias("s"), _bit(s).bitwiseOR(_bit(e)).alias("ends"), (_bit(e) - _bit(s + 1)).alias("inner"),
            x.bitwiseAND(long((1 << 20) - 1)).cast("int").alias("id"), (x.bitwiseAND(long(1 << 20)) > 0).alias("inside"),
        )

    def joins_two(mask: F.Column, x: F.Column) -> F.Column:
        return (mask.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(mask.bitwiseAND(x["inner"])) == 1)

    opened = lattice.select(*kept, F.transform("edges", open_edge).alias("joins"))

    def once(mask: F.Column, x: F.Column) -> F.Column:
        merged = mask.bitwiseAND(F.bitwise_not(x["inner"]))
        # the sign bit marks a unit in which a better edge may have become ready too late
        return F.when(joins_two(mask, x), F.when(x["inside"], merged.bitwiseOR(long(-(1 << 63)))).otherwise(merged)).otherwise(mask)

    def best(mask: F.Column, _: F.Column) -> F.Column:
        ready = F.filter("joins", lambda x: joins_two(mask, x))
        return mask.bitwiseAND(F.bitwise_not(F.coalesce(F.get(ready, F.lit(0))["inner"], long(0))))

    passed = opened.select("*", F.aggregate("joins", _bit(size + 1) - 1, once).alias("passed"))
    # each merge takes one boundary, and there are no more merges than edges or inner boundaries
    most = F.least(size - 1, F.size("joins"))
    rounds = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    again = F.when(F.col("passed") < 0, F.aggregate(rounds, _bit(size + 1) - 1, best)).otherwise(F.col("passed"))
    masked = passed.select(*kept, "joins", again.alias("mask"))
    mask = F.col("mask")
    whole = F.filter("joins", lambda x: (mask.bitwiseAND(x["ends"]) == x["ends"]) & (mask.bitwiseAND(x["inner"]) == 0))
    both = lambda i: long(3) * _bit(i)
    single = F.filter(F.sequence(F.lit(0), size - 1), lambda i: mask.bitwiseAND(both(i)) == both(i))
    parts = F.concat(
        F.transform(whole, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))),
        F.transform(single, lambda i: F.struct(i.alias("s"), (-1 - F.call_function("ascii", F.substr("unit", i + 1, F.lit(1)))).alias("id"))),
    )
    return masked.select(*kept, F.transform(F.sort_array(parts), lambda x: x["id"]).alias("ids"))


def viterbi_fold(edges: F.Column, size: F.Column) -> F.Column:
    """The ids of a unit on the path of the best sum of scores (unigram); the first of equals."""
    kind = "array<struct<score:double,ids:array<int>>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))).cast(kind)

    def step(best: F.Column, x: F.Column) -> F.Column:
        here = F.get(best, x["s"])
        score, old = here["score"] + x["score"], F.get(best, x["e"])
        new = F.struct(score.alias("score"), F.concat(here["ids"], F.array(x["id"])).alias("ids"))
        # edges come by their end, so the list grows by one or its last entry is replaced
        longer = F.concat(best, F.array(new))
        replaced = F.concat(F.slice(best, F.lit(1), x["e"]), F.array(new))
        return F.when(F.size(best) == x["e"], longer).when(score > old["score"], replaced).otherwise(best).cast(kind)

    return F.get(F.aggregate(edges, start, step), size)["ids"]


def _folded(units: DataFrame, model: Model) -> DataFrame:
    """``units`` (hash ``u``, ``unit`` and others) with ``ids``; BPE units have LONGEST characters at most."""
    if model.kind == BPE:
        return merge_fold(merge_lattice(units, model))
    found = lattice(units, model)
    return found.select(*(c for c in found.columns if c != "edges"), viterbi_fold(F.col("edges"), F.char_length("unit")).alias("ids"))


def encoded_units(units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) of the rows of ``units``, which are different, not empty and not beyond LONGEST in a BPE model.

    A character that was not merged stands as -1 minus its code point; ``Model.resolved``
    gives the ids of its own piece or of its bytes.
    """
    return _folded(units.select(F.xxhash64("unit").alias("u"), "unit"), model).select("unit", "ids")


class _Numbers(dict):
    """Units numbered by first appearance."""

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        return number


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _resolved(model: Model, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Model.resolved`` for many lists at once."""
    at = np.flatnonzero(ids < 0)
    codes, which = np.unique(ids[at], return_inverse=True)
    own = [model.resolved([k]) for k in codes.tolist()]
    sizes, starts = np.ones(len(ids), np.int64), np.arange(len(ids))
    own_sizes = np.array([len(o) for o in own], np.int64)
    sizes[at], starts[at] = own_sizes[which], len(ids) + _offsets(own_sizes)[:-1][which]
    every = np.concatenate([ids, np.array([k for o in own for k in o], ids.dtype)])
    return every[_runs(starts, sizes)], _offsets(sizes)[offsets]


def _reply(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs (unit, at, ids) rows into one compressed value per block of each stretch of rows."""
    spellings = pa.array([piece for piece, _, _ in model.pieces])
    normal = np.array([kind == NORMAL for _, _, kind in model.pieces])

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        units, places, lists = (table.column(c).chunk(0) for c in ("unit", "at", "ids"))
        begin = lists.offsets.to_numpy().astype(np.int64)
        ids, offsets = _resolved(model, lists.values.to_numpy()[begin[0] : begin[-1]], begin - begin[0])
        spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spellings.take(pa.array(ids))), "")
        same = pc.equal(spelled, units).to_numpy(zero_copy_only=False).copy()
        odd = np.diff(_offsets(~normal[ids])[offsets]) > 0
        for k in np.flatnonzero(odd).tolist():
            same[k] = model.spelled(ids[offsets[k] : offsets[k + 1]].tolist()) == units[k].as_py()
        flat = places.flatten()
        of = pc.list_parent_indices(places).to_numpy()
        block, number = flat.field("block").to_numpy(), flat.field("number").to_numpy()
        order = np.lexsort((number, block))
        of, block, number = of[order], block[order], number[order]
        sizes = np.diff(offsets)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        blocks, values = [], []
        for low, high in zip(cuts, cuts[1:]):
            some = of[low:high]
            parts = [
                np.diff(number[low:high], prepend=0).astype(np.int32), sizes[some].astype(np.int32), same[some].astype(np.int8),
                ids[_runs(offsets[some], sizes[some])].astype(np.int32),
            ]
            blocks.append(block[low])
            values.append(_written(parts))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(values, pa.binary())], names=["at", "reply"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch.column("at").flatten())
            if size >= REPLY_UNITS:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)
        held.clear()
        _give_back()

    return pack


def _written(parts: list[np.ndarray]) -> bytes:
    """Arrays as one compressed value: the bytes of all first, of all second and so on lie together."""
    count = np.array([len(p) for p in parts], np.int32).tobytes()
    planes = [p.view(np.uint8).reshape(len(p), p.dtype.itemsize).T.tobytes() for p in parts]
    raw = b"".join([count, *planes])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(raw, asbytes=True)


def _read(value: pa.Buffer) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(value[8:], int.from_bytes(value[:8], "little"), asbytes=True)
    kinds = (np.int32, np.int32, np.int8, np.int32)
    counts, at, out = np.frombuffer(raw, np.int32, len(kinds)).tolist(), 4 * len(kinds), []
    for count, kind in zip(counts, kinds, strict=True):
        width = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(count))
        at += count * width
    return out


class _Known:
    """The ids of a block's units by their numbers."""

    def __init__(self, model: Model, replies: pa.ListScalar):
        self.model, self.numbers = model, _Numbers()
        read = [_read(r.as_buffer()) for r in replies.values or []]
        numbers = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(r[0], dtype=np.int64) for r in read)])
        sizes = np.concatenate([np.zeros(0, np.int64), *(r[1] for r in read)])
        self.ids = np.concatenate([np.zeros(0, np.int32), *(r[3] for r in read)])
        count = int(numbers.max(initial=-1)) + 1
        self.starts, self.sizes, self.same = np.zeros(count, np.int64), np.full(count, -1, np.int64), np.zeros(count, bool)
        self.starts[numbers], self.sizes[numbers] = _offsets(sizes)[:-1], sizes
        self.same[numbers] = np.concatenate([np.zeros(0, np.int8), *(r[2] for r in read)]) > 0

    def _add_long(self, units: dict[int, str]) -> None:
        """Takes in units beyond LONGEST, which the block encodes itself."""
        more = max(0, len(self.numbers) - len(self.sizes))
        self.starts, self.same = np.pad(self.starts, (0, more)), np.pad(self.same, (0, more))
        self.sizes = np.pad(self.sizes, (0, more), constant_values=-1)
        lists = [self.model.merged(u) for u in units.values()]
        for number, unit, ids, start in zip(units, units.values(), lists, len(self.ids) + _offsets(np.array([len(i) for i in lists]))):
            self.starts[number], self.sizes[number], self.same[number] = start, len(ids), self.model.spelled(ids) == unit
        self.ids = np.concatenate([self.ids, np.array([k for i in lists for k in i], np.int32)])

    def encoded(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """The ids of each text, and whether they give it again."""
        find, number = self.model.units.findall, self.numbers.__getitem__
        found, counts, seen = [], [], len(self.numbers)
        for text in texts:
            units = find(self.model.escaped(text))
            found += map(number, units)
            counts.append(len(units))
        if len(self.numbers) > seen and self.model.kind == BPE:
            beyond = {seen + k: u for k, u in enumerate(islice(self.numbers, seen, None)) if len(u) > LONGEST}
            if beyond:
                self._add_long(beyond)
        units, bounds = np.array(found, np.int64), _offsets(np.array(counts, np.int64))
        sizes = self.sizes[units]
        if (sizes < 0).any():
            raise RuntimeError("a unit of the block came back without ids")
        ids, offsets = self.ids[_runs(self.starts[units], sizes)], _offsets(sizes)[bounds]
        clean = (np.diff(_offsets(~self.same[units])[bounds]) == 0).tolist()
        same = [
            True if c and BLANK not in t else self.model.decoded(ids[a:b].tolist()) == t
            for c, t, a, b in zip(clean, texts, offsets.tolist(), offsets[1:].tolist())
        ]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32())), pa.array(same, pa.bool_())


class _Packer:
    """One block, compressed as its parts come: only their compressed bytes are held."""

    def __init__(self, schema: pa.Schema):
        self.sink = pa.BufferOutputStream()
        self.writer = pa.ipc.new_stream(self.sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6)))
        self.size = 0

    def add(self, part: pa.RecordBatch, text: str) -> None:
        self.writer.write_batch(part)
        self.size += part.column(text).nbytes

    def packed(self) -> pa.RecordBatch:
        self.writer.close()
        value = self.sink.getvalue()
        offsets = pa.py_buffer(np.array([0, value.size], np.int32))
        return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), 1, [None, offsets, value])], names=["packed"])


def _pack(text: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                # a copy: a slice would be written with its whole parent
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema)
                block = block or _Packer(part.schema)
                block.add(part, text)
                if block.size >= BLOCK_BYTES:
                    yield block.packed()
                    block = None
        if block:
            yield block.packed()
        del block
        _give_back()

    return pack


def _give_back() -> None:
    """Frees what Arrow keeps for later: a worker stays alive beside the JVM of its executor."""
    pa.default_memory_pool().release_unused()


def _unpacked(value: pa.BinaryScalar) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(value.as_buffer()) as reader:
        yield from reader


def _stored(packed: DataFrame) -> DataFrame:
    """The blocks written once to the shared folder, bucketed, so that no join moves them again."""
    spark = packed.sparkSession
    name = f"piece_blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/stages/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.write.bucketBy(buckets, "block").option("path", path).option("compression", "none").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``pieces`` (ids) and ``round_trip``.

    A null or empty text has no pieces.  ``round_trip`` says whether decoding the ids gives
    the text again.  Columns of these two names are replaced.  Repeated rows stay; an
    empty table gives an empty result.
    """

    schema = "block long, number int, unit string"

    def sent(block: int, fresh: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        some = [(k, u) for k, u in fresh if model.kind != BPE or len(u) <= LONGEST]
        for at in range(0, len(some), SENT_UNITS):
            numbers, units = zip(*some[at : at + SENT_UNITS])
            columns = [pa.array([block] * len(units), pa.int64()), pa.array(numbers, pa.int32()), pa.array(units, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "number", "unit"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = model.units.findall
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed"), strict=True):
                numbers, fresh = _Numbers(), []
                for part in _unpacked(packed):
                    for value in part.column(text).to_pylist():
                        for unit in dict.fromkeys(find(model.escaped(value or ""))):
                            if unit not in numbers:
                                fresh.append((numbers[unit], unit))
                        if len(fresh) >= SENT_UNITS:
                            yield from sent(block, fresh)
                            fresh = []
                yield from sent(block, fresh)
                del numbers, fresh
        _give_back()

    kept = [n for n in docs.columns if not (drop_text and n == text) and n not in ("pieces", "round_trip")]

    def map_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                known = _Known(model, batch.column("replies")[row])
                for part in _unpacked(batch.column("packed")[row]):
                    columns = [*(part.column(n) for n in kept), *known.encoded([t or "" for t in part.column(text).to_pylist()])]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, "pieces", "round_trip"])
                del known
        _give_back()

    packed = docs.mapInArrow(_pack(text), "packed binary").withColumn("block", F.monotonically_increasing_id())
    blocks = _stored(packed)
    # a fixed number of partitions: the work per unit is large for its bytes
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = blocks.mapInArrow(cut, schema).repartition(width, F.xxhash64("unit")).withColumn("u", F.xxhash64("unit"))
    # a unit's list of places is bounded: it has a row for every 2 ** LISTED_BITS numbers
    some = F.shiftright("block", LISTED_BITS).alias("some")
    listed = pairs.groupBy("u", "unit", some).agg(F.collect_list(F.struct("block", "number")).alias("at"))
    replies = _folded(listed.select("u", "unit", "at"), model).select("unit", "at", "ids").mapInArrow(_reply(model), "at long, reply binary")
    mine = replies.groupBy("at").agg(F.collect_list("reply").alias("replies"))  # one block's units: bounded by the block's bytes
    joined = blocks.join(mine, blocks["block"] == mine["at"], "left").select("packed", "replies")
    added = [StructField("pieces", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]
    return joined.mapInArrow(map_block, StructType([*(docs.schema[n] for n in kept), *added]))


def decode(frame: DataFrame, model: Model, ids: str = "pieces", column: str = "decoded") -> DataFrame:
    """All columns of ``frame`` and the text of its ids; a null list gives a null text.

    A column named like the result is replaced; an empty table gives an empty result.
    """
    kept = [f for f in frame.schema.fields if f.name != column]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else model.decoded(i) for i in batch.column(ids).to_pylist()]
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, column])

    return frame.mapInArrow(add, StructType([*kept, StructField(column, StringType())]))
