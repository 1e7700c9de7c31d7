"""Secret scans: base patterns, and a randomness battery under false-discovery control.

Tokens of ``MIN_TOKEN`` or more characters with letters and digits are candidates.  The
smallest alphabet that holds a token is its inferred encoding, of ``k`` symbols.  Three
tests look at each: chi-squared uniformity over the alphabet, the number of runs of one
character class, and the lag-one serial correlation of the symbols' places.

Each test is used twice.  A token that is implausible as random (any test below
``RANDOM_LEVEL``) is dropped: counters, alphabets, repeated patterns.  Of the rest, the
null hypothesis is ordinary text: symbols as frequent, and classes switching as often,
as in the whole corpus.  A random token is more even and switches more often; both
p-values are combined by Fisher's method and weighed by length (longer tokens carry more
evidence, the weights have mean one).  Benjamini and Hochberg's rule over the candidates
of all documents then keeps the share of ordinary tokens among the finds below
``DISCOVERY_RATE``; it works on a histogram of p-values of fixed size.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.llm.names import fresh
from ledgerwind.session import materialise

#: Fixed values of the base patterns: kind, pattern, group to measure, least characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # the maximal runs of 24 and more
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN = 20
TOKEN = re.compile(f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("base32", UPPER + "234567"), ("lower36", DIGITS + LOWER),
    ("upper36", DIGITS + UPPER), ("base62", UPPER + LOWER + DIGITS), ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"), ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
)
RANDOM_LEVEL = 1e-4
DISCOVERY_RATE = 0.01
#: Identifiers change class more often than words: ordinary tokens switch at least so often.
LEAST_SWITCH = {"hex": 0.1, "HEX": 0.1}
LEAST_SWITCH_ELSE = 0.3
BINS_PER_DECADE, MOST_BINS = 20, 6000

_CLASS = np.zeros(256, dtype=np.int64)  # 0: not in tokens; digits, lower, upper, signs
for _k, _symbols in enumerate((DIGITS, LOWER, UPPER, "+/-_"), start=1):
    _CLASS[list(_symbols.encode())] = _k
_PLACES = []
for _, _symbols in ENCODINGS:
    _table = np.full(256, -1, dtype=np.int64)
    _table[list(_symbols.encode())] = np.arange(len(_symbols))
    _PLACES.append(_table)

STATS = 256 + 25  # byte counts, then counts of class pairs of neighbours

Span = tuple[int, int, int]  # kind, start, end


def base_spans(text: str) -> list[Span]:
    """Base spans in code points; matches that fail the length are dropped after matching."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def features(token: str) -> tuple[int, int, float, int, float] | None:
    """(encoding, length, chi-squared, class switches, p if random), or None for no candidate."""
    raw = np.frombuffer(token.encode(), dtype=np.uint8)
    classes = _CLASS[raw]
    if not (classes == 1).any() or not ((classes == 2) | (classes == 3)).any():
        return None
    for encoding, table in enumerate(_PLACES):
        places = table[raw]
        if (places >= 0).all():
            break
    k, n = len(ENCODINGS[encoding][1]), len(places)
    counts = np.bincount(places, minlength=k)
    chi = float((counts**2).sum() * k / n - n)
    # if random: Wilson and Hilferty's normal form, upper tail
    cube = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    switches = int((classes[1:] != classes[:-1]).sum())
    shares = np.bincount(_CLASS[list(ENCODINGS[encoding][1].encode())], minlength=5) / k
    theta = 1 - float((shares**2).sum())
    runs = abs(switches - (n - 1) * theta) / math.sqrt((n - 1) * theta * (1 - theta))
    spread = places.std()
    serial = float(((places[1:] - places.mean()) * (places[:-1] - places.mean())).sum() / (n * spread**2)) if spread else 1.0
    lag = abs(serial + 1 / n) * math.sqrt(n)
    return encoding, n, chi, switches, min(_upper_normal(cube), 2 * _upper_normal(runs), 2 * _upper_normal(lag))


def text_stats(text: str) -> np.ndarray:
    """Counts of a text for the null of ordinary text (``STATS`` numbers)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    classes = _CLASS[raw]
    pairs = np.bincount(classes[:-1] * 5 + classes[1:], minlength=25) if len(raw) > 1 else np.zeros(25, dtype=np.int64)
    return np.concatenate([np.bincount(raw, minlength=256), pairs])


def scan(text: str | None) -> tuple[list[Span], list[tuple]]:
    """Base spans and candidates (start, end, encoding, length, chi, switches) of one text."""
    text = text or ""
    base = base_spans(text)
    inside = sorted((a, b) for _, a, b in base)
    candidates = []
    for m in TOKEN.finditer(text):
        told = features(m[0])
        if told and told[4] >= RANDOM_LEVEL and not any(a <= m.start() and m.end() <= b for a, b in inside):
            candidates.append((m.start(), m.end(), *told[:4]))
    return base, candidates


class Ordinary:
    """The null of ordinary text, from the corpus counts."""

    def __init__(self, stats: np.ndarray) -> None:
        pairs = stats[256:].reshape(5, 5)
        self.moments = []
        for name, symbols in ENCODINGS:
            share = stats[list(symbols.encode())] + 1.0
            share = share / share.sum()
            use = sorted(set(_CLASS[list(symbols.encode())].tolist()))
            block = pairs[np.ix_(use, use)]
            switch = (block.sum() - np.trace(block) + 1.0) / (block.sum() + 2.0)
            switch = max(float(switch), LEAST_SWITCH.get(name, LEAST_SWITCH_ELSE))
            self.moments.append((len(symbols), float((share**2).sum()), float((share**3).sum()), switch))

    def log10_p(self, encoding: int, n: int, chi: float, switches: int) -> float:
        k, s2, s3, switch = self.moments[encoding]
        mean = k * (1 + (n - 1) * s2) - n
        var = (k / n) ** 2 * 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2**2)
        even = _log_upper_normal((mean - chi) / math.sqrt(max(var, 1e-12)))
        runs = _log_upper_normal((switches - 0.5 - (n - 1) * switch) / math.sqrt((n - 1) * switch * (1 - switch)))
        half = -(even + runs)  # half of Fisher's statistic, of four degrees of freedom
        return (-half + math.log1p(half)) / math.log(10)


def _log_upper_normal(z: float) -> float:
    if z < 30:
        return math.log(max(_upper_normal(z), 1e-300))
    return -z * z / 2 - math.log(z * math.sqrt(2 * math.pi))


def length_weight(n: int) -> float:
    return min(n, 64) / 32


_SPANS = "array<struct<kind:int,start:int,end:int>>"
_CANDIDATES = "array<struct<start:int,end:int,encoding:int,n:int,chi:double,switches:int>>"
_ARROW_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end")]))
_ARROW_CANDIDATES = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.int32()), ("n", pa.int32()), ("chi", pa.float64()), ("switches", pa.int32())])
)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "base", "candidates", "stats"]
    stats = np.zeros(STATS, dtype=np.int64)
    for batch in batches:
        base, candidates = [], []
        for text in batch.column("text").to_pylist():
            spans, tokens = scan(text)
            base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
            candidates.append([dict(zip(("start", "end", "encoding", "n", "chi", "switches"), t)) for t in tokens])
            if text:
                stats += text_stats(text)
        nothing = pa.nulls(len(base), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(base, _ARROW_SPANS), pa.array(candidates, _ARROW_CANDIDATES), nothing], names=names)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.int64()), pa.nulls(1, _ARROW_SPANS), pa.nulls(1, _ARROW_CANDIDATES), pa.array([stats.tolist()], pa.list_(pa.int64()))], names=names
    )


def find_secrets(rows: DataFrame) -> DataFrame:
    """(row, base, found) of ``rows`` (row, text): base spans, and what the battery finds.

    ``row`` may be any long; a null text is empty.  An empty table gives an empty result.
    """
    scanned = materialise(rows.select("row", "text").mapInArrow(_scan_batches, f"row long, base {_SPANS}, candidates {_CANDIDATES}, stats array<long>"), "secret-scan")
    totals = scanned.where("stats is not null").select(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(STATS)]).first()
    ordinary = Ordinary(np.array([x or 0 for x in totals], dtype=np.float64))
    tokens = scanned.where("base is not null")
    lengths = tokens.select(F.explode("candidates.n").alias("n")).groupBy(F.least("n", F.lit(64)).alias("n")).count().collect()
    many = sum(r["count"] for r in lengths)
    mean = sum(r["count"] * length_weight(r["n"]) for r in lengths) / max(1, many)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [
                [
                    int(min(MOST_BINS, max(0.0, BINS_PER_DECADE * (math.log10(length_weight(c["n"]) / mean) - ordinary.log10_p(c["encoding"], c["n"], c["chi"], c["switches"])))))
                    for c in row
                ]
                for row in batch.column("candidates").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("base"), batch.column("candidates"), pa.array(bins, pa.list_(pa.int32()))], names=["row", "base", "candidates", "bins"]
            )

    rated = tokens.drop("stats").mapInArrow(rate, f"row long, base {_SPANS}, candidates {_CANDIDATES}, bins array<int>")
    histogram = rated.select(F.explode("bins").alias("bin")).groupBy("bin").count().collect() if many else []
    level = discovery_bin({r["bin"]: r["count"] for r in histogram})
    chosen = F.filter(F.arrays_zip("candidates", "bins"), lambda c: c["bins"] >= F.lit(level))
    found = F.transform(chosen, lambda c: F.struct(F.lit(3).alias("kind"), c["candidates"]["start"].alias("start"), c["candidates"]["end"].alias("end")))
    return rated.select("row", "base", found.alias("found"))


def discovery_bin(histogram: dict[int, int], rate: float = DISCOVERY_RATE) -> int:
    """The lowest bin b with (tests) x 10^(-b / bins per decade) <= rate x (tests in b or above)."""
    many, above, level = sum(histogram.values()), 0, MOST_BINS + 1
    for at in sorted(histogram, reverse=True):
        above += histogram[at]
        if many * 10 ** (-at / BINS_PER_DECADE) <= rate * above:
            level = at
    return level


def _told(spans: list[dict]) -> str:
    ordered = sorted((s["start"], s["kind"], s["end"]) for s in spans)
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in ordered)


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and n_random.

    Null and empty texts have no spans; null ids and repeated rows stay as rows.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist(), strict=True):
                kinds = [s["kind"] for s in base]
                digest = hashlib.sha256(_told(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in range(3)), len(found), digest, _told(base + found)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    found = find_secrets(docs.select(F.col(doc_id).cast("long").alias("row"), F.col(text).alias("text")))
    return found.mapInArrow(tell, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def masked(text: str, spans: list[dict], mark: str) -> str:
    """``text`` with every maximal covered stretch replaced by ``mark``."""
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows of ``docs`` with secrets in ``text`` replaced and ``n_chars`` (if there) counted anew."""
    row, at, spans = fresh(docs, "row", "at", "spans")
    marked = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "secret-documents")
    found = find_secrets(marked.select(F.col(row).alias("row"), F.col(text).alias("text")))
    found = found.select(F.col("row").alias(at), F.concat("base", "found").alias(spans)).where(F.size(spans) > 0)
    joined = marked.join(found, F.col(row) == F.col(at), "left").drop(row, at)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index(text)
            rows = zip(batch.column(where).to_pylist(), batch.column(spans).to_pylist(), strict=True)
            columns = list(batch.columns[:-1])
            columns[where] = pa.array([masked(t, s, mark) if s else t for t, s in rows], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    clean = joined.mapInArrow(replace, docs.schema)
    if n_chars in docs.columns:
        clean = clean.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return clean
