"""Quality rules as a short-circuit cascade ordered by rejection per cost.

A bounded sample of documents (``SAMPLE_ROWS``, the least hashes of ids) gives
every rule's cost (measured seconds) and what it rejects.  The order is greedy: next
comes the rule that rejects most of the sample's remaining rows per second of cost.
All documents then run through the rules in that order, up to the first rejection.
The order only decides how much work is done: whether a document is kept does not
depend on it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SAMPLE_ROWS = 256

#: Fixed values of the rules.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 50
LETTER_PERCENT = 80
WORD_LENGTHS = (2, 15)
BULLETS = ("-", "*", "•")
BULLET_PERCENT = 90
ELLIPSES = ("...", "…")
ELLIPSIS_PERCENT = 30


class Facts:
    """Counts of one text, each made when first asked for; a null text counts as empty."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        if self.n_words < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in self.words], dtype=np.int64)
        _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
        _, which, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[which] > 1
        covered = np.zeros(len(ids), dtype=bool)
        for shift in range(3):
            covered[shift : shift + len(twice)] |= twice
        return int(covered.sum())

    @cached_property
    def n_letter_words(self) -> int:
        """Words with a letter: A-Z in either case or anything beyond ASCII."""
        letters = re.compile(rb"[A-Za-z\x80-\xff]").search
        return sum(1 for w in self.words if letters(w))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < MIN_WORDS),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > REPEAT_PERCENT * f.n_words),
)
MORE_RULES = (
    Rule("symbols", lambda f: 100 * f.n_symbols > SYMBOL_PERCENT * f.n_words),
    Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > DUP_LINE_PERCENT * len(f.lines)),
    Rule("few_letters", lambda f: 100 * f.n_letter_words < LETTER_PERCENT * f.n_words),
    Rule("word_length", lambda f: not WORD_LENGTHS[0] * f.n_words <= f.word_chars <= WORD_LENGTHS[1] * f.n_words),
    Rule("bullets", lambda f: 100 * sum(x.lstrip(BLANKS).startswith(BULLETS) for x in f.lines) > BULLET_PERCENT * len(f.lines)),
    Rule("ellipses", lambda f: 100 * sum(x.rstrip(BLANKS).endswith(ELLIPSES) for x in f.lines) > ELLIPSIS_PERCENT * len(f.lines)),
)


def greedy_order(costs: Sequence[float], rejected: np.ndarray) -> list[int]:
    """Indices of the rules; ``rejected`` is rules x sample rows.  Ties keep the given order."""
    left, open_rows, order = list(range(len(costs))), np.ones(rejected.shape[1], dtype=bool), []
    while left:
        best = max(left, key=lambda k: ((rejected[k] & open_rows).sum() / max(costs[k], 1e-9), -costs[k], -k))
        order.append(best)
        left.remove(best)
        open_rows &= ~rejected[best]
    return order


def ordered_rules(docs: DataFrame, rules: Sequence[Rule], doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the cascade's order, from ``rows`` documents; an empty table keeps the given order."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in batches for t in batch.column(0).to_pylist()]
        for k, rule in enumerate(rules):
            started = time.process_time()
            fails = [rule.rejects(Facts(t)) for t in texts]
            seconds = time.process_time() - started
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([seconds]), pa.array([fails])], names=["rule", "cost", "fails"])

    # the ids alone give the bound of the least hashes, so that few texts are read on
    hashed = F.xxhash64(doc_id)
    bound = docs.select(hashed.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    sample = docs.where(hashed <= F.lit(bound)).select(F.col(text).alias("text")).limit(rows)
    seen = sorted(sample.coalesce(1).mapInArrow(measure, "rule long, cost double, fails array<boolean>").collect())
    if not seen:
        return list(rules)
    return [rules[k] for k in greedy_order([r["cost"] for r in seen], np.array([r["fails"] for r in seen], dtype=bool))]


def first_rejection(facts: Facts, rules: Sequence[Rule]) -> str | None:
    return next((rule.name for rule in rules if rule.rejects(facts)), None)


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns kept, without a shuffle.

    A null text is empty and so has too few words; repeated rows are judged alike.
    """
    cascade = ordered_rules(docs, rules, doc_id, text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [first_rejection(Facts(t), cascade) is None for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def rejected_by(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = BASE_RULES + MORE_RULES, column: str = "rejected_by") -> DataFrame:
    """All rows with the name of the first rule of the cascade that rejects them (null: kept)."""
    cascade = ordered_rules(docs, rules, doc_id, text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([first_rejection(Facts(t), cascade) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, column])

    return docs.mapInArrow(judge, StructType([*docs.schema.fields, StructField(column, StringType())]))


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts, ``base_failed`` and ``kept``.

    The counts are made for every document; the cascade of the further rules only runs
    on documents that pass the base.  Null and empty texts count zero and fail; null
    ids and repeated rows are kept as rows.  An empty table gives an empty result.
    """
    skinny = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cascade = ordered_rules(skinny, MORE_RULES)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                facts = Facts(text)
                failed = first_rejection(facts, BASE_RULES) is not None
                kept = not failed and first_rejection(facts, cascade) is None
                rows.append((*(getattr(facts, c) for c in counts), failed, kept))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:])],
                names=["doc_id", *counts, "base_failed", "kept"],
            )

    schema = StructType([skinny.schema["doc_id"]]).simpleString()[7:-1].replace("doc_id:", "doc_id ")
    return skinny.mapInArrow(judge, schema + ", " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean")


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, i, words[i:i+2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
c AS (SELECT doc_id, lines, words, CAST(len(words) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 10 * n_words AND 100 * n_dup_lines <= 50 * len(lines)
       AND 100 * len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) >= 80 * n_words
       AND word_chars BETWEEN 2 * n_words AND 15 * n_words
       AND 100 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(-|\*|•)'))) <= 90 * len(lines)
       AND 100 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) <= 30 * len(lines) AS kept
FROM f"""
