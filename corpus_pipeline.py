"""A training corpus made of ``documents`` by five stages of the ``llm`` operators.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its
result is written as Parquet and read again as the next one's ``docs``.  Every stage
takes nulls in any column, empty and very long texts, repeated rows, extra columns and
empty tables; all but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ledgerwind.llm.mixing import repeat_documents
from ledgerwind.llm.pieces import encode
from ledgerwind.llm.quality import keep_good
from ledgerwind.llm.secrets import redact
from ledgerwind.llm.simhash import keep_one
from ledgerwind.llm.vocabularies import default_model
from ledgerwind.session import materialise, release, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before = (0, 0)  # marks around the tables that the stage before has left


def _stage(function: Stage) -> Stage:
    """A stage that first removes what the stage before it stored: that one's result has been written."""

    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _before
        release(spark, *_before)
        since = written()
        out = function(spark, docs, sf_dir)
        _before = (since, written())
        return out

    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return keep_good(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that share 0.8 or more of their five-word shingles: one document of each group stays."""
    return keep_one(docs)


@_stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mark; all documents stay."""
    return redact(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, 0 to 2 times."""
    return repeat_documents(docs)


@_stage
def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, and whether those give the text again."""
    return encode(docs, default_model())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("sentence_pieces", sentence_pieces),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
