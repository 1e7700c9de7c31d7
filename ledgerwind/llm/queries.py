"""The registered queries of this subpackage and their check statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerwind.llm.codes import CODES_SQL
from ledgerwind.llm.contamination import CONTAMINATION_SQL
from ledgerwind.llm.quality import QUALITY_SQL
from ledgerwind.llm.turns import TURNS_SQL
from ledgerwind.llm.urls import URLS_SQL
from ledgerwind.llm.vectors import VECTORS_SQL
from ledgerwind.llm.warc import WARC_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {"op2_pivot_join": VECTORS_SQL, "op4_url_templates": URLS_SQL, "op9_warc_chain": WARC_SQL, "op10_quality_cascade": QUALITY_SQL, "op11_vector_codes": CODES_SQL, "op12_conversation_repair": TURNS_SQL, "op13_contamination": CONTAMINATION_SQL}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op3_simhash_anchors(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query
def op10_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.quality import quality_report

    return quality_report(table(spark, folder, "documents"))


@query
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.mixing import mixed_sizes

    return mixed_sizes(table(spark, folder, "documents"))


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.sharding import shards_by_bytes

    return shards_by_bytes(table(spark, folder, "documents"))


@query
def op9_warc_chain(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.warc import round_trip

    return round_trip(table(spark, folder, "pages"))


@query
def op4_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.urls import url_verdicts

    return url_verdicts(table(spark, folder, "pages"))


@query
def op2_pivot_join(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.vectors import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.secrets import secret_report

    return secret_report(table(spark, folder, "documents"))


@query
def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.repeats import removal_report

    return removal_report(table(spark, folder, "documents"))


@query
def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_pieces, pieces and round_trip of every document."""
    from pyspark.sql import functions as F

    from ledgerwind.llm.pieces import encode
    from ledgerwind.llm.vocabularies import default_model

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return encode(docs, default_model(), drop_text=True).select("doc_id", F.size("pieces").alias("n_pieces"), "pieces", "round_trip")


@query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.codes import code_report

    return code_report(table(spark, folder, "embeddings"))


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.turns import repair_report

    return repair_report(table(spark, folder, "conversations"))


@query
def op13_contamination(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerwind.llm.contamination import contamination_report

    return contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
