"""Registered queries: masking, scanning, redaction and query screening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv
from ledgerwind.functions import phi, text
from ledgerwind.plans.catalog import register
from ledgerwind.plans.oracle_views import cleaned_sql, literal_list, names_sql, normal_sql, scan_sql
from ledgerwind.sources.questions import query_log, questions
from ledgerwind.sources.tables import Lake

DEMO_KEY = "demo-key"
LONG_DEMO_KEY = "demo-key-" * 10


def _hmac_check(value: str, key: str) -> str:
    import hashlib

    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in secret).hex()
    outer = bytes(b ^ 0x5C for b in secret).hex()
    return (
        f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"
    )


@register(
    "phi_tokenize",
    f"""SELECT c_custkey, 'tok_' || substr({_hmac_check('c_name', DEMO_KEY)}, 1, 16) AS name_token,
               'tok_' || substr({_hmac_check('CAST(c_nationkey AS VARCHAR)', LONG_DEMO_KEY)}, 1, 16) AS nation_token
        FROM customer""",
)
def _tokenize(lake: Lake) -> DataFrame:
    return lake.table("customer").select(
        "c_custkey",
        phi.tokenize(F.col("c_name"), DEMO_KEY).alias("name_token"),
        phi.tokenize(F.col("c_nationkey"), LONG_DEMO_KEY).alias("nation_token"),
    )


PATIENTS = [
    "c_custkey AS lop_id",
    "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS patient_name",
    "concat('19', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '-01-01') AS patient_dob",
    "c_mktsegment AS case_type",
]


@register(
    "phi_mask",
    f"""SELECT lop_id, CASE WHEN patient_name IS NULL OR patient_name = '' THEN patient_name
                 ELSE 'tok_' || substr({_hmac_check('patient_name', DEMO_KEY)}, 1, 16) END AS patient_name,
               'tok_' || substr({_hmac_check('patient_dob', DEMO_KEY)}, 1, 16) AS patient_dob, case_type
        FROM (SELECT {', '.join(PATIENTS)} FROM customer)""",
)
def _mask(lake: Lake) -> DataFrame:
    return phi.mask(lake.table("customer").selectExpr(*PATIENTS), "lop", DEMO_KEY)


@register(
    "phi_scan_input",
    f"SELECT question_id, label, label IS NOT NULL AS blocked FROM (SELECT question_id, {scan_sql('question')} AS label FROM questions_v)",
)
def _scan(lake: Lake) -> DataFrame:
    return (
        questions(lake)
        .select("question_id", phi.scan_input(F.col("question")).alias("label"))
        .withColumn("blocked", F.col("label").isNotNull())
    )


@register(
    "proper_names",
    f"SELECT doc_id, len(names) AS n_names, array_to_string(names, '|') AS names FROM (SELECT doc_id, {names_sql('text')} AS names FROM documents)",
)
def _names(lake: Lake) -> DataFrame:
    return (
        lake.spread("documents")
        .select("doc_id", phi.person_names(F.col("text")).alias("found"))
        .select("doc_id", F.size("found").cast("bigint").alias("n_names"), F.array_join("found", "|").alias("names"))
    )


_LABELS = " || ".join(
    f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN ['{label}'] ELSE [] END"
    for label, p in fv.PHI_PATTERNS
)


@register(
    "phi_redact",
    f"""SELECT doc_id, len(labels || names) > 0 AS phi_detected, array_to_string(labels || names, '|') AS matches,
               list_reduce([cleaned] || list_distinct(names), lambda body, name: replace(body, name, '{fv.REDACTED}')) AS redacted_text
        FROM (SELECT doc_id, labels, cleaned, {names_sql('cleaned')} AS names
              FROM (SELECT doc_id, {cleaned_sql('text')} AS cleaned, CAST({_LABELS} AS VARCHAR[]) AS labels FROM
                    (SELECT doc_id, text FROM documents
                     UNION ALL
                     SELECT -1 - c_custkey, question FROM questions_v JOIN customer ON question_id = concat('c-', c_custkey))))""",
)
def _redact(lake: Lake) -> DataFrame:
    asked = questions(lake).filter("question_id LIKE 'c-%'").selectExpr(
        "-1 - CAST(substr(question_id, 3) AS BIGINT) AS doc_id", "question AS text"
    )
    rows = lake.spread("documents").select("doc_id", "text").unionByName(asked)
    return phi.scan_output(rows, "text").select(
        "doc_id", "phi_detected", F.array_join("phi_matches", "|").alias("matches"), "redacted_text"
    )


@register(
    "mutation_phrases",
    f"SELECT log_id, regexp_matches(lower(question), '{'|'.join(fv.MUTATION_PATTERNS)}') AS rejected FROM query_log_v",
)
def _mutations(lake: Lake) -> DataFrame:
    return query_log(lake).select("log_id", text.asks_to_mutate(F.col("question")).alias("rejected"))


@register(
    "domain_relevance",
    f"""SELECT question_id, list_has_any(string_split({normal_sql('question')}, ' '), {literal_list(fv.DOMAIN_TERMS)}) AS relevant,
               sha256(question) AS query_hash, {normal_sql('question')} AS normalised
        FROM questions_v""",
)
def _relevance(lake: Lake) -> DataFrame:
    question = F.col("question")
    return questions(lake).select(
        "question_id",
        text.is_domain_question(question).alias("relevant"),
        text.query_hash(question).alias("query_hash"),
        text.normalise_entity(question).alias("normalised"),
    )


@register(
    "sql_text_cleanup",
    r"""SELECT log_id, regexp_replace(regexp_replace(trim(CASE WHEN trim(sql_text, chr(10) || ' ') LIKE '```%'
              THEN trim(replace(replace(sql_text, '```sql', ''), '```', ''), chr(10) || ' ') ELSE sql_text END, chr(10) || ' '),
              '^SQL: *', ''), ';+$', '') AS sql_text
        FROM query_log_v""",
)
def _cleanup(lake: Lake) -> DataFrame:
    return query_log(lake).select("log_id", text.clean_sql_text(F.col("sql_text")).alias("sql_text"))


@register(
    "hash_embedding",
    r"""SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight
        FROM (SELECT doc_id, CAST('0x' || right(md5(word), 2) AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS n
              FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS word FROM documents)
              WHERE word <> '' GROUP BY ALL)""",
)
def _embedding(lake: Lake) -> DataFrame:
    return text.hash_embedding(lake.spread("documents"), "doc_id", "text").select(
        "doc_id", "bucket", F.round("weight", 9).alias("weight")
    )


# --- real texts: every turn of every conversation and every document -----------------
_TEXTS = """(SELECT concat('t-', conv_id, '-', turn) AS text_id, text FROM conversations
   UNION ALL SELECT concat('d-', doc_id), text FROM documents)"""


def _texts(lake: Lake) -> DataFrame:
    turns = lake.table("conversations").select(F.concat(F.lit("t-"), "conv_id", F.lit("-"), "turn").alias("text_id"), "text")
    return turns.unionByName(lake.table("documents").select(F.concat(F.lit("d-"), "doc_id").alias("text_id"), "text"))


@register(
    "text_screening",
    f"""SELECT text_id, {scan_sql('text')} AS label, regexp_matches(lower(text), '{"|".join(fv.MUTATION_PATTERNS)}') AS mutates,
               list_has_any(string_split({normal_sql('text')}, ' '), {literal_list(fv.DOMAIN_TERMS)}) AS relevant FROM {_TEXTS}""",
)
def _screening(lake: Lake) -> DataFrame:
    """Input scan, mutation phrases and domain relevance over whole real texts."""
    body = F.col("text")
    return _texts(lake).select(
        "text_id", phi.scan_input(body).alias("label"), text.asks_to_mutate(body).alias("mutates"), text.is_domain_question(body).alias("relevant")
    )


@register(
    "phi_redact_turns",
    f"""SELECT text_id, len(labels || names) > 0 AS phi_detected, array_to_string(labels || names, '|') AS matches,
               list_reduce([cleaned] || list_distinct(names), lambda body, name: replace(body, name, '{fv.REDACTED}')) AS redacted_text
        FROM (SELECT text_id, labels, cleaned, {names_sql('cleaned')} AS names
              FROM (SELECT concat('t-', conv_id, '-', turn) AS text_id, {cleaned_sql('text')} AS cleaned, CAST({_LABELS} AS VARCHAR[]) AS labels FROM conversations))""",
)
def _redact_turns(lake: Lake) -> DataFrame:
    rows = lake.table("conversations").select(F.concat(F.lit("t-"), "conv_id", F.lit("-"), "turn").alias("text_id"), "text")
    return phi.scan_output(rows, "text").select("text_id", "phi_detected", F.array_join("phi_matches", "|").alias("matches"), "redacted_text")


CHUNK_WORDS, CHUNK_OVERLAP = 512, 64
_BLANKS_SQL = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@register(
    "text_chunks",
    f"""SELECT doc_id, CAST(start // {CHUNK_WORDS - CHUNK_OVERLAP} AS INTEGER) AS chunk, CAST(least({CHUNK_WORDS}, len(w) - start) AS INTEGER) AS n_words,
               sha256(array_to_string(w[start + 1:start + {CHUNK_WORDS}], ' ')) AS chunk_hash
        FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {CHUNK_OVERLAP}, 1), {CHUNK_WORDS - CHUNK_OVERLAP})) AS start
              FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_BLANKS_SQL}'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)""",
)
def _chunks(lake: Lake) -> DataFrame:
    rows = text.chunks(lake.table("documents"), "doc_id", "text", CHUNK_WORDS, CHUNK_OVERLAP)
    return rows.select("doc_id", "chunk", "n_words", F.sha2("chunk_text", 256).alias("chunk_hash"))
