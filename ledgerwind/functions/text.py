"""Text column helpers: normalising, formatting, screening and hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwind import fixed_values as fv


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def normalise_entity(text: Column) -> Column:
    """Lower case, anything but letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def asks_to_mutate(text: Column) -> Column:
    """Whether a question asks outright for data to be changed."""
    return F.lower(text).rlike("|".join(f"(?:{p})" for p in fv.MUTATION_PATTERNS))


def is_domain_question(text: Column) -> Column:
    terms = F.array(*[F.lit(t) for t in fv.DOMAIN_TERMS])
    return F.arrays_overlap(F.split(normalise_entity(text), " "), terms)


def query_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def clean_sql_text(text: Column) -> Column:
    """Logged SQL without code fences, a leading ``sql:`` label or trailing semicolons."""
    fenced = F.regexp_extract(strip(text), r"(?is)\A```(?:sql)?\s*(.*?)\s*```\z", 1)
    body = F.when(strip(text).rlike(r"(?is)\A```.*```\z"), strip(fenced)).otherwise(strip(text))
    unlabelled = strip(F.regexp_replace(body, r"(?i)\Asql:", ""))
    return F.regexp_replace(unlabelled, r";+\z", "")


def title_case(text: Column) -> Column:
    """Capitalise every run of letters, lower-casing the rest of the run."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 2**31 - 1)))), ""
    )


def spaced(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def settled(value: Column) -> Column:
    """The value without the last digits that depend on summation order.

    Text must not change with the partitioning, and a sum that lands on a half
    would otherwise round either way.
    """
    return F.round(value, 4)


def whole(value: Column) -> Column:
    """``1,234`` — half to even."""
    return F.format_number(settled(value), 0)


def whole_plain(value: Column) -> Column:
    """``1234`` — half to even, no separators."""
    return F.replace(whole(value), F.lit(","), F.lit(""))


def dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), whole(value))


def percent(value: Column, places: int = 1, signed: bool = False) -> Column:
    body = F.concat(F.replace(F.format_number(settled(value * 100), places), F.lit(","), F.lit("")), F.lit("%"))
    return F.when(value >= 0, F.concat(F.lit("+"), body)).otherwise(body) if signed else body


def words(text: Column) -> Column:
    """Lower-cased words between blanks of any script."""
    return F.filter(F.split(F.lower(text), f"[{fv.BLANKS}]+"), lambda w: F.length(w) > 0)


def chunks(frame: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """``(key, chunk, n_words, chunk_text)``: runs of ``size`` words, each sharing ``overlap`` with the one before.

    The last chunk ends with the text; one that would only repeat the overlap is left
    out.  Texts without words have none.
    """
    found = F.filter(F.split(F.col(text), f"[{fv.BLANKS}]+"), lambda w: F.length(w) > 0)
    last = F.greatest(F.size("_words") - overlap - 1, F.lit(0))
    cut = frame.select(key, found.alias("_words")).filter(F.size("_words") > 0).select(
        key, "_words", F.posexplode(F.sequence(F.lit(0), last, F.lit(size - overlap))).alias("chunk", "_start")
    )
    part = F.slice("_words", F.col("_start") + 1, F.lit(size))
    return cut.select(key, "chunk", F.size(part).alias("n_words"), F.array_join(part, " ").alias("chunk_text"))


def _counted(frame: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, cells, norm)``: a text's filled buckets with their counts, 256 at most.

    A word falls into bucket ``md5(word) mod 256``, the last byte of its digest.
    Counting is map-side first, so at most 256 rows per text are shuffled
    however long the text is, and one text never has to fit in one row.
    """
    bucket = F.conv(F.substring(F.md5("word"), 31, 2), 16, 10).cast("int")
    counts = (
        frame.select(key, F.explode(words(F.col(text))).alias("word"))
        .select(key, bucket.alias("bucket"))
        .groupBy(key, "bucket")
        .agg(F.count("*").alias("n"))
    )
    norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda total, cell: total + cell["n"] * cell["n"]))
    return counts.groupBy(key).agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).withColumn("norm", norm)


def hash_embedding(frame: DataFrame, key: str, text: str) -> DataFrame:
    """Unit-length hashed bag of words as sparse rows ``(key, bucket, weight)``."""
    return (
        _counted(frame, key, text).select(key, F.inline("cells"), "norm")
        .select(key, "bucket", "n", (F.col("n") / F.col("norm")).alias("weight"))
    )


def embed_text(frame: DataFrame, key: str, text: str) -> DataFrame:
    """The same embedding as one dense ``array<double>`` per key, from the same gathered cells."""
    buckets = F.sequence(F.lit(0), F.lit(fv.EMBEDDING_DIM - 1))
    # bound by an outer lambda: as a column Spark would make the map and the norm again for every bucket
    once = F.array(F.struct(F.map_from_entries("cells").alias("n"), F.col("norm").alias("norm")))
    dense = F.transform(once, lambda c: F.transform(buckets, lambda b: F.coalesce(c["n"][b] / c["norm"], F.lit(0.0))))
    return _counted(frame, key, text).select(key, dense[0].alias("vector"))
