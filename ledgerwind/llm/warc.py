"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: pages with equal payloads share one response record (that of the largest id);
the others become revisit records.  The archives are Spark text files whose line
separator is the blank lines that end a record, so they need no local folder.

Reading: Spark's text reader cuts the archives at every ``WARC/1.0`` line, wherever it
stands, and in splits of any size.  Each task turns its pieces into candidates: the
piece's offset and, from its Content-Length, the offset of its successor.  Pointer
jumping from offset 0 of every file, doubling the distance each round, marks the
candidates that the chain really reaches; magic lines inside payloads stay unmarked and
their pieces go back to the record they belong to.
"""

from __future__ import annotations

import hashlib
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwind.session import materialise, shared_folder

#: Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"

RECORDS_PER_FILE = 4096
MIN_BYTES = 0  # payloads below it are never revisits

_LEADS = len(MAGIC)


def base32_sha1(payload: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four base32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), HEX32, BASE32)


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    compression: str = "gzip", min_bytes: int = MIN_BYTES, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write one record per row of ``pages``.

    A null html is an empty payload.  A null url leaves its header out; line breaks in
    urls are percent-encoded.  Rows without id never are the response of a group that
    has one; a group without any id has responses only.  Repeated rows of the largest id
    are all responses.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload")
    ).withColumn("digest", base32_sha1(F.encode("payload", "UTF-8")))
    first = rows.groupBy("digest").agg(F.max("id").alias("of")).withColumnRenamed("digest", "of_digest")
    known = rows.join(first, F.col("digest") == F.col("of_digest"))
    small = F.octet_length("payload") < min_bytes
    revisit = ~small & F.col("of").isNotNull() & ~F.coalesce(F.col("id") == F.col("of"), F.lit(False))
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    safe_url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def line(name: str, value: F.Column, use: F.Column | None = None) -> F.Column:
        text = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return text if use is None else F.when(use, text).otherwise(F.lit(""))

    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", safe_url, F.col("url").isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.octet_length("payload").cast("string")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("of").cast("string"), F.lit(">")), revisit),
        line("WARC-Profile", F.lit(PROFILE), revisit),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    writer = known.select(record.alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file)
    writer.option("compression", compression).text(path)


def parse(piece: bytes) -> tuple[int, dict[str, str], int] | None:
    """(header bytes, fields, content length) of a piece behind the magic; None if it is no record."""
    head, end, _ = piece.partition(b"\r\n\r\n")
    if not end:
        return None
    fields = {}
    for row in head.split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    return (len(head) + 4, fields, int(length)) if length.isascii() and length.isdigit() and len(length) < 16 else None


def _reference(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def described(block: bytes, fields: dict[str, str]) -> tuple:
    """What a record says: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    kind = fields.get("warc-type")
    digest, size = fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields.get("x-payload-length", "")
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest, size = b32encode(hashlib.sha1(payload).digest()).decode(), str(len(payload))
    refers = _reference(fields.get("warc-refers-to")) if kind == "revisit" else None
    return (_reference(fields.get("warc-record-id")), fields.get("warc-target-uri"), int(size) if size.isdigit() else None, digest, kind, refers)


_SAID = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_SAID_SQL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("value").cast("binary").alias("piece"), F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int, int]]:
    """Pieces with file, block and offset inside what the block's task reads."""
    at, where = 0, None
    for batch in batches:
        for piece, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            at = at if (file, block) == where else 0
            where, whole = (file, block), piece.as_py()
            yield whole, file, block, at
            at += len(whole) + _LEADS


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "block", "at", "size", "span", "whole", *(n for n, _ in _SAID)]
    types = [pa.int64()] * 5 + [pa.bool_()] + [t for _, t in _SAID]
    rows = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for piece, file, block, at in _located(batches):
        told = parse(piece)
        span, whole, said = None, False, (None,) * 6
        if told:
            head, fields, length = told
            span, whole = _LEADS + head + length + len(RECORD_END), head + length <= len(piece)
            if whole:
                said = described(piece[head : head + length], fields)
        rows.append((file, block, at, len(piece) + _LEADS, span, whole, *said))
        if len(rows) >= 4096:
            yield flush()
            rows.clear()
    yield flush()


def _reached(links: DataFrame) -> DataFrame:
    """(file, offset) of what the chains from offset 0 reach, over ``links`` (file, offset, next)."""
    nodes = materialise(links.select("file", "offset", "next", (F.col("offset") == 0).alias("mark")), "chain")
    marked = -1
    while (now := nodes.where("mark").count()) != marked:
        marked = now
        for _ in range(2):
            hit = nodes.where("mark and next is not null").select(F.col("file").alias("hf"), F.col("next").alias("ho")).distinct()
            jump = nodes.select(F.col("file").alias("jf"), F.col("offset").alias("jo"), F.col("next").alias("jn"))
            nodes = (
                nodes.join(hit, (F.col("file") == F.col("hf")) & (F.col("offset") == F.col("ho")), "left")
                .join(jump, (F.col("file") == F.col("jf")) & (F.col("next") == F.col("jo")), "left")
                .select("file", "offset", F.col("jn").alias("next"), (F.col("mark") | F.col("hf").isNotNull()).alias("mark"))
            )
        nodes = materialise(nodes, "chain")
    return nodes.where("mark").select("file", "offset")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record that the chain from the start of its file reaches.

    Columns page_id, url, payload_bytes, payload_digest, record_type and refers_to; size
    and digest of a response come from the bytes read.  A file that does not start with
    a record, or the part of one behind a broken record, yields nothing.
    """
    found = materialise(
        _pieces(spark, path).mapInArrow(_candidates, f"file long, block long, at long, size long, span long, whole boolean, {_SAID_SQL}"), "candidates"
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.groupBy("file", "block").agg(F.sum("size").alias("read"))
    bases = bases.select(F.col("file").alias("bf"), F.col("block").alias("bb"), F.coalesce(F.sum("read").over(before), F.lit(0)).alias("base"))
    located = found.join(bases, (F.col("file") == F.col("bf")) & (F.col("block") == F.col("bb")))
    start = F.col("base") + F.col("at") - _LEADS
    located = materialise(located.withColumn("offset", start).where("offset >= 0").withColumn("next", F.col("offset") + F.col("span")).drop("bf", "bb"), "located")
    reached = _reached(located.where("span is not null").select("file", "offset", "next"))
    reached = reached.select(F.col("file").alias("rf"), F.col("offset").alias("ro"))
    kept = located.join(reached, (F.col("file") == F.col("rf")) & (F.col("offset") == F.col("ro")))
    said = [n for n, _ in _SAID]
    single = kept.where("whole").select(said)
    if kept.where("not whole").isEmpty():
        return single
    return single.unionByName(_assembled(spark, path, located, kept).select(said))


def _assembled(spark: SparkSession, path: str, located: DataFrame, kept: DataFrame) -> DataFrame:
    """Records whose payload holds magic lines, put together from their pieces."""
    split = kept.where("not whole").select(F.col("file").alias("sf"), F.col("offset").alias("so"), F.col("next").alias("sn"))
    # each piece meets its owner by the last reached split record at or before it in the file
    order = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owners = split.select(F.col("sf").alias("file"), F.col("so").alias("offset"), F.col("sn").alias("until"))
    owned = (
        located.select("file", "block", "at", "offset").join(owners, ["file", "offset"], "left")
        .withColumn("owner", F.last(F.when(F.col("until").isNotNull(), F.struct("offset", "until")), True).over(order))
        .where(F.col("offset") < F.col("owner.until"))
        .select(F.col("file").alias("of"), F.col("block").alias("ob"), F.col("at").alias("oa"), "offset", F.col("owner.offset").alias("owner"))
    )

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, file, block, at in _located(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.binary()), *(pa.array([v], pa.int64()) for v in (file, block, at))], names=["piece", "file", "block", "at"]
            )

    pieces = _pieces(spark, path).mapInArrow(again, "piece binary, file long, block long, at long")
    mine = pieces.join(owned, (F.col("file") == F.col("of")) & (F.col("block") == F.col("ob")) & (F.col("at") == F.col("oa")))
    # one record's pieces: as much as the record itself
    records = mine.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column("parts").to_pylist():
                piece = MAGIC.encode().join(p["piece"] for p in parts)
                head, fields, length = parse(piece)
                if head + length <= len(piece):  # else the archive ends inside the record
                    rows.append(described(piece[head : head + length], fields))
            columns = list(zip(*rows)) or [()] * len(_SAID)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _SAID, strict=True)], names=[n for n, _ in _SAID])

    return records.select("parts").mapInArrow(join, _SAID_SQL)


def round_trip(pages: DataFrame, compression: str = "gzip") -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back: one row per page."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/stages/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, compression=compression)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB; the base32 digest is made of the hex digest, five digits at a time.
WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS of FROM p GROUP BY h),
x AS (SELECT p.*, g.of, list_aggregate(list_transform(range(32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)),
        'string_agg', '') AS d FROM p JOIN g USING (h))
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN of IS NOT NULL AND page_id IS DISTINCT FROM of THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN of IS NOT NULL AND page_id IS DISTINCT FROM of THEN of END AS refers_to
FROM x"""
