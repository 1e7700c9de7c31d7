"""Tamper-evident audit chains.

Each row carries the hash of the row before it and its own hash over that and
its canonical text; a chain is never cut.  Building is sequential by nature: a
chain's rows stream in order through one task that holds the last hash only.
Verifying needs no order: every row is joined to its predecessor by that one's
hash, so the rows of a long chain spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerwind import fixed_values as fv


def canonical_json(columns: Sequence[str]) -> Column:
    """Keys sorted, no blanks, nulls and non-ASCII kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def _link(previous: Column, text: Column) -> Column:
    return F.sha2(F.concat(previous, text), 256)


def build_chain(rows: DataFrame, chain: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Add ``prev_hash`` and ``row_hash``; ``order`` numbers the rows of a chain uniquely."""
    columns = rows.columns
    laid = rows.withColumn("_text", canonical_json(fields)).repartition(chain).sortWithinPartitions(chain, order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, ""
        for batch in batches:
            before, own = [], []
            for key, text in zip(batch.column(chain).to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if at is None or key != at[0]:
                    at, last = (key,), ""
                before.append(last)
                last = hashlib.sha256((last + text).encode()).hexdigest()
                own.append(last)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*columns, "prev_hash", "row_hash"]
            )

    added = [StructField(c, StringType()) for c in ("prev_hash", "row_hash")]
    return laid.mapInArrow(walk, StructType([*rows.schema.fields, *added]))


def chain_seals(chained: DataFrame, chain: str, order: str) -> DataFrame:
    """The tail and length of every chain, with a hash over both; kept apart, they show cut tails."""
    tails = chained.groupBy(chain).agg(F.max_by("row_hash", order).alias("tail_hash"), F.count("*").alias("rows"))
    return tails.withColumn("row_hash", F.sha2(canonical_json(["tail_hash", "rows"]), 256))


def cut_tails(chained: DataFrame, seals: DataFrame, chain: str, order: str) -> DataFrame:
    """Sealed chains whose tail or length is no longer what the seal says."""
    now = chain_seals(chained, chain, order).select(F.col(chain).alias("_chain"), F.col("row_hash").alias("_now"))
    return seals.join(now, F.col(chain).eqNullSafe(F.col("_chain")), "left").filter(~F.col("row_hash").eqNullSafe(F.col("_now"))).select(chain)


def _checked(chained: DataFrame, chain: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Every row with ``_intact``.

    A row is intact if its hash follows from its own content, if the row whose hash
    it names is there and stands before it, and if no earlier row names the same
    one.  When all rows are, the links form one line in the chain's order.
    """
    sources = chained.groupBy(chain, "row_hash").agg(F.min(order).alias("_source")).select(
        F.col(chain).alias("_source_chain"), F.col("row_hash").alias("_source_hash"), "_source"
    )
    first = chained.groupBy(chain, "prev_hash").agg(F.min(order).alias("_first")).select(
        F.col(chain).alias("_first_chain"), F.col("prev_hash").alias("_first_hash"), "_first"
    )
    joined = chained.join(
        sources, F.col(chain).eqNullSafe(F.col("_source_chain")) & (F.col("prev_hash") == F.col("_source_hash")), "left"
    ).join(first, F.col(chain).eqNullSafe(F.col("_first_chain")) & F.col("prev_hash").eqNullSafe(F.col("_first_hash")), "left")
    content = F.col("row_hash").eqNullSafe(_link(F.col("prev_hash"), canonical_json(fields)))
    follows = (F.col("prev_hash") == "") | (F.col("_source") < F.col(order))
    alone = F.col("_first") == F.col(order)
    return joined.withColumn("_intact", content & F.coalesce(follows, F.lit(False)) & F.coalesce(alone, F.lit(False)))


def broken_rows(chained: DataFrame, chain: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Rows whose stored hashes do not follow from the row before them."""
    return _checked(chained, chain, order, fields).filter("not _intact").select(*chained.columns)


def verify_chain(chained: DataFrame, chain: str, order: str, fields: Sequence[str]) -> DataFrame:
    """``(is_intact, first_broken)`` per chain; -1 when nothing is broken."""
    checked = _checked(chained, chain, order, fields)
    return checked.groupBy(chain).agg(F.min(F.when(~F.col("_intact"), F.col(order))).alias("_first_broken")).select(
        chain, F.col("_first_broken").isNull().alias("is_intact"), F.coalesce("_first_broken", F.lit(-1)).alias("first_broken")
    )


def audit_events(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows in the audit layout; fields that are not given are null."""
    given = {**{f: F.lit(None).cast("string") for f in fv.AUDIT_FIELDS}, **values}
    return rows.select(*[given[f].alias(f) for f in fv.AUDIT_FIELDS])


def compliance_events(scanned: DataFrame, key: str, labels: str, where: str, service: str) -> DataFrame:
    """One audit event for every text a scanner reacted to."""
    hits = scanned.filter(F.size(labels) > 0)
    detail = F.to_json(F.struct(F.col(labels).alias("matches"), F.lit(True).alias("compliance_alert")))
    return audit_events(
        hits,
        event_id=F.sha2(F.concat_ws("|", F.lit(service), F.lit(where), F.col(key).cast("string")), 256),
        service=F.lit(service),
        action=F.lit(f"PHI_DETECTED_{where}"),
        input_phi_scan=F.lit("blocked"),
        output_phi_scan=F.lit("n/a"),
        detail_json=detail,
        session_id=F.col(key).cast("string"),
    )
