import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "la of the tree stone water runs over green hills and under grey clouds while birds sing songs about summer rain".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text[, source]) as documents, with an extra column or more."""

    def build(rows, **extra):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, SCHEMA).repartition(3)
        from pyspark.sql import functions as F

        for name, value in extra.items():
            frame = frame.withColumn(name, F.lit(value))
        return frame

    return build


#: Names that the operators use inside.
CLASHES = {n: 1 for n in ("fp", "root", "row", "k", "node", "copies", "size", "key", "items", "block", "tie", "a", "spans", "at")}
