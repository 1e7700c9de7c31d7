import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerwind.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4)
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Build a dense series of one or more entities from plain lists."""
    import datetime as dt

    from ledgerwind.operators.forecast import dense_series

    def build(**values):
        start = dt.date(2025, 1, 1)
        rows = [("facility", e, start + dt.timedelta(days=i), float(y)) for e, ys in values.items() for i, y in enumerate(ys)]
        return dense_series(spark.createDataFrame(rows, "entity_type string, entity_id string, ds date, y double"))

    return build
