import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridsignal.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, "gridsignal-tests")
    yield session
    session.stop()


@pytest.fixture
def small_blocks(spark, monkeypatch):
    """Blocks of seven rows and unmerged ranges, so that short series cross many edges."""
    from gridsignal.operators import ordering

    monkeypatch.setattr(ordering, "BLOCK_ROWS", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture
def series(spark):
    """Positioned series from ``{series_id: values}``; daily stamps."""
    import datetime as dt

    def make(values, start="2020-01-01"):
        first = dt.datetime.fromisoformat(start)
        rows = [
            (name, first + dt.timedelta(days=i), i, v) for name, vs in values.items() for i, v in enumerate(vs)
        ]
        return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, pos long, value double").repartition(5)

    return make
