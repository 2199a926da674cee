import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from arrayflow.session import build
    session = build("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_groups(monkeypatch):
    """Every ordered group beyond 20 rows is cut into slices."""
    from arrayflow.functions import ordered
    monkeypatch.setattr(ordered, "SLICE_ROWS", 20)


@pytest.fixture
def frame(spark):
    """Rows with seconds since the epoch in timestamp columns."""
    from pyspark.sql import functions as F

    def make(rows, ddl, ts=()):
        raw = ddl
        for c in ts:
            raw = raw.replace(f"{c} timestamp", f"{c} double")
        df = spark.createDataFrame(rows, raw)
        return df.withColumns({c: F.timestamp_micros((F.col(c) * 1_000_000).cast("bigint")) for c in ts}) if ts else df
    return make


@pytest.fixture
def rows():
    """Rows as plain tuples, sorted."""
    def plain(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)
    return plain
