"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = Path(DATA, f"{name}.parquet")
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(frame) -> list[tuple]:
    """Rows of a pandas frame, columns by name, as comparable text."""
    frame = frame[sorted(frame.columns)].astype(object)
    show = lambda v: "NULL" if v is None or v is pd.NA or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, row)) for row in frame.itertuples(index=False))
