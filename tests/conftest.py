from __future__ import annotations

import glob
import math
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    return c


def plain(x) -> str:
    """A value as text that doesn't depend on the engine's number types."""
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "__float__"):
        return f"{float(x):.6g}" if float(x) != int(x) else str(int(x))
    return str(x)


def same_rows(df, duck, sql: str) -> None:
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = duck.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in answer.fetchall())
    assert len(found) == len(want)
    assert found == want
