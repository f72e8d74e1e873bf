from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL

LONG = "word " * 40_000
ODD = [
    (1_000_001, None, "en", "s", 0),
    (1_000_002, "", None, None, None),
    (1_000_003, " \t\n ", "en", None, 3),
    (1_000_004, "12345 !!! ...", "en", "s", 13),
    (1_000_005, LONG, "en", "s", len(LONG)),
    (1_000_006, "same text twice over and over again, for good", "en", "s", 45),
    (1_000_007, "same text twice over and over again, for good", "en", "s", 45),
    (1_000_007, "same text twice over and over again, for good", "en", "s", 45),
    (1_000_008, "😀 <|endoftext|> É ß </s> \\ <| |>", "de", "s", 30),
    (None, "a row that has no id at all", None, "s", 27),
]


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents, rows of every odd kind, and columns that clash with what the operators name theirs."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame(ODD, d.schema)
    clash = {c: F.lit(7) for c in ("fp", "k1", "k2", "spans", "lang_pred", "score", "row_", "base_email", "length", "bucket", "set", "rows", "node", "whole_", "y")}
    return d.unionByName(odd).withColumns(clash)


@pytest.fixture(scope="session")
def texts(documents):
    return [(r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(spark, documents):
    return spark.createDataFrame([], documents.schema)
