"""Helpers that the training-data operators share: table access, written intermediates, bounded settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.stages import drop_path, drop_written, new_path, shared_dir, written

__all__ = ["Remembered", "batches", "crc_bucket", "drop_path", "drop_written", "join_ids", "new_path", "settled", "shared_dir", "table", "whole_texts", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str, *intermediates: DataFrame | None) -> DataFrame:
    """`df` written in the shared folder and read back, after which the tables that it was made from are removed."""
    out = written(df, name)
    drop_written(*intermediates)
    return out


#: Ids (numbers) that a join may broadcast, once they are counted: 16 MB or so. More of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def join_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined on doc_id ("left_semi" or "left_anti") with a table of ids. It is written and counted first: a few ids are
    broadcast, so that whole texts aren't shuffled for them."""
    ids = written(ids.select("doc_id").distinct(), "ids")
    few = ids.schema["doc_id"].dataType.simpleString() in ("bigint", "int") and ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def whole_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and named further columns; any other columns are left behind."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def crc_bucket(col: str, n: int):
    """crc32 of a number written as text, modulo n: the split into learning and held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def batches(table_iter, rows: int = 512, bytes_: int = 8 << 20, column: str = "text"):
    """Cut Arrow batches so that no slice has over `rows` rows, or over `bytes_` of one text column (one row at least)."""
    import numpy as np

    for batch in table_iter:
        n = batch.num_rows
        if not n:
            continue
        import pyarrow.compute as pc

        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start = 0
        ends = np.cumsum(size)
        while start < n:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + bytes_, side="right"))
            stop = min(max(stop, start + 1), start + rows, n)
            yield batch.slice(start, stop - start)
            start = stop


class Remembered(dict):
    """What `make` gives for a string, kept for the strings met lately: `most` of them, and those before them as long as they are asked for.
    Long ones are rare, and made anew."""

    def __init__(self, make, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key: str):
        if len(key) > self.longest:
            return self.make(key)
        out = self.older[key] if key in self.older else self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out
