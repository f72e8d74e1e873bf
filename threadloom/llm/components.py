"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) for directed pairs: m is the least of u and all its v. Only minima are gathered by node, never its links."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links` (u, v: long): the smallest node reachable. Rounds grow with the logarithm
    of the longest chain; each is written in the shared folder, and the one before it removed; drop_written() of the result removes the last."""
    now = common.written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = _state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        nxt = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = common.written(nxt, "links")
        common.drop_written(now)
        now, before = nxt, state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out.path_ = now.path_
    return out
