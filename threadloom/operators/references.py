"""References between parts of a document: `$ref` chains, followed by joins, a hop a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.plans.stages import written
from threadloom.sources import tables as T

HOPS = 8  # fixed value


def followed(items: DataFrame, hops: int = HOPS) -> DataFrame:
    """(document, pointer, target, hops, stopped) of items (document, pointer, ref: null, "#/..." or else): the item that each one's chain of local
    references comes to. It stops early where a reference leaves the document ("remote"), leads nowhere ("missing"), comes back ("cycle"), or is one more
    than `hops` ("long"). Every hop is one join on (document, pointer), written; only open chains take part in the next."""
    known = items.select("document", F.col("pointer").alias("next_"), F.col("ref").alias("then_"), F.lit(True).alias("there_"))
    start = items.select("document", "pointer", F.col("pointer").alias("target"), "ref", F.array().cast("array<string>").alias("seen_"), F.lit(0).alias("hops"))
    open_ = written(start, "refs")
    done: list[DataFrame] = []
    for hop in range(hops + 1):
        local = F.col("ref").startswith("#/")
        to = F.substring("ref", 2, 1 << 20)
        stopped = F.when(F.col("ref").isNull(), F.lit(None)).when(~local, "remote").when(F.array_contains("seen_", to), "cycle")
        judged = open_.withColumns({"stopped": stopped.cast("string"), "next_": F.when(stopped.isNull() & local, to)})
        done.append(judged.where("next_ is null").select("document", "pointer", "target", "hops", "stopped"))
        going = judged.where("next_ is not null")
        if hop == hops:
            done.append(going.select("document", "pointer", "target", "hops", F.lit("long").alias("stopped")))
            break
        met = written(going.join(known, ["document", "next_"], "left"), "refs-met")
        done.append(met.where("there_ is null").select("document", "pointer", "target", "hops", F.lit("missing").alias("stopped")))
        open_ = met.where("there_").select("document", "pointer", F.col("next_").alias("target"), F.col("then_").alias("ref"), F.array_append("seen_", F.col("next_")).alias("seen_"), (F.col("hops") + 1).alias("hops"))
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def given_items(spark, sf_dir: str) -> DataFrame:
    """Customers as items of their nation's document, each with a reference to the next; some have none, or one that leads out or nowhere."""
    c = T.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    nxt = F.coalesce(F.lead("c_custkey").over(order), F.min("c_custkey").over(Window.partitionBy("c_nationkey")))
    k = F.col("c_custkey")
    ref = F.when(k % 23 == 0, F.lit(None)).when(k % 29 == 0, "other.json#/c/1").when(k % 31 == 0, "#/c/0").otherwise(F.concat(F.lit("#/c/"), nxt.cast("string")))
    return c.select(F.col("c_nationkey").alias("document"), F.concat(F.lit("/c/"), k.cast("string")).alias("pointer"), ref.alias("ref"))


@query(
    "x9_local_references",
    f"""WITH RECURSIVE i AS (SELECT c_nationkey AS document, '/c/' || c_custkey AS pointer, CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 'other.json#/c/1' WHEN c_custkey % 31 = 0 THEN '#/c/0'
    ELSE '#/c/' || coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), min(c_custkey) OVER (PARTITION BY c_nationkey)) END AS ref FROM customer),
  w(document, pointer, target, ref, seen, hops) AS (SELECT document, pointer, pointer, ref, CAST([] AS VARCHAR[]), 0 FROM i
    UNION ALL SELECT w.document, w.pointer, i.pointer, i.ref, list_append(w.seen, i.pointer), w.hops + 1 FROM w JOIN i ON i.document = w.document AND i.pointer = w.ref[2:] WHERE w.hops < {HOPS} AND starts_with(w.ref, '#/') AND NOT list_contains(w.seen, w.ref[2:])),
  last AS (SELECT document, pointer, max_by(target, hops) AS target, max_by(coalesce(ref, ''), hops) AS ref, max_by(seen, hops) AS seen, max(hops) AS hops FROM w GROUP BY ALL)
  SELECT document, pointer, target, hops, CASE WHEN ref = '' THEN NULL WHEN NOT starts_with(ref, '#/') THEN 'remote' WHEN list_contains(seen, ref[2:]) THEN 'cycle' WHEN hops = {HOPS} THEN 'long' ELSE 'missing' END AS stopped FROM last""",
)
def x9(spark, sf_dir):
    return followed(given_items(spark, sf_dir))
