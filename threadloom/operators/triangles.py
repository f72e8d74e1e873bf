"""Common neighbours of adjacent nodes, by triangles.

Each edge points from its end of smaller degree to the other (ties by id), so however busy a node is, few edges leave it: the wedges that are
tried are at most the edges times the root of twice their number. Every triangle is found once, at its smallest corner, and counts for its three edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.operators import flows
from threadloom.plans.stages import written
from threadloom.sources import tables as T


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, common): each undirected edge of edges (source, target), a before b, and how many neighbours its ends share. Loops, repeats, and
    edges with a missing end don't count."""
    a, b = F.least("source", "target"), F.greatest("source", "target")
    pairs = written(edges.where("source <> target").select(a.alias("a"), b.alias("b")).distinct(), "pairs")
    degree = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).groupBy("id").agg(F.count("*").alias("degree"))
    sized = pairs.join(degree.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    out = written(sized.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(first, F.col("db")).otherwise(F.col("da")).alias("dv")), "pointed")
    one, two = out.select("u", F.col("v").alias("x"), F.col("dv").alias("dx")), out.select("u", F.col("v").alias("y"), F.col("dv").alias("dy"))
    wedges = one.join(two, "u").where(F.struct("dx", "x") < F.struct("dy", "y")).select("u", "x", "y")
    closed = wedges.join(out.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"], "left_semi")
    side = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    counts = closed.select(F.explode(F.array(side("u", "x"), side("u", "y"), side("x", "y"))).alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("common"))
    return pairs.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).cast("long").alias("common"))


@query(
    "u7_adjacent_pairs",
    f"""WITH {T.EVENTS}, t AS (SELECT trace_id, k AS x, lead(k) OVER (PARTITION BY trace_id ORDER BY event_id) AS y FROM runtime_events),
  e AS (SELECT DISTINCT least(x, y) AS x, greatest(x, y) AS y, trace_id FROM t WHERE x <> y), n AS (SELECT trace_id, x, y FROM e UNION ALL SELECT trace_id, y, x FROM e),
  c AS (SELECT e.trace_id, e.x, e.y, count(*) AS common FROM e JOIN n p ON p.trace_id = e.trace_id AND p.x = e.x JOIN n q ON q.trace_id = e.trace_id AND q.x = e.y AND q.y = p.y GROUP BY ALL)
  SELECT least(e.trace_id || '/' || e.x, e.trace_id || '/' || e.y) AS a, greatest(e.trace_id || '/' || e.x, e.trace_id || '/' || e.y) AS b, coalesce(common, 0) AS common FROM e LEFT JOIN c ON c.trace_id = e.trace_id AND c.x = e.x AND c.y = e.y""",
)
def u7_adjacent(spark, sf_dir):
    """The users' transitions as one undirected graph."""
    node = lambda c: F.concat("trace_id", F.lit("/"), F.col(c).cast("string"))
    return common_neighbours(flows.transitions(spark, sf_dir).select(node("source").alias("source"), node("target").alias("target")))
