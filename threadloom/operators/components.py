"""Strongly connected components of one graph of any size, as joins.

What no edge connects, in whichever direction, is told apart first (its pieces), by contraction. A piece of at most SMALL edges is whole in one task, many
to a task; others go through rounds over all of them. A cycle lies within one piece, so either way gives the components of the whole graph.

Rounds of trimming take away nodes that nothing leads to, or that lead nowhere: no cycle holds them. Of what is left, each node takes the smallest
id that leads to it (its colour), by propagation along edges; a node whose colour is its own is a root, and what leads back to a root within its colour
is its component. Components are taken out, and the rest is coloured anew. Every round is a written table; none is collected.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.operators import flows
from threadloom.plans.stages import drop_written, written

#: Rounds of trimming before each colouring.
TRIMS = 3
#: Edges of a piece up to which one task holds it whole; edges of the pieces that are solved together, about.
SMALL, BATCH = 100_000, 20_000


def _replaced(new: DataFrame, old: DataFrame, name: str) -> DataFrame:
    out = written(new, name)
    drop_written(old)
    return out


def trimmed(edges: DataFrame, rounds: int = TRIMS) -> DataFrame:
    """Edges between nodes that are both led to and lead on."""
    for _ in range(rounds):
        before = edges.count()
        inner = edges.select(F.col("source").alias("id")).intersect(edges.select(F.col("target").alias("id")))
        kept = edges.join(inner.withColumnRenamed("id", "source"), "source", "left_semi").join(inner.withColumnRenamed("id", "target"), "target", "left_semi")
        edges = _replaced(kept.select("source", "target"), edges, "scc-edges")
        if edges.count() == before:
            break
    return edges


def coloured(edges: DataFrame) -> DataFrame:
    """(id, colour): the smallest id that leads to each node, its own included. Minima go two steps a round, and only nodes that changed send theirs."""
    colours = written(edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().select("id", F.col("id").alias("colour"), F.lit(True).alias("new")), "scc-colours")
    while True:
        sent = colours.where("new").select(F.col("id").alias("source"), F.col("colour").alias("offer")).join(edges, "source").groupBy(F.col("target").alias("id")).agg(F.min("offer").alias("offer"))
        better = F.col("offer") < F.col("colour")
        nxt = colours.join(sent, "id", "left").select("id", F.when(better, F.col("offer")).otherwise(F.col("colour")).alias("colour"), F.coalesce(better, F.lit(False)).alias("new"))
        colours = _replaced(nxt, colours, "scc-colours")
        if colours.where("new").isEmpty():
            return colours


def pieces(edges: DataFrame) -> DataFrame:
    """(node, piece): what edges connect, regardless of direction, by hashes of ids. Each round a node joins the least of itself and its neighbours, in an
    order of that round; edges between what they joined are left. That shrinks the nodes by a share a round, so all rounds together read a few times the
    edges. Nodes that share a hash make a piece larger, no less whole."""
    now = written(edges.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b")).where("a <> b"), "scc-links")
    rng = random.Random(17)
    steps: list[DataFrame] = []
    while not now.isEmpty():
        mixed = lambda c, by=F.lit(rng.getrandbits(63)): F.col(c).bitwiseXOR(by)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(mixed("b")).alias("least")).select("a", F.least("least", mixed("a")).alias("least"))
        steps.append(written(least.select("a", mixed("least").alias("to")), "scc-joined"))
        ends = now.join(steps[-1].withColumnRenamed("to", "x"), "a").join(steps[-1].select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        now = _replaced(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), now, "scc-links")
    out = steps[-1] if steps else now.select("a", F.col("b").alias("to"))
    for step in reversed(steps[:-1]):
        out = step.join(out.select(F.col("a").alias("to"), F.col("to").alias("last")), "to", "left").select("a", F.coalesce("last", "to").alias("to"))
    out = written(out.select(F.col("a").alias("node"), F.col("to").alias("piece")), "scc-pieces")
    drop_written(now, *steps)
    return out


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component, size) of the components of over one node of edges (source, target); a component is named by its smallest id."""
    every = written(edges.select("source", "target").where("source <> target and source is not null and target is not null").distinct(), "scc-edges")
    parts = pieces(every)
    placed = every.withColumn("node", F.xxhash64("source")).join(parts, "node", "left").select("source", "target", F.coalesce("piece", "node").alias("piece"))
    placed = written(placed, "scc-placed")
    large = written(placed.groupBy("piece").count().where(F.col("count") > small).select("piece"), "scc-large")
    kind = every.schema["source"].dataType.simpleString()
    groups = F.expr(f"pmod(xxhash64(piece), {placed.count() // BATCH + 1})").alias("group")
    whole = placed.join(F.broadcast(large), "piece", "left_anti").select("source", "target", groups)
    found = whole.groupBy("group").applyInPandas(flows.strong_components, f"id {kind}, component {kind}, size long")
    rounds = None
    if not large.isEmpty():
        rounds = in_rounds(placed.join(F.broadcast(large), "piece", "left_semi").select("source", "target"))
        found = found.unionByName(rounds)
    out = written(found, "scc")
    drop_written(every, parts, placed, large, rounds)
    return out


def in_rounds(edges: DataFrame) -> DataFrame:
    """strong_components() of distinct edges between different nodes, by rounds over all of them."""
    left = written(edges, "scc-edges")
    found: list[DataFrame] = []
    while not (left := trimmed(left)).isEmpty():
        colours = coloured(left)
        own = colours.select("id", "colour")
        same = left.join(own.select(F.col("id").alias("source"), F.col("colour").alias("from_")), "source").join(own.select(F.col("id").alias("target"), F.col("colour").alias("to_")), "target").where("from_ = to_").select("source", "target")
        same = written(same, "scc-same")
        members = written(own.where("id = colour"), "scc-members")
        newest = members
        layers = [members]
        while True:
            step = newest.join(same.withColumnRenamed("target", "id"), "id").select(F.col("source").alias("id"), "colour").distinct()
            newest = written(step.join(members, "id", "left_anti"), "scc-layer")
            if newest.isEmpty():
                drop_written(newest)
                break
            layers.append(newest)
            members = written(members.unionByName(newest), "scc-members")
            layers.append(members)
        done = written(members, "scc-found")
        found.append(done)
        gone = done.select(F.col("id").alias("source"))
        rest = left.join(gone, "source", "left_anti").join(gone.withColumnRenamed("source", "target"), "target", "left_anti").select("source", "target")
        left = _replaced(rest, left, "scc-edges")
        drop_written(colours, same, *layers)
    drop_written(left)
    spark = edges.sparkSession
    if not found:
        return spark.createDataFrame([], f"id {edges.schema['source'].dataType.simpleString()}, component {edges.schema['source'].dataType.simpleString()}, size long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    sizes = every.groupBy("colour").agg(F.count("*").alias("size"), F.min("id").alias("component")).where("size > 1")
    out = written(every.join(sizes, "colour").select("id", "component", "size"), "scc")
    drop_written(*found)
    return out


@query(
    "g6_graph_components",
    f"""WITH RECURSIVE {flows.T.EVENTS}, e AS (SELECT DISTINCT trace_id, k AS a, lead(k) OVER (PARTITION BY trace_id ORDER BY event_id) AS b FROM runtime_events),
  r(trace_id, a, b) AS (SELECT trace_id, a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT r.trace_id, r.a, e.b FROM r JOIN e ON e.trace_id = r.trace_id AND e.a = r.b WHERE e.b IS NOT NULL),
  m AS (SELECT x.trace_id || '/' || x.a AS id, x.trace_id || '/' || x.b AS other FROM r x JOIN r y ON y.trace_id = x.trace_id AND y.a = x.b AND y.b = x.a WHERE x.a <> x.b)
  SELECT id, least(id, min(other)) AS component, count(DISTINCT other) + 1 AS size FROM m GROUP BY id""",
)
def g6_graph(spark, sf_dir):
    """The transitions of all users as one graph."""
    node = lambda c: F.concat("trace_id", F.lit("/"), F.col(c).cast("string"))
    return strong_components(flows.transitions(spark, sf_dir).select(node("source").alias("source"), node("target").alias("target")))
