"""Graph queries over (nodes, edges): neighbourhoods, closures, degrees, views. Bounds and truncation are part of the results.

Layers are joins and anti-joins; what a layer keeps is ordered and bounded before the next one, so frontiers are small and
the edges are scanned once a layer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.plans.stages import drop_written, written
from threadloom.sources import tables as T


#: Ids that are sent whole to each executor.
BROADCAST_IDS = 200_000
#: Ids that one task holds in a hashed table, about.
HASHED_IDS = 100_000


def touching(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Edges with either end among frontier ids. Two equi-joins: a join on OR would compare everything with everything."""
    ids = frontier.select("id")
    out = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    back = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return out.unionByName(back).dropDuplicates(["id"])


def neighborhood(nodes: DataFrame, edges: DataFrame, roots: list[str], depth: int = 1, limit: int = 250, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, truncated) around roots, undirected, layer by layer. A layer's edges are cut at 4 * limit by id, its new nodes at
    the room that is left, by id; only edges that touched an expanded frontier are returned."""
    limit, depth = max(1, min(limit, 500)), min(depth, 4)
    cap = min(50, limit)
    truncated = len(roots) > cap
    spark = nodes.sparkSession
    # written once: each layer asks it, and edges are often a union of joins
    whole = kinds is None and hasattr(edges, "path_")
    chosen = edges if whole else written((edges if kinds is None else edges.where(F.col("kind").isin(kinds))).select("id", "source", "target"), "chosen")
    ids = lambda values: F.broadcast(spark.createDataFrame([(v,) for v in values], "id string"))
    # every list below is bounded by `limit` or 4 * limit, whatever the size of the graph, so nodes and edges are never shuffled to meet one
    selected = {r["id"] for r in nodes.join(ids(roots[:cap]), "id", "left_semi").select("id").collect()}
    frontier, kept = sorted(selected), {}
    for _ in range(depth):
        if not frontier:
            break
        if len(selected) >= limit:
            truncated = True
            break
        found = touching(chosen, ids(frontier)).orderBy("id").limit(4 * limit + 1).collect()
        truncated |= len(found) > 4 * limit
        found = found[: 4 * limit]
        kept |= {r["id"]: r for r in found}
        new = sorted({r["target"] if r["source"] in selected else r["source"] for r in found} - selected)
        room = limit - len(selected)
        truncated |= len(new) > room
        loaded = sorted(r["id"] for r in nodes.join(ids(new[:room]), "id", "left_semi").select("id").collect()) if new[:room] else []
        selected |= set(loaded)
        frontier = loaded
    if not whole:
        drop_written(chosen)
    both = sorted(k for k, r in kept.items() if r["source"] in selected and r["target"] in selected)
    return nodes.join(ids(sorted(selected)), "id", "left_semi"), edges.join(ids(both[: 4 * limit]), "id", "left_semi"), truncated


def near(ids: DataFrame, *keys: str) -> DataFrame:
    """A written table of ids as the looked-up side of a join: whole to each executor if it is small, else hashed, so that the other side is never sorted.
    A hashed table can't be spilled, so they are dealt by their keys (`id`) to so many tasks that each holds HASHED_IDS of them at most."""
    rows = ids.count()  # that of the files' footers
    if rows <= BROADCAST_IDS:
        return F.broadcast(ids)
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // HASHED_IDS))
    return ids.repartition(parts, *(keys or ("id",))).hint("shuffle_hash")


def reachable(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth): the ids that start ids reach along edges, with their least distance; up to `depth` steps, or all of them.
    Each layer is written once: the edges are scanned once a layer, and no plan holds the ones before it."""
    layers = [written(start.select("id", F.lit(0).alias("depth")), "layer")]
    hops = written(edges.select(F.col("source").alias("id"), "target"), "hops")
    while depth is None or len(layers) <= depth:
        step = hops.join(near(layers[-1].select("id")), "id", "left_semi").select(F.col("target").alias("id")).distinct()
        seen = reduce(DataFrame.unionByName, layers)
        new = written(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(len(layers))), "layer")
        if new.isEmpty():
            break
        layers.append(new)
    drop_written(hops)
    return reduce(DataFrame.unionByName, layers)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("id", F.col("target").alias("source"), F.col("source").alias("target"), "kind")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree of nodes; a loop counts twice, edges that lead nowhere don't count."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in_")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in_")))
    sums = ends.groupBy("id").agg(F.sum("in_").alias("in_degree"), F.sum("out").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.join(sums, "id", "left").select("id", "kind", "label", zero("in_degree"), zero("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def roots_of(nodes: DataFrame, text: str, n: int) -> list[str]:
    """The first `n` nodes whose label or path holds a text, files first, then by label and id."""
    rows = nodes.where(X.contains_fold(F.col("label"), text) | X.contains_fold(F.col("file_path"), text)).orderBy(F.when(F.col("kind") == "file", 0).otherwise(1), "label", "id").limit(n)
    return [r["id"] for r in rows.select("id").collect()]


GRAPH = f"WITH {T.NODES}, {T.EDGES}"
LAYER = """, f0 AS (SELECT id FROM nodes WHERE id IN ('controller:3', 'class:7')),
  t1 AS (SELECT e.*, source IN (FROM f0) AS from_source FROM edges e WHERE source IN (FROM f0) OR target IN (FROM f0) ORDER BY id LIMIT 1000),
  n1 AS (SELECT DISTINCT CASE WHEN from_source THEN target ELSE source END AS id FROM t1),
  f1 AS (SELECT id FROM n1 WHERE id NOT IN (FROM f0) AND id IN (SELECT id FROM nodes) ORDER BY id LIMIT 248),
  s1 AS (FROM f0 UNION ALL FROM f1),
  t2 AS (SELECT e.* FROM edges e WHERE source IN (FROM f1) OR target IN (FROM f1) ORDER BY id LIMIT 1000),
  n2 AS (SELECT DISTINCT CASE WHEN source IN (FROM s1) THEN target ELSE source END AS id FROM t2),
  f2 AS (SELECT id FROM n2 WHERE id NOT IN (FROM s1) AND id IN (SELECT id FROM nodes) ORDER BY id LIMIT greatest(0, 250 - (SELECT count(*) FROM s1)))
"""


@query("g1_neighborhood", f"{GRAPH} {LAYER} SELECT id, kind, label FROM nodes WHERE id IN (FROM s1) OR ((SELECT count(*) FROM s1) < 250 AND id IN (FROM f2))")
def g1(spark, sf_dir):
    found, _, _ = neighborhood(T.nodes(spark, sf_dir), T.edges(spark, sf_dir), ["controller:3", "class:7"], depth=2, limit=250)
    return found.select("id", "kind", "label")


@query("g12_one_hop", f"{GRAPH}, hop AS (SELECT source AS a, target AS b, kind FROM edges UNION SELECT target, source, kind FROM edges) SELECT a AS id, kind, count(*) AS neighbours FROM hop GROUP BY ALL")
def g12(spark, sf_dir):
    return one_hop(T.edges(spark, sf_dir))


def one_hop(e: DataFrame) -> DataFrame:
    """(id, kind, neighbours) of edges (source, target, kind): each pair of ends is one row until it is shown to both; missing ends come first."""
    first = F.col("source").isNull() | (F.col("source") <= F.col("target"))
    pairs = e.select(F.when(first, F.col("source")).otherwise(F.col("target")).alias("a"), F.when(first, F.col("target")).otherwise(F.col("source")).alias("b"), "kind").distinct()
    ends = F.when(F.col("a").eqNullSafe(F.col("b")), F.array("a")).otherwise(F.array("a", "b"))
    return pairs.select(F.explode(ends).alias("id"), "kind").groupBy("id", "kind").agg(F.count("*").alias("neighbours"))


@query(
    "g11_forward_reach",
    f"""{GRAPH}, d1 AS (SELECT DISTINCT target AS id FROM edges WHERE source = 'service:1'), d2 AS (SELECT DISTINCT target AS id FROM edges WHERE source IN (FROM d1)),
  d3 AS (SELECT DISTINCT target AS id FROM edges WHERE source IN (FROM d2)), d4 AS (SELECT DISTINCT target AS id FROM edges WHERE source IN (FROM d3)),
  every AS (SELECT 'service:1' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2 UNION ALL SELECT id, 3 FROM d3 UNION ALL SELECT id, 4 FROM d4)
  SELECT id, min(depth) AS depth FROM every GROUP BY id""",
)
def g11(spark, sf_dir):
    start = T.nodes(spark, sf_dir).where("id = 'service:1'")
    return reachable(T.edges(spark, sf_dir), start, 4)


@query(
    "g10_ancestry",
    f"""WITH RECURSIVE {T.EDGES}, up(id) AS (SELECT DISTINCT target FROM edges WHERE target IN ('repository:5', 'repository:9') UNION SELECT e.source FROM edges e JOIN up ON e.target = up.id)
  SELECT string_split(id, ':')[1] AS kind, count(*) AS n, min(id) AS first_id FROM up GROUP BY 1""",
)
def g10(spark, sf_dir):
    """The whole upstream of two nodes."""
    back = reverse(T.edges(spark, sf_dir))
    start = T.nodes(spark, sf_dir).where("id in ('repository:5', 'repository:9')")
    return reachable(back, start).select(F.split("id", ":")[0].alias("kind"), "id").groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("a9_kind_histogram", f"{GRAPH} SELECT 'node' AS of, kind, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY ALL")
def a9(spark, sf_dir):
    count = lambda df, of: df.groupBy(F.lit(of).alias("of"), "kind").agg(F.count("*").alias("n"))
    return count(T.nodes(spark, sf_dir), "node").unionByName(count(T.edges(spark, sf_dir), "edge"))


@query("a10_evidence_counts", f"{GRAPH} SELECT kind, count(*) FILTER (evidence = 'declared') AS declared, count(*) FILTER (evidence = 'resolved') AS resolved, count(*) FILTER (evidence = 'observed') AS observed, count(*) FILTER (evidence = 'inferred') AS inferred FROM edges GROUP BY kind")
def a10(spark, sf_dir):
    four = ["declared", "resolved", "observed", "inferred"]
    return T.edges(spark, sf_dir).groupBy("kind").pivot("evidence", four).agg(F.count("id")).fillna(0, four)


@query(
    "a11_degree_hubs",
    f"""{GRAPH}, i AS (SELECT target AS id, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT source AS id, count(*) AS n FROM edges GROUP BY 1)
  SELECT id, kind, label, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree FROM nodes LEFT JOIN i USING (id) LEFT JOIN o USING (id) ORDER BY degree DESC, in_degree DESC, label, id LIMIT 50""",
)
def a11(spark, sf_dir):
    return degrees(T.nodes(spark, sf_dir), T.edges(spark, sf_dir)).orderBy(F.desc("degree"), F.desc("in_degree"), "label", "id").limit(50)


@query("j3_edge_ends", f"{GRAPH} SELECT s.kind AS source_kind, e.kind, t.kind AS target_kind, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target GROUP BY ALL")
def j3(spark, sf_dir):
    n = T.nodes(spark, sf_dir)
    # nodes are hashed: neither join sorts the edges
    end = lambda name: n.select(F.col("id").alias(name), F.col("kind").alias(f"{name}_kind")).hint("shuffle_hash")
    return T.edges(spark, sf_dir).join(end("source"), "source").join(end("target"), "target").groupBy("source_kind", "kind", "target_kind").agg(F.count("*").alias("n"))


@query(
    "u7_common_neighbors",
    f"""{GRAPH}, s AS (SELECT DISTINCT target AS supplier, source AS part FROM edges WHERE kind = 'queries') SELECT a.supplier AS a, b.supplier AS b, count(*) AS common FROM s a JOIN s b ON a.part = b.part AND a.supplier < b.supplier GROUP BY ALL HAVING count(*) >= 2""",
)
def u7(spark, sf_dir):
    return shared_sources(T.edges(spark, sf_dir).where("kind = 'queries'")).where("common >= 2")


def shared_sources(edges: DataFrame) -> DataFrame:
    """(a, b, common): pairs of targets, a before b, with the number of sources that lead to both. A source's targets go to the first of each pair as one
    list, so a list's length is shuffled and no pair is; what has the same first is counted where it arrives."""
    lists = edges.where("source is not null").groupBy("source").agg(F.sort_array(F.collect_set("target")).alias("all_"))
    firsts = lists.select(F.posexplode("all_").alias("at", "a"), "all_").where(F.col("at") + 1 < F.size("all_"))
    rests = firsts.select("a", F.slice("all_", F.col("at") + 2, F.size("all_")).alias("rest")).repartition("a")
    return rests.select("a", F.explode("rest").alias("b")).groupBy("a", "b").agg(F.count("*").alias("common"))


@query("g14_lens_runtime", f"{GRAPH} SELECT id, source, target FROM edges WHERE evidence IN ('observed', 'inferred') AND source IN (SELECT id FROM nodes WHERE label LIKE '%red%') AND target IN (SELECT id FROM nodes)")
def g14(spark, sf_dir):
    """A lens: edges of some evidence classes, with both ends in view."""
    n, e = T.nodes(spark, sf_dir), T.edges(spark, sf_dir)
    red = n.where(F.col("label").contains("red")).select(F.col("id").alias("source"))
    lens = e.where(F.col("evidence").isin("observed", "inferred")).join(red, "source", "left_semi").join(n.select(F.col("id").alias("target")), "target", "left_semi")
    return lens.select("id", "source", "target")


@query("p2_system_layer", f"""{GRAPH} SELECT CASE WHEN kind IN ('endpoint', 'controller') THEN 'interface' WHEN kind IN ('repository', 'model') THEN 'data' WHEN kind = 'class' AND file_path LIKE '%/model.%' THEN 'data' ELSE 'application' END AS layer,
  CASE WHEN kind = 'class' THEN 'inferred' ELSE 'exact' END AS certainty, kind, count(*) AS n FROM nodes GROUP BY ALL""")
def p2(spark, sf_dir):
    placed = T.nodes(spark, sf_dir).withColumn("p", X.system_layer(F.col("kind"), F.col("label"), F.col("file_path")))
    return placed.groupBy("p.layer", "p.certainty", "kind").agg(F.count("*").alias("n"))


@query("p3_flow_stage", f"""{GRAPH} SELECT CASE WHEN kind IN ('repository', 'model') THEN 'data' WHEN kind = 'endpoint' THEN 'api' WHEN kind IN ('service', 'class') THEN 'service' ELSE 'backend' END AS stage,
  string_split(file_path, '/')[1] AS flow_group, count(*) AS n FROM nodes GROUP BY ALL""")
def p3(spark, sf_dir):
    stage = X.flow_stage(F.col("kind"), F.col("label"), F.col("file_path"), F.lit(""), F.lit(""))
    return T.nodes(spark, sf_dir).groupBy(stage.alias("stage"), X.flow_group(F.col("file_path")).alias("flow_group")).agg(F.count("*").alias("n"))


@query(
    "w4_round_robin",
    f"""{GRAPH}, r AS (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY lower(label), id) AS turn FROM nodes) SELECT id, kind, turn FROM r ORDER BY turn, kind LIMIT 50""",
)
def w4(spark, sf_dir):
    """Candidates of each kind in turn, up to 50."""
    turn = Window.partitionBy("kind").orderBy(X.ascii_fold(F.col("label")), "id")
    ranked = T.nodes(spark, sf_dir).withColumn("turn", F.row_number().over(turn)).where("turn <= 50")
    return ranked.orderBy("turn", "kind").limit(50).select("id", "kind", F.col("turn").cast("long").alias("turn"))


@query(
    "w5_group_topn",
    f"""{GRAPH}, d AS (SELECT n.id, n.kind, count(e.id) AS degree FROM nodes n LEFT JOIN edges e ON e.source = n.id GROUP BY ALL) SELECT id, kind, degree FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY (id = 'class:11') DESC, degree DESC, id) AS r FROM d) WHERE r <= 5""",
)
def w5(spark, sf_dir):
    """The five nodes of each kind with most edges; the root is always among them."""
    out = T.edges(spark, sf_dir).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("degree"))
    d = T.nodes(spark, sf_dir).select("id", "kind").join(out, "id", "left").fillna(0, ["degree"])
    r = Window.partitionBy("kind").orderBy(F.desc(F.col("id") == "class:11"), F.desc("degree"), "id")
    return d.withColumn("r", F.row_number().over(r)).where("r <= 5").select("id", "kind", "degree")


@query(
    "l9_edge_rank",
    f"""{GRAPH} SELECT id, CAST((CASE WHEN source = 'class:11' OR target = 'class:11' THEN 10 ELSE 0 END) + CASE evidence WHEN 'observed' THEN 6 WHEN 'resolved' THEN 3 WHEN 'declared' THEN 2 ELSE 0 END AS BIGINT) AS score FROM edges ORDER BY score DESC, id LIMIT 600""",
)
def l9(spark, sf_dir):
    e = F.col("evidence")
    score = F.when((F.col("source") == "class:11") | (F.col("target") == "class:11"), 10).otherwise(0) + F.when(e == "observed", 6).when(e == "resolved", 3).when(e == "declared", 2).otherwise(0)
    return T.edges(spark, sf_dir).select("id", score.cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(600)


@query(
    "g16_corridor",
    f"""{GRAPH}, hop AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), h1 AS (SELECT DISTINCT b AS id FROM hop WHERE a = 'class:11' ORDER BY 1 LIMIT 15),
  h2 AS (SELECT DISTINCT b AS id FROM hop WHERE a IN (FROM h1) AND b <> 'class:11' AND b NOT IN (FROM h1) ORDER BY 1 LIMIT greatest(0, 15 - (SELECT count(*) FROM h1)))
  SELECT 'class:11' AS id, 0 AS layer UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""",
)
def g16(spark, sf_dir):
    """A corridor of two hops around a root, 16 nodes at most, nearer ones and smaller ids first."""
    e = T.edges(spark, sf_dir)
    both = e.unionByName(reverse(e), allowMissingColumns=True)
    found = reachable(both, T.nodes(spark, sf_dir).where("id = 'class:11'"), 2)
    return found.orderBy("depth", "id").limit(16).select("id", F.col("depth").alias("layer"))


@query("a20_flow_buckets", f"""{GRAPH}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1)
  SELECT kind, string_split(file_path, '/')[1] AS flow_group, count(*) AS size, CAST(sum(coalesce(degree, 0)) + max(CASE WHEN n.id = 'class:11' THEN 10000 ELSE 0 END) AS BIGINT) AS score FROM nodes n LEFT JOIN d USING (id) GROUP BY ALL""")
def a20(spark, sf_dir):
    n = T.nodes(spark, sf_dir)
    d = degrees(n, T.edges(spark, sf_dir)).select("id", "degree")
    root = F.max(F.when(F.col("id") == "class:11", 10000).otherwise(0))
    return n.join(d, "id").groupBy("kind", X.flow_group(F.col("file_path")).alias("flow_group")).agg(F.count("*").alias("size"), (F.sum("degree") + root).alias("score"))


@query("l1_truncation_probe", f"{GRAPH} SELECT count(*) > 100 AS truncated, least(count(*), 100) AS shown FROM (SELECT id FROM nodes WHERE label LIKE '%1%' ORDER BY label, id LIMIT 101)")
def l1(spark, sf_dir):
    """One row more than is shown tells whether there are more."""
    more = T.nodes(spark, sf_dir).where(F.col("label").contains("1")).orderBy("label", "id").limit(101)
    return more.agg((F.count("*") > 100).alias("truncated"), F.least(F.count("*"), F.lit(100)).alias("shown"))


@query("s7_keys_lookup", f"{GRAPH} SELECT id, kind, label FROM nodes WHERE id IN ('class:1', 'model:2', 'nothing:3', 'endpoint:40')")
def s7(spark, sf_dir):
    return T.nodes(spark, sf_dir).where(F.col("id").isin("class:1", "model:2", "nothing:3", "endpoint:40")).select("id", "kind", "label")


@query("j10_connected_first", f"{GRAPH} SELECT id, id IN (SELECT source FROM edges UNION SELECT target FROM edges) AS connected FROM nodes WHERE kind IN ('class', 'model')")
def j10(spark, sf_dir):
    e = T.edges(spark, sf_dir)
    ends = e.select(F.col("source").alias("id")).union(e.select("target")).distinct().withColumn("there", F.lit(True))
    return T.nodes(spark, sf_dir).where("kind in ('class', 'model')").join(ends, "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("connected"))


@query("j4_edge_owner", f"{GRAPH} SELECT e.id, o.label AS owner, t.label AS target FROM edges e JOIN nodes o ON o.id = e.source JOIN nodes t ON t.id = e.target WHERE e.kind = 'requests'")
def j4(spark, sf_dir):
    """Requests with their owner's and their target's label."""
    n = T.nodes(spark, sf_dir)
    end = lambda name, out: n.select(F.col("id").alias(name), F.col("label").alias(out))
    e = T.edges(spark, sf_dir).where("kind = 'requests'").select("id", "source", F.col("target").alias("to"))
    return e.join(end("source", "owner"), "source").join(end("to", "target"), "to").select("id", "owner", "target")


@query("h8_node_search", f"""{GRAPH}, d AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1)
  SELECT id, CAST(CASE kind WHEN 'endpoint' THEN 80 WHEN 'controller' THEN 55 ELSE 4 END + coalesce(n, 0) AS BIGINT) AS score FROM nodes LEFT JOIN d USING (id) WHERE contains(lower(label || ' ' || kind || ' ' || file_path || ' ' || string_split(file_path, '/')[1]), 'red') ORDER BY score DESC, id LIMIT 20""")
def h8(spark, sf_dir):
    """Nodes whose label, kind, path or group holds a word, best first."""
    n = T.nodes(spark, sf_dir)
    hit = n.where(X.contains_fold(F.concat_ws(" ", "label", "kind", "file_path", X.flow_group(F.col("file_path"))), "RED"))
    score = F.when(F.col("kind") == "endpoint", 80).when(F.col("kind") == "controller", 55).otherwise(4) + F.col("degree")
    return degrees(hit, T.edges(spark, sf_dir)).select("id", score.cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(20)
