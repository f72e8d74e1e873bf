"""The layered overview of a whole graph, views, runtime projection and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.operators.graph import GRAPH, reachable, reverse, touching
from threadloom.plans.stages import drop_written, written
from threadloom.sources import tables as T

# The layers in order with the seeds each may give, and the interface categories that come first.
QUOTAS = {"configuration": 4, "entry": 4, "interface": 7, "application": 7, "data": 5, "external": 3}
OVERVIEW_EDGES = ("contains", "handles", "requests", "listensTo", "emits", "queries", "accesses", "reads", "writes", "resolvesTo")


def eligible(nodes: DataFrame) -> DataFrame:
    p, name = F.col("file_path"), X.ascii_fold(X.basename(F.col("file_path")))
    sensitive = (name == ".env") | name.startswith(".env.") | name.contains("credential") | name.contains("secret")
    return nodes.where(~F.col("kind").isin("callTarget", "module") & ~X.test_path_literal(p) & ~X.auxiliary_path(p) & ~sensitive & ((F.col("kind") != "file") | X.config_path(p) | X.entry_path(p)))


def seeds(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """(id, layer, turn): what stands for each layer. Connected nodes first, then by label and id; of interfaces three endpoints, two execution
    paths, an API and an event before the rest; one entry for each project; the layers take turns up to `limit`."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().withColumn("connected", F.lit(True))
    placed = eligible(nodes).withColumn("layer", X.system_layer(F.col("kind"), F.col("label"), F.col("file_path"))["layer"]).join(ends, "id", "left")
    category = F.when(F.col("kind").isin("endpoint", "controller"), 0).when(F.col("kind").isin("api", "external-api", "externalapi"), 2).when(F.col("kind") == "event", 3).otherwise(1)
    order = [F.when(F.col("connected"), 0).otherwise(1), F.when(F.col("layer") == "data", F.when(F.col("kind").isin("repository", "model", "database", "table", "schema", "entity"), 0).otherwise(1)).otherwise(0), X.ascii_fold(F.col("label")), "id"]
    # limits are literals next to their windows, so that each task keeps a few rows of a group before anything is shuffled
    of_project = F.row_number().over(Window.partitionBy(X.flow_group(F.col("file_path"))).orderBy(*order))
    entries = placed.where("layer = 'entry'").withColumn("nth", of_project).where("nth <= 1").drop("nth")
    placed = placed.where("layer <> 'entry'").unionByName(entries).withColumn("category", category)
    most = max(QUOTAS.values())
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("layer", "category").orderBy(*order))).where(F.col("nth") <= most)
    first = F.col("nth") <= F.when(F.col("category") == 0, 3).when(F.col("category") == 1, 2).otherwise(1)
    kept_first = F.when(F.col("layer") == "interface", F.when(first, F.col("category")).otherwise(9)).otherwise(0)
    quota = F.create_map(*(F.lit(x) for kv in QUOTAS.items() for x in kv))[F.col("layer")]
    turned = placed.withColumn("turn", F.row_number().over(Window.partitionBy("layer").orderBy(kept_first, *order))).where(F.col("turn") <= quota)
    rank = F.array_position(F.array(*(F.lit(k) for k in QUOTAS)), F.col("layer"))
    return turned.orderBy("turn", rank).limit(min(limit, 50)).select("id", "layer", "turn")


def overview(nodes: DataFrame, edges: DataFrame, limit: int = 60, depth: int = 2, most_edges: int = 120) -> DataFrame:
    """(id, kind, label, layer): seeds and what the semantic edges around them reach, within the bounds; every layer of it is bounded by them."""
    spark = nodes.sparkSession
    limit = max(1, min(limit, 60))
    given = hasattr(edges, "path_")
    if not given:
        edges = written(edges.select("id", "source", "target", "kind", "evidence"), "overview-edges")  # asked by the seeds and each layer
    usable = edges.where(F.col("kind").isin(*OVERVIEW_EDGES) & ~((F.col("kind") == "resolvesTo") & (F.col("evidence") == "inferred")))
    ids = lambda values: F.broadcast(spark.createDataFrame([(v,) for v in values], "id string"))
    selected = {r["id"] for r in seeds(nodes, edges, limit).collect()}
    frontier, kept = sorted(selected), set()
    for _ in range(min(depth, 4)):
        if not frontier or len(selected) >= limit or len(kept) >= most_edges:
            break
        found = touching(usable, ids(frontier)).orderBy("id").limit(2 * most_edges).collect()
        new = sorted({i for r in found for i in (r["source"], r["target"])} - selected)
        loaded = sorted(r["id"] for r in eligible(nodes).join(ids(new), "id", "left_semi").select("id").collect())[: limit - len(selected)] if new else []
        selected |= set(loaded)
        kept |= {r["id"] for r in found if r["source"] in selected and r["target"] in selected}
        frontier = loaded
    if not given:
        drop_written(edges)
    placed = nodes.join(ids(sorted(selected)), "id", "left_semi")
    return placed.select("id", "kind", "label", X.system_layer(F.col("kind"), F.col("label"), F.col("file_path"))["layer"].alias("layer"))


def runtime_projection(events: DataFrame, nodes: DataFrame, most: int = 80) -> DataFrame:
    """(source, target, kind, evidence, confidence): the last relevant events as spans, tied to what they were observed at and to their parents."""
    last = events.orderBy(F.desc("event_id")).limit(most)
    anchor = F.struct(F.when(F.col("phase") == "start", 0).otherwise(1), "event_id")
    spans = last.groupBy("trace_id", "span_id").agg(F.min_by("node_id", anchor).alias("node_id"), F.min("event_id").alias("first_id"))
    own = spans.withColumn("id", F.concat_ws("/", "trace_id", "span_id"))
    seen = own.join(nodes.select(F.col("id").alias("node_id")), "node_id").select(F.col("id").alias("source"), F.col("node_id").alias("target"), F.lit("observedAt").alias("kind"), F.lit("observed").alias("evidence"), F.lit(1.0).alias("confidence"))
    before = F.lag("id").over(Window.partitionBy("trace_id").orderBy("first_id"))
    parents = own.withColumn("before", before).where("before is not null").select(F.col("before").alias("source"), F.col("id").alias("target"), F.lit("parentSpan").alias("kind"), F.lit("observed").alias("evidence"), F.lit(1.0).alias("confidence"))
    return seen.unionByName(parents)


SEEDS = f"""{GRAPH}, placed AS (SELECT *, CASE WHEN kind IN ('endpoint', 'controller') THEN 'interface' WHEN kind IN ('repository', 'model') THEN 'data' WHEN kind = 'class' THEN 'data' ELSE 'application' END AS layer,
    id IN (SELECT source FROM edges UNION SELECT target FROM edges) AS connected FROM nodes),
  o AS (SELECT *, CASE WHEN layer = 'data' AND kind = 'class' THEN 1 ELSE 0 END AS weak, row_number() OVER (PARTITION BY layer ORDER BY connected DESC, CASE WHEN layer = 'data' AND kind = 'class' THEN 1 ELSE 0 END, lower(label), id) AS turn FROM placed)
  SELECT id, layer, turn FROM o WHERE turn <= CASE layer WHEN 'interface' THEN 7 WHEN 'application' THEN 7 WHEN 'data' THEN 5 ELSE 4 END"""


@query("w6_overview_seeds", SEEDS)
def w6(spark, sf_dir):
    return seeds(T.nodes(spark, sf_dir), T.edges(spark, sf_dir)).select("id", "layer", F.col("turn").cast("long").alias("turn"))


@query("g2_overview")
def g2(spark, sf_dir):
    return overview(T.nodes(spark, sf_dir), T.edges(spark, sf_dir))


@query("w7_first_per_project", f"{GRAPH} SELECT string_split(file_path, '/')[1] AS project, min(id) AS first_id, count(*) AS nodes FROM nodes GROUP BY 1")
def w7(spark, sf_dir):
    return T.nodes(spark, sf_dir).groupBy(X.flow_group(F.col("file_path")).alias("project")).agg(F.min("id").alias("first_id"), F.count("*").alias("nodes"))


@query("a6_owner_relations", f"{GRAPH} SELECT source AS owner, min(id) AS first_relation, count(DISTINCT target) AS targets, count(DISTINCT target) = 1 AS is_unique FROM edges WHERE kind = 'requests' GROUP BY source")
def a6(spark, sf_dir):
    r = T.edges(spark, sf_dir).where("kind = 'requests'").groupBy(F.col("source").alias("owner")).agg(F.min("id").alias("first_relation"), F.count_distinct("target").alias("targets"))
    return r.withColumn("is_unique", F.col("targets") == 1)


@query("a21_stage_counts", f"{GRAPH}, r AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY id) <= 40 AS shown FROM nodes) SELECT kind, count(*) AS truth, count(*) FILTER (shown) AS visible, count(*) FILTER (NOT shown) AS hidden FROM r GROUP BY kind")
def a21(spark, sf_dir):
    n = T.nodes(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("truth"))
    return n.select("kind", "truth", F.least("truth", F.lit(40)).alias("visible"), F.greatest(F.col("truth") - 40, F.lit(0)).alias("hidden"))


@query("l13_latest_observed", f"WITH {T.EVENTS} SELECT kind, arg_max(node_id, event_id) AS node_id, max(event_id) AS event_id FROM runtime_events GROUP BY kind")
def l13(spark, sf_dir):
    return T.runtime_events(spark, sf_dir).groupBy("kind").agg(F.max_by("node_id", "event_id").alias("node_id"), F.max("event_id").alias("event_id"))


@query("s21_latest_events", f"WITH {T.EVENTS} SELECT event_id, kind, trace_id FROM runtime_events ORDER BY event_id DESC LIMIT 250")
def s21(spark, sf_dir):
    return T.runtime_events(spark, sf_dir).orderBy(F.desc("event_id")).limit(250).select("event_id", "kind", "trace_id")


@query(
    "g13_data_view",
    f"""WITH RECURSIVE {T.NODES}, {T.EDGES}, up(id) AS (SELECT id FROM nodes WHERE kind = 'repository' AND label LIKE '%7' UNION SELECT e.source FROM edges e JOIN up ON e.target = up.id) SELECT n.kind, count(*) AS n FROM up JOIN nodes n USING (id) GROUP BY n.kind""",
)
def g13(spark, sf_dir):
    """Data nodes and all that leads to them."""
    n = T.nodes(spark, sf_dir)
    start = n.where((F.col("kind") == "repository") & F.col("label").endswith("7"))
    return reachable(reverse(T.edges(spark, sf_dir)), start).join(n.select("id", "kind"), "id").groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "g15_trace_scope",
    f"""WITH RECURSIVE {T.EDGES}, fwd(id, d) AS (SELECT 'endpoint:40', 0 UNION SELECT e.target, d + 1 FROM edges e JOIN fwd ON e.source = fwd.id WHERE d < 12), back(id, d) AS (SELECT 'endpoint:40', 0 UNION SELECT e.source, d + 1 FROM edges e JOIN back ON e.target = back.id WHERE d < 4)
  SELECT id, min(fwd) AS ahead, min(bwd) AS behind FROM (SELECT id, d AS fwd, NULL AS bwd FROM fwd UNION ALL SELECT id, NULL, d FROM back) GROUP BY id""",
)
def g15(spark, sf_dir):
    """What a node reaches within twelve steps, and what reaches it within four."""
    n, e = T.nodes(spark, sf_dir).where("id = 'endpoint:40'"), T.edges(spark, sf_dir)
    ahead = reachable(e, n, 12).withColumnRenamed("depth", "ahead")
    behind = reachable(reverse(e), n, 4).withColumnRenamed("depth", "behind")
    return ahead.join(behind, "id", "full_outer").select("id", "ahead", "behind")


@query(
    "g20_runtime_projection",
    f"""WITH {T.EVENTS}, {T.NODES}, last AS (SELECT * FROM runtime_events ORDER BY event_id DESC LIMIT 80),
  s AS (SELECT trace_id, trace_id || '/' || span_id AS id, arg_min(node_id, (CASE phase WHEN 'start' THEN 0 ELSE 1 END, event_id)) AS node_id, min(event_id) AS first_id FROM last GROUP BY trace_id, span_id),
  p AS (SELECT lag(id) OVER (PARTITION BY trace_id ORDER BY first_id) AS source, id AS target FROM s)
  SELECT s.id AS source, s.node_id AS target, 'observedAt' AS kind, 'observed' AS evidence, CAST(1.0 AS DOUBLE) AS confidence FROM s JOIN nodes n ON n.id = s.node_id UNION ALL SELECT source, target, 'parentSpan', 'observed', CAST(1.0 AS DOUBLE) FROM p WHERE source IS NOT NULL""",
)
def g20(spark, sf_dir):
    return runtime_projection(T.runtime_events(spark, sf_dir), T.nodes(spark, sf_dir))


@query(
    "j19_graph_roots",
    f"""{GRAPH}, w AS (SELECT event_id, 'endpoint:' || (event_id % 40000) AS wanted, 'NATION_' || (event_id % 60) AS name FROM events) SELECT event_id, coalesce(a.id, b.id) AS root, CASE WHEN a.id IS NOT NULL THEN 0 WHEN b.id IS NOT NULL THEN 1 END AS rule FROM w LEFT JOIN nodes a ON a.id = wanted LEFT JOIN (SELECT label, min(id) AS id FROM nodes WHERE kind = 'controller' GROUP BY label) b ON b.label = name""",
)
def j19(spark, sf_dir):
    """The root of each wanted node: by id, else by label."""
    n = T.nodes(spark, sf_dir)
    w = T.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("endpoint:"), F.expr("cast(event_id % 40000 as string)")).alias("wanted"), F.concat(F.lit("NATION_"), F.expr("cast(event_id % 60 as string)")).alias("name"))
    by_id = n.select(F.col("id").alias("wanted"), F.col("id").alias("a"))
    by_label = n.where("kind = 'controller'").groupBy(F.col("label").alias("name")).agg(F.min("id").alias("b"))
    j = w.join(by_id, "wanted", "left").join(by_label, "name", "left")
    return j.select("event_id", F.coalesce("a", "b").alias("root"), F.when(F.col("a").isNotNull(), 0).when(F.col("b").isNotNull(), 1).alias("rule"))


@query("s20_report", f"{GRAPH}, c AS (SELECT 'node' AS part, kind, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY ALL) SELECT part, string_agg('- ' || kind || ': ' || n, chr(10) ORDER BY n DESC, kind) AS body FROM c GROUP BY part")
def s20(spark, sf_dir):
    """The Markdown report's histograms."""
    count = lambda df, part: df.groupBy("kind").agg(F.count("*").alias("n")).withColumn("part", F.lit(part))
    c = count(T.nodes(spark, sf_dir), "node").unionByName(count(T.edges(spark, sf_dir), "edge"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "kind")))
    return c.groupBy("part").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r["kind"], F.lit(": "), (-r["k"]).cast("string"))), "\n").alias("body"))


@query("s8_bulk_replace", f"{GRAPH} SELECT kind, count(*) AS n, CAST(sum(length(label)) AS BIGINT) AS characters FROM nodes GROUP BY kind")
def s8(spark, sf_dir):
    """A graph written anew in one go, and read back."""
    return written(T.nodes(spark, sf_dir), "graph").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.char_length("label")).alias("characters"))


@query("l6_layered_sort", f"{SEEDS.replace('SELECT id, layer, turn FROM o', ', cut AS (SELECT id, label, layer FROM o')}) SELECT id, layer, row_number() OVER (ORDER BY layer, lower(label), id) AS position FROM cut")
def l6(spark, sf_dir):
    """The overview's seeds (50 at most) in one order: by layer, label and id."""
    order = Window.orderBy("layer", X.ascii_fold(F.col("label")), "id")
    picked = seeds(T.nodes(spark, sf_dir), T.edges(spark, sf_dir)).join(T.nodes(spark, sf_dir).select("id", "label"), "id")
    return picked.select("id", "layer", F.row_number().over(order).cast("long").alias("position"))
