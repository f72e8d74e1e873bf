"""Resolution of calls and imports, call collapse, call trees, strongly connected components, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.operators.graph import GRAPH, degrees
from threadloom.plans.stages import written
from threadloom.sources import tables as T

IMPORT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts")


def call_key(label: Column) -> Column:
    """The final identifier of a call: what stands before the first parenthesis, its last non-empty part, in ASCII lower case."""
    parts = F.filter(F.split(F.substring_index(label, "(", 1), "[.:]"), lambda s: F.trim(s) != "")
    return X.ascii_fold(F.trim(F.element_at(parts, -1)))


def resolve_calls(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """(source, callee, target): calls whose key has just one declaration. Uniqueness is decided before the join, so a key with many
    declarations multiplies nothing."""
    unique = declarations.groupBy(X.ascii_fold(F.trim("label")).alias("key")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("target")).where("n = 1")
    return calls.withColumn("key", call_key(F.col("callee"))).join(unique, "key").select("source", "callee", "target")


def import_candidates(folder: Column, specifier: Column) -> Column:
    """The paths that a relative import may mean: as it is, with an extension, or as a folder's index. None if it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", folder, specifier), "/"), lambda s: (s != ".") & (s != ""))
    step = lambda acc, s: F.when(acc.isNull(), acc).when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    base = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(base.isNotNull() & specifier.startswith("."), F.array(base, *(F.concat(base, F.lit(f".{e}")) for e in IMPORT_EXTENSIONS), *(F.concat(base, F.lit(f"/index.{e}")) for e in IMPORT_EXTENSIONS)))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, specifier, target): imports that mean exactly one file."""
    folder = F.regexp_replace("source", "/?[^/]*$", "")
    tried = imports.select("source", "specifier", F.explode(import_candidates(folder, F.col("specifier"))).alias("relative_path"))
    hits = tried.join(files.select("relative_path").distinct(), "relative_path")
    return hits.groupBy("source", "specifier").agg(F.count("*").alias("n"), F.min("relative_path").alias("target")).where("n = 1").drop("n")


def call_tree(edges: DataFrame, root: DataFrame, depth: int, children: int) -> DataFrame:
    """(path, id, depth, cycle): every path from the root, depth first by its spelling; a node that its path holds already ends it."""
    nth = Window.partitionBy("id").orderBy("target")
    pairs = edges.select(F.col("source").alias("id"), "target")
    level = written(root.select("id", F.array("id").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("cycle")), "calls")
    out = level
    for d in range(1, depth + 1):
        open_ = level.where("not cycle")
        # only what the level calls is ranked: a level has at most children ** depth rows a root
        first = pairs.join(open_.select("id").distinct(), "id", "left_semi").distinct().withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= children)
        level = written(open_.join(first, "id").select(F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"), F.lit(d).alias("depth"), F.array_contains("path", F.col("target")).alias("cycle")), "calls")
        out = out.unionByName(level)
    return out.select(F.array_join("path", ">").alias("path"), "id", "depth", "cycle")


def strong_components(pdf):
    """Strongly connected components of one bounded snapshot (source, target): (id, component, size), those of over one node."""
    import pandas as pd

    ahead: dict = {}
    for a, b in zip(pdf["source"], pdf["target"], strict=True):
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    index, low, stack, on, out = {}, {}, [], set(), []
    for start in sorted(ahead):
        todo = [(start, iter(ahead[start]))] if start not in index else []
        if todo:
            index[start] = low[start] = len(index)
            stack.append(start)
            on.add(start)
        while todo:
            node, rest = todo[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    todo.append((nxt, iter(ahead[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while group[-1:] != [node]:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    if len(group) > 1:
                        first = min(group)
                        out += [(m, first, len(group)) for m in group]
    return pd.DataFrame(out, columns=["id", "component", "size"])


def label_communities(ids: list, pairs: list[tuple], rounds: int = 64) -> dict:
    """Label propagation on one bounded snapshot: undirected, labels change in place in id order, a neighbour weighs one more than the
    neighbours it shares, ties go to the smallest label."""
    near: dict = {i: set() for i in ids}
    for a, b in pairs:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    label = {i: i for i in near}
    for _ in range(rounds):
        changed = False
        for i in sorted(near):
            score: dict = {}
            for j in near[i]:
                score[label[j]] = score.get(label[j], 0) + 1 + len(near[i] & near[j])
            if score:
                best = min(score, key=lambda k: (-score[k], k))
                changed |= best != label[i]
                label[i] = best
        if not changed:
            break
    return label


def transitions(spark, sf_dir) -> DataFrame:
    """Per trace, which value of k follows which: a small directed graph for every user, of at most 100 nodes."""
    nxt = F.lead("k").over(Window.partitionBy("trace_id").orderBy("event_id"))
    return T.runtime_events(spark, sf_dir).select("trace_id", F.col("k").alias("source"), nxt.alias("target")).where("source is not null and target is not null").distinct()


CALLS = f"""WITH {T.NODES}, calls AS (SELECT DISTINCT 'endpoint:' || l_orderkey AS source, CASE l_orderkey % 3 WHEN 0 THEN 'db.' || upper(p_name) || '()' WHEN 1 THEN 'api::' || s_name || '(1)' ELSE 'self.x.Nation_' || (l_partkey % 40) || '(y)' END AS callee FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
  keyed AS (SELECT *, lower(regexp_extract(string_split(callee, '(')[1], '([^.:]+)$', 1)) AS key FROM calls),
  declared AS (SELECT lower(trim(label)) AS key, min(id) AS target FROM nodes WHERE kind IN ('service', 'repository', 'controller', 'model', 'class') GROUP BY 1 HAVING count(DISTINCT id) = 1),
  resolved AS (SELECT source, callee, target FROM keyed JOIN declared USING (key))"""


def calls(spark, sf_dir) -> DataFrame:
    li = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    named = li.join(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").join(T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    callee = F.when(F.expr("l_orderkey % 3 = 0"), F.concat(F.lit("db."), F.upper("p_name"), F.lit("()"))).when(F.expr("l_orderkey % 3 = 1"), F.concat(F.lit("api::"), "s_name", F.lit("(1)"))).otherwise(F.concat(F.lit("self.x.Nation_"), F.expr("cast(l_partkey % 40 as string)"), F.lit("(y)")))
    return named.select(F.concat(F.lit("endpoint:"), F.col("l_orderkey").cast("string")).alias("source"), callee.alias("callee")).distinct()


def declarations(spark, sf_dir) -> DataFrame:
    return T.nodes(spark, sf_dir).where(F.col("kind").isin("service", "repository", "controller", "model", "class")).select("id", "label")


@query("g19_resolution_edges", f"{CALLS} SELECT source, callee, target, 'resolvesTo' AS kind, 'inferred' AS evidence, CAST(0.6 AS DOUBLE) AS confidence FROM resolved")
def g19(spark, sf_dir):
    r = resolve_calls(calls(spark, sf_dir), declarations(spark, sf_dir))
    return r.select("source", "callee", "target", F.lit("resolvesTo").alias("kind"), F.lit("inferred").alias("evidence"), F.lit(0.6).alias("confidence"))


@query("g4_call_collapse", f"{CALLS} SELECT c.source, coalesce(r.target, 'call:' || c.callee) AS target, CASE WHEN r.target IS NULL THEN 'declared' ELSE 'inferred' END AS evidence, CAST(CASE WHEN r.target IS NULL THEN 0.55 ELSE least(0.55, 0.6) END AS DOUBLE) AS confidence, r.target IS NOT NULL AS candidate_only FROM calls c LEFT JOIN resolved r ON r.source = c.source AND r.callee = c.callee")
def g4(spark, sf_dir):
    """A call and its one resolution become one edge, of the weaker evidence and the smaller confidence; others stay as they are."""
    c = calls(spark, sf_dir)
    r = resolve_calls(c, declarations(spark, sf_dir))
    j = c.join(r, ["source", "callee"], "left")
    found = F.col("target").isNotNull()
    return j.select("source", F.coalesce("target", F.concat(F.lit("call:"), "callee")).alias("target"), F.when(found, "inferred").otherwise("declared").alias("evidence"), F.lit(0.55).alias("confidence"), found.alias("candidate_only"))


@query(
    "j13_import_resolution",
    f"""WITH {T.FILES}, i AS (SELECT relative_path AS source, '../' || lang || '/' || (doc_id + 160) AS specifier, regexp_replace(regexp_replace(relative_path, '/[^/]*$', ''), '[^/]*$', '') || lang || '/' || (doc_id + 160) AS base FROM files WHERE doc_id % 8 = 0)
  SELECT i.source, specifier, f.relative_path AS target FROM i JOIN files f ON f.relative_path = base || '.ts'""",
)
def j13(spark, sf_dir):
    files = T.files(spark, sf_dir)
    imports = files.where("doc_id % 8 = 0").select(F.col("relative_path").alias("source"), F.concat(F.lit("../"), "lang", F.lit("/"), (F.col("doc_id") + 160).cast("string")).alias("specifier"))
    return resolve_imports(imports, files)


@query(
    "g18_call_tree",
    f"""{GRAPH}, c AS (SELECT source, target FROM (SELECT DISTINCT source, target FROM edges) QUALIFY row_number() OVER (PARTITION BY source ORDER BY target) <= 8),
  t0 AS (SELECT 'class:7' AS path, 'class:7' AS id, 0 AS depth), t1 AS (SELECT path || '>' || target AS path, target AS id, 1 AS depth FROM t0 JOIN c ON c.source = t0.id), t2 AS (SELECT path || '>' || target, target, 2 FROM t1 JOIN c ON c.source = t1.id), t3 AS (SELECT path || '>' || target AS path, target AS id, 3 FROM t2 t(path, id, depth) JOIN c ON c.source = t.id)
  SELECT path, id, depth, false AS cycle FROM (FROM t0 UNION ALL FROM t1 UNION ALL FROM t2 UNION ALL FROM t3) ORDER BY path LIMIT 180""",
)
def g18(spark, sf_dir):
    root = T.nodes(spark, sf_dir).where("id = 'class:7'")
    return call_tree(T.edges(spark, sf_dir), root, 3, 8).orderBy("path").limit(180)


@query(
    "g6_strong_components",
    f"""WITH RECURSIVE {T.EVENTS}, e AS (SELECT DISTINCT trace_id, k AS a, lead(k) OVER (PARTITION BY trace_id ORDER BY event_id) AS b FROM runtime_events),
  r(trace_id, a, b) AS (SELECT trace_id, a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT r.trace_id, r.a, e.b FROM r JOIN e ON e.trace_id = r.trace_id AND e.a = r.b WHERE e.b IS NOT NULL),
  m AS (SELECT x.trace_id, x.a AS id, x.b AS other FROM r x JOIN r y ON y.trace_id = x.trace_id AND y.a = x.b AND y.b = x.a WHERE x.a <> x.b)
  SELECT trace_id, id, least(id, min(other)) AS component, count(DISTINCT other) + 1 AS size FROM m GROUP BY trace_id, id""",
)
def g6(spark, sf_dir):
    """Cycles in what follows what, of every user: each graph is small, and graphs are spread over tasks."""

    def solve(key, pdf):
        out = strong_components(pdf)
        out.insert(0, "trace_id", key[0])
        return out

    return transitions(spark, sf_dir).groupBy("trace_id").applyInPandas(solve, "trace_id string, id long, component long, size long")


@query("g8_communities")
def g8(spark, sf_dir):
    """Communities of every user's transition graph, exactly as sequential propagation gives them."""

    def solve(key, pdf):
        import pandas as pd

        pairs = list(zip(pdf["source"], pdf["target"], strict=True))
        label = label_communities(sorted({i for p in pairs for i in p}), pairs)
        return pd.DataFrame([(key[0], i, c) for i, c in label.items()], columns=["trace_id", "id", "community"])

    return transitions(spark, sf_dir).groupBy("trace_id").applyInPandas(solve, "trace_id string, id long, community long")


@query(
    "g17_evidence_pack",
    f"""{GRAPH}, r AS (SELECT kind, id, label, row_number() OVER (PARTITION BY kind ORDER BY id) AS n, sum(strlen(label)) OVER (PARTITION BY kind ORDER BY id ROWS UNBOUNDED PRECEDING) AS bytes FROM nodes) SELECT kind, id, CAST(bytes AS BIGINT) AS bytes FROM r WHERE n <= 24 AND bytes <= 300""",
)
def g17(spark, sf_dir):
    """The first items of each kind within a number and a running byte budget."""
    order = Window.partitionBy("kind").orderBy("id")
    first = T.nodes(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n <= 24")
    bytes_ = F.sum(F.octet_length("label")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("bytes", bytes_).where("bytes <= 300").select("kind", "id", "bytes")


@query("l10_entry_candidates", f"""{GRAPH}, d AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1) SELECT id, CAST(CASE kind WHEN 'endpoint' THEN 80 WHEN 'controller' THEN 55 ELSE 4 END + coalesce(n, 0) AS BIGINT) AS score FROM nodes LEFT JOIN d USING (id) ORDER BY score DESC, id LIMIT 40""")
def l10(spark, sf_dir):
    score = F.when(F.col("kind") == "endpoint", 80).when(F.col("kind") == "controller", 55).otherwise(4) + F.col("degree")
    return degrees(T.nodes(spark, sf_dir), T.edges(spark, sf_dir)).select("id", score.cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(40)


@query("u3_page_merge", f"{GRAPH}, pages AS (SELECT id, label || '!' AS label, 2 AS page FROM nodes WHERE kind = 'model' AND label LIKE '%red%' UNION ALL SELECT id, label, 1 FROM nodes WHERE kind = 'model') SELECT id, max_by(label, page) AS label, count(*) AS pages FROM pages GROUP BY id")
def u3(spark, sf_dir):
    """Pages of nodes as one: what a later page says overlays the earlier."""
    first = T.nodes(spark, sf_dir).where("kind = 'model'").select("id", "label", F.lit(1).alias("page"))
    second = first.where(F.col("label").contains("red")).select("id", F.concat("label", F.lit("!")).alias("label"), F.lit(2).alias("page"))
    return first.unionByName(second).groupBy("id").agg(F.max_by("label", "page").alias("label"), F.count("*").alias("pages"))
