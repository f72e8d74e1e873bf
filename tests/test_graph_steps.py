"""Steps of graph queries that are to grow no faster than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import flows, graph, navigation, overview, redaction
from threadloom.sources import tables as T


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "source string, target string, kind string")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_targets_of_one_source_are_paired_as_lists(spark):
    rows = [(f"s{k % 5}", f"t{k}") for k in range(40)] + [("s0", "t1"), ("s0", "t1"), (None, "t1"), (None, "t2"), ("s9", None), ("s8", "t1")]
    of: dict = {}
    for s, t in rows:
        if s and t:
            of.setdefault(s, set()).add(t)
    want: dict = {}
    for targets in of.values():
        for a in targets:
            for b in targets:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    found = graph.shared_sources(frame(spark, rows))
    assert {(r.a, r.b): r.common for r in found.collect()} == want
    assert "Join" not in plan(found)


def test_one_hop_tells_pairs_apart_once(spark):
    rows = [("a", "b"), ("b", "a"), ("a", "b"), ("a", "a"), ("c", None), (None, "c"), (None, None), ("c", "a")]
    want: dict = {}
    for s, t in {x for s, t in rows for x in ((s, t), (t, s))}:
        want[s] = want.get(s, 0) + 1
    found = graph.one_hop(frame(spark, rows))
    assert {r.id: r.neighbours for r in found.collect()} == want
    assert "Union" not in plan(found)


def test_only_called_sources_are_ranked(spark):
    rows = [("root", f"c{k}") for k in range(12)] + [(f"c{k}", f"d{j}") for k in range(12) for j in range(3)] + [("c1", "root")] + [(f"z{k}", "root") for k in range(50)]
    found = flows.call_tree(frame(spark, rows), frame(spark, [("root", "")]).select(F.col("source").alias("id")), 2, 2)
    assert sorted((r.path, r.depth, r.cycle) for r in found.collect()) == [
        ("root", 0, False), ("root>c0", 1, False), ("root>c0>d0", 2, False), ("root>c0>d1", 2, False), ("root>c1", 1, False), ("root>c1>d0", 2, False), ("root>c1>d1", 2, False)]
    assert "Window" not in plan(found)  # levels are written; none ranks the edges anew


def test_layers_beyond_the_broadcast_are_hashed(spark, monkeypatch):
    rows = [(f"n{k}", f"n{(k * 3 + j) % 60}") for k in range(50) for j in (1, 2)]
    start = spark.createDataFrame([("n1",)], "id string")
    want = {(r.id, r.depth) for r in graph.reachable(frame(spark, rows), start).collect()}
    monkeypatch.setattr(graph, "BROADCAST_IDS", 0)
    assert {(r.id, r.depth) for r in graph.reachable(frame(spark, rows), start).collect()} == want and len(want) > 20
    ids = spark.createDataFrame([("n1",)], "id string")
    joined = frame(spark, rows).join(graph.near(ids).withColumnRenamed("id", "source"), "source", "left_semi")
    assert "ShuffledHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_distinct_numbers_are_dealt_to_all_tasks(spark):
    rows = spark.createDataFrame([(k % 30, k % 7) for k in range(500)], "a long, b long")
    found = T.distinct_by(rows, "a")
    assert sorted(map(tuple, found.collect())) == sorted({(k % 30, k % 7) for k in range(500)})
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_are_python_objects_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(redaction, "SENT_ROWS", 3)
    rows = spark.createDataFrame([(k, None if k == 4 else f"{k} token {k}") for k in range(20)], "key long, text string").coalesce(1)
    shown = redaction.redacted(rows, ["token"])
    assert {r.key: r.preview for r in shown.collect()} == {k: None if k == 4 else f"{k} [REDACTED] {k}" for k in range(20)}
    sizes = shown.mapInArrow(lambda it: (__import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long")
    assert sizes.agg(F.sum("n")).first()[0] == 20


def test_graphs_are_not_shuffled_to_meet_a_bounded_frontier(spark, monkeypatch):
    """A layer's ids are a few hundred at most: the joins of the neighbourhood and of the overview send them to the edges and nodes."""
    rows = [(f"n{k}", f"n{(k * 3 + j) % 60}") for k in range(50) for j in (1, 2)]
    edges = frame(spark, rows).selectExpr("concat(source, '>', target) as id", "source", "target", "'contains' as kind", "'declared' as evidence")
    nodes = spark.createDataFrame([(f"n{k}", "class", f"N{k}", f"src/{k}.ts") for k in range(60)], "id string, kind string, label string, file_path string")
    plans = []
    monkeypatch.setattr(graph, "touching", lambda e, f, plain=graph.touching: plans.append(plain(e, f)) or plans[-1])
    monkeypatch.setattr(overview, "touching", graph.touching)
    found, kept, _ = graph.neighborhood(nodes, edges, ["n1"], depth=3)
    assert found.count() > 5 and overview.overview(nodes, edges).count() > 5 and len(plans) > 3
    for df in [*plans, found, kept]:
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in physical and "BroadcastHashJoin" in physical


def test_hashed_ids_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    """A task's hashed table holds a bounded number of ids, whatever the number of shuffle partitions is."""
    monkeypatch.setattr(graph, "BROADCAST_IDS", 0)
    monkeypatch.setattr(graph, "HASHED_IDS", 5, raising=False)
    ids = spark.createDataFrame([(f"n{k}",) for k in range(200)], "id string")
    rows = frame(spark, [(f"n{k % 300}", f"n{k}") for k in range(900)])
    joined = rows.join(graph.near(ids).withColumnRenamed("id", "source"), "source", "left_semi")
    assert joined.count() == 600 and joined.rdd.getNumPartitions() == 40
    assert "ShuffledHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_not_dealt_by_file_to_meet_its_change(spark):
    nodes = spark.createDataFrame([(f"n{k}", "class", f"N{k}", f"src/{k % 3}.ts") for k in range(60)], "id string, kind string, label string, file_path string")
    edges = frame(spark, [(f"n{k}", f"n{k + 1}") for k in range(59)]).selectExpr("concat(source, '>', target) as id", "*")
    changes = spark.createDataFrame([("src/1.ts", "insert"), ("src/9.ts", "delete")], "file_path string, change string")
    found, links = navigation.change_projection(nodes, edges, changes)
    assert {r.id: r.change for r in found.collect()} == {f"n{k}": "insert" if k % 3 == 1 else None for k in range(59)} | {"git-change:src/1.ts": "insert", "git-change:src/9.ts": "delete"}
    assert links.where("kind = 'changedIn'").count() == 20
    for df in (found, links):
        assert "hashpartitioning(file_path" not in df._jdf.queryExecution().executedPlan().toString()
