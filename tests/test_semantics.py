"""Small cases with known answers: bounds, uniqueness, folding, order of propagation."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from threadloom.functions import text as X
from threadloom.functions.identity import stable_id
from threadloom.operators import documents, evidence, flows, graph, inventory, navigation, overview, views
from threadloom.sources import protocols
from threadloom.sources import tables as T
from threadloom.streaming import spans


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_folding_is_ascii_only(spark):
    assert one(spark, "ÉCLAIR Ab", X.ascii_fold) == "ÉclAIR Ab".replace("A", "a").replace("I", "i").replace("R", "r")


def test_latest_is_a_test_only_where_underscore_is_a_wildcard(spark):
    assert one(spark, "src/latest.ts", X.test_path_overview)
    assert not one(spark, "src/latest.ts", X.test_path_inventory)
    assert not one(spark, "src/latest.ts", X.test_path_literal)


@pytest.mark.parametrize(("path", "denied"), [(".env", True), (".env.local", True), ("a/node_modules/b.js", True), ("a/Target/b.rs", True), ("k.PEM", True), (".config/gcloud/x", True), ("a/terraform.tfstate.backup", True), ("src/main.rs", False), ("environment.ts", False)])
def test_denied_paths(spark, path, denied):
    assert one(spark, path, X.denied_path) is denied


@pytest.mark.parametrize(("label", "remote"), [("GET https://user@api.host:80/x", True), ("http://localhost:1/x", False), ("http://[::1]:3/x", False), ("http://127.0.0.1", False), ("/x", False)])
def test_remote_targets(spark, label, remote):
    assert one(spark, label, X.remote_target) is remote


def test_identity_separates_parts(spark):
    a, b = spark.range(1).select(stable_id("x", F.lit("ab"), F.lit("c")), stable_id("x", F.lit("a"), F.lit("bc"))).first()
    assert a != b


def test_utf16_columns(spark):
    assert one(spark, "a😀b", X.utf16_length) == 4


def test_sentences(spark):
    rows = one(spark, 'Dr. Who came. "Yes!" he said, e.g. now. 3.5 is one', documents.sentences_of)
    assert rows == ["Dr. Who came.", '"Yes!"', "he said, e.g. now.", "3.5 is one"]


def test_line_matches_have_places_and_a_cut(spark):
    files = spark.createDataFrame([(1, "a.md", "x 😀 Ab ab\n" + "ab " * 60)], "doc_id long, relative_path string, text string")
    rows = documents.line_matches(files, "AB").orderBy("line_no", "start_column").collect()
    assert [(r.line_no, r.start_column, r.end_column) for r in rows[:2]] == [(1, 6, 8), (1, 9, 11)]
    assert len(rows) == 50 and rows[0].truncated


def test_ambiguous_calls_resolve_to_nothing(spark):
    calls = spark.createDataFrame([("f", "api.save(x)"), ("f", "db::Load()")], "source string, callee string")
    once = spark.createDataFrame([("n1", "Save"), ("n2", "load")], "id string, label string")
    assert flows.resolve_calls(calls, once).count() == 2
    twice = once.unionByName(spark.createDataFrame([("n3", "save")], "id string, label string"))
    assert [r.target for r in flows.resolve_calls(calls, twice).collect()] == ["n2"]


def test_imports_stay_inside_the_root(spark):
    files = spark.createDataFrame([("a/b.ts",), ("c/index.js",), ("d.ts",), ("d.js",)], "relative_path string")
    imports = spark.createDataFrame([("a/x.ts", "./b"), ("a/x.ts", "../c"), ("a/x.ts", "../../c"), ("a/x.ts", "../d"), ("a/x.ts", "react")], "source string, specifier string")
    assert {(r.specifier, r.target) for r in flows.resolve_imports(imports, files).collect()} == {("./b", "a/b.ts"), ("../c", "c/index.js")}


def test_two_triangles_are_two_communities():
    label = flows.label_communities(list("abcdefg"), [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("a", "z")])
    assert sorted(map(list(label.values()).count, set(label.values()))) == [1, 3, 3]


def test_strong_components():
    import pandas as pd

    found = flows.strong_components(pd.DataFrame([("a", "b"), ("b", "c"), ("c", "b")], columns=["source", "target"]))
    assert set(found["id"]) == {"b", "c"} and set(found["component"]) == {"b"}


def test_neighbourhood_bounds(spark):
    nodes = spark.createDataFrame([(f"n{k:02}", "x", f"n{k}", "p") for k in range(20)], "id string, kind string, label string, file_path string")
    edges = spark.createDataFrame([(f"e{k:02}", "n00", f"n{k:02}", "calls") for k in range(1, 20)] + [("e99", "n01", "n02", "calls")], "id string, source string, target string, kind string")
    found, kept, cut = graph.neighborhood(nodes, edges, ["n00"], depth=1, limit=5)
    assert [r.id for r in found.orderBy("id").collect()] == ["n00", "n01", "n02", "n03", "n04"] and cut
    assert "e99" not in {r.id for r in kept.collect()}  # no end of it was expanded
    _, none, cut = graph.neighborhood(nodes, edges, ["n00", "missing"], depth=0)
    assert none.count() == 0 and not cut


def test_cursors_belong_to_their_query():
    c = inventory.cursor("endpoint:1", "text")
    assert inventory.cursor_id(c, "text") == "endpoint:1"
    with pytest.raises(ValueError):
        inventory.cursor_id(c, "other")


def test_openapi_and_source_tree(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src" / "api.json").write_text('{"openapi": "3.0", "info": {"title": "T"}, "paths": {"/a": {"get": {"operationId": "a", "tags": ["x", "y"]}, "parameters": {}}}}')
    (root / "src" / "main.py").write_text("print(1)")
    (root / "src" / "bin.py").write_bytes(b"\x00\xff")
    (root / "node_modules" / "m.js").write_text("1")
    files = protocols.source_tree(spark, str(root))
    assert {(r.relative_path, r.language) for r in files.collect()} == {("src/api.json", "JSON"), ("src/main.py", "Python")}
    assert protocols.openapi_operations(files).first().asDict() == {"relative_path": "src/api.json", "title": "T", "method": "GET", "route_path": "/a", "operation_id": "a", "api_group": "x"}
    with pytest.raises(ValueError):
        protocols.source_tree(spark, str(root), most_files=1)


def test_trace_lines_refuse_unknown_fields(spark):
    rows = spark.createDataFrame([('@t {"event": 1, "trace": "x"}',), ('@t {"event": 1, "trace": "x", "more": 2}',), ("other",), ("@t not json",)], "value string")
    assert [r.event for r in protocols.trace_lines(rows, "@t ").collect()] == [1]


def test_python_facts_and_environment(spark):
    from threadloom.operators import extract

    code = 'import os\nfrom fastapi import FastAPI\napp = FastAPI()\nclass Shop:\n    def sell(self):\n        return pay(1)\n@app.get("/items")\ndef items():\n    return os.environ["SHOP_KEY"] + os.getenv("REGION")\n'
    files = spark.createDataFrame([("a.py", code), ("b.py", "not python("), ("c.ts", "process.env.PORT"), ("d.py", None)], "relative_path string, text string")
    facts = {(r.kind, r.label, r.owner) for r in extract.python_facts(files).collect()}
    assert {("class", "Shop", None), ("method", "sell", "Shop"), ("function", "items", None), ("endpoint", "GET /items", "items"), ("callTarget", "pay", "sell")} <= facts
    edges = {(r.source, r.target) for r in extract.contains_edges(extract.python_facts(files)).collect()}
    assert ("a.py#Shop", "a.py#sell") in edges and ("a.py", "a.py#Shop") in edges
    assert {(r.relative_path, r.name) for r in extract.environment_names(files).collect()} == {("a.py", "SHOP_KEY"), ("a.py", "REGION"), ("c.ts", "PORT")}


def test_communities_are_of_all_traces_and_values(spark):
    rows = T.runtime_events(spark, SMALL).select("trace_id", "event_id", "k").orderBy("trace_id", "event_id").collect()
    pairs: dict = {}
    for a, b in zip(rows, rows[1:], strict=False):
        if a.trace_id == b.trace_id:
            pairs.setdefault(a.trace_id, set()).add((a.k, b.k))
    want = {(t, i, c) for t, p in pairs.items() for i, c in flows.label_communities(sorted({i for x in p for i in x}), sorted(p)).items()}
    assert {tuple(r) for r in flows.g8(spark, SMALL).collect()} == want


def test_query_texts_are_checked():
    assert views.checked_text("  a b ") == "a b" and views.checked_text("  ") is None and views.checked_text(None) is None
    for bad in ("x" * 257, "a\x00b"):
        with pytest.raises(ValueError):
            views.checked_text(bad)


def test_pages_of_links_follow_each_other_and_cursors_are_bound(spark):
    edges = spark.createDataFrame([(f"e{i:02}", "r", f"class:{i}", "contains") for i in range(4)] + [("e90", "r", "x", "calls"), ("e00b", "y", "r", "calls")], "id string, source string, target string, kind string")
    links = views.link_families(edges, F.col("root") == "r")
    cursor, seen = None, []
    for _ in range(5):
        rows = views.link_page(links, "r", 2, 2, True, cursor).orderBy("place").collect()
        seen += [r["id"] for r in rows]
        cursor = rows[-1]["next_cursor"]
        if cursor is None:
            break
    assert seen == ["e00", "e01", "e02", "e03", "e90", "e00b"]
    with pytest.raises(ValueError):
        views.cursor_offset(views.page_cursor("r", 2, 2, True, 4), "r", 3, 2, True)


def test_receivers_reject_repeats_and_what_is_beyond_their_bound(spark):
    rows = [("a", "t1", "s1", 1), ("a", "t1", "s1", 2), ("a", "t2", "s1", 3), ("a", "t3", "s1", 4), ("b", "t1", "s1", 5)]
    out = views.receiver_counters(spark.createDataFrame(rows, "receiver string, trace_id string, span_id string, at long"), most=2)
    assert sorted(map(tuple, out.collect())) == [("a", 2, 2, 2), ("b", 1, 0, 1)]


def test_snapshots_show_a_suffix_of_the_latest_sessions(spark):
    rows = [("old", 1), ("one", 2), *(("two", i) for i in range(3, 8))]
    out = views.session_snapshots(spark.createDataFrame(rows, "session string, sequence long"), most=3, sessions=2)
    assert sorted(map(tuple, out.collect())) == [("one", 1, 2, False, 1), ("two", 5, 5, True, 3)]


@pytest.mark.parametrize(("path", "group"), [("src/a.ts", "Src"), ("src/orderBook/a.ts", "Order Book"), ("web/lib/user_admin/a.ts", "Web / user admin"), ("a.ts", "File Kind"), ("//x/app/a.ts", "X")])
def test_view_groups(spark, path, group):
    assert one(spark, path, lambda c: views.view_group(c, F.lit("fileKind"))) == group


def test_previews_keep_no_sensitive_names(spark):
    rows = [([("id", "long"), ("password", "string")],), ([("a\nb", "long")],), ([("f", "t")] * 33,), ([],)]
    df = spark.createDataFrame(rows, "fields array<struct<name: string, type: string>>")
    out = [r[0] for r in df.select(evidence.sanitized_fields(F.col("fields"))).collect()]
    assert [f["name"] for f in out[0]] == ["id", "[sensitive-field]"]
    assert out[1] is None and out[2] is None and out[3] == []


def test_dependencies_of_what_cannot_be_read(spark):
    assert one(spark, "{", evidence.package_dependencies) == []
    assert one(spark, '{"peerDependencies": {"B": 1}, "dependencies": {"b": {"v": 2}, "A": "x"}}', evidence.package_dependencies) == ["a", "b"]
    assert one(spark, "# x\n\nFlask==2\r\n -e .\nflask", evidence.requirement_dependencies) == ["flask"]


def test_stages_and_lanes(spark):
    rows = [("Runtime Span", "x", "a.rs", None), ("class", "x", "web\\Admin\\a.rs", None), ("class", "x", "server/a.tsx", None), ("class", "DELETE /x", None, None), ("SDK", "x", "a", "nonsense"), ("SDK", "x", "a", "Data-base")]
    df = spark.createDataFrame(rows, "kind string, label string, path string, layer string")
    c = F.col
    assert [r[0] for r in df.select(navigation.view_stage(c("kind"), c("label"), c("path"), c("layer"))).collect()] == ["trigger", "trigger", "service", "api", "external", "data"]
    assert [r[0] for r in df.select(navigation.lane(c("kind"), c("layer"))).collect()] == ["runtime", "domain", "domain", "domain", "external", "external"]


def test_key_facts_rank_and_keep_what_is_empty(spark):
    df = spark.createDataFrame([({"note": "n", "HTTPStatus": "1", "status_code": "", "url": "u", "b": "2", "a": None},), (None,)], "m map<string,string>")
    first, rest = navigation.presented(F.col("m"))
    got = df.select(first.alias("f"), rest.alias("r")).collect()
    assert [(e["label"], e["value"]) for e in got[0]["f"]] == [("URL", "u"), ("Status code", "(empty)"), ("Note", "n")]
    assert [(e["label"], e["value"]) for e in got[0]["r"]] == [("HTTP status", "1"), ("A", "null"), ("B", "2")]
    assert got[1]["f"] is None and got[1]["r"] is None


def test_handlers_of_two_owners_are_none(spark):
    o = spark.createDataFrame([("a", "GET", "/x", "s"), ("b", "GET", "/x", "s"), ("c", "GET", "/y", "s"), ("d", "GET", "/y", "s")], "id string, method string, route_path string, service string")
    h = spark.createDataFrame([("f", "a"), ("g", "b"), ("h", "c"), ("h", "d")], "owner string, target string")
    assert [(r["route_path"], r["owner"], r["operation_id"]) for r in navigation.unique_handlers(o, h).collect()] == [("/y", "h", "c")]


def test_changes_show_their_ancestry_and_a_marker_each(spark):
    n = spark.createDataFrame([(i, "class", i, p) for i, p in [("a", "x/1"), ("b", "x/2"), ("c", "x/2"), ("d", "x/3")]], "id string, kind string, label string, file_path string")
    e = spark.createDataFrame([("1", "a", "b", "calls"), ("2", "b", "a", "calls"), ("3", "b", "d", "calls")], "id string, source string, target string, kind string")
    c = spark.createDataFrame([("x/2", "modify"), ("gone/old", "delete")], "file_path string, change string")
    nodes, edges = navigation.change_projection(n, e, c)
    assert sorted((r["id"], r["change"]) for r in nodes.collect() if r["kind"] == "class") == [("a", None), ("b", "modify"), ("c", "modify")]
    assert sorted(r["label"] for r in nodes.collect() if r["kind"] != "class") == ["Deleted old", "Modified 2"]
    assert sorted(r["id"] for r in edges.collect()) == ["1", "2", "git-change:x/2:b", "git-change:x/2:c"]
    nodes, edges = navigation.change_projection(n, e, c, focus="c")
    assert sorted(r["id"] for r in nodes.where("kind = 'class'").collect()) == ["c"]
    kinds = [("?", " ", False, "insert"), ("A", " ", True, "conflict"), ("M", "D", False, "delete"), ("M", " ", False, "modify")]
    df = spark.createDataFrame(kinds, "i string, t string, c boolean, want string")
    assert df.where(navigation.change_kind(F.col("i"), F.col("t"), F.col("c")) != F.col("want")).isEmpty()


def test_the_detail_lies_around_the_overview(spark):
    n, e = T.nodes(spark, SMALL), T.edges(spark, SMALL)
    roots = sorted(r["id"] for r in overview.overview(n, e).collect())[:50]
    found = {r["id"] for r in navigation.overview_detail(n, e).collect()}
    assert set(roots) <= found and len(found) == 500
    near, hops = set(roots), [(r["source"], r["target"]) for r in e.collect()]
    for _ in range(4):
        near |= {b for a, b in hops if a in near} | {a for a, b in hops if b in near}
    assert found <= near


def test_run_profiles_of_a_root(spark):
    scripts = ", ".join(f'"s{i:02}": "x"' for i in range(40))
    rows = [("r", "package.json", '{"scripts": {"preview": "x", "dev": "y", ' + scripts + "}}"), ("r", "bun.lockb", ""), ("r", "a/package.json", "[1"), ("r", "node_modules/go.mod", ""), ("r", "z/build.gradle.kts", ""), ("r", "1/2/3/4/5/6/7/8/go.mod", ""), ("q", "gradlew", ""), ("q", "build.gradle", None)]
    rows += [("q", f"m/{i:03}/go.mod", "") for i in range(150)]
    got = navigation.run_profiles(spark.createDataFrame(rows, "root string, path string, content string")).collect()
    r = [(x["source"], x["label"], x["cwd"]) for x in got if x["root"] == "r"]
    assert ("package.json#dev", "bun run dev", "") in r and ("package.json#preview", "bun run preview", "") in r and ("package.json#s27", "bun run s27", "") in r
    assert len(r) == 31 and ("z/build.gradle.kts", "Gradle application", "z") in r
    q = [x for x in got if x["root"] == "q"]
    assert len(q) == 100 and {x["executable"] for x in q} == {"./gradlew", "go"}


def test_truncation_names_the_bounds(spark):
    df = spark.createDataFrame([(1, True, False), (2, None, None)], "k int, a boolean, b boolean")
    assert [r[0] for r in df.orderBy("k").select(navigation.truncation({"x": F.col("a"), "y": F.col("b")})).collect()] == [["x"], []]


def test_a_batch_that_comes_twice_is_kept_once(spark, tmp_path):
    deliver = spans.delivered_to(str(tmp_path))
    first, second = (spark.createDataFrame([(n, "x") for n in ns], "sequence long, kind string") for ns in ((2, 1, 3), (5, 4)))
    deliver(first, 0), deliver(second, 1), deliver(first, 0)
    assert sorted(r["sequence"] for r in spark.read.parquet(f"{tmp_path}/last").collect()) == [1, 2, 3, 4, 5]
    assert [r["sequence"] for r in spark.read.parquet(f"{tmp_path}/last/batch=1").coalesce(1).collect()] == [4, 5]


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None), ({"extra": 1}, "malformed"), ({"kind": "nap"}, "malformed"), ({"stepId": None}, "malformed"), ({"nonce": "m"}, "identity"), ({"parentStepId": "s"}, "steps"), ({"workflowId": "a b"}, "steps"), ({"sequence": 2001}, "sequence"),
        ({"source": {"relativePath": ".env", "line": 1}}, "source"), ({"source": {"relativePath": "/a", "line": 1}}, "source"), ({"source": {"relativePath": "a", "line": 3, "lineEnd": 2}}, "source"), ({"source": {"relativePath": "a", "line": 3, "odd": 2}}, "malformed"),
        ({"kind": "branch"}, "branch"), ({"kind": "branch", "branchOutcome": "loop"}, None), ({"kind": "agent"}, "semantics"), ({"kind": "agent", "operation": "a\nb"}, "semantics"), ({"kind": "agent", "operation": "plan"}, None),
        ({"dataPreview": {"kind": "record", "fields": [{"name": "x", "valueType": "int", "nullable": True}], "truncated": False}}, None), ({"dataPreview": {"kind": "record", "fields": [], "itemCount": 2_000_000_000, "truncated": False}}, "preview"),
    ],
)
def test_debug_lines(spark, change, reason):
    body = {"nonce": "n", "debugSessionId": "d", "workflowId": "w", "sequence": 1, "controlEpoch": 0, "stepId": "s", "kind": "line", "flowStage": "api", "source": {"relativePath": "a/b.rs", "line": 1}, "safePointState": "paused"} | change
    lines = spark.createDataFrame([("@d " + json.dumps(body),), ("plain",), (None,)], "value string")
    assert [r["reason"] for r in protocols.debug_lines(lines, "@d ", "n", "d").collect()] == [reason]
    assert [r["reason"] for r in protocols.debug_lines(spark.createDataFrame([("@d {",)], "value string"), "@d ", "n", "d").collect()] == ["malformed"]


def test_handlers_by_operation_id(spark):
    asked = [("1", "GET", "/api/v1/items", "s", "list_items_get"), ("2", "GET", "/api/both", "s", "both_get"), ("3", "GET", "/items", "s", "list_items_get"), ("4", "GET", "/api/items", "t", "list_items_get"), ("5", "GET", "/api/items", "s", "list_itemsget"), ("6", "GET", "", "s", "list_items_get")]
    e = spark.createDataFrame(asked, "id string, method string, route_path string, service string, declared_id string")
    o = spark.createDataFrame([("a", "GET", "/items", "s"), ("b", "GET", "/both", "s"), ("c", "GET", "/both", "s"), ("d", "GET", "/", "s")], "id string, method string, route_path string, service string")
    h = spark.createDataFrame([("f", "list_items", "a"), ("g", "both", "b"), ("h", "both", "c"), ("i", "list_items", "d")], "owner string, label string, target string")
    assert [tuple(r) for r in navigation.handlers_by_operation_id(e, o, h).collect()] == [("1", "f", "a")]
