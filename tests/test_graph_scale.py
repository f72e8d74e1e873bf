"""Strong components of one graph, and templated routes, against plain versions."""

from __future__ import annotations

import random
import re

import pandas as pd
import pytest

from threadloom.operators import components, correlate, flows, references, triangles


@pytest.mark.parametrize(("n", "edges"), [(40, 50), (40, 90), (60, 64)])
def test_components_are_those_of_a_depth_first_search(spark, n, edges):
    rng = random.Random(n + edges)
    rows = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(edges)]
    rows += [(f"c{k:02}", f"c{(k + 1) % 17:02}") for k in range(17)] + [("a", "a"), ("a", "b"), (None, "b")]
    got = {r.id: (r.component, r.size) for r in components.strong_components(spark.createDataFrame(rows, "source string, target string")).collect()}
    plain = flows.strong_components(pd.DataFrame([r for r in rows if r[0]], columns=["source", "target"]))
    assert got == {i: (c, s) for i, c, s in plain.itertuples(index=False)}


def test_no_edges_no_components(spark):
    assert components.strong_components(spark.createDataFrame([("a", "b")], "source string, target string")).count() == 0


def cycles(count: int, length: int) -> list:
    """Cycles that share nothing, each with a tail on either side; numbers are mixed, so that their order says nothing of the way round."""
    at = lambda c, k: c * 1000 + k * 37 % 101
    return [(at(c, k), at(c, (k + 1) % length)) for c in range(count) for k in range(length)] + [(c * 1000 + 500, at(c, 0)) for c in range(count)] + [(at(c, 1), c * 1000 + 501) for c in range(count)]


def test_small_graphs_take_no_rounds_over_all_of_them(spark, monkeypatch):
    """Tables written: a few for each halving of a piece, not some for each step round a cycle."""
    tables = []
    monkeypatch.setattr(components, "written", lambda df, name, plain=components.written: tables.append(name) or plain(df, name))
    rows = cycles(20, 60)
    got = {tuple(r) for r in components.strong_components(spark.createDataFrame(rows, "source long, target long")).collect()}
    assert got == {(a, min(x for x, _ in rows if x // 1000 == a // 1000), 60) for a, _ in rows if a % 1000 < 500}
    assert len(tables) < 40


@pytest.mark.parametrize("small", [0, 15, 45, 10_000])
def test_pieces_of_any_size_give_the_same_components(spark, small):
    rng = random.Random(small)
    rows = [(f"{g}/{rng.randrange(n)}", f"{g}/{rng.randrange(n)}") for g, n in enumerate((3, 8, 8, 12, 30, 40)) for _ in range(int(n * 1.4))]
    got = {tuple(r) for r in components.strong_components(spark.createDataFrame(rows, "source string, target string"), small).collect()}
    assert got == set(flows.strong_components(pd.DataFrame(rows, columns=["source", "target"])).itertuples(index=False, name=None))


def test_pieces_are_what_edges_connect(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(400)] + [(5000, k) for k in range(5001, 5100)]
    root = list(range(6000))

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        root[top(a)] = top(b)
    edges = spark.createDataFrame(rows, "source long, target long")
    hashes = {r.h: r.id for r in edges.selectExpr("explode(array(source, target)) as id").selectExpr("id", "xxhash64(id) as h").collect()}
    met: dict = {}
    for r in components.pieces(edges).collect():
        met.setdefault(r.piece, set()).add(hashes[r.node])
    want: dict = {}
    for x in {x for a, b in rows if a != b for x in (a, b)}:
        want.setdefault(top(x), set()).add(x)
    assert sorted(map(sorted, met.values())) == sorted(map(sorted, want.values()))


def plain_match(template: str, path: str) -> bool:
    clean = lambda p: [s for s in re.sub(r"^[a-z]+://[^/]*", "", re.split(r"[?#]", p)[0]).split("/") if s]
    a, b = clean(template), clean(path)
    return len(a) == len(b) and all(x == y or re.fullmatch(r"\{[^/{}]+\}|:[^/]+|\*", x) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("most", [10_000, 0])
def test_routes_are_those_of_all_comparisons(spark, monkeypatch, most):
    monkeypatch.setattr(correlate, "MOST_MASKS", most)
    rng = random.Random(9)
    part = lambda wild: rng.choice(["a", "b", "users", "1", *(["{id}", ":name", "*", "{}", "{a}{b}", ":"] if wild else [])])
    routes = [(k, rng.choice(["GET", "post", None]), "/" + "/".join(part(True) for _ in range(rng.randint(0, 3))) + rng.choice(["", "/"])) for k in range(40)]
    requests = [(k, rng.choice(["get", "POST", None]), rng.choice(["", "https://h:1"]) + "/" + "/".join(part(False) for _ in range(rng.randint(0, 3))) + rng.choice(["", "/", "?q=/a", "#/x"])) for k in range(120)]
    requests += [(500, "GET", None), (501, "GET", "")]
    r = spark.createDataFrame(requests, "request long, method string, path string")
    t = spark.createDataFrame(routes, "route long, method string, template string")
    fits = lambda m, made: m is None or made is None or m.upper() == made.upper()
    want = {(q, k) for q, m, p in requests if p for k, made, template in routes if plain_match(template, p) and fits(m, made)}
    assert {tuple(x) for x in correlate.matches(r, t).collect()} == want
    once = {q: [k for a, k in want if a == q] for q, _ in want}
    assert {(x.request, x.route) for x in correlate.correlated(r, t).collect()} == {(q, k[0]) for q, k in once.items() if len(k) == 1}
    assert "NestedLoop" not in correlate.matches(r, t)._jdf.queryExecution().executedPlan().toString()


def test_a_single_route_is_found_without_pairs(spark, monkeypatch):
    """Routes that share a key meet requests as one row: 3,000 times 3,000 pairs are never made."""
    monkeypatch.setattr(correlate, "matches", None)
    routes = spark.range(3000).selectExpr("id as route", "'GET' as method", "'/a/{b}' as template").union(spark.sql("select 5000L, 'POST', '/a/:c' union all select 5000L, null, '/a/*/d' union all select 5001L, 'PUT', '/a/x'"))
    requests = spark.range(3000).selectExpr("id as request", "if(id % 3 = 0, 'post', 'get') as method", "concat('/a/', id % 7) as path").union(spark.sql("select 9000L, null, '/a/1/d' union all select 9001L, 'put', '/a/x' union all select 9001L, 'post', '/a/y' union all select 9002L, null, '/a/x'"))
    got = {(r.request, r.route) for r in correlate.correlated(requests, routes).collect()}
    assert got == {(k, 5000) for k in range(0, 3000, 3)} | {(9000, 5000)}


def plain_chain(items: dict, start: str):
    at, seen, hops = start, [], 0
    while (ref := items[at]) is not None:
        if not ref.startswith("#/"):
            return at, hops, "remote"
        if ref[1:] in seen:
            return at, hops, "cycle"
        if hops == references.HOPS:
            return at, hops, "long"
        if ref[1:] not in items:
            return at, hops, "missing"
        at, hops = ref[1:], hops + 1
        seen.append(at)
    return at, hops, None


def test_references_are_followed_one_by_one(spark):
    rng = random.Random(11)
    docs = {d: {f"/p{k}": rng.choice([None, "x.json#/p1", "#/nowhere", "#", *(f"#/p{rng.randrange(30)}" for _ in range(9))]) for k in range(30)} for d in range(4)}
    docs[9] = {f"/p{k}": f"#/p{k + 1}" for k in range(12)} | {"/p12": None, "/self": "#/self"}
    rows = [(d, p, r) for d, items in docs.items() for p, r in items.items()]
    got = {(r.document, r.pointer): (r.target, r.hops, r.stopped) for r in references.followed(spark.createDataFrame(rows, "document int, pointer string, ref string")).collect()}
    assert got == {(d, p): plain_chain(items, p) for d, items in docs.items() for p in items}
    assert {s for *_, s in got.values()} == {None, "remote", "missing", "cycle", "long"}


def test_common_neighbours_of_adjacent_pairs(spark):
    rng = random.Random(13)
    rows = [(rng.randrange(30), rng.randrange(30)) for _ in range(150)] + [(99, k) for k in range(30)] + [(None, 1), (2, None)]
    near: dict = {}
    for a, b in rows:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    got = {(r.a, r.b): r.common for r in triangles.common_neighbours(spark.createDataFrame(rows, "source long, target long")).collect()}
    assert got == {(a, b): len(near[a] & near[b]) for a in near for b in near[a] if a < b}
