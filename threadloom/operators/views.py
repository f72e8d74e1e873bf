"""What views of a graph and of its events ask: link pages, cycle flags, flow roots, stages, groups, datastore calls, counters, snapshots."""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.operators import flows
from threadloom.sources import tables as T

# Stages, folders that name no group, event names without meaning, kinds that may start a flow, bounds.
RUNTIME_STAGES = ("trigger", "api", "backend", "service", "data", "external", "response")
GENERIC_FOLDERS = ("src", "lib", "app", "source", "packages")
TRIVIAL_EVENTS = ("abort", "change", "click", "drag", "end", "mousemove", "start", "tick", "zoom")
ENTRY_KINDS = ("entry", "entrypoint", "main", "handler")
SNAPSHOT_EVENTS, SESSIONS = 250, 8
RECEIVER_SPANS = 8_192


def checked_text(value: str | None, most: int = 256) -> str | None:
    """A query text, trimmed (empty: None). ValueError if it is too long or holds control characters."""
    if value is None or not (text := value.strip()):
        return None
    if len(text) > most:
        raise ValueError(f"over {most} characters")
    if any(unicodedata.category(c) == "Cc" for c in text):
        raise ValueError("control characters")
    return text


def page_cursor(root: str, depth: int, limit: int, tests: bool, offset: int) -> str:
    """A place in a flow's links, bound to the question that it belongs to."""
    bound = hashlib.sha256(f"{root}|{depth}|{limit}|{str(tests).lower()}".encode()).hexdigest()
    return f"{offset}:{bound}"


def cursor_offset(cursor: str | None, root: str, depth: int, limit: int, tests: bool) -> int:
    """Where a cursor points to; ValueError if it was made for another question."""
    if cursor is None:
        return 0
    offset = cursor.partition(":")[0]
    if not (offset.isascii() and offset.isdigit()) or cursor != page_cursor(root, depth, limit, tests, int(offset)):
        raise ValueError("the cursor belongs to another question")
    return int(offset)


def link_families(edges: DataFrame, roots: Column) -> DataFrame:
    """(root, family, id): what hangs on each root in the order of families: contained classes, other outgoing links, incoming links.
    `roots` tests a column named root."""
    handled = (F.col("kind") == "contains") & F.col("target").startswith("class:")
    out = edges.select(F.col("source").alias("root"), F.when(handled, 0).otherwise(1).alias("family"), "id").where(roots)
    back = edges.select(F.col("target").alias("root"), F.lit(2).alias("family"), "id").where(roots)
    return out.unionByName(back)


def link_page(links: DataFrame, root: str, depth: int, limit: int, tests: bool, cursor: str | None) -> DataFrame:
    """One page of a root's links and the cursor of the next one (null on the last). One row more than is shown tells whether there is a next."""
    offset = cursor_offset(cursor, root, depth, limit, tests)
    rows = links.orderBy("family", "id").offset(offset).limit(limit + 1)
    place = F.row_number().over(Window.orderBy("family", "id"))  # over limit + 1 rows at most
    more = F.count("*").over(Window.partitionBy(F.lit(0))) > limit
    following = F.when(more, F.lit(page_cursor(root, depth, limit, tests, offset + limit)))
    return rows.select("family", "id", place.alias("place"), following.alias("next_cursor")).where(F.col("place") <= limit)


def runtime_stage(kind: Column, reported: Column) -> Column:
    """The stage of a flow that a runtime event belongs to: what it reports, if that is a stage, else by its kind."""
    k = F.lower(kind)
    starts = lambda *prefixes: k.rlike("^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")
    return (
        F.when(reported.isin(*RUNTIME_STAGES), reported)
        .when(starts("trace.database."), "data")
        .when(starts("trace.external."), "external")
        .when(starts("trace.http.server.", "trace.http.client.", "trace.event.", "http.", "websocket."), "api")
        .when(starts("trace.agent.", "trace.job.", "trace.function."), "service")
        .otherwise("trigger")
    )


def humanized(value: Column) -> Column:
    """Camel case, dashes, dots and underscores as words, the first letter in upper case; nothing is "Other"."""
    words = F.regexp_replace(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), r"[-_.]+", " ")
    words = F.trim(F.regexp_replace(words, r"\s+", " "))
    return F.when(words == "", "Other").otherwise(F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words))))


def view_group(path: Column, kind: Column) -> Column:
    """The group of a node in a view: the top folder and the first telling folder below it; without folders, the kind."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    telling = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: ~F.lower(p).isin(*GENERIC_FOLDERS))
    root, scope = F.get(parts, F.lit(0)), F.get(telling, F.lit(0))
    named = F.when(scope.isNotNull() & (root != "src"), F.concat(root, F.lit(" / "), scope)).otherwise(F.coalesce(scope, root))
    return humanized(F.when(F.size(parts) > 1, named).otherwise(kind))


def meaningful_event(kind: Column, api: Column, label: Column, path: Column) -> Column:
    """Events worth an overview: no DOM events, no hidden or trivial names, none of drawing code."""
    drawn = F.lower(path).contains("canvas") | F.lower(path).contains("pointcloud")
    return (kind == "event") & (F.coalesce(api, F.lit("")) != "DOM") & ~label.startswith(".") & ~F.lower(label).isin(*TRIVIAL_EVENTS) & ~drawn


def datastore_calls(calls: DataFrame) -> DataFrame:
    """Those of the calls (callee, argument, ...) that reach a datastore, with node_kind, edge_kind, label and confidence."""
    c = F.lower("callee")
    redis = c.rlike(r"^redis$|^redis\.|\.redis\.|^redisclient\.")
    other = c.rlike(r"(^|\.)db\.(query|execute)$|(^|\.)(prisma|sequelize|knex)\.")
    label = F.when(F.col("argument").isNull(), F.col("callee")).otherwise(F.concat("callee", F.lit(" "), "argument"))
    found = calls.where(redis | other)
    return found.withColumns({"node_kind": F.lit("database"), "edge_kind": F.when(redis, "accesses").otherwise("queries"), "label": label, "confidence": F.lit(0.88)})


def receiver_counters(spans: DataFrame, most: int = RECEIVER_SPANS) -> DataFrame:
    """(receiver, accepted, rejected, traces) of spans (receiver, trace_id, span_id, at): the first of each span is accepted, up to `most` of a
    receiver; repeats and what comes later are rejected. Keys are aggregated before they are ranked, and ranks stop at `most`."""
    keys = spans.groupBy("receiver", "trace_id", "span_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("receiver").orderBy("first", "trace_id", "span_id"))
    taken = keys.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("receiver").agg(F.count("*").alias("accepted"), F.count_distinct("trace_id").alias("traces"))
    return keys.groupBy("receiver").agg(F.sum("n").alias("all")).join(taken, "receiver").select("receiver", "accepted", (F.col("all") - F.col("accepted")).alias("rejected"), "traces")


def session_snapshots(events: DataFrame, most: int = SNAPSHOT_EVENTS, sessions: int = SESSIONS) -> DataFrame:
    """The latest sessions of events (session, sequence): how many events each has, and where the suffix that is shown begins."""
    nth = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("sequence")))
    shown = events.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("session").agg(F.min("sequence").alias("events_start_sequence"), F.count("*").alias("shown"))
    last = events.groupBy("session").agg(F.count("*").alias("event_count"), F.max("sequence").alias("last")).orderBy(F.desc("last"), "session").limit(sessions)
    return last.join(shown, "session").select("session", "event_count", "events_start_sequence", (F.col("event_count") > most).alias("events_truncated"), "shown")


GRAPH = f"WITH {T.NODES}, {T.EDGES}"
EV = f"WITH {T.EVENTS}"
ROOT, DEPTH, LIMIT, OFFSET = "controller:7", 4, 5, 4
FAMILIES = """links AS (SELECT source AS root, CASE WHEN kind = 'contains' AND target LIKE 'class:%' THEN 0 ELSE 1 END AS family, id FROM edges UNION ALL SELECT target, 2, id FROM edges)"""


@query("u1_link_families", f"{GRAPH}, {FAMILIES} SELECT root, family, count(*) AS links, min(id) AS first FROM links WHERE root LIKE 'controller:%' GROUP BY root, family")
def u1(spark, sf_dir):
    links = link_families(T.edges(spark, sf_dir), F.col("root").startswith("controller:"))
    return links.groupBy("root", "family").agg(F.count("*").alias("links"), F.min("id").alias("first"))


@query(
    "l3_link_page",
    f"""{GRAPH}, {FAMILIES}, page AS (SELECT family, id, row_number() OVER (ORDER BY family, id) - {OFFSET} AS place, count(*) OVER () AS n FROM links WHERE root = '{ROOT}')
  SELECT family, id, place, CASE WHEN n > {OFFSET + LIMIT} THEN '{OFFSET + LIMIT}:' || sha256('{ROOT}|{DEPTH}|{LIMIT}|false') END AS next_cursor FROM page WHERE place BETWEEN 1 AND {LIMIT}""",
)
def l3(spark, sf_dir):
    """The second page of a root's links."""
    links = link_families(T.edges(spark, sf_dir), F.col("root") == ROOT)
    return link_page(links, ROOT, DEPTH, LIMIT, False, page_cursor(ROOT, DEPTH, LIMIT, False, OFFSET))


@query(
    "g7_cycle_edges",
    f"""WITH RECURSIVE {T.EVENTS}, n AS (SELECT DISTINCT trace_id, k AS a, lead(k) OVER (PARTITION BY trace_id ORDER BY event_id) AS b FROM runtime_events), e AS (FROM n WHERE a IS NOT NULL AND b IS NOT NULL),
  r(trace_id, a, b) AS (FROM e UNION SELECT r.trace_id, r.a, e.b FROM r JOIN e ON e.trace_id = r.trace_id AND e.a = r.b)
  SELECT e.trace_id, e.a AS source, e.b AS target, r.a IS NOT NULL AS cyclic FROM e LEFT JOIN r ON r.trace_id = e.trace_id AND r.a = e.b AND r.b = e.a""",
)
def g7(spark, sf_dir):
    """Which edges of each user's graph of transitions (100 nodes at most) lie on a cycle: loops, and edges within a strong component."""

    def flagged(pdf):
        rows = flows.strong_components(pdf)
        part = dict(zip(rows["id"], rows["component"], strict=True))
        same = [a == b or (a in part and part[a] == part.get(b)) for a, b in zip(pdf["source"], pdf["target"], strict=True)]
        return pdf.assign(cyclic=same)[["trace_id", "source", "target", "cyclic"]]

    return flows.transitions(spark, sf_dir).groupBy("trace_id").applyInPandas(flagged, "trace_id string, source long, target long, cyclic boolean")


@query("l12_flow_root", f"{GRAPH} SELECT id, CAST(CASE WHEN kind = 'controller' AND label LIKE 'B%' THEN 100 ELSE 0 END + CASE kind WHEN 'endpoint' THEN 50 ELSE 0 END AS BIGINT) AS score FROM nodes ORDER BY score DESC, id LIMIT 1")
def l12(spark, sf_dir):
    """Where a flow starts if nobody says so: declared roots, endpoints, entries; the smallest id of the best."""
    declared = (F.col("kind") == "controller") & F.col("label").startswith("B")
    score = declared.cast("long") * 100 + (F.col("kind") == "endpoint").cast("long") * 50 + F.col("kind").isin(*ENTRY_KINDS).cast("long") * 25
    return T.nodes(spark, sf_dir).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(1)


PREFIXES = ("trace.database.", "trace.external.", "Trace.Http.Server.", "trace.http.client.", "trace.event.", "http.", "websocket.", "trace.agent.", "trace.job.", "trace.function.", "trace.", "httpx.", "ui.")


@query(
    "p24_runtime_stage",
    f"""{EV}, e AS (SELECT event_id, lower({list(PREFIXES)}[k % 13 + 1] || kind) AS kind, CASE k % 9 WHEN 0 THEN 'response' WHEN 1 THEN 'elsewhere' END AS reported FROM runtime_events)
  SELECT event_id, CASE WHEN reported = 'response' THEN reported WHEN kind LIKE 'trace.database.%' THEN 'data' WHEN kind LIKE 'trace.external.%' THEN 'external'
    WHEN kind LIKE 'trace.http.server.%' OR kind LIKE 'trace.http.client.%' OR kind LIKE 'trace.event.%' OR kind LIKE 'http.%' OR kind LIKE 'websocket.%' THEN 'api'
    WHEN kind LIKE 'trace.agent.%' OR kind LIKE 'trace.job.%' OR kind LIKE 'trace.function.%' THEN 'service' ELSE 'trigger' END AS stage FROM e""",
)
def p24(spark, sf_dir):
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), F.expr("cast(k % 13 as int) + 1"))
    reported = F.when(F.expr("k % 9 = 0"), "response").when(F.expr("k % 9 = 1"), "elsewhere")
    return T.runtime_events(spark, sf_dir).select("event_id", runtime_stage(F.concat(prefix, "kind"), reported).alias("stage"))


@query(
    "p6_view_group",
    rf"""WITH {T.FILES}, p AS (SELECT doc_id, [x FOR x IN string_split(relative_path, '/') IF x <> ''] AS parts FROM files),
  s AS (SELECT doc_id, parts[1] AS root, [x FOR x IN parts[2:len(parts) - 1] IF lower(x) NOT IN {GENERIC_FOLDERS}][1] AS scope FROM p),
  v AS (SELECT doc_id, CASE WHEN scope IS NOT NULL AND root <> 'src' THEN root || ' / ' || scope ELSE coalesce(scope, root) END AS v FROM s),
  w AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(v, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[-_.]+', ' ', 'g'), '\s+', ' ', 'g')) AS w FROM v)
  SELECT doc_id, upper(w[1]) || w[2:] AS view_group FROM w""",
)
def p6(spark, sf_dir):
    return T.files(spark, sf_dir).select("doc_id", view_group(F.col("relative_path"), F.lit("file")).alias("view_group"))


LABELS = ("order.placed", ".hidden", "Zoom", "tick", "Dragged", "mousemove")


@query(
    "f13_meaningful_events",
    f"""{EV}, e AS (SELECT event_id, CASE WHEN k % 11 = 0 THEN 'function' ELSE 'event' END AS kind, CASE k % 5 WHEN 0 THEN 'DOM' WHEN 1 THEN 'bus' END AS api, {list(LABELS)}[k % 6 + 1] AS label,
    CASE k % 7 WHEN 0 THEN 'ui/Canvas/a.ts' WHEN 1 THEN 'view/pointCloud.ts' ELSE 'src/a.ts' END AS path FROM runtime_events)
  SELECT event_id, label FROM e WHERE kind = 'event' AND coalesce(api, '') <> 'DOM' AND label NOT LIKE '.%' AND lower(label) NOT IN {TRIVIAL_EVENTS} AND path NOT ILIKE '%canvas%' AND path NOT ILIKE '%pointcloud%'""",
)
def f13(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.expr("cast(k % 6 as int) + 1"))
    kind = F.when(F.expr("k % 11 = 0"), "function").otherwise("event")
    api = F.when(F.expr("k % 5 = 0"), "DOM").when(F.expr("k % 5 = 1"), "bus")
    path = F.when(F.expr("k % 7 = 0"), "ui/Canvas/a.ts").when(F.expr("k % 7 = 1"), "view/pointCloud.ts").otherwise("src/a.ts")
    return T.runtime_events(spark, sf_dir).select("event_id", label.alias("label"), "k").where(meaningful_event(kind, api, F.col("label"), path)).select("event_id", "label")


CALLEES = ("redis.get", "app.Redis.set", "redisClient.del", "db.query", "ctx.db.execute", "db.queryAll", "prisma.user.find", "app.prisma.x", "knex.select", "mydb.query", "sequelize.sync", "redis", "predis.get")


@query(
    "x4_datastore_calls",
    f"""WITH c AS (SELECT p_partkey, {list(CALLEES)}[p_partkey % 13 + 1] AS callee, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS argument FROM part), l AS (SELECT *, lower(callee) AS c FROM c),
  d AS (SELECT *, c = 'redis' OR c LIKE 'redis.%' OR c LIKE '%.redis.%' OR c LIKE 'redisclient.%' AS redis FROM l)
  SELECT p_partkey, 'database' AS node_kind, CASE WHEN redis THEN 'accesses' ELSE 'queries' END AS edge_kind, callee || coalesce(' ' || argument, '') AS label, CAST(0.88 AS DOUBLE) AS confidence FROM d
  WHERE redis OR c IN ('db.query', 'db.execute') OR c LIKE '%.db.query' OR c LIKE '%.db.execute' OR c LIKE 'prisma.%' OR c LIKE '%.prisma.%' OR c LIKE 'sequelize.%' OR c LIKE '%.sequelize.%' OR c LIKE 'knex.%' OR c LIKE '%.knex.%'""",
)
def x4(spark, sf_dir):
    callee = F.element_at(F.array(*map(F.lit, CALLEES)), F.expr("cast(p_partkey % 13 as int) + 1"))
    calls = T.table(spark, sf_dir, "part").select("p_partkey", callee.alias("callee"), F.when(F.expr("p_partkey % 5 > 0"), F.col("p_name")).alias("argument"))
    return datastore_calls(calls).select("p_partkey", "node_kind", "edge_kind", "label", "confidence")


@query("u6_unique_profiles", f"WITH {T.OPERATIONS} SELECT source_service || ':' || api_group || ':' || method AS profile, min_by(id, (file_path, route_path, id)) AS first_id, count(*) AS found FROM operations GROUP BY 1")
def u6(spark, sf_dir):
    """Profiles that several manifests declare count once: the first by path wins."""
    profile = F.concat_ws(":", "source_service", "api_group", "method")
    return T.operations(spark, sf_dir).groupBy(profile.alias("profile")).agg(F.min_by("id", F.struct("file_path", "route_path", "id")).alias("first_id"), F.count("*").alias("found"))


@query(
    "a22_receiver_counters",
    f"""{EV}, k AS (SELECT kind AS receiver, trace_id, span_id, min(event_id) AS first, count(*) AS n FROM runtime_events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY receiver ORDER BY first, trace_id, span_id) <= {RECEIVER_SPANS} AS taken FROM k)
  SELECT receiver, count(*) FILTER (taken) AS accepted, CAST(sum(n) - count(*) FILTER (taken) AS BIGINT) AS rejected, count(DISTINCT trace_id) FILTER (taken) AS traces FROM r GROUP BY receiver""",
)
def a22(spark, sf_dir):
    spans = T.runtime_events(spark, sf_dir).select(F.col("kind").alias("receiver"), "trace_id", "span_id", F.col("event_id").alias("at"))
    return receiver_counters(spans)


@query(
    "t11_session_snapshots",
    f"""{EV}, s AS (SELECT kind || ':' || phase AS session, event_id AS sequence FROM runtime_events), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY sequence DESC) AS nth FROM s)
  SELECT session, count(*) AS event_count, min(sequence) FILTER (nth <= {SNAPSHOT_EVENTS}) AS events_start_sequence, count(*) > {SNAPSHOT_EVENTS} AS events_truncated, count(*) FILTER (nth <= {SNAPSHOT_EVENTS}) AS shown
  FROM r GROUP BY session ORDER BY max(sequence) DESC, session LIMIT {SESSIONS}""",
)
def t11(spark, sf_dir):
    events = T.runtime_events(spark, sf_dir).select(F.concat_ws(":", "kind", "phase").alias("session"), F.col("event_id").alias("sequence"))
    return session_snapshots(events)
