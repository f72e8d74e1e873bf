"""Runtime events, spans and workflows: canonical spans, parents, overlays, collapsing, pages, rate windows, state checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.sources import tables as T


def canonical_spans(events: DataFrame) -> DataFrame:
    """One row for each (trace, span): its anchor is the start event, else the first by time and id; more than one start is ambiguous."""
    anchor = F.struct(F.when(F.col("phase") == "start", 0).otherwise(1).alias("p"), "at", "event_id")
    return (
        events.groupBy("trace_id", "span_id")
        .agg(
            F.min_by("event_id", anchor).alias("anchor"),
            F.min_by("kind", anchor).alias("kind"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            F.count_if(F.col("phase") == "start").alias("starts"),
            F.count("*").alias("events"),
        )
        .withColumn("ambiguous", F.col("starts") > 1)
    )


def with_parent(events: DataFrame) -> DataFrame:
    """Events and the event before them in their trace."""
    order = Window.partitionBy("trace_id").orderBy("at", "event_id")
    return events.withColumn("parent_id", F.lag("event_id").over(order))


def span_category(db: str, messaging: str, kind: str, route: str, method: str):
    """Database, event, server, client, external or function; the first rule that holds decides."""
    c = F.col
    return (
        F.when(c(db).isNotNull(), "Database")
        .when(c(messaging).isNotNull() | c(kind).isin(4, 5), "Event")
        .when((c(kind) == 2) | c(route).isNotNull(), "HttpServer")
        .when((c(kind) == 3) & c(method).isNotNull(), "HttpClient")
        .when(c(kind) == 3, "External")
        .otherwise("Function")
    )


def overlay(events: DataFrame) -> DataFrame:
    """What was observed at each node: counts, the last 20 events, up to 20 traces, the last time. Only the bounded tails are gathered:
    events are ranked within their node first."""
    latest = Window.partitionBy("node_id").orderBy(F.desc("at"), F.desc("event_id"))
    tail = events.withColumn("r", F.row_number().over(latest)).where("r <= 20").groupBy("node_id").agg(F.sort_array(F.collect_list("event_id")).alias("last_events"))
    traces = events.select("node_id", "trace_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy("trace_id"))).where("r <= 20").groupBy("node_id").agg(F.sort_array(F.collect_list("trace_id")).alias("traces"))
    sums = events.groupBy("node_id").agg(F.count("*").alias("observations"), F.max("at").alias("last_at"))
    return sums.join(tail, "node_id").join(traces, "node_id")


def runs(steps: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Consecutive rows of equal value as one: (key, run, value, first, last, length)."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return steps.withColumn("run", F.sum(changed).over(w)).groupBy(key, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def rate_windows(events: DataFrame, seconds: int, admit: int) -> DataFrame:
    """(window_start, admitted, dropped): the first `admit` events of each aligned window pass, the rest are counted."""
    n = events.groupBy(F.window("at", f"{seconds} seconds")["start"].alias("window_start")).agg(F.count("*").alias("n"))
    return n.select("window_start", F.least("n", F.lit(admit)).alias("admitted"), F.greatest(F.col("n") - admit, F.lit(0)).alias("dropped"))


def phase_machine(events: DataFrame) -> DataFrame:
    """(event_id, verdict): start and event need a new span, end an open one. In batch: by the place of an event in its span."""
    order = Window.partitionBy("trace_id", "span_id").orderBy("at", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.max(F.when(F.col("phase") != "end", 1)).over(before), F.lit(0))
    closed = F.coalesce(F.max(F.when(F.col("phase").isin("end", "event"), 1)).over(before), F.lit(0))
    verdict = F.when(F.col("phase") != "end", F.when(opened == 0, "accepted").otherwise("duplicate")).when(opened == 0, "unknown span").when(closed == 1, "already ended").otherwise("accepted")
    return events.select("event_id", verdict.alias("verdict"))


EV = f"WITH {T.EVENTS}"
STEPS = f"WITH {T.STEPS}"


@query(
    "a14_span_canonical",
    f"""{EV} SELECT trace_id, span_id, min_by(event_id, (CASE phase WHEN 'start' THEN 0 ELSE 1 END, seen_at, event_id)) AS anchor, min_by(kind, (CASE phase WHEN 'start' THEN 0 ELSE 1 END, seen_at, event_id)) AS kind,
  CAST(epoch_us(min(seen_at)) AS BIGINT) AS first_us, CAST(epoch_us(max(seen_at)) AS BIGINT) AS last_us, count(*) FILTER (phase = 'start') AS starts, count(*) AS events, count(*) FILTER (phase = 'start') > 1 AS ambiguous FROM runtime_events GROUP BY ALL""",
)
def a14(spark, sf_dir):
    s = canonical_spans(T.runtime_events(spark, sf_dir))
    return s.select("trace_id", "span_id", "anchor", "kind", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "starts", "events", "ambiguous")


@query("j17_parent_span", f"{EV} SELECT event_id, lag(event_id) OVER (PARTITION BY trace_id ORDER BY seen_at, event_id) AS parent_id FROM runtime_events")
def j17(spark, sf_dir):
    return with_parent(T.runtime_events(spark, sf_dir)).select("event_id", "parent_id")


@query(
    "a13_observation_rollup",
    f"""{EV}, r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seen_at DESC, event_id DESC) AS r FROM runtime_events), t AS (SELECT node_id, trace_id, row_number() OVER (PARTITION BY node_id ORDER BY trace_id) AS r FROM (SELECT DISTINCT node_id, trace_id FROM runtime_events))
  SELECT node_id, count(*) AS observations, CAST(epoch_us(max(seen_at)) AS BIGINT) AS last_us, string_agg(event_id, ',' ORDER BY event_id) FILTER (r <= 20) AS last_events,
  (SELECT string_agg(trace_id, ',' ORDER BY trace_id) FROM t WHERE t.node_id = r.node_id AND t.r <= 20) AS traces FROM r GROUP BY node_id""",
)
def a13(spark, sf_dir):
    o = overlay(T.runtime_events(spark, sf_dir))
    return o.select("node_id", "observations", F.unix_micros("last_at").alias("last_us"), F.array_join(F.col("last_events").cast("array<string>"), ",").alias("last_events"), F.array_join("traces", ",").alias("traces"))


@query("j18_runtime_overlay", f"{EV}, {T.NODES} SELECT n.id, n.kind, count(e.event_id) AS observations FROM nodes n LEFT JOIN runtime_events e ON e.node_id = n.id GROUP BY ALL")
def j18(spark, sf_dir):
    """Static nodes with what was observed at them; observations never change what is declared."""
    sums = T.runtime_events(spark, sf_dir).groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("observations"))
    return T.nodes(spark, sf_dir).select("id", "kind").join(sums, "id", "left").fillna(0, ["observations"])


@query("j16_correlate", f"{EV}, {T.NODES} SELECT CASE WHEN n.id IS NOT NULL THEN 'observedAt' WHEN u.label IS NOT NULL THEN 'correlatesTo' ELSE 'none' END AS relation, count(*) AS events FROM runtime_events e LEFT JOIN nodes n ON n.id = e.node_id LEFT JOIN (SELECT label FROM nodes WHERE kind IN ('service', 'controller') GROUP BY label HAVING count(*) = 1) u ON u.label = 'NATION_' || (e.k % 40) GROUP BY 1")
def j16(spark, sf_dir):
    """An event's node: by its id, else by a label that just one node has, else none."""
    n = T.nodes(spark, sf_dir)
    e = T.runtime_events(spark, sf_dir).withColumn("label", F.concat(F.lit("NATION_"), F.expr("cast(k % 40 as string)")))
    exact = n.select(F.col("id").alias("node_id"), F.lit(True).alias("exact"))
    unique = n.where("kind in ('service', 'controller')").groupBy("label").agg(F.count("*").alias("same")).where("same = 1")
    relation = F.when(F.col("exact"), "observedAt").when(F.col("same") == 1, "correlatesTo").otherwise("none")
    return e.join(exact, "node_id", "left").join(unique, "label", "left").groupBy(relation.alias("relation")).agg(F.count("*").alias("events"))


@query("a15_workflow_summary", f"{STEPS} SELECT workflow_id, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) AS steps, min_by(label, sequence) AS first_label, max_by(kind, sequence) AS last_kind FROM workflow_steps GROUP BY workflow_id")
def a15(spark, sf_dir):
    s = T.workflow_steps(spark, sf_dir)
    return s.groupBy("workflow_id").agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count("*").alias("steps"), F.min_by("label", "sequence").alias("first_label"), F.max_by("kind", "sequence").alias("last_kind"))


@query(
    "a16_collapse",
    f"""{EV}, c AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w THEN 0 ELSE 1 END AS changed FROM runtime_events WINDOW w AS (PARTITION BY trace_id ORDER BY event_id)), g AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY trace_id ORDER BY event_id) AS BIGINT) AS run FROM c)
  SELECT trace_id, run, kind, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY ALL""",
)
def a16(spark, sf_dir):
    return runs(T.runtime_events(spark, sf_dir), "trace_id", "event_id", "kind")


@query("w10_step_pages", f"{EV}, p AS (SELECT trace_id, event_id, (row_number() OVER (PARTITION BY trace_id ORDER BY event_id) - 1) // 12 AS page FROM runtime_events) SELECT trace_id, page, min(event_id) AS first, max(event_id) AS last, count(*) AS steps FROM p GROUP BY ALL")
def w10(spark, sf_dir):
    page = F.floor((F.row_number().over(Window.partitionBy("trace_id").orderBy("event_id")) - 1) / 12)
    return T.runtime_events(spark, sf_dir).withColumn("page", page).groupBy("trace_id", "page").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("steps"))


@query("l14_ring_tail", f"{EV}, tail AS (SELECT event_id, kind FROM runtime_events ORDER BY event_id DESC LIMIT 2000) FROM tail")
def l14(spark, sf_dir):
    """The last 2,000 events, oldest first."""
    return T.runtime_events(spark, sf_dir).orderBy(F.desc("event_id")).limit(2000).orderBy("event_id").select("event_id", "kind")


@query("s22_delete_trace", f"{EV} SELECT count(*) AS kept FROM runtime_events WHERE trace_id <> 'trace-7'")
def s22(spark, sf_dir):
    return T.runtime_events(spark, sf_dir).where("trace_id <> 'trace-7'").agg(F.count("*").alias("kept"))


@query("f17_relevant_events", f"{EV} SELECT kind, count(*) AS n FROM runtime_events WHERE kind IN ('error', 'purchase') OR k >= 50 GROUP BY kind")
def f17(spark, sf_dir):
    return T.runtime_events(spark, sf_dir).where("kind in ('error', 'purchase') or k >= 50").groupBy("kind").agg(F.count("*").alias("n"))


CATEGORY = """CASE WHEN kind = 'purchase' THEN 'Database' WHEN kind = 'signup' OR k % 6 IN (4, 5) THEN 'Event' WHEN k % 6 = 2 OR kind = 'view' THEN 'HttpServer' WHEN k % 6 = 3 AND kind = 'click' THEN 'HttpClient' WHEN k % 6 = 3 THEN 'External' ELSE 'Function' END"""


@query("p17_span_category", f"{EV} SELECT event_id, {CATEGORY} AS category FROM runtime_events")
def p17(spark, sf_dir):
    e = T.runtime_events(spark, sf_dir)
    is_ = lambda name: F.when(F.col("kind") == name, F.lit(name))
    named = e.select("event_id", is_("purchase").alias("db"), is_("signup").alias("messaging"), F.expr("cast(k % 6 as int)").alias("span_kind"), is_("view").alias("route"), is_("click").alias("method"))
    return named.select("event_id", span_category("db", "messaging", "span_kind", "route", "method").alias("category"))


@query("p18_timestamps", f"{EV} SELECT event_id, strftime(seen_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp FROM runtime_events")
def p18(spark, sf_dir):
    return T.runtime_events(spark, sf_dir).select("event_id", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("stamp"))


@query("t5_rate_window", f"{EV}, w AS (SELECT time_bucket(INTERVAL 3600 SECONDS, seen_at) AS b, count(*) AS n FROM runtime_events GROUP BY 1) SELECT CAST(epoch_us(b) AS BIGINT) AS window_us, least(n, 12) AS admitted, greatest(n - 12, 0) AS dropped FROM w")
def t5(spark, sf_dir):
    return rate_windows(T.runtime_events(spark, sf_dir), 3600, 12).select(F.unix_micros("window_start").alias("window_us"), "admitted", "dropped")


@query("t7_sampled_points", f"{EV} SELECT event_id FROM runtime_events WHERE event_id % 10 = 0")
def t7(spark, sf_dir):
    return T.runtime_events(spark, sf_dir).where("event_id % 10 = 0").select("event_id")


@query(
    "t2_phase_machine",
    f"""{EV}, p AS (SELECT *, coalesce(max(CASE WHEN phase <> 'end' THEN 1 END) OVER b, 0) AS opened, coalesce(max(CASE WHEN phase IN ('end', 'event') THEN 1 END) OVER b, 0) AS closed FROM runtime_events WINDOW b AS (PARTITION BY trace_id, span_id ORDER BY seen_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT event_id, CASE WHEN phase <> 'end' THEN CASE WHEN opened = 0 THEN 'accepted' ELSE 'duplicate' END WHEN opened = 0 THEN 'unknown span' WHEN closed = 1 THEN 'already ended' ELSE 'accepted' END AS verdict FROM p""",
)
def t2(spark, sf_dir):
    return phase_machine(T.runtime_events(spark, sf_dir))


@query("t4_sequence_check", f"{STEPS} SELECT workflow_id, count(*) AS steps, CAST(sum(CASE WHEN sequence = prev + 1 OR (prev IS NULL AND sequence = 0) THEN 1 ELSE 0 END) AS BIGINT) AS accepted FROM (SELECT *, lag(sequence) OVER (PARTITION BY workflow_id ORDER BY sequence) AS prev FROM workflow_steps) GROUP BY workflow_id")
def t4(spark, sf_dir):
    """Safe points are accepted only in an unbroken sequence."""
    prev = F.lag("sequence").over(Window.partitionBy("workflow_id").orderBy("sequence"))
    ok = (F.col("sequence") == F.col("prev") + 1) | (F.col("prev").isNull() & (F.col("sequence") == 0))
    return T.workflow_steps(spark, sf_dir).withColumn("prev", prev).groupBy("workflow_id").agg(F.count("*").alias("steps"), F.count_if(ok).alias("accepted"))


@query("s12_outbox", f"{EV}, o AS (SELECT event_id AS sequence, kind, k, event_id <= 500 AS delivered FROM runtime_events) SELECT sequence, kind FROM (SELECT * FROM o WHERE NOT delivered ORDER BY sequence LIMIT 500)")
def s12(spark, sf_dir):
    """An outbox drain: what isn't delivered yet, in order, 500 at once; what is up to the acknowledged sequence is done."""
    o = T.runtime_events(spark, sf_dir).select(F.col("event_id").alias("sequence"), "kind").withColumn("delivered", F.col("sequence") <= 500)
    return o.where("not delivered").orderBy("sequence").limit(500).select("sequence", "kind")


@query("w9_prune_delivered", f"{EV} SELECT event_id AS sequence FROM runtime_events WHERE event_id % 2 = 1 UNION ALL (SELECT event_id FROM runtime_events WHERE event_id % 2 = 0 ORDER BY event_id DESC LIMIT 1000)")
def w9(spark, sf_dir):
    """Delivered rows are kept to the last 1,000; others all stay."""
    e = T.runtime_events(spark, sf_dir).select(F.col("event_id").alias("sequence"))
    return e.where("sequence % 2 = 1").unionByName(e.where("sequence % 2 = 0").orderBy(F.desc("sequence")).limit(1000))


@query(
    "j8_line_in_range",
    """WITH r AS (SELECT o_custkey AS path, o_orderkey AS id, CAST(o_orderkey % 50 AS BIGINT) AS first, CAST(o_orderkey % 50 + 3 + o_orderkey % 5 AS BIGINT) AS last FROM orders), p AS (SELECT event_id, user_id AS path, event_id % 60 AS line FROM events)
  SELECT event_id, min(id) AS node FROM p JOIN r ON p.path = r.path AND line BETWEEN first AND last GROUP BY event_id HAVING count(*) = 1""",
)
def j8(spark, sf_dir):
    """The one node whose lines enclose a place; none where several do."""
    o = T.table(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("id"), F.expr("o_orderkey % 50").alias("first"), F.expr("o_orderkey % 50 + 3 + o_orderkey % 5").alias("last"))
    p = T.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"), F.expr("event_id % 60").alias("line"))
    hit = p.join(r, "path").where("line between first and last")
    return hit.groupBy("event_id").agg(F.min("id").alias("node"), F.count("*").alias("n")).where("n = 1").select("event_id", "node")


@query(
    "j20_enclosing_node",
    """WITH r AS (SELECT o_custkey AS path, o_orderkey AS id, CAST(o_orderkey % 50 AS BIGINT) AS first, CAST(o_orderkey % 50 + 3 + o_orderkey % 5 AS BIGINT) AS last FROM orders), p AS (SELECT event_id, user_id AS path, event_id % 60 AS line FROM events)
  SELECT event_id, min_by(id, (last - first, first, id)) AS node FROM p JOIN r ON p.path = r.path AND line BETWEEN first AND last GROUP BY event_id""",
)
def j20(spark, sf_dir):
    """The smallest node that encloses a changed line."""
    o = T.table(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("id"), F.expr("o_orderkey % 50").alias("first"), F.expr("o_orderkey % 50 + 3 + o_orderkey % 5").alias("last"))
    p = T.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"), F.expr("event_id % 60").alias("line"))
    hit = p.join(r, "path").where("line between first and last")
    return hit.groupBy("event_id").agg(F.min_by("id", F.struct(F.col("last") - F.col("first"), "first", "id")).alias("node"))
