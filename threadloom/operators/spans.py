"""Spans of traces: one event stands for all of a span, with what they say together, and reported parents become edges where nothing is ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.sources import tables as T

PHASES = ("start", "event", "end", "single")  # fixed values


def canonical_spans(events: DataFrame) -> DataFrame:
    """(trace_id, span_id, anchor, parent_span_id, metadata, unambiguous) of events (event_id, at, trace_id, span_id, phase, parent_span_id,
    metadata: a map). The anchor is the first start, or else the first event; of the metadata, and of parents, what is said last counts; a span is
    unambiguous where no phase comes twice. Sums by span come before the shuffle, but for the metadata's keys, which are summed by key first."""
    said = events.select("event_id", "at", "trace_id", "span_id", F.explode("metadata").alias("name", "value"))
    last = said.groupBy("trace_id", "span_id", "name").agg(F.max_by("value", F.struct("at", "event_id")).alias("value"))
    merged = last.groupBy("trace_id", "span_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("metadata"))
    phase = F.coalesce("phase", F.lit("single"))
    first = F.struct(F.when(phase == "start", 0).otherwise(1), "at", "event_id")
    repeated = F.greatest(*(F.count_if(phase == p) for p in PHASES)) > 1
    parent = F.max_by("parent_span_id", F.when(F.col("parent_span_id").isNotNull(), F.struct("at", "event_id")))
    spans = events.where("trace_id is not null and span_id is not null").groupBy("trace_id", "span_id").agg(F.min_by("event_id", first).alias("anchor"), parent.alias("parent_span_id"), (~repeated).alias("unambiguous"))
    return spans.join(merged, ["trace_id", "span_id"], "left").select("trace_id", "span_id", "anchor", "parent_span_id", "metadata", "unambiguous")


def parent_edges(spans: DataFrame) -> DataFrame:
    """(parent, child): anchors of spans of one trace that a reported parent ties, where both are unambiguous."""
    sure = spans.where("unambiguous")
    parents = sure.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("anchor").alias("parent"))
    return sure.join(parents, ["trace_id", "parent_span_id"]).select("parent", F.col("anchor").alias("child"))


def given_spans(spark, sf_dir: str) -> DataFrame:
    """Events as phases of twenty spans of each user's trace; three in four report a parent."""
    e = T.runtime_events(spark, sf_dir).where("k is not null")
    span = lambda n: F.concat(F.lit("g"), F.expr(f"cast((k + {n}) % 20 as string)"))
    parent = F.when(F.col("event_id") % 4 != 0, span(1))
    metadata = F.create_map(F.lit("kind"), F.col("kind"), F.concat(F.lit("p"), F.expr("cast(event_id % 2 as string)")), F.col("event_id").cast("string"))
    return e.select("event_id", "at", "trace_id", span(0).alias("span_id"), "phase", parent.alias("parent_span_id"), metadata.alias("metadata"))


SPANS = f"""WITH {T.EVENTS}, e AS (SELECT event_id, seen_at, trace_id, 'g' || (k % 20) AS span_id, phase, kind, CASE WHEN event_id % 4 <> 0 THEN 'g' || ((k + 1) % 20) END AS parent FROM runtime_events WHERE k IS NOT NULL),
  s AS (SELECT trace_id, span_id, min_by(event_id, (CASE phase WHEN 'start' THEN 0 ELSE 1 END, seen_at, event_id)) AS anchor, max_by(parent, (seen_at, event_id)) FILTER (parent IS NOT NULL) AS parent_span_id,
    count(*) FILTER (phase = 'start') < 2 AND count(*) FILTER (phase = 'event') < 2 AND count(*) FILTER (phase = 'end') < 2 AS unambiguous,
    max_by(kind, (seen_at, event_id)) AS kind, max_by(event_id, (seen_at, event_id)) FILTER (event_id % 2 = 0) AS p0, max_by(event_id, (seen_at, event_id)) FILTER (event_id % 2 = 1) AS p1 FROM e GROUP BY ALL)"""


@query("a14_merged_spans", f"{SPANS} SELECT trace_id, span_id, anchor, parent_span_id, unambiguous, kind, CAST(p0 AS VARCHAR) AS p0, CAST(p1 AS VARCHAR) AS p1 FROM s")
def a14_merged(spark, sf_dir):
    m = lambda k: F.col("metadata")[k].alias(k)
    return canonical_spans(given_spans(spark, sf_dir)).select("trace_id", "span_id", "anchor", "parent_span_id", "unambiguous", m("kind"), m("p0"), m("p1"))


@query("j17_span_parents", f"{SPANS} SELECT p.anchor AS parent, c.anchor AS child FROM s c JOIN s p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE c.unambiguous AND p.unambiguous")
def j17_parents(spark, sf_dir):
    return parent_edges(canonical_spans(given_spans(spark, sf_dir)))
