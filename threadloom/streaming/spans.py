"""Structured Streaming twins of the runtime operators. Each reads the event table as a stream, works it off (availableNow), and returns what
its sink holds; watermarks only bound the state, since late and repeated input is refused rather than waited for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.catalog import SQL, query
from threadloom.operators import runtime  # noqa: F401  the batch twins, whose SQL also holds for the streams
from threadloom.plans.stages import shared_dir
from threadloom.sources import tables as T

EV = f"WITH {T.EVENTS}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # as a pattern, since a stream takes a path without one for a folder
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("trace-"), F.col("user_id").cast("string")).alias("trace_id"), F.concat(F.lit("span-"), F.expr("cast(event_id div 3 as string)")).alias("span_id"),
        F.element_at(F.array(F.lit("start"), F.lit("event"), F.lit("end")), F.expr("cast(event_id % 3 as int) + 1")).alias("phase"), F.col("event_type").alias("kind"),
    )


def drained(stream: DataFrame, name: str, mode: str = "append", each=None) -> DataFrame:
    """Run a stream over all that is there, with its checkpoint in the shared folder, and read its sink."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    run = writer.foreachBatch(each(f"{base}/sink")).start() if each else writer.format("parquet").option("path", f"{base}/sink").start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/sink/last" if each else f"{base}/sink")


@query("t1_stream_dedup", f"{EV} SELECT DISTINCT trace_id, span_id FROM runtime_events")
def t1(spark, sf_dir):
    """A span counts once while it is remembered: a day of event time bounds the state."""
    s = event_stream(spark, sf_dir).withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["trace_id", "span_id"])
    return drained(s.select("trace_id", "span_id"), "dedup")


@query("t5_stream_rate", SQL.get("t5_rate_window"))
def t5(spark, sf_dir):
    """Counts by hour as a stream; complete mode keeps one row a window."""
    n = event_stream(spark, sf_dir).groupBy(F.window("at", "3600 seconds")["start"].alias("w")).agg(F.count("*").alias("n"))
    out = n.select(F.unix_micros("w").alias("window_us"), F.least("n", F.lit(12)).alias("admitted"), F.greatest(F.col("n") - 12, F.lit(0)).alias("dropped"))
    return drained(out, "rate", "complete", lambda sink: lambda df, _: df.write.mode("overwrite").parquet(f"{sink}/last"))


def judged(sink: str):
    """A batch writer of verdicts on events (trace_id, span_id, at, event_id, phase), in order of time within a batch. What is known of a span is
    whether it was opened and whether it was closed; each batch adds the spans that it touches, and asks for those alone. A batch that comes twice
    replaces itself."""
    span = ["trace_id", "span_id"]
    opens, closes = F.coalesce(F.col("phase") != "end", F.lit(True)), F.coalesce(F.col("phase").isin("event", "end"), F.lit(False))

    def work(df: DataFrame, number: int) -> None:
        before = Window.partitionBy(*span).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
        rows = df.withColumns({"opened": F.coalesce(F.max(opens).over(before), F.lit(False)), "closed": F.coalesce(F.max(closes).over(before), F.lit(False))})
        if number:
            known = df.sparkSession.read.parquet(*(f"{sink}/state/{k}" for k in range(number)))
            known = known.join(df.select(*span).distinct(), span, "left_semi").groupBy(*span).agg(F.max("opened").alias("was_opened"), F.max("closed").alias("was_closed"))
            rows = rows.join(known, span, "left").withColumns({c: F.col(c) | F.coalesce(f"was_{c}", F.lit(False)) for c in ("opened", "closed")})
        verdict = F.when(opens, F.when(F.col("opened"), "duplicate").otherwise("accepted")).when(~F.col("opened"), "unknown span").when(F.col("closed"), "already ended").otherwise("accepted")
        rows.select("event_id", verdict.alias("verdict")).write.mode("overwrite").parquet(f"{sink}/last/batch={number}")
        df.groupBy(*span).agg(F.max(opens).alias("opened"), F.max(closes).alias("closed")).write.mode("overwrite").parquet(f"{sink}/state/{number}")

    return work


@query("t2_stream_phases", SQL.get("t2_phase_machine"))
def t2(spark, sf_dir):
    """Verdicts on the events of every span, as windows of each micro-batch: a span is one of millions, so none has a Python call of its own."""
    return drained(event_stream(spark, sf_dir), "phases", each=judged).select("event_id", "verdict")


@query("t10_stream_latest", f"{EV} SELECT trace_id, max(event_id) AS event_id, arg_max(kind, event_id) AS kind, count(*) AS events FROM runtime_events GROUP BY trace_id")
def t10(spark, sf_dir):
    """A view kept up to date batch by batch: what a batch adds is merged with what the view held, and the new version replaces the old."""

    def merge(sink):
        def work(df, batch):
            new = df.groupBy("trace_id").agg(F.max("event_id").alias("event_id"), F.max_by("kind", "event_id").alias("kind"), F.count("*").alias("events"))
            session = df.sparkSession
            if batch:
                old = session.read.parquet(f"{sink}/v{batch - 1}")
                new = old.unionByName(new).groupBy("trace_id").agg(F.max("event_id").alias("event_id"), F.max_by("kind", "event_id").alias("kind"), F.sum("events").alias("events"))
            new.write.mode("overwrite").parquet(f"{sink}/v{batch}")
            session.read.parquet(f"{sink}/v{batch}").write.mode("overwrite").parquet(f"{sink}/last")

        return work

    return drained(event_stream(spark, sf_dir), "latest", "append", merge)



def delivered_to(sink: str):
    """A batch writer that may be called again: a batch that comes twice replaces itself, so what is delivered at least once is kept once. Rows
    of a batch are in order of their sequence over its files; batches follow each other."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch.orderBy("sequence").write.mode("overwrite").parquet(f"{sink}/last/batch={number}")

    return deliver


@query("t12_stream_delivery", f"{EV} SELECT event_id AS sequence, kind FROM runtime_events WHERE phase <> 'event'")
def t12(spark, sf_dir):
    """Outbox rows delivered in order, each once."""
    rows = event_stream(spark, sf_dir).where("phase <> 'event'").select(F.col("event_id").alias("sequence"), "kind")
    return drained(rows, "delivery", each=delivered_to).select("sequence", "kind")
