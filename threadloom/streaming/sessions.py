"""Keyed state machines as streams: safe points of debug sessions, debounced batches of changed paths, admission by rate; and pacing, as windows.

Each machine is a StatefulProcessor with its own state variables, kept by key in the state store between micro-batches: a hot key is one
machine by its nature, and its rows stream through it, never collected. Within a micro-batch the rows of a key are taken in the order of their
arrival number; what a batch brings late is judged when it comes. Clocks are those of the rows, so a run over what is there ends. The machines
need the RocksDB state store, which run_machine() sets.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.catalog import query
from threadloom.plans.stages import drop_path, shared_dir
from threadloom.sources import tables as T
from threadloom.streaming.spans import event_stream

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Events of a session, seconds that a control may wait; quiet and longest time of a batch in ms and its paths; events a second; ms between emissions.
MOST_EVENTS, CONTROL_SECONDS, QUIET_MS, LONGEST_MS, MOST_PATHS, PER_SECOND, PACE_MS = 2_000, 30, 250, 2_000, 2_048, 120, 20
TERMINAL = ("failed", "stopped", "completed")


def run_machine(stream: DataFrame, key: str, machine: StatefulProcessor, schema: str, mode: str, name: str) -> DataFrame:
    """Work a stream off with a machine for each key, and read what it wrote. The state goes with the run; its output stays."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        out = stream.groupBy(key).transformWithState(statefulProcessor=machine, outputStructType=schema, outputMode="append", timeMode=mode)
        run = out.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{base}/sink").start()
        run.awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    drop_path(spark, f"{base}/checkpoint")
    return spark.read.schema(schema).parquet(f"{base}/sink")


class SafePoints(StatefulProcessor):
    """The sequencer of a debug session. Rows: session, arrival, type ("point", "control", "exit" or "expire"), sequence, epoch, workflow,
    step, parent, state ("running", "paused", "completed" or "failed"), action ("pause", "resume", "stepInto", "stepOver" or "stop"). A control's
    sequence and epoch are those that its sender has seen; an exit's state is "stopped" or null. Every row gets a verdict: "accepted", or why not.

    A refused control changes nothing; a refused safe point ends its session as failed, and so does a control that isn't acknowledged in
    CONTROL_SECONDS by the rows' clock, or an expire row for its epoch. A session that has ended refuses all that comes. Where no row shows that a
    control's time is over, a timer does, once the watermark has passed it, with a row of its own (no arrival)."""

    SCHEMA = "session string, arrival long, verdict string, status string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "status string, sequence long, count long, epoch long, acknowledged long, action string, pending long, asked_ms long, workflow string")
        self.steps = handle.getMapState("steps", "workflow string, step string", "seen boolean")

    def _load(self) -> dict:
        names = ("status", "sequence", "count", "epoch", "acknowledged", "action", "pending", "asked_ms", "workflow")
        return dict(zip(names, self.session.get() if self.session.exists() else ("starting", 0, 0, 0, 0, None, None, None, None), strict=True))

    def point(self, s: dict, r) -> str:
        """A safe point that the child reports."""
        if s["status"] in TERMINAL:
            return "session has ended"
        if s["count"] >= MOST_EVENTS:
            return "session is full"
        if r.sequence != s["sequence"] + 1:
            return "out of sequence"
        answers = s["pending"] is not None and r.epoch == s["pending"]
        in_flight = s["action"] in ("pause", "stop") and r.epoch == s["acknowledged"]
        if not (r.epoch == s["acknowledged"] or answers or in_flight):
            return "stale epoch"
        if self.steps.containsKey((r.workflow, r.step)):
            return "step is known"
        if r.parent is not None and not self.steps.containsKey((r.workflow, r.parent)):
            return "parent is unknown"
        if s["workflow"] is not None and s["workflow"] != r.workflow:
            return "another workflow is active"
        if s["workflow"] is None and r.state != "paused":
            return "workflow doesn't begin paused"
        if s["status"] == "paused" and s["action"] is None:
            return "no permit"
        if answers:
            if s["action"] in ("pause", "stepInto", "stepOver") and r.state == "running":
                return "control isn't acknowledged"
            s.update(acknowledged=r.epoch, action=None, pending=None)
        self.steps.updateValue((r.workflow, r.step), (True,))
        ended = r.state in ("completed", "failed")
        s.update(sequence=r.sequence, count=s["count"] + 1, status="running" if ended else r.state, workflow=None if ended else r.workflow)
        return "accepted"

    def control(self, s: dict, r) -> str:
        """What its user asks of the session."""
        fresh = r.sequence <= s["sequence"] if r.action in ("pause", "stop") else r.sequence == s["sequence"]
        if not fresh or r.epoch != s["epoch"]:
            return "stale control"
        if s["status"] in TERMINAL:
            return "session has ended"
        if s["action"] is not None:
            return "a control is pending"
        fits = {"pause": ("running",), "stop": ("starting", "running", "paused")}.get(r.action, ("paused",))
        if s["status"] not in fits:
            return "not available"
        s.update(epoch=s["epoch"] + 1, action=r.action, pending=s["epoch"] + 1, asked_ms=r.ms)
        self.handle.registerTimer(r.ms + CONTROL_SECONDS * 1000)
        return "accepted"

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        from pyspark.sql import Row

        s = self._load()
        for r in sorted(rows, key=lambda r: r.arrival):
            if self._overdue(s, r.ms):
                s.update(status="failed", action=None, pending=None)
            if r.type == "point":
                verdict = self.point(s, r)
                if verdict != "accepted" and s["status"] not in TERMINAL:
                    s.update(status="failed", action=None, pending=None)
            elif r.type == "control":
                verdict = self.control(s, r)
            elif s["status"] in TERMINAL or (r.type == "expire" and r.epoch != s["pending"]):
                verdict = "nothing to end"
            else:
                verdict = "accepted"
                unfinished = s["count"] == 0 or s["workflow"] is not None
                s["status"] = "failed" if r.type == "expire" else "stopped" if r.state == "stopped" else "failed" if unfinished else "completed"
                s.update(action=None, pending=None)
            yield Row(session=key[0], arrival=r.arrival, verdict=verdict, status=s["status"])
        self.session.update(tuple(s.values()))

    def _overdue(self, s: dict, ms: int) -> bool:
        return s["action"] is not None and ms >= s["asked_ms"] + CONTROL_SECONDS * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        from pyspark.sql import Row

        s = self._load()
        if self._overdue(s, expiredTimerInfo.getExpiryTimeInMs()):
            s.update(status="failed", action=None, pending=None)
            self.session.update(tuple(s.values()))
            yield Row(session=key[0], arrival=None, verdict="control expired", status="failed")

    def close(self) -> None:
        pass


class Debounce(StatefulProcessor):
    """Batches of changed paths. Rows: root, arrival, ms (when they came), path. A batch is closed by QUIET of no arrival, or LONGEST after its first;
    one of over MOST paths asks for a rescan and names none. The clock is that of the rows: a batch whose end no row of its root shows is
    closed by a timer, once the watermark has passed it."""

    SCHEMA = "root string, first_ms long, last_ms long, rescan boolean, paths array<string>"

    def __init__(self, quiet: int = QUIET_MS, longest: int = LONGEST_MS, most: int = MOST_PATHS):
        self.quiet, self.longest, self.most = quiet, longest, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.batch = handle.getValueState("batch", "first long, last long, n long, rescan boolean")
        self.paths = handle.getMapState("paths", "path string", "seen boolean")

    def _end(self, first: int, last: int) -> int:
        return min(last + self.quiet, first + self.longest)

    def _closed(self, key, b: tuple):
        from pyspark.sql import Row

        paths = [] if b[3] else sorted(k[0] for k in self.paths.keys())  # noqa: SIM118  a state variable, not a dict; bounded by `most`
        self.paths.clear()
        return Row(root=key[0], first_ms=b[0], last_ms=b[1], rescan=b[3], paths=paths)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        from pyspark.sql import Row

        b = tuple(self.batch.get()) if self.batch.exists() else None
        # the open batch's paths, at most `most`: read once and put back once, as each call to the state costs more than a row
        stored = {k[0] for k in self.paths.keys()} if b else set()  # noqa: SIM118  a state variable, not a dict
        held = set(stored)
        for r in sorted(rows, key=lambda r: (r.ms, r.arrival)):
            if b and r.ms >= self._end(b[0], b[1]):
                yield Row(root=key[0], first_ms=b[0], last_ms=b[1], rescan=b[3], paths=sorted(held))
                b = None
                held.clear()
            first, last, n, rescan = b or (r.ms, r.ms, 0, False)
            if not rescan and r.path not in held:
                if n >= self.most:
                    held.clear()
                    rescan = True
                else:
                    held.add(r.path)
                    n += 1
            b = (first, max(last, r.ms), n, rescan)
        if b:
            if not stored <= held:
                self.paths.clear()
                stored = set()
            for path in held - stored:
                self.paths.updateValue((path,), (True,))
            self.batch.update(b)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(self._end(b[0], b[1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.batch.exists():
            b = tuple(self.batch.get())
            if self._end(b[0], b[1]) <= expiredTimerInfo.getExpiryTimeInMs():
                yield self._closed(key, b)
                self.batch.clear()

    def close(self) -> None:
        pass


class Admission(StatefulProcessor):
    """At most so many events in a window that starts with the first event after the last one's end. Rows: source, arrival, ms. Each gets whether it is
    admitted, and how many were dropped in the window before, told by the first event of the next."""

    SCHEMA = "source string, arrival long, admitted boolean, dropped_before long"

    def __init__(self, most: int = PER_SECOND, window_ms: int = 1000):
        self.most, self.window = most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "started long, emitted long, dropped long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        from pyspark.sql import Row

        import numpy as np

        started, emitted, dropped = self.state.get() if self.state.exists() else (None, 0, 0)
        # a busy source has millions of rows in a batch: two numbers of each are held, no row
        arrivals, times = array("q"), array("q")
        for r in rows:
            arrivals.append(r.arrival)
            times.append(r.ms)
        for at in np.argsort(np.frombuffer(arrivals, dtype=np.int64), kind="stable") if arrivals else ():
            told, ms = 0, times[at]
            if started is None or ms - started >= self.window:
                told, started, emitted, dropped = dropped, ms, 0, 0
            admitted = emitted < self.most
            emitted, dropped = emitted + admitted, dropped + (not admitted)
            yield Row(source=key[0], arrival=arrivals[at], admitted=admitted, dropped_before=told)
        self.state.update((started, emitted, dropped))

    def close(self) -> None:
        pass


def paced(events: DataFrame, key: str, ms: str, order: str, pace: int = PACE_MS, block_ms: int = 86_400_000) -> DataFrame:
    """events with `slot`, the time at which each may be emitted: no sooner than it comes, and `pace` after the one before.

    slot(i) = max(t(i), slot(i - 1) + pace) is a prefix maximum: the largest t(j) - pace * j so far, plus pace * i. Prefix maxima of blocks combine,
    so a busy key's blocks of time are worked off apart: each with its own running maximum, then with that of all blocks before (a row a block)."""
    e = events.withColumn("block_", F.floor(F.col(ms) / block_ms))
    inner = Window.partitionBy(key, "block_").orderBy(ms, order)
    e = e.withColumn("i_", F.row_number().over(inner).cast("long"))
    lead = F.max(F.col(ms) - pace * F.col("i_"))
    e = e.withColumn("lead_", lead.over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = e.groupBy(key, "block_").agg(F.count("*").alias("n_"), F.max(F.col(ms) - pace * F.col("i_")).alias("own_"))
    before = Window.partitionBy(key).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("count_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    blocks = blocks.withColumn("past_", F.max(F.col("own_") - pace * F.col("count_")).over(before)).select(key, "block_", "count_", "past_")
    met = e.join(blocks, [key, "block_"])
    slot = F.greatest(F.col("past_"), F.col("lead_") - pace * F.col("count_")) + pace * (F.col("count_") + F.col("i_"))
    return met.withColumn("slot", slot).drop("block_", "i_", "lead_", "count_", "past_")


def event_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.runtime_events(spark, sf_dir).select("event_id", "kind", F.unix_millis("at").alias("ms"))


HOUR = 3_600_000


@query(
    "t6_output_pacing",
    f"WITH {T.EVENTS}, e AS (SELECT event_id, kind, epoch_us(seen_at) // 1000 AS ms FROM runtime_events), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ms, event_id) AS i FROM e) SELECT event_id, CAST(max(ms - {HOUR} * i) OVER (PARTITION BY kind ORDER BY i) + {HOUR} * i - ms AS BIGINT) AS delay_ms FROM n",
)
def t6(spark, sf_dir):
    """How long each event waits for its turn, an emission of its kind an hour."""
    out = paced(event_ms(spark, sf_dir), "kind", "ms", "event_id", HOUR)
    return out.select("event_id", (F.col("slot") - F.col("ms")).alias("delay_ms"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(spark, sf_dir).select("event_id", "trace_id", "kind", "at", F.unix_millis("at").alias("ms"))


@query("t5_stream_admission")
def t5_admission(spark, sf_dir):
    """Three events a day of each kind, counted from the first after the last window's end."""
    s = arrivals(spark, sf_dir).select(F.col("kind").alias("source"), F.col("event_id").alias("arrival"), "ms")
    return run_machine(s, "source", Admission(3, 24 * HOUR), Admission.SCHEMA, "None", "admission")


@query("t3_stream_debounce")
def t3(spark, sf_dir):
    """Batches of what each user touched: four hours of quiet close one, or two days in all; over three kinds ask for a rescan."""
    s = arrivals(spark, sf_dir).withWatermark("at", "0 seconds").select(F.col("trace_id").alias("root"), F.col("event_id").alias("arrival"), "ms", F.col("kind").alias("path"), "at")
    return run_machine(s, "root", Debounce(4 * HOUR, 48 * HOUR, 3), Debounce.SCHEMA, "EventTime", "debounce")


def step_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as debug sessions: turns are safe points; what a user says is a pause, which a resume of the same number follows."""
    path = f"{sf_dir}/conversations.parquet"
    c = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/conversation[s].parquet")
    turn, user = F.col("turn"), F.col("role") == "user"
    point = F.struct((turn * 2).alias("arrival"), F.lit("point").alias("type"), (turn + 1).alias("sequence"), F.floor((turn + 1) / 2).alias("epoch"), turn.cast("string").alias("step"), F.when(turn > 0, (turn - 1).cast("string")).alias("parent"), F.when(user, "paused").otherwise("running").alias("state"), F.lit(None).cast("string").alias("action"))
    resume = F.struct((turn * 2 + 1).alias("arrival"), F.lit("control").alias("type"), (turn + 1).alias("sequence"), F.floor((turn + 1) / 2).alias("epoch"), F.lit(None).cast("string").alias("step"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("state"), F.lit("resume").alias("action"))
    rows = c.select("conv_id", F.explode(F.when(user, F.array(point, resume)).otherwise(F.array(point))).alias("r"))
    ms = (F.col("r.arrival") + 1) * 1000  # a watermark begins at the epoch, and takes what isn't after it for late
    return rows.select(F.col("conv_id").cast("string").alias("session"), "r.*", F.lit("w").alias("workflow"), ms.alias("ms"), F.timestamp_millis(ms).alias("at")).withWatermark("at", "1 hour")


@query("t4_stream_safe_points")
def t4_points(spark, sf_dir):
    """Verdicts on the safe points and controls of every session."""
    return run_machine(step_stream(spark, sf_dir), "session", SafePoints(), SafePoints.SCHEMA, "EventTime", "sessions")
