"""Keyed state machines against plain folds over the same rows, over several micro-batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from threadloom.plans.stages import new_path
from threadloom.streaming import sessions as S
from threadloom.streaming import spans


def streamed(spark, rows: list[tuple], schema: str, batches: int):
    """Rows as a stream, a file a micro-batch, in their order."""
    path = new_path(spark, "rows")
    each = -(-len(rows) // batches)
    for k in range(batches):
        part = rows[k * each : (k + 1) * each]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


POINT = "session string, arrival long, type string, sequence long, epoch long, workflow string, step string, parent string, state string, action string, ms long"


def fold_session(rows):
    """Verdicts on the rows of one session, one after the other."""
    status, seq, events, epoch, known, action, pending, active, steps, out = "starting", 0, 0, 0, 0, None, None, None, set(), []
    asked_at = 0
    for _, arrival, kind, sequence, ep, workflow, step, parent, state, asked, ms in rows:
        if action and ms >= asked_at + 30_000:
            status, action, pending = "failed", None, None
        over = status in ("failed", "stopped", "completed")
        if kind == "point":
            problem = None
            if over:
                problem = "session has ended"
            elif events >= 2000:
                problem = "session is full"
            elif sequence != seq + 1:
                problem = "out of sequence"
            elif ep != known and ep != pending and not (action in ("pause", "stop") and ep == known):
                problem = "stale epoch"
            elif (workflow, step) in steps:
                problem = "step is known"
            elif parent is not None and (workflow, parent) not in steps:
                problem = "parent is unknown"
            elif active not in (None, workflow):
                problem = "another workflow is active"
            elif active is None and state != "paused":
                problem = "workflow doesn't begin paused"
            elif status == "paused" and action is None:
                problem = "no permit"
            elif pending is not None and ep == pending and action in ("pause", "stepInto", "stepOver") and state == "running":
                problem = "control isn't acknowledged"
            if problem:
                if not over:
                    status, action, pending = "failed", None, None
            else:
                if pending is not None and ep == pending:
                    known, action, pending = ep, None, None
                steps.add((workflow, step))
                seq, events = sequence, events + 1
                active = None if state in ("completed", "failed") else workflow
                status = "running" if state in ("completed", "failed") else state
            verdict = problem or "accepted"
        elif kind == "control":
            fresh = sequence <= seq if asked in ("pause", "stop") else sequence == seq
            if not fresh or ep != epoch:
                verdict = "stale control"
            elif over:
                verdict = "session has ended"
            elif action:
                verdict = "a control is pending"
            elif not (status == "paused" if asked in ("resume", "stepInto", "stepOver") else status == "running" or (asked == "stop" and status in ("starting", "paused"))):
                verdict = "not available"
            else:
                epoch, action, verdict = epoch + 1, asked, "accepted"
                pending, asked_at = epoch, ms
        elif over or (kind == "expire" and ep != pending):
            verdict = "nothing to end"
        else:
            verdict = "accepted"
            if kind == "expire":
                status = "failed"
            else:
                status = "stopped" if state == "stopped" else "failed" if not events or active else "completed"
            action = pending = None
        out.append((arrival, verdict, status))
    return out


def session_rows(key: str, rng: random.Random, n: int, errors: float) -> list[tuple]:
    """What a session may bring, mostly sound: points in turn, controls when it is paused, and now and then anything."""
    rows, seq, epoch, state, step = [], 0, 0, None, 0
    for arrival in range(n):
        if rng.random() < errors:
            rows.append((key, arrival, rng.choice(["point", "control", "expire"]), rng.randint(0, seq + 2), rng.randint(0, epoch + 1), rng.choice("wv"), str(rng.randint(0, step + 1)), None, rng.choice(["running", "paused", "completed"]), rng.choice(["resume", "pause", "stop"])))
        elif state == "paused" and (not rows or rows[-1][2] != "control"):
            rows.append((key, arrival, "control", seq, epoch, None, None, None, None, rng.choice(["resume", "stepOver"])))
            epoch += 1
        else:
            asked = rows[-1][9] if rows and rows[-1][2] == "control" else None
            new = "paused" if state is None or asked == "stepOver" else rng.choice(["running", "running", "paused", "completed"])
            seq, step = seq + 1, step + 1
            rows.append((key, arrival, "point", seq, epoch, "w", str(step), str(step - 1) if step > 1 and rng.random() < 0.5 else None, new, None))
            state = None if new == "completed" else new
    if rng.random() < 0.5:
        rows.append((key, n, "exit", None, None, None, None, None, rng.choice(["stopped", None]), None))
    return [(*r, 1_000 + r[1] * rng.choice([10, 20, 20_000] if errors > 0.05 else [10, 20])) for r in rows]


def test_safe_points_equal_a_fold(spark):
    rng = random.Random(3)
    by_key = {f"s{k}": session_rows(f"s{k}", rng, 40, 0.02 * (k % 4)) for k in range(24)}
    for key in ("s0", "s5"):  # repeats, and rows that come late, in later batches
        by_key[key] = by_key[key][:20] + [(*r[:1], 100 + i, *r[2:]) for i, r in enumerate(by_key[key][5:9])]
    rows = sorted((r for v in by_key.values() for r in v), key=lambda r: r[1])
    stream = streamed(spark, rows, POINT, 3).withColumn("at", F.timestamp_millis("ms")).withWatermark("at", "10 days")
    got: dict = {}
    for r in S.run_machine(stream, "session", S.SafePoints(), S.SafePoints.SCHEMA, "EventTime", "sessions").collect():
        got.setdefault(r.session, []).append((r.arrival, r.verdict, r.status))
    want = {k: fold_session(v) for k, v in by_key.items()}
    assert {k: sorted(v) for k, v in got.items()} == want
    verdicts = {v for rows in want.values() for _, v, _ in rows}
    assert {"accepted", "session has ended", "out of sequence", "stale control", "stale epoch"} <= verdicts


@pytest.mark.parametrize(("rows", "verdicts"), [
    ([("point", 1, 0, "w", "a", None, "running", None)], ["workflow doesn't begin paused"]),
    ([("point", 1, 0, "w", "a", None, "paused", None), ("point", 2, 0, "w", "b", None, "running", None)], ["accepted", "no permit"]),
    ([("point", 1, 0, "w", "a", None, "paused", None), ("control", 1, 0, None, None, None, None, "stepOver"), ("point", 2, 1, "w", "b", "a", "running", None), ("point", 3, 1, "w", "c", None, "paused", None)], ["accepted", "accepted", "control isn't acknowledged", "session has ended"]),
    ([("point", 1, 0, "w", "a", None, "paused", None), ("control", 1, 0, None, None, None, None, "resume"), ("point", 2, 1, "w", "a", None, "running", None)], ["accepted", "accepted", "step is known"]),
    ([("point", 1, 0, "w", "a", None, "paused", None), ("control", 1, 0, None, None, None, None, "resume"), ("point", 2, 1, "w", "b", "z", "running", None)], ["accepted", "accepted", "parent is unknown"]),
    ([("point", 1, 0, "w", "a", None, "paused", None), ("control", 1, 0, None, None, None, None, "resume"), ("point", 2, 1, "v", "b", None, "paused", None)], ["accepted", "accepted", "another workflow is active"]),
    ([("point", 1, 0, "w", "a", None, "paused", None), ("control", 1, 0, None, None, None, None, "resume"), ("control", 1, 1, None, None, None, None, "stop"), ("expire", None, 1, None, None, None, None, None)], ["accepted", "accepted", "a control is pending", "accepted"]),
])
def test_plain_cases_of_the_fold(rows, verdicts):
    assert [v for _, v, _ in fold_session([("s", k, *r, k) for k, r in enumerate(rows)])] == verdicts


def test_controls_expire_by_the_clock(spark):
    rows = [("s", 0, "point", 1, 0, "w", "a", None, "paused", None, 1_000), ("s", 1, "control", 1, 0, None, None, None, None, "resume", 1_010), ("z", 0, "exit", None, None, None, None, None, None, None, 100_000), ("z", 1, "exit", None, None, None, None, None, None, None, 200_000)]
    stream = streamed(spark, rows, POINT, 2).withColumn("at", F.timestamp_millis("ms")).withWatermark("at", "0 seconds")
    got = S.run_machine(stream, "session", S.SafePoints(), S.SafePoints.SCHEMA, "EventTime", "sessions").where("session = 's'").collect()
    assert [(r.arrival, r.verdict, r.status) for r in sorted(got, key=lambda r: (r.arrival is None, r.arrival))] == [(0, "accepted", "paused"), (1, "accepted", "paused"), (None, "control expired", "failed")]


def fold_batches(rows, quiet, longest, most):
    out, batch = [], None
    for _, _, ms, path in rows:
        if batch and (ms - batch["last"] >= quiet or ms - batch["first"] >= longest):
            out.append(batch)
            batch = None
        batch = batch or {"first": ms, "last": ms, "paths": set(), "rescan": False}
        batch["last"] = ms
        if not batch["rescan"]:
            batch["paths"].add(path)
            batch["rescan"] = len(batch["paths"]) > most
    return [(b["first"], b["last"], b["rescan"], [] if b["rescan"] else sorted(b["paths"])) for b in [*out, batch]]


def test_debounced_batches_equal_a_fold(spark):
    rng, rows = random.Random(5), []
    for k in range(12):
        ms = 1_000
        for i in range(120):
            ms += rng.choice([1, 20, 100, 100, 150, 240, 249, 249, 250, 700])
            rows.append((f"r{k}", i, ms, f"p{rng.randint(0, 3 + 4 * (k % 3))}"))
    rows.sort(key=lambda r: r[2])
    rows += [("clock", 0, rows[-1][2] + 10_000, "x"), ("clock", 1, rows[-1][2] + 20_000, "x")]
    stream = streamed(spark, rows, "root string, arrival long, ms long, path string", 4).withColumn("at", F.timestamp_millis("ms")).withWatermark("at", "0 seconds")
    got: dict = {}
    for r in S.run_machine(stream, "root", S.Debounce(250, 2_000, 7), S.Debounce.SCHEMA, "EventTime", "debounce").collect():
        got.setdefault(r.root, []).append((r.first_ms, r.last_ms, r.rescan, r.paths))
    for k in range(12):
        want = fold_batches([r for r in rows if r[0] == f"r{k}"], 250, 2_000, 7)
        assert sorted(got[f"r{k}"]) == want
    assert any(b[2] for v in got.values() for b in v) and any(b[1] - b[0] > 1_700 for v in got.values() for b in v)


def test_admission_equals_a_fold(spark):
    rng, rows = random.Random(6), []
    for k in range(8):
        ms = 0
        for i in range(150):
            ms += rng.choice([0, 1, 5, 30, 400])
            rows.append((f"s{k}", i, ms - (2 if rng.random() < 0.1 else 0)))
    rows.sort(key=lambda r: r[1])
    got: dict = {}
    for r in S.run_machine(streamed(spark, rows, "source string, arrival long, ms long", 3), "source", S.Admission(12, 1_000), S.Admission.SCHEMA, "None", "admission").collect():
        got.setdefault(r.source, []).append((r.arrival, r.admitted, r.dropped_before))
    for k in range(8):
        start, emitted, dropped, want = None, 0, 0, []
        for _, i, ms in (r for r in rows if r[0] == f"s{k}"):
            told = 0
            if start is None or ms - start >= 1_000:
                told, start, emitted, dropped = dropped, ms, 0, 0
            ok = emitted < 12
            emitted, dropped = emitted + ok, dropped + (not ok)
            want.append((i, ok, told))
        assert sorted(got[f"s{k}"]) == want
    assert any(not a for v in got.values() for _, a, _ in v) and any(t for v in got.values() for _, _, t in v)


def test_paces_equal_a_fold(spark):
    rng = random.Random(7)
    rows = [(f"k{rng.randint(0, 3)}", i, rng.randint(0, 3_000)) for i in range(900)]
    for block in (100, 1_000, 10**9):
        got = {r.i: r.slot for r in S.paced(spark.createDataFrame(rows, "k string, i long, ms long"), "k", "ms", "i", 20, block).collect()}
        nxt: dict = {}
        for k, i, ms in sorted(rows, key=lambda r: (r[2], r[1])):
            nxt[k] = max(nxt.get(k, ms), ms)
            assert got[i] == nxt[k]
            nxt[k] += 20


def test_verdicts_on_phases_over_several_batches(spark):
    """Each event by what came before it in its span, in this batch or in those before; no batch calls Python for a span."""
    rng = random.Random(21)
    rows = [(k, rng.choice("ab"), f"s{rng.randrange(12)}", k // 3, rng.choice(["start", "event", "end", None])) for k in range(180)]
    stream = streamed(spark, rows, "event_id long, trace_id string, span_id string, at long, phase string", 4)
    got = {r.event_id: r.verdict for r in spans.drained(stream, "phases", each=spans.judged).collect()}
    want, known = {}, {}
    for event, trace, span, _, phase in rows:
        opened, closed = known.get((trace, span), (False, False))
        if phase != "end":
            want[event], known[trace, span] = "duplicate" if opened else "accepted", (True, closed or phase == "event")
        else:
            want[event], known[trace, span] = "unknown span" if not opened else "already ended" if closed else "accepted", (opened, True)
    assert got == want and len(set(want.values())) == 4


class Held:
    """A state variable in memory that counts its calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {"exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "keys": lambda: list(self.map), "clear": self.map.clear, "containsKey": lambda k: k in self.map, "updateValue": self.map.__setitem__, "listTimers": list, "registerTimer": lambda t: None}[name]


def test_rows_of_a_root_do_not_ask_the_state_one_by_one():
    machine = S.Debounce(250, 1_000_000, 7)
    machine.batch, machine.paths, machine.handle = Held(), Held(), Held()
    rows = [Row(ms=k, arrival=k, path=f"p{k % 5}") for k in range(1000)]
    assert list(machine.handleInputRows(("r",), iter(rows), None)) == [] and set(machine.paths.map) == {(f"p{k}",) for k in range(5)}
    assert machine.batch.calls + machine.paths.calls + machine.handle.calls < 20


def test_a_busy_source_is_not_held_as_rows():
    """What is held of a row is two numbers, whatever else it carries."""
    import tracemalloc

    machine = S.Admission(12, 1_000)
    machine.state = Held()
    tracemalloc.start()
    out = machine.handleInputRows(("s",), (Row(source="s", arrival=k, ms=k) for k in range(50_000, 0, -1)), None)
    first = next(out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (first.arrival, first.admitted) == (1, True) and sum(1 for _ in out) == 49_999
    assert peak < 4_000_000
