"""Operator 6: benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

Texts become lower-case words. Every run of SEED words of a test item is a seed, however many documents hold it; where a document
holds a seed, the window that an alignment through it could span (with the item's length on either side) is kept, as word numbers of the
benchmark's own vocabulary, unless it holds too few of the item's words for any alignment to reach the threshold. Windows are aligned
with the item by Smith-Waterman over words (match 2, mismatch and gap -1), equal ones of a batch once; a score of at least
THRESHOLD of the item's own marks a copy. As such an alignment spans twice the item's length at most, a longer window (seeds all over a long
text) comes in stretches of STRETCH lengths that overlap by two; and windows are aligned at most CELLS at a time. So memory grows with the
longest item, not with the longest text.

The benchmark side is broadcast: its words are counted first, and beyond BLOCK_WORDS it is worked off in blocks of
items, each over all documents. Nothing of the corpus is broadcast or collected; windows are a small share of it.

Defined cases: null and empty texts have no words; items of fewer than SEED words have no seed and match nothing; items
that repeat are each reported; rows that repeat a doc_id are searched alike, and its best alignment is reported once; rows without
doc_id cannot be reported, and contaminated() leaves them out, while clean_of() judges them by their texts; with an empty table there are no
pairs; other columns are left behind. Among equal scores the earliest passage is reported.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: With a threshold of one half an alignment spans twice the item's length at most, so a slack of one length holds it whole.
SEED, SLACK, THRESHOLD = 3, 1.0, 0.5
BLOCK_WORDS = 5_000_000
#: Item lengths in a stretch of a window; words of all windows that are aligned at once.
STRETCH, CELLS = 8, 1 << 18
MATCH, MISMATCH, GAP = 2, -1, -1
WORDS = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


class SeedIndex:
    """Items as numbers of their common vocabulary, and where each seed stands in them."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED):
        self.vocabulary: dict[str, int] = {}
        self.seed = seed
        self.items = {k: np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)], dtype=np.int64) for k, (_, t) in enumerate(items)}
        self.ids = [i for i, _ in items]
        # the runs of 2, 3, ... words that items hold, shorter than a seed: a run is numbered by its place here, so keys stay small
        self.runs: list[np.ndarray] = []
        for k in range(1, seed - 1):
            self.runs.append(np.unique(np.concatenate([self.keys(a, k + 1) for a in self.items.values()] or [np.zeros(0, np.int64)])))
        keys = [self.keys(a) for a in self.items.values()]
        item, offset = np.repeat(np.arange(len(keys)), [len(x) for x in keys]), np.concatenate([np.arange(len(x)) for x in keys] or [np.zeros(0, np.int64)])
        key = np.concatenate(keys or [np.zeros(0, np.int64)])
        order = np.lexsort((offset, item, key))
        self.key, self.item, self.offset = key[order], item[order], offset[order]

    def keys(self, a: np.ndarray, size: int = 0) -> np.ndarray:
        """The run of `size` words (a seed's) that starts at each place, as a number; -1 where no item holds it, up to its last word."""
        size = size or self.seed
        if len(a) < size:
            return np.zeros(0, dtype=np.int64)
        base, n = len(self.vocabulary) + 1, len(a) - size + 1
        out = a[:n].copy()
        for k in range(1, size):
            good = np.flatnonzero((out >= 0) & (a[k : k + n] >= 0))
            key = out[good] * base + a[good + k]
            out[:] = -1
            if k < size - 1:
                runs = self.runs[k - 1]
                at = np.minimum(np.searchsorted(runs, key), max(len(runs) - 1, 0))
                held = runs[at] == key if len(runs) else np.zeros(0, dtype=bool)
                good, key = good[held], at[held]
            out[good] = key
        return out

    def windows(self, text: str) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item, first word, word numbers) of each window of a text."""
        found = words(text)
        a = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), dtype=np.int64, count=len(found))
        keys = self.keys(a)
        place = np.flatnonzero(keys >= 0)
        lo, hi = np.searchsorted(self.key, keys[place], "left"), np.searchsorted(self.key, keys[place], "right")
        n = hi - lo
        if not n.sum():
            return
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, start = self.item[entry], np.repeat(place, n) - self.offset[entry]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        slack = np.array([max(4, int(SLACK * len(self.items[k]))) for k in range(len(self.ids))])[item]
        cuts = np.flatnonzero((np.diff(item) != 0) | (np.diff(start) > slack[1:])) + 1
        for part in np.split(np.arange(len(item)), cuts):
            k, s = int(item[part[0]]), int(slack[part[0]])
            n = len(self.items[k])
            first, stop = max(0, int(start[part[0]]) - s), min(len(a), int(start[part[-1]]) + n + s)  # as long as its seeds' alignments may be
            wide, step = max(STRETCH * n, n + 2 * s), max(1, max(STRETCH * n, n + 2 * s) - 2 * n)
            for at in range(first, max(first + 1, stop - 2 * n), step):
                yield k, at, a[at : min(stop, at + wide)]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item with its window: scores, and the window places where the alignments end."""
    n, m, w = len(items), max(map(len, items)), max(map(len, windows))
    a, b = np.full((n, m), -2, dtype=np.int32), np.full((n, w), -3, dtype=np.int32)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    rise = -GAP * np.arange(w + 1, dtype=np.int32)
    h = np.zeros((n, w + 1), dtype=np.int32)
    best, end = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for i in range(m):
        step = np.where(a[:, i : i + 1] == b, np.int32(MATCH), np.int32(MISMATCH))
        new = np.zeros_like(h)
        np.maximum(h[:, :-1] + step, h[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + rise, axis=1) - rise
        top = h.argmax(1)
        value = h[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better] - 1
    return best, end


def parted(rows: list[tuple], cells: int) -> Iterator[list[tuple]]:
    """Runs of rows that take at most so many words side by side, as wide as the widest window (their last field); one row at least."""
    part, wide = [], 0
    for r in rows:
        wide = max(wide, len(r[3]))
        if part and (len(part) + 1) * wide > cells:
            yield part
            part, wide = [], len(r[3])
        part.append(r)
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): documents that hold a copy of a test item, and its best passage."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\W+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_WORDS))
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        found = _in_block(spark, docs, sorted((r["item_id"], r["text"] or "") for r in part.collect()), threshold)
        out = found if out is None else out.unionByName(found)
    return out


def _in_block(spark: SparkSession, docs: DataFrame, items: list[tuple[int, str]], threshold: float) -> DataFrame:
    shared = spark.sparkContext.broadcast(items)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(it: Iterator) -> Iterator:
        import pyarrow as pa

        index = SeedIndex(shared.value)
        for b in common.batches(it):
            ids, cols = b.column("doc_id"), defaultdict(list)
            for i, t in enumerate(b.column("text").to_pylist()):
                for item, first, window in index.windows(t):
                    # the most that an alignment could score, before it is made
                    if np.isin(index.items[item], window).mean() < threshold:
                        continue
                    cols["i"].append(i)
                    cols["item"].append(item)
                    cols["first"].append(first)
                    cols["window"].append(window)
            if cols:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols["i"])), pa.array(cols["item"], pa.int32()), pa.array(cols["first"], pa.int64()), pa.array(cols["window"], pa.list_(pa.int32()))], names=["doc_id", "item", "first", "window"])

    scanned = common.whole_texts(docs).where("doc_id is not null").mapInArrow(scan, f"doc_id {id_type}, item int, first long, window array<int>")
    windows = common.written(scanned, "windows")

    def score(it: Iterator) -> Iterator:
        import pyarrow as pa

        index = SeedIndex(shared.value)
        for b in it:
            ids, same = b.column("doc_id"), defaultdict(list)
            for i, (item, first, window) in enumerate(zip(b.column("item").to_pylist(), b.column("first").to_pylist(), b.column("window"), strict=True)):
                same[item, window.values.to_numpy().tobytes()].append((i, first))
            rows = [(at, item, index.items[item], np.frombuffer(w, dtype=np.int32)) for (item, w), at in same.items()]
            rows.sort(key=lambda r: (len(r[2]), len(r[3])))
            for part in parted(rows, CELLS):
                best, end = align([r[2] for r in part], [r[3] for r in part])
                good = [j for j, r in enumerate(part) if best[j] >= threshold * MATCH * len(r[2])]
                if not good:
                    continue
                _, back = align([part[j][2][::-1] for j in good], [part[j][3][: end[j] + 1][::-1] for j in good])
                out = [
                    (i, index.ids[part[j][1]], float(best[j]) / (MATCH * len(part[j][2])), first + int(end[j]) - int(e), first + int(end[j]) + 1)
                    for j, e in zip(good, back, strict=True)
                    for i, first in part[j][0]
                ]
                at, *cols = zip(*out, strict=True)
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "item_id", "score", "start_word", "end_word"])

    hits = windows.mapInArrow(score, f"doc_id {id_type}, item_id long, score double, start_word long, end_word long")
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"))).alias("b")
    found = hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.start_word", "b.end_word")
    return common.settled(found, "contaminated", windows)


def clean_of(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that hold a copy of a test item (and without other rows of their doc_ids)."""
    found = contaminated(docs, benchmark, threshold)
    out = common.join_ids(docs, found, "left_anti").select(docs.columns)
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return out
    # rows without doc_id are known by their texts
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    held = contaminated(nameless.select(key.alias("doc_id"), "text"), benchmark, threshold).select(F.col("doc_id").alias("key_")).distinct()
    row = F.struct(*(docs[c] for c in docs.columns))
    left = nameless.select(row.alias("row_"), key.alias("key_")).join(held, "key_", "left_anti").select(*(F.col("row_")[c].alias(c) for c in docs.columns))
    return out.where("doc_id is not null").unionByName(left)


def op6_seed_alignment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
