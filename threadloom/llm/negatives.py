"""Operator 12: hard negatives by angular triangle filtering.

Vectors become integers, floor(scale * x), and a score is the integer inner product. Each row stores its norm and its angles to REFERENCES
directions. With t and u the angles of two rows to one direction, the angle between them lies in [|t - u|, min(t + u, 2 pi - t - u)], so its
cosine in [cos(t + u), cos(t - u)]; over all directions the narrowest such interval, times both norms, bounds the score from either side, with
a margin for rounding. Only rows whose interval overlaps a window in which an anchor still looks for rows are scored, in integers.

Rows are written in the order of their nearest direction and the angle to it, so that the rows of a block lie together: an anchor's bounds to
a whole block come first, from the ranges of its angles and norms, and those to its rows only where the block is open.

Anchors come to the rows, ANCHOR_BYTES of them at a time, as a broadcast of that size; rows are never shuffled for them, and each task keeps
only the best of each window. So that tasks don't each send a whole list, a window's first bound is its k-th best row in a sample of one row
in SAMPLED, once there are more than TRUSTED rows (this changes what is sent, never what is found). Positives are found first, by the same scan with one open window over the rows of the anchor's label; then
negatives, one window a positive, over those of other labels.

Defined cases: a row with a null label, id or vector, or any null or non-finite component takes no part, nor does one whose length isn't the most
frequent one (of equally frequent ones the longest), or whose scaled vector has a squared norm from 2^62 on (scores must fit 64 bits); rows that
repeat id, label and vector count once; rows of one id that differ are rows of their own, and anchors of their own, but no positives of their own
id; zero vectors take part with score 0; ties go to the smaller id; fewer rows than asked are all returned; a positive with a negative score has no window, as its upper bound is below its lower one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .neighbours import distinct_rows, slices

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: Percent of the positive's score that a negative may have.
LOW, HIGH = 30, 90
#: Directions, rows that they are chosen from, rows of a block, rows of a written file.
REFERENCES, CHOICE, BLOCK, FILE_ROWS = 6, 2048, 128, 200_000
ANCHOR_BYTES, SAMPLED, TRUSTED = 16 << 20, 16, 1 << 20
#: What rounding may add to a bound, as a share of the norms' product.
ROUNDING = 1e-9
#: Scores below this are exact in double precision.
EXACT = 2.0**53


def usable(vectors: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): the rows that take part, in integers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    fits = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31))  # no larger component has a norm that fits
    rows = rows.where("vec_id is not null and label is not null and x is not null").where(fits)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (sizes["d"] if sizes else 0)).select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) < 2.0**62)
    return distinct_rows(rows)


def directions(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors far from each other, out of the sample's."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.eye(1, sample.shape[1])
    chosen = [units[0]]
    far = units @ units[0]
    while len(chosen) < min(count, len(units)):
        k = int(far.argmin())
        chosen.append(units[k])
        far = np.maximum(far, units @ units[k])
    return np.array(chosen)


def angles(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows and their angles to the directions (a right angle for zero rows)."""
    norms = np.linalg.norm(x, axis=1)
    return norms, np.arccos(np.clip(x @ references.T / np.maximum(norms, 1e-300)[:, None], -1, 1))


class Anchors:
    """Anchors with their windows [low, high] (a row an anchor, a column a window), and the best k rows of each so far."""

    def __init__(self, ids, labels, x: np.ndarray, references: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same_label: bool, exact: bool):
        self.ids, self.labels, self.k, self.same = np.asarray(ids), np.asarray(labels), k, same_label
        self.x = x.astype(np.float64) if exact else x
        self.norms, self.angles = angles(x.astype(np.float64), references)
        self.cos, self.sin = np.cos(self.angles), np.sin(self.angles)
        self.low, self.high = low.copy(), high  # low rises as lists fill
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def open_to(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which anchors (of any window) may find scores between the bounds; these have a row an anchor, and further axes."""
        low, high = self.low.min(1), np.where(self.low <= self.high, self.high, -np.inf).max(1)
        more = (slice(None),) + (None,) * (least.ndim - 1)
        return (most >= low[more]) & (least <= high[more])

    def block_open(self, norms: np.ndarray, angle: np.ndarray) -> np.ndarray:
        """Anchors that may find a row in a block."""
        lo, hi = angle.min(0), angle.max(0)
        gap = np.maximum(0, np.maximum(lo - self.angles, self.angles - hi))
        most = np.cos(gap).min(1)
        a, b = self.angles + lo, self.angles + hi
        wide = np.where((a <= np.pi) & (b >= np.pi), np.pi, np.maximum(np.minimum(a, 2 * np.pi - a), np.minimum(b, 2 * np.pi - b)))
        least = np.cos(wide).max(1)
        far, near = norms.max(), norms.min()
        slack = ROUNDING * self.norms * far + ROUNDING
        return self.open_to(self.norms * least * np.where(least < 0, far, near) - slack, self.norms * most * np.where(most < 0, near, far) + slack)

    def row_open(self, who: np.ndarray, norms: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
        """(anchors of `who`, rows): pairs whose score bounds overlap a window."""
        most, least = np.full((len(who), len(norms)), 1.0), np.full((len(who), len(norms)), -1.0)
        for r in range(cos.shape[1]):
            c, s = np.outer(self.cos[who, r], cos[:, r]), np.outer(self.sin[who, r], sin[:, r])
            np.minimum(most, c + s, out=most)
            np.maximum(least, c - s, out=least)
        both = self.norms[who][:, None] * norms[None, :]
        slack = ROUNDING * both + ROUNDING
        low, high = self.low[who].min(1), np.where(self.low[who] <= self.high[who], self.high[who], -np.inf).max(1)
        return (most * both + slack >= low[:, None]) & (least * both - slack <= high[:, None])

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norms: np.ndarray, angle: np.ndarray) -> None:
        """Score the rows of a block where the bounds leave them open."""
        who = np.flatnonzero(self.block_open(norms, angle))
        if not len(who):
            return
        pairs = self.row_open(who, norms, np.cos(angle), np.sin(angle))
        equal = self.labels[who][:, None] == labels[None, :]
        pairs &= equal if self.same else ~equal
        if self.same:
            pairs &= self.ids[who][:, None] != ids[None, :]
        some, rows = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
        if not len(some):
            return
        who, pairs = who[some], pairs[np.ix_(some, rows)]
        score = self.x[who] @ x[rows].T
        for w in range(self.low.shape[1]):
            i, j = np.nonzero(pairs & (score >= self.low[who, w][:, None]) & (score <= self.high[who, w][:, None]))
            if len(i):
                self.held.append((who[i], np.full(len(i), w), ids[rows[j]], score[i, j].astype(np.int64)))
                self.waiting += len(i)
        if self.waiting > 4 * self.k * self.low.size + 100_000:
            self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        """(anchor number, window, id, score) of the best k rows of each window; lower bounds rise to the k-th."""
        none = np.zeros(0, np.int64)
        a, w, i, s = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (none,) * 4
        order = np.lexsort((i, -s, w, a))
        a, w, i, s = a[order], w[order], i[order], s[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])]) if len(a) else none
        nth = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        full = nth == self.k - 1
        self.low[a[full], w[full]] = s[full]
        keep = nth < self.k
        self.held, self.waiting = [(a[keep], w[keep], i[keep], s[keep])], 0
        return self.held[0]


def scan(rows: DataFrame, anchors: Anchors, exact: bool) -> DataFrame:
    """(a, w, vec_id, score): each task's best rows of every window."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def work(it: Iterator) -> Iterator:
        import copy

        import pyarrow as pa

        found = copy.copy(shared.value)
        found.low, found.held = found.low.copy(), []
        for b in slices(it, BLOCK):
            x = np.stack(b.column("v").to_numpy(zero_copy_only=False))
            ids, labels, norms = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "norm"))
            found.meet(ids, labels, x.astype(np.float64) if exact else x, norms, np.stack(b.column("angles").to_numpy(zero_copy_only=False)))
        out = found.best()
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "w", "vec_id", "score"])

    return rows.mapInArrow(work, "a long, w long, vec_id long, score long")


def first_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by `every` its best rows
    of the same label, and for each of these the best rows of other labels that score from `low` to `high` percent of it."""
    spark = vectors.sparkSession
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = common.written(usable(vectors, scale, id_col, vec_col, label_col), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, largest, asked, width = rows.agg(F.count("*"), F.max(square), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v"))).first()
    if not asked:
        common.drop_written(rows)
        return spark.createDataFrame([], columns)
    exact = largest < EXACT / 2
    share = min(1.0, CHOICE / n)
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) <= int(1_000_000 * share)).limit(2 * CHOICE).collect()  # bounded: directions only
    references = directions(np.array([r["v"] for r in sorted(picked, key=lambda r: r["vec_id"])] or [rows.first()["v"]], dtype=np.float64))
    ways = spark.sparkContext.broadcast(references)

    def measure(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(it):
            norms, angle = angles(np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.float64), ways.value)
            more = [pa.array(norms), pa.array(list(angle), pa.list_(pa.float64())), pa.array(angle.argmin(1).astype(np.int32)), pa.array(angle.min(1))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "v")), *more], names=["vec_id", "label", "v", "norm", "angles", "home", "near"])

    kinds = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, v array<long>, norm double, angles array<double>, home int, near double"
    order = ["home", "near", F.xxhash64("vec_id")]
    placed = rows.mapInArrow(measure, kinds).repartitionByRange(max(spark.sparkContext.defaultParallelism, -(-n // FILE_ROWS)), *order).sortWithinPartitions(*order)
    placed = common.written(placed.drop("home", "near"), "angled")
    sampled = common.written(placed.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(SAMPLED)) == 0), "sampled") if n > TRUSTED else None
    chunks = max(1, -(-asked * (width + 4 * positives * negatives) * 8 // ANCHOR_BYTES))
    results = []
    for chunk in range(chunks):
        held = rows.where((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(chunks)) == chunk)).collect()  # ANCHOR_BYTES of them
        if not held:
            continue
        ids, labels, x = np.array([r["vec_id"] for r in held]), np.array([r["label"] for r in held]), np.array([r["v"] for r in held], dtype=np.int64)

        def best(low_: np.ndarray, high_: np.ndarray, k: int, same: bool, ids=ids, labels=labels, x=x) -> DataFrame:
            def over(some: DataFrame, least: np.ndarray) -> DataFrame:
                return scan(some, Anchors(ids, labels, x, references, least, high_, k, same, exact), exact)

            least = low_
            if sampled is not None:
                least = low_.copy()
                for r in first_of(over(sampled, low_), k).where(F.col("rank") == k).collect():  # a row a window at most
                    least[r["a"], r["w"]] = max(least[r["a"], r["w"]], r["score"])
            return first_of(over(placed, least), k)

        ends = np.full((len(ids), 1), 2**62)
        found = best(-ends, ends, positives, True).collect()  # `positives` rows an anchor of the chunk
        low_, high_ = np.full((len(ids), positives), 1), np.full((len(ids), positives), 0)
        mates = []
        for r in found:
            w, s = r["rank"] - 1, r["score"]
            low_[r["a"], w], high_[r["a"], w] = -(-low * s // 100), high * s // 100
            mates.append((r["a"], w, int(ids[r["a"]]), r["vec_id"], s))
        known = spark.createDataFrame(mates, "a long, w long, anchor_id long, positive_id long, positive_score long")
        mined = best(low_, high_, negatives, False).join(F.broadcast(known), ["a", "w"])
        results.append(common.written(mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    common.drop_written(rows, placed, sampled)
    return out


def op12_angular_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(common.table(spark, sf_dir, "embeddings").withColumn("label", label))
