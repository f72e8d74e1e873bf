"""Operator 1: nearest neighbours by largest inner product, with vantage-point trees per shard.

Inner products become distances: with M the largest norm, a row x gets one more coordinate sqrt(M^2 - |x|^2), a query is scaled to norm M
and gets 0 there; the nearest point is then the one with the largest inner product, and triangle bounds hold.

A tree grown on a bounded sample deals the rows to shards (its leaves), and its bounds are then measured over all rows dealt; shards of more
than PART rows are cut by a hash of the id. Each part grows a vantage-point tree of its own over its rows. A query first visits the parts of its home shard, whose
20th best distance bounds its search; then those shards that the bound can't rule out. A branch is pruned where its lower
bound times `factor` exceeds the best distance so far: factor 1 is exact search, a larger one prunes more. Scores are
inner products of the original vectors in double precision.

Defined cases: a vector that is null, all zero, or holds a null or non-finite component takes no part, nor does one whose
length isn't the most frequent one (of equally frequent ones the longest), or a row without id; rows that repeat both id and
vector count once; rows of one id with different vectors are candidates, and queries, of their own, but never neighbours of their own id;
ties go to the smaller id; fewer candidates than k are all returned; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Beyond 1 the factor trades recall for pruning: on circles, clusters and low dimensions 1.25 found over 0.99 of the true neighbours, 2 down to 0.58.
K, EVERY, FACTOR = 20, 20, 1.25
#: Rows of a part and queries that meet it at once; rows of a leaf of its tree; rows that shape the shards (a leaf of the shard tree
#: holds 8 of them at least, so there are SAMPLE / 4 shards at most); rows aimed at once.
PART, QUERIES, LEAF, SAMPLE, AIMED = 8192, 4096, 256, 8192, 1024
#: What rounding may add to a distance, as a share of the largest norm.
ROUNDING = 1e-6


class VantageTree:
    """Nodes in order; inner[k] has (vantage point, low and high distance of the near side, and of the far side)."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.points: list[np.ndarray] = []
        self.bounds: list[tuple[float, float, float, float]] = []
        self.cut: list[float] = []
        self.children: list[tuple[int, int]] = []  # node numbers; a leaf is -1 - its number
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(points, np.arange(len(points)), leaf, rng)

    def _grow(self, points: np.ndarray, inside: np.ndarray, leaf: int, rng) -> int:
        if len(inside) > leaf:
            for v in points[rng.choice(inside, 3)]:
                d = np.sqrt(np.maximum(((points[inside] - v) ** 2).sum(1), 0))
                mid = float(np.median(d))
                near = d <= mid
                if near.all():
                    near = d < mid
                if near.any() and not near.all():
                    me = len(self.points)
                    self.points.append(v)
                    self.bounds.append((float(d[near].min()), float(d[near].max()), float(d[~near].min()), float(d[~near].max())))
                    self.cut.append(float(d[near].max()))
                    self.children.append((0, 0))
                    self.children[me] = (self._grow(points, inside[near], leaf, rng), self._grow(points, inside[~near], leaf, rng))
                    return me
        self.leaves.append(inside)
        return -len(self.leaves)

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds (rows of x by leaves) of the distance to anything in a leaf, and each row's home leaf."""
        bound, home = np.zeros((len(x), len(self.leaves))), np.zeros(len(x), dtype=np.int64)
        todo = [(self.root, np.zeros(len(x)), np.ones(len(x), dtype=bool))]
        while todo:
            node, low, at_home = todo.pop()
            if node < 0:
                bound[:, -1 - node] = low
                home[at_home] = -1 - node
                continue
            d = np.sqrt(np.maximum(((x - self.points[node]) ** 2).sum(1), 0))
            a, b, c, e = self.bounds[node]
            near = d <= self.cut[node]
            todo.append((self.children[node][0], np.maximum(low, np.maximum(a - d, d - b)), at_home & near))
            todo.append((self.children[node][1], np.maximum(low, np.maximum(c - d, d - e)), at_home & ~near))
        return bound, home


    def measured(self, x: np.ndarray) -> np.ndarray:
        """The bounds of the nodes over the rows of x alone, as they are dealt; (inf, -inf) for a side that none goes to."""
        out = np.tile([np.inf, -np.inf, np.inf, -np.inf], (len(self.points), 1))
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, inside = todo.pop()
            if node < 0 or not len(inside):
                continue
            d = np.sqrt(np.maximum(((x[inside] - self.points[node]) ** 2).sum(1), 0))
            near = d <= self.cut[node]
            for side, at in enumerate((near, ~near)):
                if at.any():
                    out[node, 2 * side : 2 * side + 2] = d[at].min(), d[at].max()
                    todo.append((self.children[node][side], inside[at]))
        return out


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(most**2 - (x**2).sum(1), 0))[:, None]])


def as_query(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x * (most / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))])


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, most: float, k: int, factor: float, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, vec ids, scores): up to k best rows for each query in one part. limit: the distances beyond which nothing counts."""
    tree = VantageTree(lifted(rows, most), LEAF)
    norms = np.linalg.norm(queries, axis=1)
    for a in range(0, len(queries), 512):
        q, qid, norm = queries[a : a + 512], query_ids[a : a + 512], norms[a : a + 512]
        bound, home = tree.reach(as_query(q, most))
        score = np.full((len(q), len(ids)), -np.inf)

        def visit(leaf: int, who: np.ndarray, q=q, qid=qid, score=score) -> None:
            inside = tree.leaves[leaf]
            s = q[who] @ rows[inside].T
            s[qid[who][:, None] == ids[inside][None, :]] = -np.inf
            score[np.ix_(who, inside)] = s

        def reached(limit=limit[a : a + 512], norm=norm, score=score) -> np.ndarray:
            """The distance of the k-th best so far, of queries scaled to norm `most`."""
            if score.shape[1] < k:
                return limit
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            return np.minimum(limit, np.sqrt(np.maximum(2 * most**2 - 2 * kth * most / norm, 0)) + ROUNDING * most)

        for leaf in range(len(tree.leaves)):
            if len(who := np.flatnonzero(home == leaf)):
                visit(leaf, who)
        best, half = reached(), len(tree.leaves) // 2
        order = np.argsort(np.median(bound, axis=0), kind="stable")
        for turn, leaf in enumerate(order):
            if turn == half:
                best = reached()
            if len(who := np.flatnonzero((bound[:, leaf] * factor <= best) & (home != leaf))):
                visit(int(leaf), who)
        top = min(k, score.shape[1])
        kth = -np.partition(-score, top - 1, axis=1)[:, top - 1]
        for r in range(len(q)):
            found = np.flatnonzero((score[r] >= kth[r]) & (score[r] > -np.inf))
            found = found[np.lexsort((ids[found], -score[r, found]))][:k]
            yield np.full(len(found), a + r), ids[found], score[r, found]


def distinct_rows(rows: DataFrame) -> DataFrame:
    """rows (vec_id, v) without repeated ones. Only ids are shuffled to find those that repeat, and only their rows are compared."""
    several = common.written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "several")
    if several.isEmpty():
        common.drop_written(several)
        return rows
    return rows.join(several, "vec_id", "left_anti").unionByName(rows.join(several, "vec_id", "left_semi").distinct())


def slices(it: Iterator, rows: int = AIMED) -> Iterator:
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return distinct_rows(rows.where(F.size("v") == (sizes["d"] if sizes else 0)))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = common.written(usable(vectors, id_col, vec_col), "vectors")
    n, most = rows.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        common.drop_written(rows)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, SAMPLE / n)
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).limit(2 * SAMPLE).collect()  # bounded: shapes the shards only
    sample = lifted(np.array([r["v"] for r in sorted(picked, key=lambda r: r["vec_id"])] or [rows.first()["v"]]), most)
    tree = VantageTree(sample, max(8, int(PART * len(sample) / n)))
    shared = spark.sparkContext.broadcast((tree, float(most)))

    def deal(it: Iterator) -> Iterator:
        import pyarrow as pa

        tree, most = shared.value
        for b in slices(it):
            x = np.stack(b.column("v").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(tree.reach(lifted(x, most))[1])], names=["vec_id", "v", "shard"])

    dealt = common.written(rows.mapInArrow(deal, "vec_id long, v array<double>, shard long"), "dealt")

    def measure(it: Iterator) -> Iterator:
        import pyarrow as pa

        tree, most = shared.value
        found = None
        for b in it:
            if b.num_rows:
                here = tree.measured(lifted(np.stack(b.column("v").to_numpy(zero_copy_only=False)), most))
                found = here if found is None else np.where([True, False] * 2, np.minimum(found, here), np.maximum(found, here))
        if found is not None and len(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), *(pa.array(c) for c in np.ascontiguousarray(found.T))], names=["inner", "a", "b", "c", "e"])

    # the tree's own bounds are those of its sample; a row a node of the tree
    bounds = dealt.select("v").mapInArrow(measure, "inner long, a double, b double, c double, e double").groupBy("inner").agg(F.min("a"), F.max("b"), F.min("c"), F.max("e"))
    for node, *over_all in bounds.collect():
        tree.bounds[node] = tuple(over_all)
    aimed = spark.sparkContext.broadcast((tree, float(most)))
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / PART).alias("parts"))  # a row a leaf of the tree
    candidates = dealt.join(F.broadcast(sizes), "shard").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
    # q tells apart the queries of one id
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("q", F.xxhash64("v"))

    def aim(first: bool):
        def work(it: Iterator) -> Iterator:
            import pyarrow as pa

            tree, most = aimed.value
            for b in slices(it):
                x = np.stack(b.column("v").to_numpy(zero_copy_only=False))
                bound, home = tree.reach(as_query(x, most))
                if first:
                    i, shard, limit = np.arange(len(x)), home, np.full(len(x), np.inf)
                else:
                    kth = np.array([np.nan if s is None else s for s in b.column("kth").to_pylist()])
                    limit = np.sqrt(np.maximum(2 * most**2 - 2 * kth * most / np.linalg.norm(x, axis=1), 0)) + ROUNDING * most
                    limit[np.isnan(limit)] = np.inf
                    open_ = bound * factor <= limit[:, None]
                    open_[np.arange(len(x)), home] = False
                    i, shard = np.nonzero(open_)
                    limit = limit[i]
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("vec_id", "q", "v")), pa.array(shard), pa.array(limit)], names=["vec_id", "q", "v", "shard", "limit_"])

        return work

    def within(pdf):
        import pandas as pd

        _, most = shared.value
        is_query = pdf["limit_"].notna().to_numpy()
        found = []
        if is_query.any() and not is_query.all():
            x, ids, limit = np.stack(pdf["v"].to_numpy()), pdf["vec_id"].to_numpy(), pdf["limit_"].to_numpy()
            found = list(search(ids[~is_query], x[~is_query], ids[is_query], x[is_query], most, k, factor, limit[is_query]))
        who, vec_id, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"query_id": pdf["vec_id"].to_numpy()[is_query][who], "q": pdf["q"].to_numpy()[is_query][who], "vec_id": vec_id, "score": score})

    def ask(queries: DataFrame) -> DataFrame:
        """Queries (vec_id, q, v, shard, limit_) meet the parts of their shards; many queries of one shard come in blocks."""
        blocks = queries.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
        met = queries.join(F.broadcast(sizes), "shard").join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.col("blocks")))
        met = met.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        given = candidates.join(F.broadcast(blocks), "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        columns = ["shard", "part", "block", "vec_id", "q", "v", "limit_"]
        both = met.select(columns).unionByName(given.withColumns({"q": F.lit(0).cast("long"), "limit_": F.lit(None).cast("double")}).select(columns))
        return both.groupBy("shard", "part", "block").applyInPandas(within, "query_id long, q long, vec_id long, score double")

    def cut(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    columns = "vec_id long, q long, v array<double>, shard long, limit_ double"
    at_home = common.written(ask(asked.mapInArrow(aim(True), columns)), "near")
    kth = cut(at_home).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "q", F.col("score").alias("kth"))
    further = common.written(asked.join(kth, ["vec_id", "q"], "left").mapInArrow(aim(False), columns), "further")
    # a query meets each part once, and a candidate is in one part, so no row comes twice
    found = cut(at_home.unionByName(ask(further))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return common.settled(found, "neighbours", rows, dealt, at_home, further)


def op1_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))
