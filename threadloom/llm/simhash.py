"""Operator 9: SimHash near-duplicates through vantage-point trees.

A fingerprint has 64 bits; rows of one fingerprint are one class, so copies are never paired. Classes within RADIUS
bits of each other are found with vantage-point trees over Hamming distance. Distances of unrelated fingerprints to any
point crowd around 32, where a triangle bound of 3 bits prunes little; so the tree is built over each half of 32 bits:
two fingerprints within 3 bits agree within 1 bit on one half at least, and there a bound of 1 prunes well.

A tree is grown on a bounded sample of fingerprints (its choice changes the cost, never the result): every inner node
has a vantage point and the median distance to it, and its leaves are the shards. Each class goes to its home shard, and as a
visitor to every shard that the triangle bound leaves within reach of 1 bit. Within a shard, all 64 bits decide
exactly; one of over TILE classes is worked off in tiles of a block of its home classes and a block of all. (A wider radius works with
more, shorter parts in the same way.) Only links that join what a tile has not joined yet leave it, so a group of n near copies gives n - 1
of them.

Defined cases: words are runs of anything but space and \\t \\n \\v \\f \\r, A-Z in lower case; fewer words than a shingle
are one shingle; texts that are null, empty or blank have fingerprint zero and link like any other; a bit is 1 if it is set in over
half of the shingles, repeats included; rows without doc_id have a fingerprint, but take no part in links (their
component is their class's, or null); repeated doc_ids are one node; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Classes in a shard, about, and the deepest tree.
SHARD, DEEPEST = 512, 20
#: Rows of either side of a tile: in which fingerprints are compared, and in which pairs are checked on their shingles.
TILE, SET_TILE = 16_384, 2048
#: Bands and rows of the min-hashes: of pairs with similarity 0.8, one in 2,900 has no band in common.
BANDS, ROWS = 20, 5
#: Shingles of a tile's right rows that are held against one left row at once.
AT_ONCE = 2_000_000
REMEMBERED = 100_000
#: Multipliers of the min-hashes, and of the words of a shingle.
MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Fingerprints that decide a tree's shape: so many, or one in 64 of more, up to the second number (16 MB).
SAMPLE = (40_000, 2_000_000)
BYTE_AT = np.arange(8, dtype=np.int64)[None, :] * 256
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        hashes = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ BYTE_BITS).ravel()  # bit 8 * byte + k, little-endian
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in common.batches(it):
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return common.whole_texts(docs).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class Tree:
    """A vantage-point tree over 32-bit values: node k has children 2k + 1 (near) and 2k + 2 (far), or is a leaf (radius -1)."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        size = (1 << (depth + 1)) - 1
        self.point, self.radius = np.zeros(size, dtype=np.uint32), np.full(size, -1, dtype=np.int16)
        todo = [(0, sample)]
        while todo:
            node, inside = todo.pop()
            if 2 * node + 2 >= size or len(np.unique(inside)) < 4:
                continue
            tried = inside[rng.integers(0, len(inside), 5)]
            d = np.bitwise_count(inside[None, :] ^ tried[:, None])
            mid = np.median(d, axis=1).astype(np.int16)
            # the best vantage point keeps fewest values on its boundary, while both sides hold some
            edge = ((d == mid[:, None]) | (d == mid[:, None] + 1)).mean(1) + np.abs((d <= mid[:, None]).mean(1) - 0.5)
            k = int(edge.argmin())
            near = d[k] <= mid[k]
            if near.all():
                mid[k] -= 1
                near = d[k] <= mid[k]
            if near.all() or not near.any():
                continue
            self.point[node], self.radius[node] = tried[k], mid[k]
            todo += [(2 * node + 1, inside[near]), (2 * node + 2, inside[~near])]

    def shards(self, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, home) of each leaf that values within `reach` of x[index] may live in; home where x itself does."""
        index, node, home = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=bool)
        done = []
        while len(index):
            radius = self.radius[node]
            leaf = radius < 0
            done.append((index[leaf], node[leaf], home[leaf]))
            index, node, home, radius = index[~leaf], node[~leaf], home[~leaf], radius[~leaf]
            d = np.bitwise_count(x[index] ^ self.point[node]).astype(np.int16)
            inner, outer = d - reach <= radius, d + reach > radius
            index, node, home = (np.concatenate([a[inner], b[outer]]) for a, b in ((index, index), (2 * node + 1, 2 * node + 2), (home & (d <= radius), home & (d > radius))))
        return tuple(np.concatenate(c) for c in zip(*done, strict=True))


def tile_forest(fp: np.ndarray, node: np.ndarray, left: np.ndarray, right: np.ndarray, levels: tuple[int, ...]) -> list[tuple[int, int]]:
    """Links between the left and the right classes of a tile that join what was not joined yet. `levels`: the distances up to which links are
    made in turn, the last one being the radius."""
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    fp, out = fp.view(np.uint64), []
    _, who = np.unique(node, return_inverse=True)
    group = np.arange(who.max(initial=-1) + 1)
    block = max(1, (4 << 20) // max(1, len(b)))
    for level in levels:
        for at in range(0, len(a), block):
            rows = a[at : at + block]
            near = np.bitwise_count(fp[rows, None] ^ fp[None, b]) <= level
            near &= who[rows, None] != who[None, b]
            for r in np.flatnonzero(near.any(1)):
                me, others = who[rows[r]], b[near[r]]
                roots, first = np.unique(group[who[others]], return_index=True)
                new = roots != group[me]
                if new.any():
                    out += [(int(node[rows[r]]), int(node[others[f]])) for f in first[new]]
                    group[np.isin(group, roots[new])] = group[me]
    return out


def sharded(classes: DataFrame, radius: int, parts: int, shard: int) -> DataFrame:
    """(shard, home, and the columns of classes (fp, ...)): each class in its home shards, and as a visitor where one within `radius` bits may live.

    Of two fingerprints within `radius` bits, one of the `parts` differs in at most radius // parts bits, so some shard holds both, and one
    of them at home."""
    spark, reach, width = classes.sparkSession, radius // parts, 64 // parts
    n = classes.count()
    sample = min(max(SAMPLE[0], n // 64), SAMPLE[1])
    share = min(1.0, sample / max(n, 1))
    picked = classes.select("fp").where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).limit(2 * sample)
    values = np.sort(picked.toArrow().column("fp").to_numpy()).view(np.uint64)  # bounded: the tree's shape only
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(n / shard, 1))))))
    cut = lambda x, k: ((x >> np.uint64(width * k)) & np.uint64((1 << width) - 1)).astype(np.uint32)
    trees = spark.sparkContext.broadcast([Tree(cut(values, k), depth, k) for k in range(parts)])

    def route(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in it:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for k, tree in enumerate(trees.value):
                i, leaf, home = tree.shards(cut(fp, k), reach)
                i_ = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(parts * leaf + k), pa.array(home), *(c.take(i_) for c in b.columns)], names=["shard", "home", *b.schema.names])

    return classes.mapInArrow(route, "shard long, home boolean, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema))


def tiled(placed: DataFrame, tile: int) -> DataFrame:
    """Rows (shard, home, ...) as rows of tiles (shard, i, j): a row meets as `left` what comes as `right` in its tile. Each home row meets
    every row of its shard once. A shard of up to `tile` rows is one tile, and its rows aren't repeated."""
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n_")).where(F.col("n_") > tile).select("shard", F.ceil(F.col("n_") / tile).alias("blocks_"))
    large = common.written(sizes, "large")  # shards that a tree couldn't split
    if large.isEmpty():
        common.drop_written(large)
        return placed.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long"), "left": F.col("home"), "right": F.lit(True)}).drop("home")
    held = placed.join(large, "shard", "left").withColumn("blocks_", F.coalesce("blocks_", F.lit(1).cast("long"))).withColumn("block_", F.pmod(F.xxhash64("node"), F.col("blocks_")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_") - 1))
    one = held.where("blocks_ = 1").withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long"), "left": F.col("home"), "right": F.lit(True)})
    left = held.where("blocks_ > 1 and home").withColumns({"i": F.col("block_"), "j": every, "left": F.lit(True), "right": F.lit(False)})
    right = held.where("blocks_ > 1").withColumns({"i": every, "j": F.col("block_"), "left": F.lit(False), "right": F.lit(True)})
    return one.unionByName(left).unionByName(right).drop("home", "blocks_", "block_")


def class_links(classes: DataFrame, radius: int = RADIUS, parts: int = 2, levels: tuple[int, ...] = (), shard: int = SHARD) -> DataFrame:
    """(u, v): links between classes (fp, node), enough to join all that are within `radius` bits; closer ones first, by `levels`."""

    def within(pdf):
        import pandas as pd

        found = tile_forest(*(pdf[c].to_numpy() for c in ("fp", "node", "left", "right")), levels or (radius,))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    placed = tiled(sharded(classes.select("fp", "node"), radius, parts, shard), TILE)
    return placed.groupBy("shard", "i", "j").applyInPandas(within, "u long, v long")


def tile_links(pdf, similarity: float) -> list[tuple[int, int]]:
    """Links of one tile: pairs of a left and a right row that have the Jaccard similarity of their sets, as far as they join components that
    neither `comp` nor an earlier link of the tile joined. Sizes that rule a pair out are all that is decided without a look at the sets."""
    own = pdf["left"].to_numpy()
    node = pdf["node"].to_numpy()
    if not own.any() or own.all():
        return []
    size = np.fromiter(map(len, pdf["set"]), dtype=np.int64, count=len(pdf))
    _, words = np.unique(np.concatenate(pdf["set"].to_list()), return_inverse=True)
    begin, held = np.cumsum(size) - size, np.zeros(int(words.max()) + 1, dtype=bool)
    _, group = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
    right, out = np.flatnonzero(~own), []
    for r in np.flatnonzero(own):
        near = right[group[right] != group[r]]
        # the most that sets of such sizes could have in common
        near = near[np.minimum(size[near], size[r]) >= similarity * np.maximum(size[near], size[r])]
        mine = words[begin[r] : begin[r] + size[r]]
        held[mine] = True
        for some in np.split(near, np.flatnonzero(np.diff(np.cumsum(size[near]) // AT_ONCE)) + 1):
            some = some[group[some] != group[r]]
            if not len(some):
                continue
            ends = np.cumsum(size[some])
            flat = np.repeat(begin[some] - ends + size[some], size[some]) + np.arange(ends[-1])
            both = np.add.reduceat(held[words[flat]].astype(np.int64), ends - size[some])
            for o in some[both >= similarity * (size[some] + size[r] - both)]:
                if group[o] != group[r]:
                    out.append((int(node[r]), int(node[o])))
                    group[group == group[o]] = group[r]
        held[mine] = False
    return out


def bucket_links(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links between the components of each bucket, of rows (bucket, node, fp, comp), enough to join all that are alike by their
    sets. Rows of a bucket's largest component meet only the others, in tiles."""
    counts = open_.groupBy("bucket", "comp").agg(F.count("*").alias("n_"))
    top = counts.groupBy("bucket").agg(F.max_by("comp", F.struct("n_", "comp")).alias("top_"), F.max("n_").alias("most_"), F.sum("n_").alias("all_"))
    blocks = lambda n: F.ceil(n / F.lit(SET_TILE))
    held = open_.join(top.select("bucket", "top_", blocks(F.col("all_") - F.col("most_")).alias("lefts_"), blocks(F.col("all_")).alias("rights_")), "bucket")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["bucket", "i", "j", "left", "fp", "node", "comp"]
    left = held.where("comp <> top_").withColumns({"i": block("lefts_"), "j": every("rights_"), "left": F.lit(True)}).select(columns)
    right = held.withColumns({"i": every("lefts_"), "j": block("rights_"), "left": F.lit(False)}).select(columns)
    tiles = left.unionByName(right).join(sets.withColumnRenamed("doc_id", "node"), "node")

    def within(pdf):
        import pandas as pd

        return pd.DataFrame(tile_links(pdf, similarity), columns=["u", "v"]).astype("int64")

    return tiles.groupBy("bucket", "i", "j").applyInPandas(within, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row of docs."""
    prints = common.written(fingerprints(docs, shingle), "fingerprints")
    classes = common.written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    # one doc_id under several fingerprints joins them too
    same = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1 and a <> b").select("doc_id")
    joined = prints.join(same, "doc_id", "left_semi").join(classes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    labels = components.connected(class_links(classes, radius).unionByName(joined))
    found = classes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return common.settled(prints.join(found, "fp", "left").select("doc_id", "fp", "component_id"), "near_duplicates", prints, classes, labels)


class Shingles:
    """Hashes of the word shingles of texts; those of words are remembered."""

    def __init__(self, size: int):
        self.size, self.seen = size, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """The hash of each shingle, in order (fewer words are one shingle)."""
        from xxhash import xxh64_intdigest

        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        h = np.fromiter((seen[w] if w in seen else seen.setdefault(w, xxh64_intdigest(w)) for w in words), dtype=np.uint64, count=len(words))
        with np.errstate(over="ignore"):
            n = max(1, len(h) - self.size + 1)
            out = np.full(n, len(h) if len(h) < self.size else self.size, dtype=np.uint64)
            for k in range(min(self.size, len(h))):
                out = (out ^ (out >> np.uint64(29))) * MULTIPLIERS[1] + h[k : k + n]
            out = (out ^ (out >> np.uint64(32))) * MULTIPLIERS[0]
            return out ^ (out >> np.uint64(29))

    def bands(self, words: list[bytes]) -> np.ndarray:
        """BANDS numbers, each made of ROWS min-hashes; texts with the number of a band in common are candidates."""
        h = np.unique(self.hashes(words))
        least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(0, len(h), 4096):
                np.minimum(least, (h[k : k + 4096, None] * MULTIPLIERS).min(0), out=least)
            out = np.arange(1, BANDS + 1, dtype=np.uint64)
            for row in least.reshape(BANDS, ROWS).T:
                out = (out ^ (out >> np.uint64(31))) * MULTIPLIERS[2] + row
            return out.view(np.int64)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, set): the distinct hashes of the word shingles of each text, of 32 bits each (two of a pair of texts of 500 words
    meet by chance once in 16,000 pairs)."""

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa

        shingles = Shingles(shingle)
        for b in common.batches(it):
            sets = [np.unique(shingles.hashes(t.encode("utf-8", "surrogatepass").lower().split()).astype(np.uint32)).view(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "set"])

    return common.whole_texts(docs).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set array<int>")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets have the Jaccard similarity."""
    both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("set").alias("b")), "v")
    common_ = F.size(F.array_intersect("a", "b"))
    return both.where(common_ >= similarity * (F.size("a") + F.size("b") - common_)).select("u", "v")


def with_components(mates: DataFrame, labels: DataFrame) -> DataFrame:
    """The mates (bucket, node, ...) whose bucket holds several components, with theirs as `comp`."""
    now = mates.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    several = now.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("bucket")
    return common.written(now.join(several, "bucket", "left_semi"), "open")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(doc_id, component_id, rows) of each doc_id: groups of texts that are equal word for word, or linked by a Jaccard similarity of
    their word shingles of at least `similarity`, checked exactly. rows: how many rows hold the id. (Different texts under one doc_id are one
    document here; one_of_each() names documents by id and text.)

    Candidates are the pairs whose fingerprints differ in at most `radius` bits, found by the trees: a spanning forest of them, closer ones
    first. Pairs with a similarity near 0.8 differ in 8 bits in the mean, where trees over parts of 16 bits prune next to nothing (7 bits made
    115 visits a class among 230,000 classes, and more with more of them); and what a forest leaves apart may still belong together. So texts that share a band of min-hashes over the same shingles are candidates, too, as far as they are still apart: first each
    with the one of its bucket that shares most buckets with others, then all that are left in different groups, in tiles."""

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        shingles = Shingles(shingle)
        for b in common.batches(it):
            out, bands = [], []
            for t in b.column("text").to_pylist():
                words = t.encode("utf-8", "surrogatepass").lower().split()
                same = b" ".join(words)
                out.append((fingerprint(t), xxh64_intdigest(same, 1), xxh64_intdigest(same, 2)))
                bands.append(shingles.bands(words))
            cols = np.array(out, dtype=np.uint64).view(np.int64).T
            kinds = [*(pa.array(np.ascontiguousarray(c)) for c in cols), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *kinds], names=["doc_id", "fp", "c1", "c2", "bands"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = common.whole_texts(docs).where("doc_id is not null")
    prints = common.written(texts.mapInArrow(work, f"doc_id {id_type}, fp long, c1 long, c2 long, bands array<long>"), "fingerprints")
    classes = common.written(prints.groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "classes")
    near = class_links(classes, radius, levels=(1, radius))
    near = common.written(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "near")
    each = classes.select("node", "fp", F.explode("bands").alias("bucket"))
    often = common.written(each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "often")
    mates = common.written(each.join(often, "bucket"), "mates")
    held = near.select(F.explode(F.array("u", "v")).alias("doc_id")).unionByName(mates.select(F.col("node").alias("doc_id")))
    # of rows that repeat an id the largest set counts
    sets = common.written(shingle_sets(common.join_ids(texts, held, "left_semi"), shingle).groupBy("doc_id").agg(F.max_by("set", F.size("set")).alias("set")), "sets")
    by_id = prints.join(classes, ["c1", "c2"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v")).where("u <> v")
    labels = components.connected(alike(near, sets, similarity).unionByName(by_id))
    done = [prints, classes, near, often, mates, sets, labels]
    edges = lambda: labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    open_ = with_components(mates, labels)
    if not open_.isEmpty():
        degree = open_.groupBy("node").agg(F.sum("n").alias("degree_"))
        hubs = open_.join(degree, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "comp"), F.struct("degree_", -F.col("node"))).alias("hub_"))
        star = open_.join(hubs, "bucket").where("comp <> hub_.comp").select(F.col("node").alias("u"), F.col("hub_.node").alias("v")).distinct()
        labels = components.connected(alike(star, sets, similarity).unionByName(edges()))
        done.append(labels)
        left = with_components(open_.drop("comp"), labels)
        if not left.isEmpty():
            labels = components.connected(bucket_links(left, sets, similarity).unionByName(edges()))
            done.append(labels)
        common.drop_written(left)
    ids = prints.groupBy("doc_id").agg(F.count("*").alias("rows"))
    out = ids.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"), "rows")
    return common.settled(out, "groups", open_, *done)


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of similar_groups(), where a document is a doc_id and a text: that of the smallest doc_id, and one of rows that
    repeat both. So a text whose doc_id other texts share is judged by itself. Rows without doc_id stay."""
    key = F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))
    named = docs.where("doc_id is not null").select(key.alias("doc_id"), "text", F.col("doc_id").alias("own_"))
    groups = similar_groups(named.drop("own_"), shingle, similarity)
    shared = groups.groupBy("component_id").agg(F.count("*").alias("n_")).where("n_ > 1").select("component_id")
    members = common.written(groups.join(shared, "component_id", "left_semi").select("doc_id", "component_id"), "members")
    ids = common.join_ids(named.drop("text"), members, "left_semi").distinct()
    first = F.min_by("doc_id", F.struct("own_", "doc_id"))
    stay = ids.join(members, "doc_id").groupBy("component_id").agg(first.alias("stays_"))
    gone = common.written(members.join(stay, "component_id").where("doc_id <> stays_").select("doc_id"), "gone")
    rows = docs.select(F.when(F.col("doc_id").isNotNull(), key).alias("doc_id"), F.struct(*(docs[c] for c in docs.columns)).alias("row_"))
    kept = common.join_ids(rows, gone, "left_anti").select("doc_id", "row_")
    repeated = common.written(groups.where("rows > 1").select("doc_id"), "repeated")
    whole = lambda df: df.select(*(F.col("row_")[c].alias(c) for c in docs.columns))
    common.drop_written(members, groups)
    if repeated.isEmpty():
        return whole(kept)
    # summed before the shuffle: a third of all rows may be one document
    one = common.join_ids(kept, repeated, "left_semi").groupBy("doc_id", "row_.text").agg(F.min_by("row_", F.xxhash64("row_")).alias("row_"))
    return whole(common.join_ids(kept, repeated, "left_anti")).unionByName(whole(one))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
