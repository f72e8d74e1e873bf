"""Operator 2: removal of long repeated byte strings, by column-wise multi-document construction.

A byte is removed if a string of LENGTH bytes that covers it starts anywhere else too. To insert whole documents symbol by symbol
takes as many rounds as the longest has bytes, over everything inserted so far; so the collection is made of short,
aligned documents that hold every possible repeat:

1. Each window of LENGTH bytes has an anchor, its leftmost smallest hash of GRAM bytes; equal windows have their anchors at
   the same place. Windows in a row with one anchor form one context, of at most 2 * LENGTH - GRAM bytes, placed so that the
   anchor is in column 0. Only contexts whose anchor hash occurs at least twice can hold a repeat.
2. The contexts of one anchor are a collection of aligned documents. Column by column, one symbol of each is inserted: the
   order (of the columns read so far, backwards: the collection's Burrows-Wheeler order) is updated by a stable sort on
   the new symbol, and the common lengths of neighbours by range minima. Where a neighbour shares LENGTH
   symbols, a window repeats - decided on the bytes themselves, never on hashes.
3. Contexts are short of 2 * LENGTH, so all repeated windows of one overlap, and cover one range. Ranges are merged by document.

What passes between the steps are tables in the shared folder, written and read in sequence: the documents, dealt into buckets
once (later joins leave the texts where they are), and contexts. The query removes them once its result is written. An anchor with over HOT occurrences isn't gathered in one
task: its windows are counted by 128-bit hash, combined before the shuffle.

Defined cases: null texts are empty; a text of under LENGTH bytes keeps all; rows that repeat are copies of each other, so all
of their text of LENGTH bytes or more goes; matches never cross documents; an empty table gives no rows; other columns
are left behind.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 400, 64
#: Occurrences of an anchor beyond which its windows are counted by hash; contexts in one construction, about.
HOT, BATCH = 100_000, 20_000
#: Low bits of a key that hold a place, so the bytes that are searched for anchors at once; longer texts come in slices.
PLACE_BITS = 24
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
VALUES = np.random.default_rng(400).integers(1, 2**63, (2, 256), dtype=np.uint64)


def gram_hashes(data: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The hash of each string of `size` bytes (polynomials modulo 2^64 over random byte values, mixed)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        base = BASES[which]
        back = np.uint64(pow(int(base), -1, 2**64))
        power = np.full(len(data), base, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(VALUES[which][data] * power)])
        inverse = np.full(n, back, dtype=np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        h = (sums[size:] - sums[:-size]) * inverse
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, anchor hash) of every run of windows with one anchor; places within their text."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.cumsum(size) - size
    h = gram_hashes(data, gram)
    starts = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begin, size, strict=True) if s >= length] or [np.zeros(0, np.int64)])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    width, place = length - gram + 1, np.uint64((1 << PLACE_BITS) - 1)
    key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(key) // width)
    cells = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    cells[: len(key)] = key
    ahead = np.minimum.accumulate(cells.reshape(rows, width), axis=1).ravel()
    behind = np.minimum.accumulate(cells.reshape(rows, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[starts], ahead[starts + width - 1]) & place).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(starts) != 1)]))
    last = np.append(first[1:], len(starts)) - 1
    text = np.searchsorted(begin, anchor[first], side="right") - 1
    # empty texts share their begin with the next one; the last of them holds the anchor
    return text, anchor[first] - begin[text], starts[first] - begin[text], starts[last] - begin[text], h[anchor[first]].view(np.int64)


def sliced_anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """anchors() of texts of any length: each window lies in one slice, and its anchor depends on nothing but the window. A run that
    a slice's end cuts is given in two parts, which have no window in common."""
    most = 1 << PLACE_BITS
    if sum(map(len, texts)) <= most:
        return anchors(texts, length, gram)
    found = []
    for k, t in enumerate(texts):
        for a in range(0, len(t) - length + 1, most - length + 1):
            _, at, lo, hi, h = anchors([t[a : a + most]], length, gram)
            found.append((np.full(len(at), k), at + a, lo + a, hi + a, h))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else anchors([], length, gram)


def repeated_ranges(group: np.ndarray, before: np.ndarray, bodies: list[bytes], copies: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For aligned contexts, sorted by group: the first and last start (from the context's own begin) of a window that some other
    context of the group, or a copy of it, holds at the same columns; -1 where there is none.

    before: the bytes of a context before its anchor. Column by column one symbol of each context is inserted."""
    n, lead = len(group), length - gram
    size = np.fromiter(map(len, bodies), dtype=np.int64, count=n)
    begin, end = lead - before, lead - before + size
    matrix = np.zeros((n, lead + length), dtype=np.uint8)
    for row, b, body in zip(matrix, begin.tolist(), bodies, strict=True):
        row[b : b + len(body)] = np.frombuffer(body, dtype=np.uint8)
    columns = np.ascontiguousarray(matrix.T)
    del matrix
    order = np.arange(n)
    major = (np.cumsum(np.concatenate([[True], np.diff(group) != 0])) - 1) * 512
    common_ = np.zeros(n, dtype=np.int32)  # symbols that the context at a place shares with the one before it, up to here
    first, last = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    for c in range(lead + length):
        missing = (c < begin[order]) | (c >= end[order])
        key = major + np.where(missing, 256, columns[c][order])
        if (key[1:] < key[:-1]).any():
            perm = np.argsort(key, kind="stable")
            old = perm[:-1]
            step = perm[1:] - old
            least = common_[perm].copy()
            far = np.flatnonzero((step != 1) & (key[perm[1:]] == key[old]))
            if len(far):  # neighbours now, but not before: the least of all between them
                cuts = np.column_stack([old[far] + 1, np.minimum(perm[1:][far] + 1, n - 1)]).ravel()
                ends_ = perm[1:][far] == n - 1
                low = np.minimum.reduceat(common_, cuts)[::2]
                low[ends_] = [common_[a + 1 :].min() for a in old[far][ends_]]
                least[far + 1] = low
            order, key, missing, common_ = order[perm], key[perm], missing[perm], least
        same = np.zeros(n, dtype=bool)
        same[1:] = (key[1:] == key[:-1]) & ~missing[1:]
        common_ = np.where(same, common_ + 1, 0).astype(np.int32)
        if c >= length - 1:
            long_ = common_ >= length
            hit = long_.copy()
            hit[:-1] |= long_[1:]
            x = order[hit]
            if len(x):
                start = c - length + 1 - begin[x]
                first[x] = np.where(first[x] < 0, start, first[x])
                last[x] = start
    many = copies > 1
    first[many], last[many] = 0, size[many] - length
    return first, last


def bucketed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): the documents, written once in buckets of (k1, k2), so that joins on those leave them in place."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"whole_texts_{uuid.uuid4().hex}"
    rows = common.whole_texts(docs).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull())})
    path = f"{common.shared_dir(spark)}/{name}"
    rows.repartition(n, "k1", "k2").write.option("compression", "zstd").option("path", path).bucketBy(n, "k1", "k2").saveAsTable(name)
    out = spark.table(name)
    out.path_, out.table_ = path, name
    return out


def drop_bucketed(rows: DataFrame) -> None:
    rows.sparkSession.sql(f"DROP TABLE IF EXISTS {rows.table_}")
    common.drop_written(rows)


def removed_ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(k1, k2, start, stop): ranges of bytes to remove, of documents (k1, k2, text); ranges may overlap."""
    lead = length - gram

    def find(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in common.batches(it, bytes_=1 << 20):
            text, at, lo, hi, h = sliced_anchors([t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()], length, gram)
            t = pa.array(text)
            yield pa.RecordBatch.from_arrays([b.column("k1").take(t), b.column("k2").take(t), pa.array(h), pa.array(at), pa.array(lo), pa.array(hi)], names=["k1", "k2", "anchor", "at", "lo", "hi"])

    every = common.written(rows.select("k1", "k2", "text").mapInArrow(find, "k1 long, k2 long, anchor long, at long, lo long, hi long"), "anchors")
    # written, so that the join has a plain exchange on either side, and a frequent anchor's partition can be split
    often = common.written(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "often")
    kept = every.join(often, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "lo", "hi", "anchor", (F.col("n") > hot).alias("hot"))).alias("found"))

    def contexts(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in it:
            out: list[tuple] = []
            seen: dict[bytes, int] = {}
            k1, k2 = b.column("k1").to_pylist(), b.column("k2").to_pylist()
            for i, (t, found) in enumerate(zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True)):
                data = t.encode("utf-8", "surrogatepass")
                for f in found:
                    body = data[f["lo"] : f["hi"] + length]
                    before = f["at"] - f["lo"]
                    digest = hashlib.blake2b(body, digest_size=16, key=before.to_bytes(4, "little")).digest()
                    if digest in seen:  # its bytes are given once a batch
                        out[seen[digest]][7] += 1
                        body = None
                    else:
                        seen[digest] = len(out)
                    out.append([k1[i], k2[i], f["lo"], f["anchor"], f["hot"], before, digest, int(body is not None), body])
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["k1", "k2", "lo", "anchor", "hot", "before", "digest", "copies", "body"])

    held = common.written(rows.join(kept, ["k1", "k2"]).select("k1", "k2", "text", "found").mapInArrow(contexts, "k1 long, k2 long, lo long, anchor long, hot boolean, before int, digest binary, copies long, body binary"), "contexts")
    common.drop_written(every, often)
    bodies = held.where("body is not null").select("anchor", "hot", "before", "digest", "copies", "body")

    def construct(it: Iterator) -> Iterator:
        import pyarrow as pa

        def solved(group: list) -> pa.RecordBatch:
            one: dict[bytes, list] = {}
            for anchor, before, digest, copies, body in group:
                if digest in one:
                    one[digest][3] += copies
                else:
                    one[digest] = [anchor, before, digest, copies, body]
            g = list(one.values())
            first, last = repeated_ranges(*(np.array([x[k] for x in g], dtype=np.int64) for k in (0, 1)), [x[4] for x in g], np.array([x[3] for x in g], dtype=np.int64), length, gram)
            good = np.flatnonzero(first >= 0)
            return pa.RecordBatch.from_arrays([pa.array([g[i][2] for i in good], pa.binary()), pa.array(first[good]), pa.array(last[good])], names=["digest", "first", "last"])

        waiting: list = []
        for b in it:
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "before", "digest", "copies", "body")), strict=True):
                if len(waiting) >= BATCH and row[0] != waiting[-1][0]:
                    yield solved(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield solved(waiting)

    found_schema = "digest binary, first long, last long"
    usual = bodies.where("not hot").select("anchor", "before", "digest", "copies", "body").repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(construct, found_schema)

    def windows(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in it:
            for digest, before, copies, body in zip(*(b.column(c).to_pylist() for c in ("digest", "before", "copies", "body")), strict=True):
                data = np.frombuffer(body, dtype=np.uint8)
                h1, h2 = (gram_hashes(data, length, k).view(np.int64) for k in (0, 1))
                n = len(h1)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([digest] * n, pa.binary()), pa.array(np.arange(n)), pa.array([copies] * n, pa.int64())], names=["h1", "h2", "digest", "start", "copies"])

    each = bodies.where("hot").groupBy("digest", "before", "body").agg(F.sum("copies").alias("copies")).mapInArrow(windows, "h1 long, h2 long, digest binary, start long, copies long")
    repeated = each.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).where("n > 1").select("h1", "h2")
    counted = each.join(repeated, ["h1", "h2"]).groupBy("digest").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    found = usual.unionByName(counted)
    ranges = held.select("k1", "k2", "lo", "digest").join(found, "digest").select("k1", "k2", (F.col("lo") + F.col("first")).alias("start"), (F.col("lo") + F.col("last") + length).alias("stop"))
    return common.settled(ranges, "ranges", held)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the bytes left of each text."""
    rows = bucketed(docs)
    return without(rows, removed_ranges(rows, length, gram, hot))


def without(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """dedup()'s result, from the documents (doc_id, text, k1, k2) and the ranges to remove."""
    spans = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def cut(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in common.batches(it):
            out = []
            for t, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                kept, at, spans_ = [], 0, 0
                stop_before = -1
                for s, e in sorted((f["start"], f["stop"]) for f in found or ()):
                    if s > stop_before:
                        spans_ += 1
                        kept.append(data[at:s])
                    at = stop_before = max(stop_before, e)
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), spans_, kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_columnwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bucketed(common.table(spark, sf_dir, "documents"))
    ranges = removed_ranges(rows)
    out = without(rows, ranges).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    found = common.settled(out, "deduplicated", ranges)
    drop_bucketed(rows)
    return found
