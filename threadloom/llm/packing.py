"""Operator 3: best-fit packing of token pieces by exact-complement hashing.

Lengths are at most `capacity`, so however many pieces there are, their histogram has at most `capacity` rows: the
packing is planned on the driver over that histogram alone, as patterns ("these lengths, so many times"), and every
piece finds its place by its length and its rank among the pieces of that length. Ranks come from counts by
(length, bucket) and a running sum; a length has as many buckets as its pieces need, so that a very frequent one never meets in one task.

Defined cases: null text is an empty text (one piece, its end mark only); an empty table gives no rows; rows that
repeat a doc_id are packed as documents of their own; a doc_id may have any type, or be null; further columns are left behind; texts of any
length are cut whole into pieces of `capacity` ids, the shorter remainder first.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of one length in one bucket, on average at most, when ranks are dealt.
BUCKET_ROWS = 1_000

PIECES = "piece int, start long, length long, ids_crc32 long"


class ByteTokenizer:
    """Ids of whole texts: those that `tokenizers` gives with the JSON file, special tokens in a text included.

    Texts without a special token's opening go through the same vocabulary as ranks, which tiktoken encodes to the
    same ids (tested) in a third of the time; the others through `tokenizers` itself."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.specials):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `total` ids: the remainder first, then whole ones."""
    first = total % capacity or min(total, capacity)
    starts = [0, *range(first, total, capacity)]
    return [(s, first if not s else capacity) for s in starts]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): tokenize whole texts, end each with `end_id`, and cut those of over `capacity` ids."""

    def work(it: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = ByteTokenizer(tokenizer_path)
        for b in common.batches(it):
            at, rows = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.array([*tok.ids(text), end_id], dtype="<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), *cols], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.whole_texts(docs).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}")


class SumIndex:
    """Which single lengths, pairs and triples of them make a sum, under the counts that are left.

    Pairs are indexed by their sum, those with the longest part first. Counts only fall, so a pair that can't be had is never looked at
    again. A triple is a single length and a pair with the rest of the sum."""

    def __init__(self, left: np.ndarray):
        self.left = left
        lengths = np.flatnonzero(left)[::-1]
        halves = [(np.full(k := int((lengths[i:] + a < len(left)).sum()), a), lengths[i:][-k:] if k else lengths[:0]) for i, a in enumerate(lengths)]
        first, second = (np.concatenate(c) if halves else np.zeros(0, np.int64) for c in (zip(*halves, strict=True) if halves else ((), ())))
        order = np.argsort(first + second, kind="stable")
        self.first, self.second = first[order], second[order]
        self.next = np.searchsorted(first[order] + second[order], np.arange(len(left) + 1))
        self.end = self.next[1:].copy()

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.left[total] > 0 else None

    def pair(self, total: int, beside: int = 0) -> tuple[int, int] | None:
        """Two available lengths; `beside`: one that is spoken for."""
        k, lasting = int(self.next[total]), True
        while k < self.end[total]:
            a, b = int(self.first[k]), int(self.second[k])
            if self.left[a] > (a == b) and self.left[b] > 0:
                if self.left[a] > (a == b) + (a == beside) and self.left[b] > (a == b) + (b == beside):
                    return a, b
                lasting = False
            k += 1
            if lasting:
                self.next[total] = k
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        single = np.flatnonzero(self.left[: max(total - 1, 0)] > 0)[::-1]
        for c in single[self.next[total - single] < self.end[total - single]].tolist():
            if two := self.pair(total - c, c):
                return (c, *two)
        return None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        return (self.single(gap) or self.pair(gap) or self.triple(gap)) if gap else None


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence, how many such sequences) that use every piece of the histogram once.

    From the longest length down: its gap is looked up in an index of single lengths, of sums of two and of sums of three
    that are available, and a combination that fills it exactly is taken as often as counts allow. What has no exact
    complement is left over, and placed best-fit, longest first, into the fullest sequence that has room."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    index = SumIndex(left)
    out: list[tuple[tuple[int, ...], int]] = []
    residual: list[tuple[int, int]] = []

    def take(parts: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        times = min(int(left[p]) // k for p, k in need.items())
        for p, k in need.items():
            left[p] -= times * k
        out.append((parts, times))

    for n in range(capacity, 0, -1):
        while left[n] > 0:
            left[n] -= 1  # one is spoken for
            found = index.filling(capacity - n)
            left[n] += 1
            if found or n == capacity:
                take((n, *(found or ())))
            else:
                residual.append((n, int(left[n])))
                left[n] = 0
    # best-fit of what is left: sequences that look alike are kept as one entry with a count
    room: dict[int, list[list]] = defaultdict(list)
    for n, times in residual:
        while times:
            gap = next((g for g in range(n, capacity) if room[g]), 0)
            if not gap:
                per = capacity // n
                whole, rest = divmod(times, per)
                if whole:
                    room[capacity - per * n].append([(n,) * per, whole])
                if rest:
                    room[capacity - rest * n].append([(n,) * rest, 1])
                break
            parts, k = room[gap].pop()
            used = min(k, times)
            if k > used:
                room[gap].append([parts, k - used])
            room[gap - n].append([(*parts, n), used])
            times -= used
    out += [(tuple(parts), k) for entries in room.values() for parts, k in entries]
    return [(p, k) for p, k in out if k]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) with, for each, the first sequence id and the offset within it."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for parts, times in patterns:
        offset = 0
        for n in parts:
            rows.append((n << 44 | rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), ())))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of `pieces` (doc_id, piece, start, length, ids_crc32) a sequence_id and an offset in it."""
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n"))
    lengths = {r["length"]: r["n"] for r in histogram.collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(places(plan_patterns(lengths, capacity)))
    buckets = histogram.select("length", F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets_"))  # a row a length
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = pieces.join(F.broadcast(buckets), "length").select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets_")).alias("bucket"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own_", F.row_number().over(own) - 1).join(offsets, ["length", "bucket"])
    ranked = ranked.select(*columns, (F.col("before_") + F.col("own_")).alias("rank_"))

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa

        keys, sequences, at = plan.value
        for b in it:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank_"))
            key = length << 44 | rank
            k = np.searchsorted(keys, key, side="right") - 1
            found = [pa.array(sequences[k] + key - keys[k]), pa.array(at[k])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *found], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(work, f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, {PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """Tokenize, cut and pack whole documents. The pieces (without their ids) are written once in the shared folder."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    pieces = common.written(token_pieces(docs, tokenizer_path, capacity), "pieces")
    return common.settled(pack(pieces, capacity), "packed", pieces)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
