"""Operator 13: alignment of two tokenizers by divide and conquer at shared cuts.

Tokens A are those of a byte-level tokenizer for a space and the text, tokens B those of a piece tokenizer for the text (which adds the space).
Both cover the same bytes. A stretch of tokens is divided at a place where a token of A and one of B end together: the ends of A nearest to the
stretch's middle are looked up among those of B by bisection, further and further from the middle, until one is found; both halves are then
divided in the same way. A stretch without such a place inside is a leaf: a group. All stretches of a batch of documents are divided at once, a
round at a time. Within a group, A and B tokens that share bytes are linked.

How often an id pair is linked in the whole corpus comes from the pairs of each document, counted in tasks before they are shuffled. The counts then
return to the documents' pairs as broadcast blocks of at most COUNTS pairs, as many blocks as there are: no link is shuffled, however frequent its
pair. What is written and counted for a document are its distinct pairs, each with its number of links.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from a space and the text, have no tokens: zeros, and an empty
hash; rows that repeat a doc_id are documents of their own; a doc_id may have any type, or be null; an empty table gives no rows; other columns are
left behind. Special tokens' strings in a text are plain text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of a broadcast block of counts; bytes of text that are aligned at once.
COUNTS, AT_ONCE = 500_000, 1 << 20


class Vocabulary:
    """The bytes of each id, one after the other, to put together whole texts' bytes."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=self.size)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.all = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        return self.all[np.repeat(self.begin[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]


class ByteTokens(Vocabulary):
    """A: the ids of a space and a text, by the ranks beside a byte-level JSON file (the same ids, tested); all of it is plain text."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            tokens[i] = b
        super().__init__(tokens)
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class PieceTokens(Vocabulary):
    """B: the ids of a text, in front of which the model puts a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def shared_cuts(a: np.ndarray, b: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """Numbers of the A tokens that end groups. a, b: ends of the tokens of a batch, growing; tops: the last A token of each document.

    Each round takes stretches (first, last) of A tokens whose last one ends with one of B, and looks for such a token from `first` to before
    `last`, nearest to the middle first, in rings that double in width."""
    cuts = [tops]
    first, last = np.concatenate([[0], tops[:-1] + 1]), tops
    while len(first := first[keep := first < last]):
        last = last[keep]
        middle, cut = (first + last - 1) // 2, np.full(len(first), -1)
        todo, reach, wide = np.arange(len(first)), 0, 1
        while len(todo):
            lo, hi, m = first[todo], last[todo], middle[todo]
            sides = []
            for start, stop in ((m + reach, np.minimum(m + reach + wide, hi)), (np.maximum(m - reach - wide + 1, lo), m - reach + 1)):
                n = np.maximum(stop - start, 0)
                if reach == 0 and len(sides):
                    n[:] = 0  # the middle itself was looked at
                flat = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                held = b[np.minimum(np.searchsorted(b, a[flat]), len(b) - 1)] == a[flat]
                sides.append((np.repeat(todo, n)[held], flat[held]))
            who, at = (np.concatenate(c) for c in zip(*sides, strict=True))
            order = np.lexsort((np.abs(at - middle[who]), who))
            who, at = who[order], at[order]
            nearest = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
            cut[who[nearest]] = at[nearest]
            reach, wide = reach + wide, 2 * wide if reach else 1
            todo = todo[(cut[todo] < 0) & ((m + reach < hi) | (m - reach >= lo))]
        found = cut >= 0
        cut = cut[found]
        cuts.append(cut)
        first, last = np.concatenate([first[found], cut + 1]), np.concatenate([cut, last[found]])
    return np.sort(np.concatenate(cuts))


def links_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens of each link, in order: between two neighbouring ends of either lies what one token of each shares."""
    a_ends, b_ends = np.zeros(int(a[-1]) + 1, dtype=bool), np.zeros(int(b[-1]) + 1, dtype=bool)
    a_ends[a], b_ends[b] = True, True
    ends = np.flatnonzero(a_ends | b_ends)
    before = lambda e: np.cumsum(e)[ends] - e[ends]
    return before(a_ends), before(b_ends)


def counted(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a sorted array, and how often each stands there."""
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    return sorted_[first], np.diff(np.r_[first, len(sorted_)])


class Aligner:
    """Groups and links of whole texts under two tokenizers."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        # decimal ids followed by each mark, as they stand in the groups' text
        self.names = [f"{i}{m}".encode() for m in ",|;" for i in range(max(a.size, b.size))]

    def tokens(self, texts: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(number, A ids, B ids) of the texts whose bytes either covers."""
        some = [k for k, t in enumerate(texts) if t]
        found = []
        for k, *both in zip(some, *(t.encode([texts[k] for k in some]) for t in (self.a, self.b)), strict=True):
            want = np.frombuffer(b" " + texts[k].encode("utf-8", "surrogatepass"), dtype=np.uint8)
            a, b = (np.array(x, dtype=np.int64) for x in both)
            if all(int(t.lengths[ids].sum()) == len(want) and np.array_equal(t.joined(ids), want) for t, ids in ((self.a, a), (self.b, b))):
                found.append((k, a, b))
        return found

    def aligned(self, texts: list[str]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links, groups' hash, distinct pairs, links of each) of each text."""
        out: list = [(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        held = self.tokens(texts)
        if not held:
            return out
        of, a_of, b_of = zip(*held, strict=True)
        a_ids, b_ids = np.concatenate(a_of), np.concatenate(b_of)
        # both tokenizers' bytes of a document are equally many, so ends of one document meet in a batch as they do alone
        a_end, b_end = np.cumsum(self.a.lengths[a_ids]), np.cumsum(self.b.lengths[b_ids])
        a_top, b_top = np.cumsum([len(x) for x in a_of]), np.cumsum([len(x) for x in b_of])
        cuts = shared_cuts(a_end, b_end, a_top - 1)
        a_cut, b_cut = cuts + 1, np.searchsorted(b_end, a_end[cuts]) + 1  # tokens up to each cut
        groups = np.searchsorted(a_cut, a_top, side="right")
        # the groups' text: A tokens of a group, then its B tokens
        size, marks = max(self.a.size, self.b.size), np.zeros(len(a_ids) + len(b_ids), dtype=np.int64)
        a_group, b_group = (np.repeat(np.arange(len(cuts)), np.diff(c, prepend=0)) for c in (a_cut, b_cut))
        marks[np.arange(len(a_ids)) + np.concatenate([[0], b_cut])[a_group]] = a_ids
        marks[np.arange(len(b_ids)) + a_cut[b_group]] = b_ids
        marks[a_cut + np.concatenate([[0], b_cut[:-1]]) - 1] += size
        marks[a_cut + b_cut - 1] += 2 * size
        la, lb = links_of(a_end, b_end)
        pair = a_ids[la] * self.b.size + b_ids[lb]
        link_top = np.searchsorted(la, a_top)
        begin = [0, 0, 0, 0]
        for k, stops in zip(of, zip(a_top, b_top, groups, link_top, strict=True), strict=True):
            n = [int(s - t) for s, t in zip(stops, begin, strict=True)]
            text = b"".join(map(self.names.__getitem__, marks[begin[0] + begin[1] : stops[0] + stops[1]].tolist()))
            pairs, times = counted(np.sort(pair[begin[3] : stops[3]]))
            out[k] = (*n, hashlib.sha256(text[:-1]).hexdigest(), pairs, times)
            begin = stops
        return out


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row: pairs are a * (size of B) + b, in growing order."""

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa

        both = Aligner(ByteTokens(path_a), PieceTokens(path_b))
        for b in common.batches(it, bytes_=AT_ONCE):
            *counts, sha, pairs, times = zip(*both.aligned(b.column("text").to_pylist()), strict=True)
            cols = [*(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return common.whole_texts(docs).mapInArrow(work, kinds)


def linked_pairs(aligned: DataFrame, *keep: str) -> DataFrame:
    """(keep, pair, times) of every distinct pair of every row."""
    return aligned.select(*keep, F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times")))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): each pair's links corpus-wide, and whether no pair of its B id has more."""
    counts = common.written(linked_pairs(aligned).groupBy("pair").agg(F.sum("times").alias("n")), "pair_counts")
    of_b = F.col("pair") % size_b
    most = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))  # a row a B id at most: its vocabulary bounds it
    out = counts.join(F.broadcast(most), of_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return common.settled(out, "pair_counts", counts)


def with_counts(aligned: DataFrame, counts: DataFrame, block: int = COUNTS) -> DataFrame:
    """(row, n_best, count_sum) of the rows of `aligned` that have links: counts come in blocks that are small enough to broadcast."""
    blocks = max(1, -(-counts.count() // block))
    part = F.pmod(F.xxhash64("pair"), F.lit(blocks))
    sums = None
    for k in range(blocks):
        met = linked_pairs(aligned, "row").join(F.broadcast(counts.where(part == k)), "pair")
        here = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        sums = here if sums is None else sums.unionByName(here)
    return sums if blocks == 1 else sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def cross_aligned(docs: DataFrame, path_a: str, path_b: str, block: int = COUNTS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs."""
    size_b = PieceTokens(path_b).size
    aligned = common.written(aligned_documents(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(aligned, size_b)
    own = aligned.drop("pairs", "times").join(with_counts(aligned, counts, block), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return common.settled(own.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), "crossing", aligned, counts)


def op13_shared_cut_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return cross_aligned(common.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B))
