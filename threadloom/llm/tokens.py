"""Operator 11: token ids in Parquet files that can be read in parts.

A token set is a folder with two Parquet tables. `tokens` has a row a document, in ascending order of doc_id: shard, doc_id, start and stop
(places in the stream of the shard's ids) and ids, a list column. A shard is one file, a range of doc_ids. `shards` has a row a shard: its first
place in the stream of all ids, how many ids and documents it holds, and its least and largest doc_id. So places in the whole stream cost no
second pass over the ids, and no file depends on another.

Encodings: the ids are dictionary-encoded (a vocabulary of 49,408 takes 16 bits an id, packed); doc_id, start and stop grow, so they are
delta-encoded. Row groups and pages are small, with page indexes: a reader of a few documents, or of a window of the stream, reads the pages that
hold them, and a reader of metadata never touches the ids.

Ids are those that `tokenizers` gives for the whole text. As the tokenizer drops white space and treats what stands between it alone, what
stands between spaces or line ends is encoded once and remembered: Latin letters, digits and marks straight by the library's model
(its other steps leave them as they are, but for lower case), all else by its whole pipeline.

Defined cases: null text is an empty text (its end mark only); rows without doc_id come first; rows that repeat a doc_id are documents of their
own, in the order of their texts' hashes; rows that repeat both are dealt over shards like others; special tokens' strings in a text become
special ids, as the library does it; an empty table gives empty tables; other columns are left behind.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Bytes of text in a shard, about; bytes of a row group and of a page, and rows of a page at most; words that a worker remembers.
SHARD_BYTES, GROUP_BYTES, PAGE_BYTES, PAGE_ROWS, REMEMBERED = 64 << 20, 8 << 20, 64 << 10, 512, 500_000
WRITER = {
    "parquet.writer.version": "v2",
    "parquet.block.size": GROUP_BYTES,
    "parquet.page.size": PAGE_BYTES,
    "parquet.page.row.count.limit": PAGE_ROWS,
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start": "false",
    "parquet.enable.dictionary#stop": "false",
    "compression": "zstd",
}


class WordTokenizer:
    """Ids of whole texts: those of the library for each part between spaces and line ends."""

    #: What stands between spaces and holds anything but Latin letters that compose with nothing here, digits and marks. (An apostrophe starts
    #: English endings, < and | special tokens.)
    ODD = re.compile(r"(?<![^ \n])([A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-;=-@\[-`{}~]*+[^A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-;=-@\[-`{}~ \n][^ \n]*)").split
    RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9 \n]+").findall

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.code = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        # printable bytes stand for themselves in byte-level vocabularies, the others for characters from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        self.as_char = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.words, self.odd = common.Remembered(self._word, REMEMBERED), common.Remembered(self._whole, REMEMBERED // 10)

    def _word(self, run: str) -> bytes:
        """A run of lower-case letters, or of marks, as the model's input, byte by byte."""
        chars = run if run.isascii() else "".join(map(self.as_char.__getitem__, run.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(chars)]).tobytes()

    def _whole(self, part: str) -> bytes:
        return array(self.code, self.whole.encode(part, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> np.ndarray:
        out = []
        for k, part in enumerate(self.ODD(text)):
            if k % 2:
                out.append(self.odd[part])
            else:
                out.extend(map(self.words.__getitem__, self.RUNS(part.lower())))
        return np.frombuffer(b"".join(out), dtype=self.code)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode the whole texts of docs, each with `end_id` behind, as a token set in the folder `path`."""
    spark = docs.sparkSession
    texts = common.whole_texts(docs)
    size = texts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes), min(spark.sparkContext.defaultParallelism, -(-size // (1 << 20))))
    # what repeats a doc_id is told apart by its text, and what repeats both by its place in the input, so that no range must hold it all
    key = [F.col("doc_id").asc_nulls_first(), F.col("hash_"), F.col("nth_")]
    dealt = texts.withColumns({"hash_": F.xxhash64("text"), "nth_": F.monotonically_increasing_id()}).repartitionByRange(int(shards), *key).sortWithinPartitions(*key)

    def work(it: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok, at, shard = WordTokenizer(tokenizer_path), 0, TaskContext.get().partitionId()
        for b in common.batches(it):
            found = [tok.ids(t) for t in b.column("text").to_pylist()]
            ends = np.cumsum([len(x) + 1 for x in found])
            ids = np.full(ends[-1], end_id, dtype=np.int32)
            for x, e in zip(found, ends, strict=True):
                ids[e - 1 - len(x) : e - 1] = x
            begins = np.concatenate([[0], ends[:-1]])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1]).astype(np.int32)), pa.array(ids))
            cols = [pa.array(np.full(len(ends), shard, dtype=np.int32)), b.column("doc_id"), pa.array(at + begins), pa.array(at + ends), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "doc_id", "start", "stop", "ids"])
            at += int(ends[-1])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    encoded = dealt.select("doc_id", "text").mapInArrow(work, f"shard int, doc_id {id_type}, start long, stop long, ids array<int>")
    encoded.write.options(**{k: str(v) for k, v in WRITER.items()}).parquet(f"{path}/tokens")
    made = spark.read.parquet(f"{path}/tokens").groupBy("shard").agg(F.max("stop").alias("n_ids"), F.count("*").alias("n_docs"), F.min("doc_id").alias("least"), F.max("doc_id").alias("largest"))
    rows = sorted(made.collect(), key=lambda r: r["shard"])  # a row a shard
    firsts = np.cumsum([0, *(r["n_ids"] for r in rows)])
    kinds = f"shard int, first long, n_ids long, n_docs long, least {id_type}, largest {id_type}"
    spark.createDataFrame([(r["shard"], int(f), r["n_ids"], r["n_docs"], r["least"], r["largest"]) for r, f in zip(rows, firsts, strict=False)], kinds).coalesce(1).write.parquet(f"{path}/shards")


class TokenSet:
    """A written token set, to read in parts."""

    def __init__(self, spark: SparkSession, path: str):
        self.tokens, self.shards = (spark.read.parquet(f"{path}/{t}") for t in ("tokens", "shards"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """start and stop of the shards' streams become those of the whole one; there is a row a shard to broadcast."""
        out = rows.join(F.broadcast(self.shards.select("shard", "first")), "shard")
        return out.withColumns({"start": F.col("first") + F.col("start"), "stop": F.col("first") + F.col("stop")}).drop("shard", "first")

    def metadata(self) -> DataFrame:
        """(doc_id, start, n_tokens), without a look at the ids."""
        return self._placed(self.tokens.select("shard", "doc_id", "start", "stop")).select("doc_id", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))

    def documents(self, least=None, largest=None) -> DataFrame:
        """(doc_id, start, stop, ids) of the documents of a range of doc_ids; pages of others are skipped by their index."""
        rows = self.tokens
        for bound, inside in ((least, F.col("doc_id") >= least), (largest, F.col("doc_id") <= largest)):
            rows = rows if bound is None else rows.where(inside)
        return self._placed(rows)

    def window(self, start: int, stop: int) -> DataFrame:
        """(doc_id, start, stop, ids): what documents hold of the places [start, stop) of the whole stream."""
        met = self.shards.where((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start)).orderBy("first").collect()  # a row a shard of the window
        if not met:
            return self._placed(self.tokens.limit(0))
        parts = F.lit(False)
        for ends in dict.fromkeys((met[0], met[-1])):
            parts |= (F.col("shard") == ends["shard"]) & (F.col("start") < stop - ends["first"]) & (F.col("stop") > start - ends["first"])
        if len(met) > 2:
            parts |= F.col("shard").between(met[1]["shard"], met[-2]["shard"])
        rows = self._placed(self.tokens.where(F.col("shard").between(met[0]["shard"], met[-1]["shard"])).where(parts))
        a, b = F.greatest("start", F.lit(start)), F.least("stop", F.lit(stop))
        return rows.select("doc_id", a.alias("start"), b.alias("stop"), F.slice("ids", (a - F.col("start") + 1).cast("int"), (b - a).cast("int")).alias("ids"))

    def digests(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, of the ids as they are read."""

        def work(it: Iterator) -> Iterator:
            import pyarrow as pa

            for b in it:
                lists = b.column("ids")
                ids, ends = np.asarray(lists.flatten()).astype("<u4"), np.cumsum(np.asarray(lists.value_lengths()))
                crc = [zlib.crc32(x.tobytes()) for x in np.split(ids, ends[:-1])] if len(ends) else []
                counts = pa.array(np.diff(ends, prepend=0), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("doc_id"), b.column("start"), counts, pa.array(crc, pa.int64())], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

        id_type = self.tokens.schema["doc_id"].dataType.simpleString()
        found = self.tokens.select("shard", "doc_id", "start", "ids").mapInArrow(work, f"shard int, doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
        placed = found.join(F.broadcast(self.shards.select("shard", "first")), "shard")
        return placed.select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op11_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.new_path(spark, "tokens")
    write_tokens(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    out = common.written(TokenSet(spark, path).digests(), "token_digests")
    common.drop_path(spark, path)
    return out
