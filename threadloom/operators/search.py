"""A trigram index: posting lists by trigram, built and replaced a file at a time, that answer literal phrases without a look at the texts.

`postings` has a row a trigram and file: how often, and where (places in characters). A trigram of A-Z-folded characters is one number of 63 bits.
Rows lie in folders by a hash of the trigram, in blocks of texts, each sorted by trigram and file, so that a phrase reads the pages of its few trigrams. A phrase of n
characters is covered by every third trigram and the last; where their places, each less its offset, meet, the phrase stands: what the index
finds needs no check. `entries` has a row a file: its size, its number of trigrams (the length that BM25 takes) and what else the caller keeps.

Changes are a further generation of both tables: a file's entry in the latest generation that names it counts, a removed file's says so, and postings
of older generations go with their entries. compacted() writes what counts as one generation.

Postings are many times the texts, so they are written where they are made, and never shuffled. Files without key are left out; files of a key that
repeats in a generation are one entry, the one with the largest text; null texts are empty; texts of under three characters have an entry and no posting; a phrase of under three characters is refused (short_query() is for those).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.plans.stages import new_path
from threadloom.sources import tables as T

#: Characters of text in a folder of postings, about; folders at most (a task has a file open in each); characters of a task's texts, and
#: of a block of them that is sorted as one; rows that a task sends at once.
FOLDER_CHARS, FOLDERS, TASK_CHARS, BLOCK_CHARS, SENT_ROWS = 4 << 20, 32, 32 << 20, 4 << 20, 1 << 16
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Files by content and labels that a search looks at, best first; kinds whose labels are found in the contents anyway. (Fixed values.)
MOST_FILES, MOST_LABELS = 2_000, 1_000
UNLISTED_KINDS = ("file", "callTarget", "module")
WRITER = {"parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "4096", "parquet.block.size": str(8 << 20), "parquet.writer.version": "v2", "compression": "zstd"}


def trigrams(text: str) -> np.ndarray:
    """The number of each trigram of a text, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    c = np.where((c >= 65) & (c <= 90), c + 32, c)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def postings_of(files: DataFrame) -> DataFrame:
    """(gram, key, n, places) of files (key, text): a block of texts after the other, each sorted by trigram and file."""

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def block(parts: list) -> Iterator:
            keys, texts = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("key", "text"))
            lengths = pc.utf8_length(texts).to_numpy().astype(np.int64)
            every = trigrams("".join(texts.to_pylist()))
            file = np.repeat(np.arange(len(keys), dtype=np.int32), lengths)[: len(every)]
            place = np.arange(len(every)) - (np.cumsum(lengths) - lengths)[file]
            within = np.flatnonzero(place < lengths[file] - 2)  # no trigram is of two texts
            within = within[np.argsort(every[within], kind="stable")]  # files and places stay in order within a trigram
            every, file, place = every[within], file[within], place[within].astype(np.int32)
            first = np.flatnonzero(np.r_[True, (every[1:] != every[:-1]) | (file[1:] != file[:-1])]) if len(every) else within
            ends = np.r_[first, len(every)]
            for at in range(0, len(first), SENT_ROWS):
                some = ends[at : at + SENT_ROWS + 1]
                lists = pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), pa.array(place[some[0] : some[-1]]))
                rows = some[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(every[rows]), keys.take(pa.array(file[rows])), pa.array(np.diff(some).astype(np.int32)), lists], names=["gram", "key", "n", "places"])

        parts, size = [], 0
        for batch in it:
            ends = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy().astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = min(int(np.searchsorted(ends, before + BLOCK_CHARS - size)) + 1, batch.num_rows)
                parts.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - before)
                start = stop
                if size >= BLOCK_CHARS:
                    yield from block(parts)
                    parts, size = [], 0
        if parts:
            yield from block(parts)

    kind = files.schema["key"].dataType.simpleString()
    return files.select("key", "text").mapInArrow(work, f"gram long, key {kind}, n int, places array<int>")


def write_postings(rows: DataFrame, path: str, folders: int) -> None:
    """Postings (with their folder) where they are: a task keeps a file open in each folder, so nothing is shuffled, or sorted again."""
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(folders + 1))  # a task that reaches this number sorts what is left
    try:
        rows.write.options(**WRITER).partitionBy("folder").parquet(path)
    finally:
        conf.set(name, before)


class TrigramIndex:
    """An index in a folder: `build` makes it, `replace` and `remove` change it, `phrase` and `ranked` ask it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, files: DataFrame, generation: int, folders: int | None = None, chars: int | None = None) -> None:
        files = files.where("key is not null").withColumn("text", F.coalesce("text", F.lit("")))
        kept = [c for c in files.columns if c not in ("key", "text")]
        if chars is None:
            chars = files.agg(F.sum(F.char_length("text"))).first()[0] or 0
        folders = folders or int(min(FOLDERS, max(8, chars // FOLDER_CHARS)))
        size = F.char_length("text")
        entries = files.select("key", size.alias("size"), F.greatest(size - 2, F.lit(0)).alias("grams"), F.lit(False).alias("removed"), F.lit(folders).alias("folders"), *kept)
        if files.groupBy("key").count().where("count > 1").limit(1).count():
            largest = files.groupBy("key").agg(F.max_by(F.struct("text", *kept), F.struct(F.char_length("text"), "text")).alias("f")).select("key", "f.*")
            return self._write(largest, generation, folders, chars)
        # texts are dealt out evenly, however the input is cut; that is little beside their postings
        tasks = max(self.spark.sparkContext.defaultParallelism, int(chars // TASK_CHARS))
        rows = postings_of(files.select("key", "text").repartition(tasks)).withColumn("folder", F.pmod(F.xxhash64("gram"), F.lit(folders)).cast("int"))
        write_postings(rows, f"{self.path}/postings/generation={generation}", folders)
        entries.write.parquet(f"{self.path}/entries/generation={generation}")
        return None

    @classmethod
    def build(cls, files: DataFrame, path: str) -> TrigramIndex:
        """Index files (key, text and whatever else their entries are to hold) in an empty folder."""
        index = cls(files.sparkSession, path)
        index._write(files, 0)
        return index

    def _table(self, name: str) -> DataFrame:
        read = self.spark.read.option("basePath", f"{self.path}/{name}")
        if name == "postings":  # an index of no text has no file
            read = read.schema(f"gram long, key {dict(self._table('entries').dtypes)['key']}, n int, places array<int>, generation int, folder int")
        return read.parquet(f"{self.path}/{name}")

    def generations(self) -> list[int]:
        return sorted(r[0] for r in self._table("entries").select("generation").distinct().collect())  # one a change

    def replace(self, files: DataFrame) -> None:
        """Put files, new or changed, in the place of what the index holds under their keys."""
        at = self.generations()[-1] + 1
        self._write(files, at, self._folders())

    def remove(self, keys: DataFrame) -> None:
        """Take out the files of some keys."""
        at, last = self.generations()[-1] + 1, self._table("entries")
        none = {c: F.lit(None).cast(kind) for c, kind in last.dtypes if c not in ("key", "generation")}
        gone = keys.select("key").where("key is not null").distinct().withColumns(none | {"removed": F.lit(True), "folders": F.lit(self._folders())})
        gone.select([c for c in last.columns if c != "generation"]).write.parquet(f"{self.path}/entries/generation={at}")

    def _folders(self) -> int:
        return self._table("entries").where("generation = 0").agg(F.max("folders")).first()[0] or 8

    def entries(self) -> DataFrame:
        """What the index holds: a row a file, of the latest generation that names it."""
        every = self._table("entries")
        if len(self.generations()) == 1:
            return every.drop("removed", "folders")
        rest = [c for c in every.columns if c not in ("key", "generation")]
        latest = every.groupBy("key").agg(F.max("generation").alias("generation"), F.max_by(F.struct(*rest), "generation").alias("e")).select("key", "generation", "e.*")
        return latest.where("not removed").drop("removed", "folders")

    def phrase(self, text: str) -> DataFrame:
        """(key, tf): the files that hold a text of three characters or more, without regard to the case of A-Z, and how often (overlaps count)."""
        grams = trigrams(text)
        if not len(grams):
            raise ValueError("a phrase has three characters at least")
        offsets = sorted({*range(0, len(grams), 3), len(grams) - 1})
        wanted = sorted({int(grams[k]) for k in offsets})
        folders = self._folders()
        rows = self._table("postings").where(F.col("gram").isin(wanted) & F.col("folder").isin([F.pmod(F.xxhash64(F.lit(g)), F.lit(folders)).cast("int") for g in wanted]))
        asked = F.create_map(*(x for g in wanted for x in (F.lit(g), F.array(*(F.lit(k) for k in offsets if int(grams[k]) == g)))))
        starts = rows.select("key", "generation", "places", F.explode(asked[F.col("gram")]).alias("offset")).select("key", "generation", F.transform("places", lambda p: p - F.col("offset")).alias("at"))
        lists = starts.groupBy("key", "generation").agg(F.collect_list("at").alias("all_")).where(F.size("all_") == len(offsets))
        met = F.aggregate(F.slice("all_", F.lit(2), F.size("all_")), F.get("all_", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        found = lists.select("key", "generation", F.size(met).cast("long").alias("tf")).where("tf > 0")
        if len(self.generations()) > 1:
            found = found.join(self.entries().select("key", "generation"), ["key", "generation"], "left_semi")
        return found.select("key", "tf")

    def ranked(self, text: str) -> DataFrame:
        """The entries that hold a text, with tf and bm25 (more is better)."""
        found, entries = self.phrase(text), self.entries()
        corpus = entries.agg(F.count("*").alias("files_"), F.avg("grams").alias("mean_")).join(found.agg(F.count("*").alias("holding_")))  # one row
        scored = entries.join(found, "key")
        idf = F.greatest(F.log((F.col("files_") - F.col("holding_") + 0.5) / (F.col("holding_") + 0.5)), F.lit(LEAST_IDF))
        norm = F.col("tf") + K1 * (1 - B + B * F.col("grams") / F.col("mean_"))
        return scored.join(F.broadcast(corpus)).withColumn("bm25", idf * F.col("tf") * (K1 + 1) / norm).drop("files_", "mean_", "holding_")

    def compacted(self, path: str) -> TrigramIndex:
        """What counts of this index, as one generation in an empty folder."""
        live = self.entries()
        folders = self._folders()
        live.drop("generation").withColumns({"removed": F.lit(False), "folders": F.lit(folders)}).write.parquet(f"{path}/entries/generation=0")
        rows = self._table("postings").join(live.select("key", "generation"), ["key", "generation"], "left_semi").drop("generation")
        write_postings(rows, f"{path}/postings/generation=0", folders)
        return TrigramIndex(self.spark, path)


BUILT: dict[tuple, TrigramIndex] = {}


def index_of(spark: SparkSession, sf_dir: str, name: str = "contents") -> TrigramIndex:
    """The index of the given texts ("contents"), or of the labels of nodes and files ("labels"): built once in an application, and anew when
    a table's files have changed."""
    tables = ("documents",) if name == "contents" else ("documents", "region", "nation", "customer", "supplier", "part", "orders")
    stamps = []
    for t in tables:
        of = T.table(spark, sf_dir, t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        stamps.append(of.agg(F.sort_array(F.collect_list(F.struct("*"))).cast("string")).first()[0])  # a row a file of a table
    made = (spark.sparkContext.applicationId, name, *stamps)
    if made not in BUILT:
        rows = contents(spark, sf_dir) if name == "contents" else labels(spark, sf_dir)
        BUILT[made] = TrigramIndex.build(rows, new_path(spark, f"index-{name}"))
    return BUILT[made]


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.files(spark, sf_dir).select(F.col("doc_id").alias("key"), "text", "relative_path", "content_hash", "size_bytes")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the declaration-like facts: file nodes and what else is found in the contents stay out, and so do facts without a source."""
    files = T.files(spark, sf_dir).select(F.concat(F.lit("file:"), "relative_path").alias("id"), F.lit("file").alias("kind"), F.col("relative_path").alias("label"), F.col("relative_path").alias("file_path"))
    listed = T.nodes(spark, sf_dir).unionByName(files).where(~F.col("kind").isin(*UNLISTED_KINDS) & F.col("file_path").isNotNull())
    return listed.select(F.col("id").alias("key"), F.col("label").alias("text"), "kind", "label", "file_path")


def best(rows: DataFrame, most: int, *order: str | Column) -> DataFrame:
    """The first `most` rows, and whether there are more."""
    first = rows.orderBy(*order).limit(most + 1)
    cut = first.agg((F.count("*") > most).alias("truncated"))  # one row
    return first.orderBy(*order).limit(most).join(F.broadcast(cut))


BM25 = """corpus AS (SELECT count(*) AS n, avg(grams) AS mean, count(*) FILTER (tf > 0) AS df FROM sized),
  scored AS (SELECT sized.*, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * grams / mean)) AS bm25 FROM sized, corpus WHERE tf > 0)"""
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: How often a text made of one repeated part stands in another, overlaps included: runs of the part, less one each.
OVERLAPS = "CAST(coalesce(list_sum(list_transform(regexp_extract_all({}, '(?:an)+'), lambda x: length(x) // 2 - 1)), 0) AS BIGINT)"


@query("h1_content_candidates", f"WITH {T.FILES} SELECT doc_id, relative_path FROM files WHERE contains({FOLD.format('text')}, 'license')")
def h1(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return index.entries().join(index.phrase("LICENSE"), "key").select(F.col("key").alias("doc_id"), "relative_path")


@query(
    "h1_phrase_ranked",
    f"""WITH {T.FILES}, sized AS (SELECT doc_id, relative_path, content_hash, size_bytes, greatest(length(coalesce(text, '')) - 2, 0) AS grams, {OVERLAPS.format(FOLD.format("coalesce(text, '')"))} AS tf FROM files), {BM25},
  cut AS (SELECT * FROM scored ORDER BY round(bm25, 9) DESC, relative_path LIMIT {MOST_FILES})
  SELECT doc_id, relative_path, content_hash, size_bytes, tf, round(bm25, 6) AS bm25, (SELECT count(*) FROM scored) > {MOST_FILES} AS truncated FROM cut""",
)
def h1_ranked(spark, sf_dir):
    """Files that hold a phrase which overlaps itself, by BM25, then path, with what a reader needs to see whether they have changed."""
    found = best(index_of(spark, sf_dir).ranked("anAN"), MOST_FILES, F.desc(F.round("bm25", 9)), "relative_path")
    return found.select(F.col("key").alias("doc_id"), "relative_path", "content_hash", "size_bytes", "tf", F.round("bm25", 6).alias("bm25"), "truncated")


@query(
    "l8_bm25_rank",
    f"""WITH {T.FILES}, sized AS (SELECT doc_id, relative_path, length(text) AS size, (length(text) - length(replace({FOLD.format("text")}, 'license', ''))) // 7 AS tf FROM files),
  corpus AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (tf > 0) AS df FROM sized),
  scored AS (SELECT doc_id, relative_path, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean)) AS score FROM sized, corpus WHERE tf > 0)
  SELECT doc_id, tf, round(score, 6) AS score FROM scored ORDER BY score DESC, relative_path LIMIT 100""",
)
def l8(spark, sf_dir):
    """Relevance over lengths in characters, with an inverse frequency that is never negative."""
    index = index_of(spark, sf_dir)
    entries, found = index.entries(), index.phrase("license")
    corpus = entries.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).join(found.agg(F.count("*").alias("df")))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean"))
    scored = entries.join(found, "key").join(F.broadcast(corpus)).withColumn("score", F.round(idf * F.col("tf") * (K1 + 1) / norm, 6))
    return scored.orderBy(F.desc("score"), "relative_path").limit(100).select(F.col("key").alias("doc_id"), "tf", "score")


LABELS = f"""WITH {T.NODES}, {T.FILES}, listed AS (SELECT id, kind, label, file_path FROM (SELECT * FROM nodes UNION ALL SELECT 'file:' || relative_path, 'file', relative_path, relative_path FROM files)
  WHERE kind NOT IN ('file', 'callTarget', 'module') AND file_path IS NOT NULL)"""


@query(
    "h4_label_candidates",
    f"""{LABELS}, sized AS (SELECT id, kind, label, file_path, greatest(length(coalesce(label, '')) - 2, 0) AS grams, len(string_split({FOLD.format("coalesce(label, '')")}, 'urgent')) - 1 AS tf FROM listed), {BM25}
  SELECT id, kind, label, file_path, round(bm25, 6) AS bm25, (SELECT count(*) FROM scored) > {MOST_LABELS} AS truncated FROM scored ORDER BY round(bm25, 9) DESC, file_path, id LIMIT {MOST_LABELS}""",
)
def h4(spark, sf_dir):
    """Labels that hold a phrase, by BM25, then file and id."""
    found = best(index_of(spark, sf_dir, "labels").ranked("Urgent"), MOST_LABELS, F.desc(F.round("bm25", 9)), "file_path", "key")
    return found.select(F.col("key").alias("id"), "kind", "label", "file_path", F.round("bm25", 6).alias("bm25"), "truncated")


@query(
    "s9_index_replace",
    f"""WITH {T.FILES}, now AS (SELECT doc_id, relative_path, CASE WHEN doc_id % 10 = 0 THEN 'changed ' || text ELSE text END AS text FROM files WHERE doc_id % 17 <> 0)
  SELECT doc_id, relative_path, (length(text) - length(replace({FOLD.format("text")}, 'changed ', ''))) // 8 AS tf FROM now WHERE contains({FOLD.format("text")}, 'changed ')""",
)
def s9_index(spark, sf_dir):
    """An index after files were replaced and others removed: a further generation each, no posting of the rest is touched."""
    files = contents(spark, sf_dir)
    index = TrigramIndex.build(files, new_path(spark, "index-changed"))
    index.replace(files.where("key % 10 = 0").withColumn("text", F.concat(F.lit("changed "), "text")))
    index.remove(files.where("key % 17 = 0"))
    return index.entries().join(index.phrase("Changed "), "key").select(F.col("key").alias("doc_id"), "relative_path", "tf")
