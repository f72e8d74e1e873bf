"""The trigram index against scans, and what changes do to it."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import documents, search
from threadloom.plans.stages import new_path, shared_dir

LETTERS = ["a", "b", "A", "B", "n", "é", "É", "😀", " ", "\n", "'", "\\E", "%"]


def corpus(n: int) -> dict[int, str | None]:
    rng = random.Random(7)
    texts: dict[int, str | None] = {k: "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for k in range(n)}
    texts |= {n: None, n + 1: "", n + 2: "ab", n + 3: "ananananan", n + 4: "x" * 5000 + "the needle" + "y" * 5000}
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, f"src/{k:04}.txt") for k, t in texts.items()], "key long, text string, path string")


def scan(texts, phrase):
    """How often a phrase stands in each text, by trying every place."""
    phrase = X.fold(phrase)
    found = {k: sum(X.fold(t).startswith(phrase, i) for i in range(len(t))) for k, t in texts.items() if t}
    return {k: n for k, n in found.items() if n}


@pytest.fixture(scope="module")
def index(spark):
    return search.TrigramIndex.build(frame(spark, corpus(300)), new_path(spark, "index"))


@pytest.mark.parametrize("phrase", ["aba", "anan", "ab a", "nbab", "É😀a", "é😀A", "the needle", "THE NEEDLE", "xxxx", "absent phrase", "a'b", "\\Ea", "%an", "b\na", "bbaaé"])
def test_phrases_are_those_of_a_scan(index, phrase):
    assert {r.key: r.tf for r in index.phrase(phrase).collect()} == scan(corpus(300), phrase)


def test_order_is_that_of_the_published_formula(index):
    texts, phrase = corpus(300), "anan"
    tf, mean, n = scan(texts, phrase), sum(max(len(t or "") - 2, 0) for t in texts.values()) / len(texts), len(texts)
    idf = max(math.log((n - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6)
    want = {k: idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(texts[k]) - 2) / mean)) for k, f in tf.items()}
    got = search.best(index.ranked(phrase), 2, F.desc("bm25"), "path").collect()
    assert [r.key for r in got] == sorted(want, key=lambda k: (-want[k], k))[:2]
    assert all(r.bm25 == pytest.approx(want[r.key]) and r.truncated == (len(want) > 2) for r in got)


def test_short_phrases_are_refused(index):
    with pytest.raises(ValueError):
        index.phrase("ab")


def test_a_phrase_reads_its_folders_only(index):
    plan = index.phrase("anan")._jdf.queryExecution().executedPlan().toString()
    scanned = next(line for line in plan.splitlines() if "postings" in line)
    assert "folder" in scanned.split("PartitionFilters")[1] and "In(gram" in scanned.split("PushedFilters")[1]


def test_a_plan_names_the_table_in_a_longer_shared_folder(spark):
    shared = shared_dir(spark)
    longer = "d" * max(0, 34 - len(shared) - 1)  # 34 characters: a temporary folder in /proc/self/cwd/.tmp
    built = search.TrigramIndex.build(frame(spark, corpus(5)), new_path(spark, f"{longer}/index" if longer else "index"))
    scanned = [line for line in built.phrase("anan")._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert len(scanned) == 1 and ("postings" in scanned[0] or len(shared) > 34)


def test_changes_and_removals(spark):
    texts = corpus(40)
    index = search.TrigramIndex.build(frame(spark, texts), new_path(spark, "index"))
    index.replace(frame(spark, {3: "fn alpha_unique() {}", 500: "alpha_unique, too"}))
    texts |= {3: "fn alpha_unique() {}", 500: "alpha_unique, too"}
    assert {r.key: r.tf for r in index.phrase("alpha_unique").collect()} == {3: 1, 500: 1}
    index.replace(frame(spark, {3: "fn beta_unique() {}"}))
    texts[3] = "fn beta_unique() {}"
    index.remove(spark.createDataFrame([(500,), (5,), (9999,)], "key long"))
    del texts[500], texts[5]
    index.replace(frame(spark, {5: "back again"}))
    texts[5] = "back again"
    for held in (index, index.compacted(new_path(spark, "index"))):
        assert {r.key for r in held.entries().collect()} == set(texts)
        for phrase in ("alpha_unique", "beta_unique", "back again", "anan", "ab "):
            assert {r.key: r.tf for r in held.phrase(phrase).collect()} == scan(texts, phrase)


def test_repeated_and_empty_keys(spark):
    rows = [(1, "short"), (1, "the longer text"), (None, "the nameless"), (2, None)]
    index = search.TrigramIndex.build(spark.createDataFrame(rows, "key long, text string"), new_path(spark, "index"))
    assert [tuple(r) for r in index.phrase("the").collect()] == [(1, 1)]
    assert sorted(r.key for r in index.entries().collect()) == [1, 2]
    none = search.TrigramIndex.build(spark.createDataFrame([], "key long, text string"), new_path(spark, "index"))
    assert none.phrase("the").count() == 0 and none.ranked("the").count() == 0


def test_terms_with_marks(spark):
    files = spark.createDataFrame([(1, "a", "it's \\E 100% it's"), (2, "b", "its")], "doc_id long, relative_path string, text string")
    assert [(r.doc_id, r.tf) for r in documents.bm25(files, "It's").collect()] == [(1, 2)]
    assert [r.start_column for r in documents.line_matches(files, "\\e 1").collect()] == [6]
    masked = files.select(documents.mask_patterns(F.col("text"), ("\\E", "it's", "100%", "100"))).collect()
    assert [r[0] for r in masked] == ["[REDACTED] [REDACTED] [REDACTED] [REDACTED]", "its"]


def test_postings_are_written_where_they_are_made(spark):
    """Only texts are dealt out: nothing is shuffled or sorted after the step that makes postings, which are many times the texts."""
    files = frame(spark, corpus(60))
    plan = search.postings_of(files.where("text is not null"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    stages = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    path = new_path(spark, "index")
    search.write_postings(search.postings_of(files.where("text is not null")).withColumn("folder", F.expr("cast(pmod(xxhash64(gram), 8) as int)")), path, 8)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert len(jobs) - stages == 1 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    held = spark.read.parquet(path)
    assert held.select("folder").distinct().count() == 8
    assert held.agg(F.sum("n")).first()[0] == sum(max(len(t or "") - 2, 0) for t in corpus(60).values())


def test_blocks_of_texts_keep_their_places(spark, monkeypatch):
    texts = corpus(60)
    for chars in (1, 50, 1000):
        monkeypatch.setattr(search, "BLOCK_CHARS", chars)
        rows = search.postings_of(frame(spark, {k: t or "" for k, t in texts.items()}).coalesce(1)).collect()
        assert sorted((r.key, p, r.gram) for r in rows for p in r.places) == sorted((k, p, g) for k, t in texts.items() if t for p, g in enumerate(search.trigrams(t).tolist()))
        assert all(r.n == len(r.places) for r in rows)
