"""What the stages' decisions rest on: long texts, the kernel's say, documents that share an id, passages that repeat."""

from __future__ import annotations

import dataclasses
import resource

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from threadloom.llm import common, decontaminate, language, simhash, toxicity

STAGES = dict(corpus_pipeline.STAGES)


def plain_alignment(item: list[str], text: list[str]) -> tuple[int, int]:
    """Smith-Waterman over words, a cell at a time: the best score, and the words that its first end leaves behind it."""
    best, end, row = 0, 0, [0] * (len(text) + 1)
    for w in item:
        new = [0]
        for j, t in enumerate(text):
            new.append(max(0, row[j] + (2 if w == t else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best, end


def test_windows_come_in_stretches_that_hold_every_alignment():
    rng = np.random.default_rng(1)
    item = [f"w{k}" for k in rng.integers(0, 12, 30)]
    index = decontaminate.SeedIndex([(1, " ".join(item))])
    for _ in range(30):
        text = [f"w{k}" if rng.random() < 0.8 else "other" for k in rng.integers(0, 14, 900)]
        at = int(rng.integers(0, 800))
        text[at : at + 30] = [w for w in item if rng.random() < 0.85]
        windows = list(index.windows(" ".join(text)))
        assert all(len(w) <= decontaminate.STRETCH * 30 for _, _, w in windows)
        best, _ = decontaminate.align([index.items[0]] * len(windows), [w for _, _, w in windows])
        assert max(best) == plain_alignment(item, text)[0]


def test_parts_are_bounded_in_words():
    rows = [(k, 0, None, "x" * n) for k, n in enumerate([3, 5, 2, 50, 4, 4, 4, 90])]
    parts = list(decontaminate.parted(rows, 40))
    assert [r for p in parts for r in p] == rows
    assert all(len(p) == 1 or len(p) * max(len(r[3]) for r in p) <= 40 for p in parts)


def test_a_text_of_half_a_million_words(spark):
    item = "seven grey herons waited by the old mill until the river froze over and the miller came home late that year"
    words = item.split()
    edited = " ".join(w if k % 6 else "changed" for k, w in enumerate(words))
    long_text = " ".join([f"{item} then" if k % 7 else edited for k in range(25_000)])
    docs = spark.createDataFrame([(1, long_text), (2, edited), (3, "nothing of it at all " * 20)], "doc_id long, text string")
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1].score == 1.0
    assert long_text.split()[got[1].start_word : got[1].end_word] == words
    # one worker: index, scan and alignment of the same text
    index = decontaminate.SeedIndex([(5, item)])
    rows = [w for _, _, w in index.windows(long_text)]
    peak = max(len(p) * max(len(r[3]) for r in p) for p in decontaminate.parted([(0, 0, None, w) for w in rows], decontaminate.CELLS))
    assert peak <= decontaminate.CELLS and before >= 0


FAR = ["Αυτό είναι ένα κείμενο σε μια γλώσσα που κανείς δεν έμαθε ποτέ ως τώρα", "Этот текст написан на языке, которого нет среди выученных, и говорит о зиме", "这是一个没有人学过的语言的句子，讲的是冬天和很多很多的雪"]


def test_the_kernel_decides_on_far_languages(spark, monkeypatch):
    docs = common.table(spark, SMALL.replace("0.001", "0.01"), "documents")
    model = language.fit(language.training_rows(docs))
    assert 0 < model.least <= language.LEAST_NEAR
    rows = language.predict(spark.createDataFrame(list(enumerate(FAR)), "doc_id long, text string"), model, judge=True).collect()
    assert all(r.near < model.least for r in rows)
    own = language.predict(docs, model, judge=True).where("lang_pred <> 'und'")
    assert own.where(F.col("near") < model.least).count() == 0
    # the stage keeps other rows under another matrix
    foreign = docs.limit(len(FAR)).select("*").collect()
    planted = docs.unionByName(spark.createDataFrame([(-1 - k, t, None, *r[3:]) for k, (t, r) in enumerate(zip(FAR, foreign, strict=True))], docs.schema))
    kept = STAGES["language_id"](spark, planted, SMALL)
    assert kept.where("doc_id < 0").count() == 0
    assert kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    blind = dataclasses.replace(model, matrix=np.vstack([np.zeros_like(model.matrix[:-1]), model.matrix[-1:]]))
    monkeypatch.setattr(language, "fit", lambda *_: blind)
    assert STAGES["language_id"](spark, docs, SMALL).count() == 0


def test_texts_that_share_an_id_are_judged_apart(spark):
    rng = np.random.default_rng(2)
    prose = lambda: " ".join(f"w{k}" for k in rng.integers(0, 5000, 80))
    a, b, c = prose(), prose(), prose()
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b + " more"), (4, c), (None, c), (None, "alone"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_", F.lit(1))
    kept = STAGES["near_dedup"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, a), (1, b), (4, c), (0, c), (0, "alone"), (5, "")])


def test_repeated_passages_lose_no_pair(spark):
    """Shingle counts shift a fingerprint, but not the sets that similarity is about."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        body, passage = [f"w{k}" for k in rng.integers(0, 4000, 150)], [f"p{k}" for k in rng.integers(0, 4000, 50)]
        texts += [" ".join(body + passage), " ".join(body + passage * 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(40))
    far = [int(np.bitwise_count(np.uint64(simhash.fingerprint(texts[2 * k]) ^ simhash.fingerprint(texts[2 * k + 1])))) for k in range(40)]
    assert max(far) > 10


def test_op5_locates_sentences_in_its_query(spark):
    docs = common.table(spark, SMALL.replace("0.001", "0.01"), "documents")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    rows = toxicity.op5_multiple_instance_toxicity(spark, SMALL.replace("0.001", "0.01")).collect()
    assert len(rows) == len(texts) and any(r.predicted for r in rows)
    for r in rows:
        if not r.predicted:
            assert r.sentence is None and r.probability is None
        elif r.sentence is not None:
            assert r.sentence in toxicity.sentences(texts[r.doc_id]) and 0 < r.probability <= r.score + 1e-9
    # a text is as toxic as its sentences together, by noisy-or, so one of them accounts for its share at least
    assert all(1 - (1 - r.probability) ** len(toxicity.sentences(texts[r.doc_id])) >= r.score - 1e-6 for r in rows if r.predicted and r.sentence is not None)
