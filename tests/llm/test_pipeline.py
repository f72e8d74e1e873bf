"""The corpus pipeline: each stage on its own input, with planted copies, passages and personal data, and the whole run."""

from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.test_operators import groups_of
from threadloom.llm import common, simhash

STAGES = dict(corpus_pipeline.STAGES)


def five_word_similarity(a: str, b: str) -> float:
    def shingles(t: str) -> set:
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def planted(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("ta", "re", "mo", "ni", "ku", "le") for b in ("n", "st", "va", "ri", "do", "ph", "zz", "ck")]
    text = lambda n: " ".join(rng.choice(words, n))
    docs, near = [], defaultdict(set)
    for k in range(40):
        base = text(int(rng.integers(200, 500))).split()
        docs.append((100 * k, " ".join(base)))
        for j in range(1, 4):
            w = list(base)
            w[(37 * j) % len(w)] = f"edit{j}"
            docs.append((100 * k + j, " ".join(w)))
            near[k].add(100 * k + j)
        docs.append((100 * k + 9, " ".join(base).upper()))
        near[k].add(100 * k + 9)
    docs += [(9000 + i, text(int(rng.integers(30, 300)))) for i in range(120)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long"), "rows": F.lit(4)})
    return d, near, dict(docs)


def test_near_dedup_keeps_one_of_each_group(spark):
    d, near, texts = planted(spark)
    again = d.where("doc_id = 9003")
    kept = STAGES["near_dedup"](spark, d.unionByName(again).unionByName(again.withColumn("doc_id", F.lit(None).cast("long"))), SMALL)
    assert kept.columns == d.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=lambda x: -1 if x is None else x)
    assert ids == [None, *(100 * k for k in range(40)), *range(9000, 9120)]


def test_groups_hold_only_what_links_allow(spark):
    docs = common.table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = defaultdict(list)
    for r in simhash.similar_groups(docs).collect():
        groups[r.component_id].append(r.doc_id)
    for root, members in groups.items():
        assert root == min(members)
        for m in members:  # someone in the group is that similar
            assert len(members) == 1 or max(five_word_similarity(texts[m], texts[o]) for o in members if o != m) >= 0.8
    copies = defaultdict(list)
    for i, t in texts.items():
        copies[" ".join(t.lower().split())].append(i)
    of = {m: root for root, members in groups.items() for m in members}
    assert all(len({of[i] for i in same}) == 1 for same in copies.values())


def alike_pairs(texts: list[str]) -> list[tuple[int, int]]:
    return [(a, b) for a in range(len(texts)) for b in range(a) if five_word_similarity(texts[a], texts[b]) >= 0.8]


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    """Short texts of one template: many are near each other, and few of those alike enough, so a forest of the near pairs isn't enough."""
    monkeypatch.setattr(simhash, "TILE", 64)
    monkeypatch.setattr(simhash, "SET_TILE", 16)
    rng = np.random.default_rng(12)
    template = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(300):
        w = list(template)
        for k in rng.choice(120, rng.integers(1, 5), replace=False):
            w[k] = f"e{rng.integers(0, 4)}"
        texts.append(" ".join(w))
    links = alike_pairs(texts)
    assert 0 < len(links) < 300 * 299 / 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert [got[i] for i in range(300)] == groups_of(300, links)


def test_near_copies_of_every_similarity_are_found(spark):
    """Near copies just above and just below 0.8; the kept rows are those of the brute-force grouping."""
    rng = np.random.default_rng(13)
    texts = []
    for _ in range(60):
        base = [f"w{k}" for k in rng.integers(0, 3000, int(rng.integers(40, 400)))]
        texts.append(" ".join(base))
        for _ in range(5):
            w = list(base)
            for k in rng.choice(len(w), max(1, int(len(w) * rng.uniform(0.002, 0.035))), replace=False):
                w[k] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    links = alike_pairs(texts)
    close = [p for p in links if five_word_similarity(texts[p[0]], texts[p[1]]) < 0.85]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    want = groups_of(len(texts), links)
    found = sum(got[a] == got[b] for a, b in links)
    print(f"recall {found / len(links):.4f} of {len(links)} pairs, {sum(got[a] == got[b] for a, b in close)} of {len(close)} below 0.85")
    assert len(close) > 50 and found >= 0.99 * len(links)
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == {g for g in got.values()} and len(kept ^ set(want)) <= 1


def test_stages_drop_what_they_should_and_nothing_else(spark, documents):
    d, _, _ = planted(spark)
    kept = STAGES["language_id"](spark, documents, SMALL)
    assert kept.columns == documents.columns
    gone = {r.doc_id for r in documents.join(kept.select("doc_id"), "doc_id", "left_anti").collect() if r.doc_id}
    assert gone == {1_000_001, 1_000_002, 1_000_003, 1_000_004}
    foreign = documents.limit(1).withColumns({"doc_id": F.lit(78).cast("long"), "text": F.lit("Αυτό είναι ένα κείμενο σε μια γλώσσα που κανείς δεν έμαθε")})
    assert 78 not in {r.doc_id for r in STAGES["language_id"](spark, documents.where("doc_id <> 78").unionByName(foreign), SMALL).collect()}
    item = common.table(spark, SMALL, "benchmark").first().text
    dirty = d.limit(1).withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit(f"before all that {item} and after")})
    clean = STAGES["decontamination"](spark, d.unionByName(dirty), SMALL)
    assert clean.count() == d.count() and clean.columns == d.columns
    personal = d.withColumn("text", F.concat("text", F.lit(" me@host.org 10.0.0.1")))
    out = STAGES["personal_data"](spark, personal, SMALL)
    assert out.columns == d.columns
    assert all(r.text.endswith(" [email] [ip]") and r.n_chars == len(r.text) for r in out.collect())


def test_whole_run_accounts_for_every_document(spark):
    docs = common.table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SMALL), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert not docs.isEmpty()
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", r.text) for r in docs.collect())
    pieces = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty_corpus(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
