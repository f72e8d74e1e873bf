"""The ten operators against brute-force versions, exact round trips, held-out accuracy and SQL, odd rows included."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, same_rows
from threadloom.llm import chat, common, components, decontaminate, language, neighbours, packing, pii, registry, simhash, suffix_dedup, toxicity, url_filter


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


# 1 nearest neighbours


def test_neighbours_exact_at_factor_one_and_recall_beyond(spark):
    rows = table(spark, "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    odd = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [None] * 64), (9005, [1.0]), (None, [0.5] * 64)]
    v = table(spark, "embeddings").select("vec_id", "embedding").unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).withColumns({"v": F.lit(1), "shard": F.lit(2)})
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[ids == ids[q]] = -np.inf
        want[int(ids[q])] = ids[np.lexsort((ids, -s))[:20]].tolist()
    for factor in (1.0, neighbours.FACTOR):
        got = defaultdict(list)
        for r in neighbours.nearest(v, factor=factor).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
        assert set(got) == set(want)
        assert got == want if factor == 1.0 else hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_prune_clusters_and_break_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16)) * 5
    x = np.round(centres[np.arange(640) % 8] + rng.normal(size=(640, 16)) * 0.2, 2)
    x[100:180] = x[100]  # many equal vectors
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(v, factor=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    for q in range(0, 640, 20):
        s = np.array([float(np.dot(x[q], y)) for y in x]).round(9)
        s[q] = -np.inf
        assert [s for _, s in got[q]] == sorted(s.tolist(), reverse=True)[:20]
    assert [i for i, _ in got[120][:3]] == [i for i in np.lexsort((np.arange(640), -np.where(np.arange(640) == 120, -np.inf, (x @ x[120]).round(9))))[:3]]


def test_neighbours_exact_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 32)
    monkeypatch.setattr(neighbours, "SAMPLE", 48)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 3))
    x *= rng.uniform(0.8, 1, (1500, 1)) / np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(v, k=1, every=1, factor=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(1500):
        s = x @ x[q]
        s[q] = -np.inf
        assert got[q] == [int(s.argmax())]


@pytest.mark.parametrize("factor", [1.0, neighbours.FACTOR])
@pytest.mark.parametrize("repeated", ["queries", "candidates", "both"])
def test_neighbours_of_repeated_rows(spark, monkeypatch, repeated, factor):
    monkeypatch.setattr(neighbours, "PART", 64)
    a = np.arange(2000) * 2 * np.pi / 2000
    rows = [(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(a)]
    rows += [(7, [1.0, 0.5]), (20, [0.2, -0.9]), (20, [0.1, 0.3])]  # ids with vectors of several kinds
    again = [r for r in rows if (r[0] % 20 == 0) == (repeated == "queries") or repeated == "both"]
    v = spark.createDataFrame(rows + again + again[:300], "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.nearest(v, factor=factor).collect())
    want, ids, x = Counter(), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for i, q in rows:
        if i % 20 == 0:
            s = x @ np.array(q)
            s[ids == i] = -np.inf
            want.update((i, k + 1, int(ids[j]), round(float(s[j]), 9)) for k, j in enumerate(np.lexsort((ids, -s.round(12)))[:20]))
    if factor == 1.0:
        # mirror images on the circle have scores that are equal but for the last bit
        assert Counter((q, s) for q, _, _, s in got.elements()) == Counter((q, s) for q, _, _, s in want.elements())
    one_id = lambda found: {(q, i) for q, _, i, _ in found}
    assert len(one_id(got) & one_id(want)) >= 0.9 * len(one_id(want)) and sum(got.values()) == sum(want.values())


def test_neighbours_few_or_none(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in neighbours.nearest(v).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert neighbours.nearest(v.limit(0)).count() == 0


# 2 repeated strings


def brute_removed(texts: list[str], length: int) -> list[tuple[int, int, int, bytes]]:
    data = [t.encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        gone[-1] = False
        kept = np.frombuffer(d, dtype=np.uint8)[~gone[:-1]].tobytes()
        out.append((len(d), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), kept))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(spark, hot):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdé"), rng.integers(1, 6)))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(int(rng.integers(0, 60)))) for _ in range(60)]
    texts = [t[: len(t) // 2] + passage[int(rng.integers(0, 20)) :] + t[len(t) // 2 :] if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[5], texts[5], "a" * 300, "ab" * 90, "", None, "x" + "a" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"k1": F.lit(1), "spans": F.lit(2)})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs, length=40, gram=12, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed([t or "" for t in texts], 40)


def test_suffix_dedup_of_texts_beyond_the_place_bits(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 10)
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passages = [text(200) for _ in range(4)]
    texts = [text(1500) + p + text(900 + 7 * k) + p[:150] + text(300) for k, p in enumerate(passages)] + [text(600) + "".join(passages) + text(700), text(50), ""]
    found = suffix_dedup.sliced_anchors([t.encode() for t in texts], 40, 12)
    assert (found[1] >= found[2]).all() and (found[3] >= found[2]).all()
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 24)
    whole = suffix_dedup.sliced_anchors([t.encode() for t in texts], 40, 12)
    windows = lambda f: sorted((int(t), int(s), int(a), int(h)) for t, a, lo, hi, h in zip(*f, strict=True) for s in range(lo, hi + 1))
    assert {w[:2] for w in windows(found)} == {w[:2] for w in windows(whole)} and len(windows(found)) == len(windows(whole))
    # tasks import the module anew, so the steps are called here
    gone = [np.zeros(len(t), dtype=bool) for t in texts]
    seen = Counter(t[i : i + 40] for t in texts for i in range(len(t) - 39))
    by_anchor = defaultdict(list)
    for t, a, lo, hi, h in zip(*found, strict=True):
        by_anchor[int(h)].append((int(t), int(a), int(lo), int(hi)))
    for group in by_anchor.values():
        bodies = [texts[t].encode()[lo : hi + 40] for t, _, lo, hi in group]
        first, last = suffix_dedup.repeated_ranges(np.zeros(len(group), dtype=np.int64), np.array([a - lo for _, a, lo, _ in group]), bodies, np.ones(len(group), dtype=np.int64), 40, 12)
        for (t, _, lo, _), f, e in zip(group, first, last, strict=True):
            if f >= 0:
                gone[t][lo + f : lo + e + 40] = True
    for t, g in zip(texts, gone, strict=True):
        want = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 39):
            if seen[t[i : i + 40]] > 1:
                want[i : i + 40] = True
        assert (g == want).all()


def test_suffix_dedup_odd_rows(documents, texts, empty):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(documents).collect())
    want = Counter((i, *b) for (i, _), b in zip(texts, brute_removed([t for _, t in texts], 400), strict=True))
    assert got == want
    assert suffix_dedup.dedup(empty).count() == 0


# 3 packing


def test_packing(documents, texts, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.pack_documents(documents).collect()
    want = Counter()
    for i, t in texts:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(n for _, n in p) <= 2048
    assert len(places) <= 1.03 * sum(r.length for r in rows) / 2048 + 1
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 101, 2000).tolist())
    plan = packing.plan_patterns(dict(counts), 100)
    used = Counter()
    for parts, k in plan:
        assert sum(parts) <= 100
        for p in parts:
            used[p] += k
    assert used == counts
    # long pieces need a sequence each, whatever fills it up
    least = max(sum(n * c for n, c in counts.items()) / 100, sum(c for n, c in counts.items() if n > 50))
    assert sum(k for _, k in plan) <= 1.02 * least + 1


@pytest.mark.parametrize("seed", range(3))
def test_sum_index_against_all_combinations(seed):
    rng = np.random.default_rng(seed)
    left = np.zeros(31, dtype=np.int64)
    for n in rng.integers(1, 20, 12):
        left[n] += 1
    index = packing.SumIndex(left)
    for _ in range(40):
        total = int(rng.integers(1, 31))
        stock = [n for n in range(31) for _ in range(left[n])]
        for size, found in ((1, index.single(total)), (2, index.pair(total)), (3, index.triple(total))):
            can = any(sum(c) == total for c in itertools.combinations(stock, size))
            assert (found is not None) == can and (not found or sum(found) == total and not Counter(found) - Counter(stock))
        if len(stock):
            left[rng.choice(stock)] -= 1


def test_packing_of_ids_of_any_type_and_frequent_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    docs = spark.createDataFrame([(f"id{k % 90}", "one two" if k % 3 else "word " * (k % 50)) for k in range(300)] + [(None, None)], "doc_id string, text string")
    rows = packing.pack_documents(docs, capacity=64).collect()
    assert {r.doc_id for r in rows} == {None, *(f"id{k}" for k in range(90))} and len(rows) >= 301
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for p in used.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(n for _, n in p) <= 64
    assert len(used) <= 1.03 * sum(r.length for r in rows) / 64 + 1


def test_cut_keeps_every_id():
    for total in range(1, 50):
        parts = packing.cut(total, 8)
        assert sum(n for _, n in parts) == total and all(n == 8 for _, n in parts[1:]) and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))


# 4 chat


def test_chat_matches_sql(spark, duck):
    same_rows(registry.QUERIES["op4_reply_tree_chat"](spark, SMALL), duck, registry.SQL["op4_reply_tree_chat"])


def test_chat_round_trip(spark):
    odd = ["<|turn|>", "\\<|", "<\\|", "<\\\\|end|>", "a<", "|>b", "", None, "\\", "\n<|text|>\\\\"]
    rows = [(1, k, "assistant" if k % 2 else "us<|er", t) for k, t in enumerate(odd)] + [(2, None, None, "x"), (2, 1, "assistant", None), (None, 0, "user", "y"), (3, 5, "user", "tie b"), (3, 5, "user", "tie a")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree_id", F.lit(1))
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in chat.format_conversations(c).select("conv_id", chat.parsed(F.col("formatted")).alias("t")).collect()}
    assert got[1] == [(r, t or "") for _, _, r, t in rows[: len(odd)]]
    assert got[2] == [("", "x"), ("assistant", "")] and got[None] == [("user", "y")] and got[3] == [("user", "tie a"), ("user", "tie b")]
    assert chat.format_conversations(c.limit(0)).count() == 0


def test_reply_trees(spark):
    nodes = spark.createDataFrame(
        [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 9.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", "more", 0.0), ("u", 1, 77, "user", "lost parent", 0.0), ("v", 1, 2, "user", "loop", 0.0), ("v", 2, 1, "user", "loop", 0.0), ("v", 3, 2, "user", "hangs", 0.0)],
        "tree_id string, node_id long, parent_id long, role string, text string, score double",
    )
    paths = chat.reply_paths(nodes, per_tree=2)
    got = {(r.tree_id, r.branch_rank): [x.text for x in r.p] for r in chat.format_paths(nodes, paths).select("tree_id", "branch_rank", chat.parsed(F.col("formatted")).alias("p")).collect()}
    assert got == {("t", 1): ["q", "good", "more"], ("t", 2): ["q", "bad"], ("u", 1): ["lost parent"]}


def test_long_reply_chain(spark):
    n = 300
    nodes = spark.range(n).select(F.lit("t").alias("tree_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    out = chat.format_paths(nodes, chat.reply_paths(nodes)).select(chat.parsed(F.col("formatted")).alias("p")).collect()
    assert [x.text for x in out[0].p] == [str(i) for i in range(n)]


# 5 toxicity


def toxic_rows(n: int) -> tuple[list, list]:
    rng = np.random.default_rng(5)
    calm = [f"w{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(n):
        body = [" ".join(rng.choice(calm, 8)) + "." for _ in range(6)]
        bad = i % 6 == 0
        if bad:
            body[int(rng.integers(0, 6))] = "you utter vileling" + rng.choice(list("abc")) + " thing."
        docs.append((i, " ".join(body)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_learns_and_locates(spark):
    docs, labels = toxic_rows(600)
    d = spark.createDataFrame([*docs, (900, None), (901, ""), (None, "no id"), (0, docs[0][1])], "doc_id long, text string").withColumns({"y": F.lit(1), "score": F.lit(2)})
    y = spark.createDataFrame([*labels, (5, None), (6, 3), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d.where("doc_id < 400"), y.where("doc_id < 400"))
    rows = {r.doc_id: r for r in toxicity.score(d, model, worst=1).collect()}
    held = [(rows[i].score >= toxicity.THRESHOLD, i % 6 == 0) for i in range(400, 600)]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert all("vileling" in rows[i].sentences[0].sentence for i in range(402, 600, 6))
    assert 0 <= rows[900].score < 0.3 and rows[900].score == rows[901].score


def plain_noisy_or(bags: list[tuple[int, list[set[int]]]], width: int, steps: int) -> tuple[list[float], float]:
    """Adam on the likelihood 1 - prod(1 - p(s)), one document after the other; a bag is the label and each sentence's features."""
    w, m, v = [0.0] * width + [-6.0], [0.0] * (width + 1), [0.0] * (width + 1)
    for step in range(1, steps + 1):
        grad = [0.0] * (width + 1)
        for y, parts in bags:
            p = [1 / (1 + np.exp(-(sum(w[f] for f in s) + w[-1]))) for s in parts]
            none = np.prod([1 - x for x in p])
            for x, s in zip(p, parts, strict=True):
                # d/dz of log(1 - none) is p * none / (1 - none), of log(none) it is -p
                pull = x * none / (1 - none) if y else -x
                for f in s:
                    grad[f] += pull / len(bags)
                grad[-1] += pull / len(bags)
        for k in range(width + 1):
            g = grad[k] - (1e-4 * w[k] if k < width else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
        w[-1] = min(max(w[-1], -14), -4)
    return w[:-1], w[-1]


def test_toxicity_against_plain_noisy_or(spark):
    """Features, their choice, training and scores, all in plain Python."""
    docs, labels = toxic_rows(90)
    width = 40
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    weights, bias, constant = toxicity.fit(d, y, width=width)
    parts = {i: [s for s in re.split(r"(?<=[.!?])\s+|\n+", t.lower()) if s] for i, t in docs}
    grams = lambda s: {x for w in re.findall(r"[^\W\d_]+", s) for x in [w + "$", *(w[:n] + "^" for n in range(3, 7) if n <= len(w))]}
    held, size = {0: Counter(), 1: Counter()}, Counter(y for _, y in labels)
    for i, y_ in labels:
        held[y_].update(set().union(*map(grams, parts[i])))
    share = lambda f: (held[0][f] + held[1][f]) / len(docs)
    z = {f: abs(held[1][f] / size[1] - held[0][f] / size[0]) / np.sqrt(share(f) * (1 - share(f)) + 1e-6) for f in {*held[0], *held[1]} if held[0][f] + held[1][f] >= toxicity.LEAST}
    known = {f: k for k, f in enumerate(sorted(z, key=lambda f: (-round(z[f], 12), f))[:width])}
    w, b = plain_noisy_or([(y_, [{known[f] for f in grams(s) if f in known} for s in parts[i]]) for i, y_ in labels], width, 300)
    assert constant is None and set(weights) == set(known) and abs(bias - b) < 1e-2
    assert max(abs(weights[f] - w[k]) for f, k in known.items()) < 1e-2
    for r in toxicity.score(d, (weights, bias, None)).collect():
        plain = 1 - np.prod([1 - 1 / (1 + np.exp(-(sum(weights[f] for f in grams(s) & set(weights)) + bias))) for s in parts[r.doc_id]])
        assert abs(r.score - plain) < 1e-9


def test_toxicity_fits_on_bounded_text(spark, monkeypatch):
    docs, labels = toxic_rows(300)
    d, y = spark.createDataFrame(docs * 3 + [(0, "x " * 900)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), y)
    monkeypatch.setattr(toxicity, "LONGEST", 1000)
    assert toxicity.fit(d, y) == once  # repeated rows teach once, longer texts nothing
    monkeypatch.setattr(toxicity, "CHARACTERS", sum(len(t) for _, t in docs) // 2)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, width: seen.append(len(rows)) or (np.ones(width), -6.0))
    toxicity.fit(d, y)
    assert 90 < seen[0] < 210


def test_toxicity_of_the_tables_is_learned(spark):
    t = registry.QUERIES["op5_multiple_instance_toxicity"](spark, SMALL.replace("0.001", "0.1")).join(table(spark, "labels").limit(0).unionByName(spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/labels.parquet")), "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in t)
    assert hit >= 0.8 * sum(r.toxic for r in t) and hit >= 0.85 * sum(r.predicted for r in t)


def test_toxicity_without_labels(spark, documents, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(documents, toxicity.fit(documents, none)).collect()} == {0.0}
    assert toxicity.score(empty, ({}, 0.0, 0.0)).count() == 0


# 6 decontamination


def test_alignment_against_plain_dynamic_programming():
    rng = np.random.default_rng(6)
    items = [rng.integers(0, 5, rng.integers(1, 12)) for _ in range(60)]
    windows = [rng.integers(0, 5, rng.integers(1, 30)) for _ in range(60)]
    best, end = decontaminate.align(items, windows)
    for a, b, s, e in zip(items, windows, best, end, strict=True):
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert h.max() == s and (s == 0 or h[:, e + 1].max() == s)


def test_decontamination_finds_edited_copies(spark, documents, empty):
    rng = np.random.default_rng(7)
    words = [f"v{k}" for k in range(900)]
    items = [(k, " ".join(rng.choice(words, 30))) for k in range(20)]
    filler = lambda n: " ".join(rng.choice(words, n))
    docs, want = [], set()
    for k, t in items:
        w = t.split()
        edited = [x if j % 5 else "changed" for j, x in enumerate(w)]
        cut = w[:7] + w[9:15] + ["more", "words"] + w[15:]
        for variant, body in enumerate((w, edited, cut, [x.upper() + "," for x in w])):
            docs.append((100 * k + variant, f"{filler(40)} {' '.join(body)} {filler(50)}"))
            want.add((100 * k + variant, k))
        docs.append((100 * k + 50, f"{filler(60)} {' '.join(w[:6])} {filler(60)}"))
    docs += [(5000 + i, f"{items[0][1]} {filler(5)}") for i in range(200)]  # one very common passage
    want |= {(5000 + i, 0) for i in range(200)}
    b = spark.createDataFrame([*items, (98, None), (99, "two words"), (None, "no id here at all")], "item_id long, text string").withColumn("item", F.lit(1))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit(1), "first": F.lit(2)})
    found = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    exact = next(r for r in found if (r.doc_id, r.item_id) == (300, 3))
    assert (exact.score, exact.start_word, exact.end_word) == (1.0, 40, 70)
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(empty, b).count() == 0
    decontaminate.contaminated(documents, b).collect()


def test_decontamination_against_alignment_of_everything(spark):
    """Every document aligned whole with every item; a hit needs the score and a run of three words in common."""
    rng = np.random.default_rng(21)
    words = [f"q{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words, int(rng.integers(3, 14))))) for k in range(12)]
    docs = []
    for i in range(150):
        w = items[int(rng.integers(0, 12))][1].split()
        for _ in range(int(rng.integers(0, 7))):  # changed, left out and added words
            k, change = int(rng.integers(0, len(w) + 1)), int(rng.integers(0, 3))
            w[k : k + (change < 2)] = [rng.choice(words)] if change else []
        docs.append((i, " ".join([*rng.choice(words, int(rng.integers(0, 30))), *w, *rng.choice(words, int(rng.integers(0, 30)))])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.score, 6) for r in decontaminate.contaminated(d, b).collect()}
    want = {}
    for i, t in docs:
        y = t.split()
        runs = {tuple(y[k : k + 3]) for k in range(len(y) - 2)}
        for k, item in items:
            x = item.split()
            if not any(tuple(x[j : j + 3]) in runs for j in range(len(x) - 2)):
                continue
            h = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
            for a, b_ in itertools.product(range(len(x)), range(len(y))):
                h[a + 1, b_ + 1] = max(0, h[a, b_] + (2 if x[a] == y[b_] else -1), h[a, b_ + 1] - 1, h[a + 1, b_] - 1)
            if h.max() >= len(x):
                want[i, k] = round(h.max() / (2 * len(x)), 6)
    assert got == want and len(want) > 80


def test_seeds_of_large_vocabularies():
    n = 2_200_000  # three word numbers in one product would pass 2^63
    index = decontaminate.SeedIndex([(5, " ".join(f"w{k}" for k in range(n))), (6, "w2100001 w7 w2100000 w9 w9")])
    found = [(k, first, len(window)) for k, first, window in index.windows(f"no w2199997 w2199998 w2199999 no {'x ' * 40} w2100001 w7 w2100000 w9 w8")]
    assert [k for k, _, _ in found] == [0, 1] and (np.diff(index.key) >= 0).all() and len(index.key) == n - 2 + 3
    assert not list(index.windows("w2100001 w7 w2100001 w2100000 w9 w2199999"))


def test_rows_without_id_are_decontaminated(spark):
    item = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(None, f"so {item} it is"), (None, "clean text of no importance"), (None, None), (1, f"{item}"), (2, "clean")], "doc_id long, text string").withColumns({"key_": F.lit(1), "row_": F.lit(2)})
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.clean_of(d, b)
    assert left.columns == d.columns and sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(None, "clean text of no importance"), (None, None), (2, "clean")]))


@pytest.mark.parametrize("copies", [7, 8, 300])
def test_decontamination_finds_edited_copies_however_many(spark, copies):
    w = [f"v{k}" for k in range(20)]
    edited = " ".join(x if k % 5 else f"changed{k}" for k, x in enumerate(w))
    docs = [(i, f"filler number {i} before {edited} and after") for i in range(copies)] + [(9000, " ".join(w))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    found = decontaminate.contaminated(d, b).collect()
    assert sorted(r.doc_id for r in found) == [*range(copies), 9000]
    assert {(r.start_word, r.end_word) for r in found} == {(5, 24), (0, 20)}


def test_benchmark_in_blocks(spark, monkeypatch):
    d, b = table(spark, "documents"), table(spark, "benchmark")
    once = {tuple(r) for r in decontaminate.contaminated(d, b).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert {tuple(r) for r in decontaminate.contaminated(d, b).collect()} == once and once


# 7 language


def test_language_held_out(spark):
    sf = SMALL.replace("0.001", "0.01")
    rows = registry.QUERIES["op7_string_kernel_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_places_are_the_distinct_n_grams():
    flags = np.zeros(1 << language.BITS, dtype=np.uint8)
    a, b = language.places("abcab", flags), language.places("ABCAB", flags)
    assert a.tolist() == b.tolist() and len(a) == 3 + 3 + 3 and not flags.any()


def test_scores_are_those_of_the_kernel_ridge_regression(spark):
    """Kernels from set intersections, and the ridge regression in its dual form, over the same landmarks."""
    rng = np.random.default_rng(11)
    alphabets = {"aa": "abcdefgh ", "bb": "efghijkl ", "cc": "ijklmnop "}
    make = lambda k, n: "".join(rng.choice(list(alphabets[k]), n))
    rows = [(i, make(k, int(rng.integers(20, 60))), k) for i, k in enumerate(list(alphabets) * 9)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), landmarks=5)
    new = [(100 + i, make(k, 40), k) for i, k in enumerate(list(alphabets) * 5)] + [(200, "xyz", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()}

    flags = np.zeros(1 << language.BITS, dtype=np.uint8)
    sets = lambda texts: [set(language.places(t, flags).tolist()) for t in texts]
    kernel = lambda a, b: np.array([[len(x & z) / np.sqrt(len(x) * len(z)) for z in b] for x in a])
    bitmap = lambda x: np.packbits(np.isin(np.arange(1 << language.BITS), list(x))).tobytes()
    train = sorted(((k, bitmap(x), x) for (_, _, k), x in zip(rows, sets(t for _, t, _ in rows), strict=True)), key=lambda r: r[:2])
    langs, x = sorted(alphabets), [r[2] for r in train]
    marks = [s for k in langs for s in [r[2] for r in train if r[0] == k][:5]]
    root = np.linalg.pinv(kernel(marks, marks), rcond=1e-6, hermitian=True)
    y = np.array([[1.0 if r[0] == k else -1.0 for k in langs] for r in train])
    # phi phi' = K(X, M) K(M, M)^-1 K(M, X), and 1 for the constant; all languages hold 9 texts, so all weigh 1 / 9
    phi = lambda a, b: kernel(a, marks) @ root @ kernel(b, marks).T + 1
    alpha = np.linalg.solve(phi(x, x) + language.RIDGE * np.eye(len(x)), y)
    scores = phi(sets(t for _, t, _ in new), x) @ alpha
    for (i, _, _), s in zip(new, scores, strict=True):
        e = np.exp(3 * (s - s.max()))
        assert got[i][0] == langs[int(s.argmax())] and abs(got[i][1] - e.max() / e.sum()) < 1e-4


def test_unlearned_languages_are_unknown(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(language.training_rows(docs))
    rng = np.random.default_rng(0)
    foreign = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300)), "Αυτό είναι ένα κείμενο σε μια γλώσσα που κανείς δεν έμαθε ποτέ", "Tämä on suomenkielinen teksti, jota luokittelija ei ole koskaan nähnyt eikä oppinut. Se kertoo talvesta ja lumesta.", "Ten tekst jest napisany po polsku i klasyfikator nigdy wcześniej go nie widział ani się nie uczył.", "Этот текст написан на языке, которого нет среди выученных", "这是一个没有人学过的语言的句子"]
    rows = language.predict(spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string"), model, judge=True).collect()
    assert all(r.known < model.floor for r in rows) and model.floor > 0.85
    own = language.predict(docs.where(common.crc_bucket("doc_id", 5) == 0), model, judge=True).collect()
    assert all(r.known >= model.floor for r in own if r.lang_pred != "und")


def test_language_odd_rows(documents, empty, spark):
    model = language.fit(documents)
    rows = {r.doc_id: r for r in language.predict(documents, model).collect()}
    assert {rows[i].lang_pred for i in (1_000_001, 1_000_002, 1_000_003, 1_000_004)} == {"und"} and rows[1_000_001].score == 0
    assert rows[1_000_005].lang_pred != "und"
    assert language.fit(empty) is None and {r.lang_pred for r in language.predict(documents, None).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


# 8 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    def good(kind: str, m: str) -> bool:
        d = re.sub("[^0-9]", "", m)
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and total % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]

    return {k: [m.span() for m in re.finditer(p, text) if good(k, m.group())] for k, p in PATTERNS.items()}


TRICKY = [
    "a@b.com_x@y.com and x@y, .@-.- 😀 z@q.é a@b..c",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.255 1.2.3 256.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111 1111 1111 1112 79927398713 4111111111111111 4111  1111",
    "+1 (017) 555-7713 190.116.163.254 +12 +1-2-3-4-5-6-7-8 ++44 20 7946 0958.",
    "9" * 20000 + " " + "a" * 20000 + " " + "1." * 20000 + " " + "2-" * 20000 + " x@" + "a." * 20000 + " " + "+1" * 20000,
    "4111\ue0001111\ue0001111\ue0001111 a@b\ue001c a@b.c\ue001d",
    "write to jo (at) example (dot) com or 10[.]0[.]0[.]1, 4111.1111.1111.1111, call 020 7946 0958",
]


def test_pii_base_spans(spark, documents, texts, empty):
    more = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 5_000_000)
    docs = documents.select("doc_id", "text").unionByName(more).withColumn("hit", F.lit(3))
    rows = pii.detect(docs, pii.fit(docs)).select("doc_id", "text", *(F.col(f"base_{k}") for k in pii.KINDS), pii.spelled("base").alias("base"), pii.spelled("all").alias("spans")).collect()
    for r in rows:
        want = brute_spans(r.text or "")
        assert {k: [(m.start, m.stop) for m in r[f"base_{k}"]] for k in pii.KINDS} == want
        assert r.base == ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))
    assert pii.detect(empty, pii.fit(empty)).count() == 0


def test_pii_proposals_add_spans_and_redaction_replaces(spark):
    docs = [(i, f"mail u{i}@host{i}.com now, or 10.0.{i}.1, call +1 555 010 {1000 + i} today, id 12{i}45-99-1") for i in range(250)]
    plain = [(1000 + i, "nothing at all here (at) least, 3.14 and 12 34") for i in range(50)]
    d = spark.createDataFrame([*docs, *plain, (2000, TRICKY[-1]), (2001, None)], "doc_id long, text string").withColumns({"base_ip": F.lit(1), "row_": F.lit(2)})
    accepted = pii.fit(d)
    rows = {r.doc_id: r for r in pii.detect(d.select("doc_id", "text"), accepted).select("doc_id", pii.spelled("all").alias("s")).collect()}
    assert "ip:" in rows[2000].s and all(not rows[1000 + i].s for i in range(50))
    out = {r.doc_id: r for r in pii.redact(d, accepted).collect()}
    assert out[3].text == "mail [email] now, or [ip], call [phone] today, id 12345-99-1" and out[1000].text == plain[0][1] and out[2001].text is None and out[3].row_ == 2


def test_pii_learns_contexts_and_meets_rewritings_that_the_fit_lacked(spark):
    """Plain data and rule breakers teach; rewritings in styles that no document of the fit has are judged."""
    rng = np.random.default_rng(8)

    def card(good: bool) -> str:
        d = rng.integers(0, 10, 15).tolist()
        d[0] = 4
        last = next(k for k in range(10) if pii_luhn([*d, k]))
        return "".join(map(str, [*d, last if good else (last + 1 + int(rng.integers(0, 9))) % 10]))

    four = lambda c, mark: mark.join(c[k : k + 4] for k in range(0, 16, 4))
    octets = lambda top: [str(int(x)) for x in rng.integers(1, top, 4)]
    teach = []
    for i in range(600):
        bad = octets(255)
        bad[int(rng.integers(0, 4))] = str(int(rng.integers(300, 999)))
        teach.append((i, f"pay by card {four(card(True), '-')} now. order id {four(card(False), '-')} then. host {'.'.join(octets(255))} up, version {'.'.join(bad)} out. mail u{i}@h{i}.org and [at] last"))
    model = pii.fit(spark.createDataFrame(teach, "doc_id long, text string"))
    judged, want = [], []
    for i in range(200):
        a = [f"u{i} {{at}} h{i} {{dot}} org", f"u{i} at h{i} dot org"][i % 2]
        ip = ["(dot)", " dot ", "[.]"][i % 3].join(octets(255))
        c, other = four(card(True), "./_"[i % 3]), four(card(True), "./_"[i % 3])
        text = f"mail {a} or host {ip} up, pay by card {c} now. order id {other} then, be here [at] once"
        judged.append((i, text))
        want.append({("email", text.index(a)), ("ip", text.index(ip)), ("card", text.index(c))})
    rows = pii.detect(spark.createDataFrame(judged, "doc_id long, text string"), model).select("doc_id", pii.spelled("all").alias("s")).collect()
    got = {r.doc_id: {(x.split(":")[0], int(x.split(":")[1])) for x in r.s.split(",") if x} for r in rows}
    hits = sum(len(got[i] & w) for i, w in enumerate(want))
    assert hits >= 0.95 * sum(map(len, want)) and hits >= 0.95 * sum(map(len, got.values()))


def pii_luhn(d: list[int]) -> bool:
    return sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0


def test_pii_trees_as_an_expression(spark):
    rng = np.random.default_rng(1)
    cells = [(tuple(int(rng.integers(0, n)) for n in pii.FEATURES.values()), int(rng.integers(0, 9)), int(rng.integers(0, 9))) for _ in range(300)]
    trees = pii.Boosted(cells)
    rows = spark.createDataFrame([c[0] for c in cells], ", ".join(f"{n} int" for n in pii.FEATURES)).select("*", trees.expression(F.col).alias("s")).collect()
    assert len(trees.trees) == pii.ROUNDS and all(abs(r.s - trees.score(tuple(r)[:-1])) < 1e-9 for r in rows)


def test_boosted_trees_separate_cells():
    cells = [((0, d, 1, 0, 0, 0, 0, w), 0 if w and d > 2 else 50, 50 if w and d > 2 else 0) for d in range(6) for w in (0, 1)]
    trees = pii.Boosted(cells)
    assert all((trees.score(x) > 0) == (p > 0) for x, _, p in cells)


# 9 near duplicates


def brute_fingerprint(text: str) -> int:
    import xxhash

    w = [x for x in re.split("[\x20\t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(n: int, pairs) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash_whole_tables(documents, texts, empty):
    rows = simhash.near_duplicates(documents).collect()
    known = {(i, brute_fingerprint(t)) for i, t in texts}
    assert {(r.doc_id, r.fp % 2**64) for r in rows} == known and len(rows) == len(texts)
    items = sorted((i, f) for i, f in known if i is not None)
    roots = groups_of(len(items), ((a, b) for a in range(len(items)) for b in range(a) if (items[a][1] ^ items[b][1]).bit_count() <= 3))
    least = {}
    for (i, _), g in zip(items, roots, strict=True):
        least[g] = min(least.get(g, i), i)
    want = {i: least[g] for (i, _), g in zip(items, roots, strict=True)}
    assert all(r.component_id == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("radius", "parts", "tile"), [(3, 2, 16_384), (7, 4, 16_384), (3, 2, 8)])
def test_vantage_trees_lose_no_link(spark, monkeypatch, radius, parts, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 9), replace=False)) for b in base for _ in range(4)]
    fps = sorted({int(b) for b in base} | set(near))
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    links = [tuple(r) for r in simhash.class_links(classes, radius, parts, shard=16).collect()]
    brute = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius]
    assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in brute}
    assert groups_of(len(fps), links) == groups_of(len(fps), brute)


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 700), (700, 600), (900, 900)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 600: 500, 700: 500}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


# 10 url filters


def test_url_filter_matches_sql(spark, duck):
    same_rows(registry.QUERIES["op10_temporal_url_filter"](spark, SMALL), duck, registry.SQL["op10_temporal_url_filter"])


def test_url_filter_intervals(spark):
    ts = "timestamp"
    changes = spark.createDataFrame([(1, "bad.com", "2024-01-10", "add"), (2, "bad.com", "2024-02-01", "remove"), (3, "bad.com", "2024-03-01", "add"), (4, "ok.org/spam", "2024-01-01", "add"), (5, None, "2024-01-01", "add"), (6, "z.com", None, "add"), (7, "tie.com", "2024-01-01", "add"), (8, "tie.com", "2024-01-01", "remove")], "change_id long, pattern string, at string, action string").withColumn("changed_at", F.col("at").cast(ts))
    captures = spark.createDataFrame([(1, "http://a.bad.com/x", "2024-01-09"), (2, "http://a.bad.com/x", "2024-01-10"), (3, "https://u@BAD.com:8/", "2024-02-01"), (4, "http://bad.com", "2024-06-01"), (5, "http://ok.org/spam/1?q", "2024-05-05"), (6, "http://ok.org/spammer", "2024-05-05"), (7, None, "2024-05-05"), (8, "no host", "2024-05-05"), (9, "http://bad.com", None), (10, "http://tie.com", "2024-05-05"), (10, "http://tie.com", "2024-05-05")], "page_id long, url string, at string").withColumn("fetched_at", F.col("at").cast(ts)).withColumn("pattern", F.lit(1))
    got = {r.page_id: (r.blocked, r.pattern) for r in url_filter.evaluate(captures, changes).collect()}
    assert got == {1: (False, None), 2: (True, "bad.com"), 3: (False, None), 4: (True, "bad.com"), 5: (True, "ok.org/spam"), 6: (False, None), 7: (False, None), 8: (False, None), 9: (False, None), 10: (False, None)}
    assert url_filter.evaluate(captures.limit(0), changes).count() == 0 and not url_filter.evaluate(captures, changes.limit(0)).where("blocked").count()




def test_personal_data_is_learned_from_every_document(spark, monkeypatch):
    """No document is left out of the fit, however many there are."""
    docs = spark.range(50_000).selectExpr("id as doc_id", "'write to a.b@example.org, card 4111 1111 1111 1111' as text")
    counted = []
    trees = pii.Boosted.__init__
    monkeypatch.setattr(pii.Boosted, "__init__", lambda self, cells, *a: (counted.append(sum(c[1] + c[2] for c in cells)), trees(self, cells, *a))[1])
    pii.fit(docs)
    half = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0).count()
    assert counted[0] >= 2 * half
