"""Operators 11 to 13 against brute-force versions and round trips."""

from __future__ import annotations

import glob
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from threadloom.llm import common, crossing, negatives, tokens

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in (tokens.TOKENIZER, crossing.TOKENIZER_A, crossing.TOKENIZER_B))
MIXED = ["a", "The", "É", "ß", "µ", "ª", "×", "'s", "'", "'t", ".", " ", "  ", "\n", "\t", "\r", "<|endoftext|>", "<|", "|>", "1", "42", "２", "İ", "Σ", "́", " ", "▁", "你", "😀", "\x1c", "!", "$$$", "--", "`", "\x7f", "<0x0A>", "</s>", "ing"]


def mixed_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(MIXED) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def test_word_ids_are_those_of_the_library(whole, texts):
    tok = tokens.WordTokenizer(WORD)
    for t in mixed_texts(5000, 1) + [t for _, t in texts]:
        assert tok.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_what_is_remembered_stays_bounded():
    made = []
    r = common.Remembered(lambda k: made.append(k) or k.upper(), 3)
    for k in "abcabcdefabc":
        assert r[k] == k.upper()
    assert len(r) <= 3 and len(r.older) <= 3
    assert r["x" * 100] == "X" * 100 and "x" * 100 not in r


def plain_digests(rows, whole):
    """Of (doc_id, text) in the order of op11, ids of each with 2 behind."""
    at, out = 0, []
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def token_set(spark, documents):
    path = common.new_path(spark, "tokens")
    tokens.write_tokens(documents, path, WORD, shard_bytes=200_000)
    return path, tokens.TokenSet(spark, path)


def test_op11_reads_back_what_it_wrote(spark, documents, token_set, whole):
    rows = sorted(((r.doc_id, r.text, r.h) for r in documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    path, found = token_set
    want = plain_digests([r[:2] for r in rows], whole)
    assert sorted(map(tuple, found.digests().collect()), key=lambda r: r[1]) == want
    assert found.shards.count() > 1
    assert sorted(map(tuple, found.metadata().collect()), key=lambda r: r[1]) == [w[:3] for w in want]


def test_op11_files_have_the_layout_that_partial_reads_need(token_set):
    path, _ = token_set
    for f in glob.glob(f"{path}/tokens/*.parquet"):
        m = pq.ParquetFile(f).metadata
        if not m.num_rows:
            continue
        of = {m.row_group(0).column(c).path_in_schema: m.row_group(0).column(c) for c in range(m.num_columns)}
        assert all(c.has_column_index and c.has_offset_index for c in of.values())
        assert "DELTA_BINARY_PACKED" in of["start"].encodings and "DELTA_BINARY_PACKED" in of["stop"].encodings
        assert any("DICTIONARY" in e for e in of["ids.list.element"].encodings)


def scan_of(df) -> str:
    return next(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "stop" in line)


def test_op11_reads_in_parts(token_set):
    _, found = token_set
    assert "ids" not in scan_of(found.metadata()).split("ReadSchema")[1]
    every = sorted(found.documents().collect(), key=lambda r: r.start)
    stream = [i for r in every for i in r.ids]
    some = found.documents(20, 30)
    assert "GreaterThanOrEqual(doc_id,20)" in scan_of(some)
    assert sorted((r.doc_id, r.ids) for r in some.collect()) == sorted((r.doc_id, r.ids) for r in every if r.doc_id is not None and 20 <= r.doc_id <= 30)
    for start, stop in ((0, 1), (5, 5_000), (len(stream) // 3, len(stream) // 2), (10, len(stream) + 7), (len(stream), len(stream) + 1)):
        got = sorted(found.window(start, stop).collect(), key=lambda r: r.start)
        assert [i for r in got for i in r.ids] == stream[start:stop]
        assert all(r.stop - r.start == len(r.ids) for r in got)
    assert "LessThan(start" in scan_of(found.window(5, 600))


def test_op11_repeats_and_empty(spark, empty, whole):
    path = common.new_path(spark, "tokens")
    df = spark.createDataFrame([(7, "same words")] * 50 + [(None, None), (3, "")], "doc_id int, text string").repartition(6)
    tokens.write_tokens(df, path, WORD, shard_bytes=300)
    got = sorted(map(tuple, tokens.TokenSet(spark, path).digests().collect()), key=lambda r: r[1])
    assert got == plain_digests([(None, None), (3, "")] + [(7, "same words")] * 50, whole)
    path = common.new_path(spark, "tokens")
    tokens.write_tokens(empty, path, WORD)
    assert tokens.TokenSet(spark, path).digests().count() == 0 and tokens.TokenSet(spark, path).window(0, 9).count() == 0


def plain_negatives(rows, every=100, positives=5, negatives_=10):
    """Of (id, label, integer vector) rows, all scores."""
    out = []
    for a, la, x in rows:
        if a % every:
            continue
        scores = [(sum(int(p) * int(q) for p, q in zip(x, y, strict=True)), i, k) for i, k, y in rows]
        order = sorted(scores, key=lambda s: (-s[0], s[1]))
        for sp, p, _ in [s for s in order if s[2] == la and s[1] != a][:positives]:
            found = [s for s in order if s[2] != la and 30 * sp <= 100 * s[0] <= 90 * sp][:negatives_]
            out += [(a, p, k + 1, n, sp, sn) for k, (sn, n, _) in enumerate(found)]
    return sorted(out)


def as_rows(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("kind", ["given", "clustered", "sampled and in chunks"])
def test_op12_equals_all_scores(spark, kind, monkeypatch):
    if kind == "given":
        t = pq.read_table(f"{SMALL}/embeddings.parquet").to_pydict()
        ids, labels = t["vec_id"], [(x + 1) % 10 if i % 7 == 0 else x for i, x in zip(t["vec_id"], t["label"], strict=True)]
        rows = [(i, k, np.floor(256 * np.array(v, dtype=np.float64)).astype(int)) for i, k, v in zip(ids, labels, t["embedding"], strict=True)]
        assert as_rows(negatives.op12_angular_hard_negatives(spark, SMALL)) == plain_negatives(rows)
        return
    if kind != "clustered":
        monkeypatch.setattr(negatives, "TRUSTED", 50)
        monkeypatch.setattr(negatives, "SAMPLED", 3)
        monkeypatch.setattr(negatives, "ANCHOR_BYTES", 4000)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5)) * 3
    at = rng.integers(0, 6, 700)
    v = (centres[at] + rng.normal(size=(700, 5)) * 0.2).astype(np.float32)
    v[::9] = v[0]  # ties
    v[5], v[300] = 0, 0
    df = spark.createDataFrame([(i, x.tolist(), int(c % 3), "more") for i, (x, c) in enumerate(zip(v, at, strict=True))], "vec_id long, embedding array<float>, label int, a string")
    rows = [(i, int(c % 3), np.floor(256 * x.astype(np.float64)).astype(int)) for i, (x, c) in enumerate(zip(v, at, strict=True))]
    assert as_rows(negatives.hard_negatives(df, every=20)) == plain_negatives(rows, 20)


def test_op12_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(400, 3)) * 50).astype(np.int64)
    ways = negatives.directions(x[:50].astype(float))
    norms, angle = negatives.angles(x.astype(float), ways)
    low, high = np.full((40, 1), 2000), np.full((40, 1), 2500)
    a = negatives.Anchors(np.arange(40), np.zeros(40), x[:40], ways, low, high, 5, False, True)
    inside = ((s := x[:40] @ x.T) >= 2000) & (s <= 2500)
    open_ = a.row_open(np.arange(40), norms, np.cos(angle), np.sin(angle))
    assert not (inside & ~open_).any() and open_.mean() < 0.5
    for k in range(0, 400, 20):
        assert not (inside[:, k : k + 20].any(1) & ~a.block_open(norms[k : k + 20], angle[k : k + 20])).any()


def test_op12_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.5], 1), (1, [1.0, 1.5], 1), (2, [1.0, 0.5], 2), (3, None, 1), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 1), (7, [1.0], 2), (8, [1.0, 0.5], None), (None, [1.0, 1.0], 2), (9, [3e30, 1.0], 2), (10, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert as_rows(negatives.hard_negatives(df)) == [(0, 1, 1, 2, 256 * 256 + 512 * 384, 256 * 256 + 512 * 128)]
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.where("vec_id = 0")).count() == 0
    # sums beyond double precision
    big = [(0, [2.0**20, 3.0], 1), (1, [2.0**20, 5.0], 1), (2, [2.0**19, 3.0], 2), (3, [2.0**19, 2.0], 2)]
    got = as_rows(negatives.hard_negatives(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int"), scale=512))
    assert got == plain_negatives([(i, k, [int(512 * c) for c in v]) for i, v, k in big])


def plain_alignment(texts: list[str]):
    """n_a, n_b, n_groups, n_links, n_best, count_sum and hash of each text, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, m = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    t.encode_special_tokens = True
    a_bytes, b_bytes = crossing.ByteTokens(BYTE), crossing.PieceTokens(PIECE)
    held, counts = [], Counter()
    for text in texts:
        sides = ((a_bytes, t.encode(" " + text, add_special_tokens=False).ids), (b_bytes, m.encode(text))) if text else ()
        cut = [[v.joined(np.array([i])).tobytes() for i in ids] for v, ids in sides]
        if not text or any(b"".join(c) != (" " + text).encode() for c in cut):
            held.append(None)
            continue
        (a, b), (ea, eb) = [ids for _, ids in sides], [np.cumsum([len(x) for x in c]).tolist() for c in cut]
        groups, links, i, j, p, q = [], [], 0, 0, 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            if ea[i] == eb[j]:
                groups.append(f"{','.join(map(str, a[p : i + 1]))}|{','.join(map(str, b[q : j + 1]))}")
                i, j = i + 1, j + 1
                p, q = i, j
            elif ea[i] < eb[j]:
                i += 1
            else:
                j += 1
        counts.update(links)
        held.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for h in held:
        if h is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = h
        out.append((na, nb, len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def test_op13_equals_token_by_token(spark, documents, texts):
    more = mixed_texts(600, 2)
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(more)], "doc_id long, text string"))
    want = sorted([*zip((str(i) for i, _ in texts), (plain := plain_alignment([t for _, t in texts] + more)), strict=False), *zip((str(-k - 1) for k in range(len(more))), plain[len(texts) :], strict=True)])
    for block in (crossing.COUNTS, 2000):
        got = crossing.cross_aligned(df, BYTE, PIECE, block)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((str(r[0]), tuple(r)[1:]) for r in got.collect()) == want


def test_op13_cuts_are_the_common_ends():
    rng = np.random.default_rng(6)
    for share in (0.02, 0.3, 0.9, 1.0):
        a, b, tops, base = [], [], [], 0
        for _ in range(20):
            n = int(rng.integers(1, 400))
            for side in (a, b):
                side += [base + e for e in sorted({n, *np.flatnonzero(rng.random(n) < share).tolist()} - {0})]
            base += n
            tops.append(len(a) - 1)
        cuts = crossing.shared_cuts(np.array(a), np.array(b), np.array(tops))
        assert [a[k] for k in cuts] == sorted(set(a) & set(b))
    # far from the middle, and none at all inside
    a, b = np.arange(1, 100_002) * 2, np.r_[2, np.arange(1, 100_001) * 2 + 1, 200_002]
    assert a[crossing.shared_cuts(a, b, np.array([len(a) - 1]))].tolist() == [2, 200_002]


def test_op13_empty(spark, empty):
    assert crossing.cross_aligned(empty, BYTE, PIECE).count() == 0
    df = spark.createDataFrame([("x", None), ("y", ""), ("z", "▁")], "doc_id string, text string")
    assert {tuple(r)[1:] for r in crossing.cross_aligned(df, BYTE, PIECE).collect()} == {(0, 0, 0, 0, 0, 0, "")}
