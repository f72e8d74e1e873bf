"""Operator 5: toxicity by multiple-instance learning.

A document is a bag of sentences; sentence s is toxic with probability p(s), a logistic function of its words; the
document with 1 - prod(1 - p(s)) (noisy-or). Weights are trained from document labels alone, through that product, and
the sentence probabilities then locate what is offending.

Words count through themselves and their first 3 to 6 characters. Fitting uses a bounded sample: labelled ids whose hash falls
under SAMPLE ids in expectation, of texts of at most LONGEST characters, and CHARACTERS of them in all in expectation. Over it Spark
counts, for each feature, how many documents of either class hold it; the FEATURES most telling ones go into the model, and sentences that
hold any of them come to the driver as ids.

Defined cases: null and empty texts have no sentence and are scored as one sentence without words; without labels of
both kinds every score is 1 if there is a label 1, else 0; rows that repeat are scored alike, and of an id's rows one teaches; a label other
than 0 and 1 teaches nothing; of labels that contradict each other, 1 counts; rows without doc_id teach nothing and aren't held out; other
columns are left behind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, FEATURES, THRESHOLD = 20_000, 3_000, 0.3
#: Characters of a text that may teach, and of all that teach.
LONGEST, CHARACTERS = 1_000_000, 200_000_000
#: Least documents of the sample that hold a feature.
LEAST = 5
REMEMBERED = 500_000
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WORDS = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> set[str]:
    return {word + "$", *(f"{word[:n]}^" for n in range(3, min(7, len(word) + 1)))}


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s] or [""]


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, pos, neg): the documents of either class that hold it."""

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa

        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for b in common.batches(it):
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                counts[y].update({f for w in set(WORDS(t.lower())) for f in features(w)})
        for at in (0, 1):
            names = list(counts[at])
            for k in range(0, len(names), 20_000):
                part = names[k : k + 20_000]
                n = pa.array([counts[at][f] for f in part], pa.int64())
                zero = pa.array([0] * len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part), n if at else zero, zero if at else n], names=["feature", "pos", "neg"])

    return sample.select("text", "y").mapInArrow(work, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def bags(sample: DataFrame, known: dict[str, int]) -> DataFrame:
    """(y, n, ids): the class, the number of sentences, and for each sentence that holds features their ids."""
    shared = sample.sparkSession.sparkContext.broadcast(known)

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa

        index = shared.value
        for b in common.batches(it):
            n, ids = [], []
            for t in b.column("text").to_pylist():
                parts = sentences(t.lower())
                n.append(len(parts))
                hits = ({index[f] for w in set(WORDS(s)) for f in features(w) if f in index} for s in parts)
                ids.append([sorted(h) for h in hits if h])
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.list_(pa.int32())))], names=["y", "n", "ids"])

    return sample.select("text", "y").mapInArrow(work, "y int, n long, ids array<array<int>>")


def train(rows: list, width: int, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the noisy-or likelihood of the documents' labels (Adam on all rows at once)."""
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    n = np.array([r["n"] for r in rows], dtype=np.float64)
    doc = np.repeat(np.arange(len(rows)), [len(r["ids"]) for r in rows])
    held = [s for r in rows for s in r["ids"]]
    sentence = np.repeat(np.arange(len(held)), [len(s) for s in held])
    feature = np.array([f for s in held for f in s], dtype=np.int64)
    bare = n - np.bincount(doc, minlength=len(rows))
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = -6.0
    for step in range(1, steps + 1):
        z = np.bincount(sentence, w[feature], len(held)) + w[-1]
        q = np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0)  # -log(1 - p)
        q0 = np.log1p(np.exp(w[-1]))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        total = np.maximum(np.bincount(doc, q, len(rows)) + bare * q0, 1e-9)
        pull = np.where(y > 0, 1 / np.expm1(np.minimum(total, 50)), -1.0)  # of the log-likelihood, by total
        gz = pull[doc] * p
        grad = np.append(np.bincount(feature, gz[sentence], width), gz.sum() + (pull * bare).sum() * p0) / len(rows)
        grad[:-1] -= decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w[-1] = np.clip(w[-1], -14, -4)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, width: int = FEATURES) -> tuple[dict[str, float], float, float | None]:
    """Weights by feature, the bias, and (where nothing can be learned) the constant score. `docs` and `labels` are the rows to learn from."""
    y = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = y.count()
    if n > sample:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    texts = common.whole_texts(docs).where(F.char_length("text") <= LONGEST).join(y, "doc_id").groupBy("doc_id", "y")
    picked = common.written(texts.agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxic_sample")
    size = picked.agg(F.sum(F.char_length("text"))).first()[0] or 0
    chosen = picked if size <= CHARACTERS else picked.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000)) < int(1_000_000 * CHARACTERS / size))
    sizes = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}, 0.0, float(sizes.get(1, 0) > 0)
    share = (F.col("pos") + F.col("neg")) / float(sizes[0] + sizes[1])
    z = F.abs(F.col("pos") / sizes[1] - F.col("neg") / sizes[0]) / F.sqrt(share * (1 - share) + 1e-6)
    best = feature_counts(chosen).where(F.col("pos") + F.col("neg") >= min(LEAST, sizes[1])).orderBy(F.desc(z), "feature").limit(width)
    known = {r["feature"]: k for k, r in enumerate(best.select("feature").collect())}
    weights, bias = train(bags(chosen, known).collect(), len(known))  # bounded by CHARACTERS: ids of sentences that hold features
    common.drop_written(picked)
    return {f: float(weights[k]) for f, k in known.items() if weights[k]}, bias, None


class Scorer:
    """Logits of sentences, with those of words remembered."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.seen: dict[str, float] = {}

    def word(self, w: str) -> float:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        x = self.seen[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return x

    def logits(self, text: str) -> tuple[list[str], np.ndarray]:
        parts = sentences(text)
        out = np.empty(len(parts))
        seen, get = self.seen, self.seen.get
        for k, s in enumerate(parts):
            words = set(WORDS(s.lower()))
            x = list(map(get, words))
            if None in x:
                x = [seen[w] if w in seen else self.word(w) for w in words]
            out[k] = sum(x)
        return parts, out + self.bias


def score(docs: DataFrame, model: tuple[dict[str, float], float, float | None], worst: int = 0, least: float = 0.0) -> DataFrame:
    """doc_id and score of whole texts; with `worst`, also that many sentences (sentence, probability), most toxic first, of texts that score
    `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa

        weights, bias, constant = shared.value
        scorer = Scorer(weights, bias)
        for b in common.batches(it):
            scores, found = [], []
            for t in b.column("text").to_pylist():
                parts, z = scorer.logits(t)
                total = np.logaddexp(0, z).sum()
                scores.append(float(-np.expm1(-total)) if constant is None else constant)
                if worst:
                    order = np.argsort(-z, kind="stable")[: worst if scores[-1] >= least else 0]
                    found.append([{"sentence": parts[i], "probability": float(1 / (1 + np.exp(-z[i])))} for i in order])
            cols = [b.column("doc_id"), pa.array(scores)]
            if worst:
                cols.append(pa.array(found, pa.list_(pa.struct([("sentence", pa.string()), ("probability", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "sentences"][: len(cols)])

    more = ", sentences array<struct<sentence string, probability double>>" if worst else ""
    return common.whole_texts(docs).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double{more}")


def op5_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = common.crc_bucket("doc_id", 4) != 2
    model = fit(docs.where(learn), common.table(spark, sf_dir, "labels").where(learn))
    out = score(docs, model, worst=1, least=THRESHOLD)
    held_out = F.coalesce(common.crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    located = F.get("sentences", F.lit(0))
    return out.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), located["sentence"].alias("sentence"), located["probability"].alias("probability"))
