"""Operator 7: language identification by string kernels.

Kernel: blended-spectrum n-gram presence. A text is the set X of its distinct character n-grams of 1 to MAX_N lower-case
characters, hashed into 2^BITS places, and k(X, Z) = |X and Z| / sqrt(|X| |Z|). Nystrom: landmarks are training texts,
K(X, landmarks) times the inverse root of their own kernel matrix are the features of a one-versus-rest kernel ridge
regression. As the kernel is linear in the presence vector, landmarks, inverse root and coefficients fold into one matrix
(places by languages): a batch is scored by the product of its presence rows with it.

The classifier is fitted on a bounded sample: at most SAMPLE texts of each language (the ones with the smallest hashes
of their ids, one text an id), of which LANDMARKS are landmarks; each comes to the driver as two bitmaps of 2^BITS bits, whatever
its length.

A one-versus-rest score says which language is nearest, not whether it is near. So predict() can also judge. `near` is what the kernel itself says
for the language that it speaks for most: that score without its constant, which a text that shares nothing with the sample has alone. The model's
`least` for it is LEAST_NEAR, or less where a classifier of one half of the sample gives the other half less: half of what all but one in a hundred
of its texts have. Languages of other letters stay below it. A second guard, for languages that share letters with a learned one: `known`, the share of the n-grams of a text's words (tokens with digits and marks
aside) that two texts of the sample hold, whatever their language, SPARE forgiven. Its `floor` is LEAST_KNOWN, or less where the sample is too
small to hold even its own languages' n-grams: measured as what one half of it holds of the other.

Defined cases: a text that is null, empty or without a letter is `und` with score, near and known 0; with nothing to learn from, all are;
null lang or doc_id teaches nothing; rows that repeat are scored alike; ties go to the smaller name; other columns are left behind. Rows
without doc_id are not held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_N, BITS = 3, 16
SAMPLE, LANDMARKS, RIDGE = 300, 48, 1e-2
#: The least share of known n-grams, the unknown ones that any text may hold beside, and how many texts of the sample must hold an n-gram
#: (so that one of another language among them doesn't teach its own).
LEAST_KNOWN, SPARE, HELD_BY = 0.9, 4, 2
#: The least that the kernel says for a text's language (of the labelled documents of sf0.1, all have 0.06 or more; Greek, Russian, Chinese 0.04 or less).
LEAST_NEAR = 0.05
DIGIT = re.compile(r"\d").search
WORDS = re.compile(r"[^\W\d_]+").findall
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def places(text: str, flags: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a text. `flags`: zeros for all places, and zeros again afterwards."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    shift = np.uint32(32 - BITS)
    h = np.zeros(len(c), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for n in range(min(MAX_N, len(c))):
            h = (h[: len(c) - n] if n else h) * MULTIPLIERS[0] + c[n:] + np.uint32(n + 1)
            mixed = h ^ (h >> np.uint32(15))
            flags[(mixed * MULTIPLIERS[1]) >> shift] = 1
    out = np.flatnonzero(flags)
    flags[out] = 0
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def words(text: str) -> str:
    """The words of a text; tokens that hold a digit, and all marks, are left out."""
    return " ".join(WORDS(" ".join(w for w in text.split() if not DIGIT(w))))


def bitmaps(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, bits, word_bits): the places of each text and of its words. One text an id and language."""

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa

        flags = np.zeros(1 << BITS, dtype=np.uint8)

        def packed(text: str) -> bytes:
            flags[places(text, flags)] = 1
            out = np.packbits(flags).tobytes()
            flags[:] = 0
            return out

        for b in common.batches(it):
            texts = b.column("text").to_pylist()
            cols = [pa.array(map(packed, texts), pa.binary()), pa.array((packed(words(t)) for t in texts), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("doc_id"), *cols], names=["lang", "doc_id", "bits", "word_bits"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("text", "lang", "doc_id").mapInArrow(work, f"lang string, doc_id {id_type}, bits binary, word_bits binary")
    return found.groupBy("lang", "doc_id").agg(F.min(F.struct("bits", "word_bits")).alias("b")).select("lang", "doc_id", "b.bits", "b.word_bits")


@dataclass
class Model:
    langs: list[str]
    #: Its rows' sum over a text's places, over sqrt(their number), scores it; the last row is added.
    matrix: np.ndarray
    #: The places of the sample's words, and the least share of them that a text of a learned language has.
    seen: np.ndarray
    floor: float
    #: The least that the kernel says for a text of a learned language.
    least: float = LEAST_NEAR


def known_share(word_places: np.ndarray, seen: np.ndarray) -> float:
    """The share of a text's places that are seen, SPARE unseen ones forgiven."""
    n = len(word_places)
    return 1.0 if not n else min(1.0, (int(seen[word_places].sum()) + SPARE) / n)


def nearness(scores: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """What the kernel says for the language that it speaks for most, by text."""
    return (scores - constant).max(-1)


def solve(langs: list[str], of: list[str], bits: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> np.ndarray:
    """The folded matrix, from the bitmaps (a row a text) and languages of training texts."""
    y = np.array([[1.0 if x == k else -1.0 for k in langs] for x in of])
    marks = np.concatenate([[i for i, x in enumerate(of) if x == k][:landmarks] for k in langs]).astype(int)

    def presence(some: np.ndarray) -> np.ndarray:
        x = np.unpackbits(some, axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    z = presence(bits[marks])
    # bitmaps are unpacked a block at a time: all of them at once would be the driver's largest object
    kernel = np.vstack([presence(bits[k : k + 64]) @ z.T for k in range(0, len(bits), 64)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([kernel @ root, np.ones((len(of), 1))])
    weight = (1 / (y > 0).sum(0))[(y > 0).argmax(1)][:, None]  # languages count alike
    beta = np.linalg.solve(phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1]) * weight.mean(), phi.T @ (y * weight))
    folded = z.T @ (root @ beta[:-1]).astype(np.float32)
    return np.vstack([folded.astype(np.float64), beta[-1:]])


def fit(labelled: DataFrame, per_language: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The classifier, from rows (doc_id, text, lang)."""
    usable = common.whole_texts(labelled, "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("doc_id", "lang").withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language).select("doc_id").distinct()
    rows = bitmaps(usable.join(F.broadcast(ids), "doc_id", "left_semi")).collect()  # bounded: per_language ids a language, two bitmaps each
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["bits"])))
    of = [r["lang"] for r in rows]
    bits, word_bits = (np.frombuffer(b"".join(bytes(r[c]) for r in rows), dtype=np.uint8).reshape(len(rows), -1) for c in ("bits", "word_bits"))
    langs = sorted(set(of))
    held = [np.zeros(1 << BITS, dtype=np.int32) for _ in range(2)]  # by how many texts of either half
    for k, w in enumerate(word_bits):
        held[k % 2] += np.unpackbits(w)
    seen = held[0] + held[1] >= HELD_BY
    # what one half of the sample knows of the other
    shares = [known_share(np.flatnonzero(np.unpackbits(w)), held[0] >= HELD_BY) for w in word_bits[1::2]] or [1.0]
    floor = min(LEAST_KNOWN, 1 - 2 * (1 - float(np.quantile(shares, 0.01))))
    return Model(langs, solve(langs, of, bits, landmarks, ridge), seen, floor, _least(langs, of, bits, landmarks, ridge))


def _least(langs: list[str], of: list[str], bits: np.ndarray, landmarks: int, ridge: float) -> float:
    """Half of the nearness that all but one in a hundred texts of one half of the sample have by a classifier of the other; LEAST_NEAR at most."""
    if set(of[::2]) != set(langs) or len(of) < 2:
        return 0.0  # too small to say
    matrix = solve(langs, of[::2], bits[::2], landmarks, ridge)
    found = []
    for b in bits[1::2]:
        x = np.flatnonzero(np.unpackbits(b))
        found.append(float(nearness(matrix[x].sum(0) / np.sqrt(max(len(x), 1)), 0.0)))
    return min(LEAST_NEAR, max(0.0, float(np.quantile(found, 0.01)) / 2))


def predict(docs: DataFrame, model: Model | None, *keep: str, judge: bool = False) -> DataFrame:
    """doc_id, lang_pred and score (its share of the languages' exponential scores) of whole texts, with `judge` also `near` and `known`; `keep`: more
    columns, none of them named like those."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole_"), *keep)
    rest = [f for f in source.schema if f.name != "whole_"]
    schema = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField(c, T.DoubleType()) for c in ("near", "known")] if judge else [])])

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        flags = np.zeros(1 << BITS, dtype=np.uint8)
        for b in common.batches(it, column="whole_"):
            names, scores, near, known, at, rows, sizes = [], [], [], [], [], [], []
            for i, t in enumerate(b.column("whole_").to_pylist()):
                names.append("und")
                scores.append(0.0)
                near.append(0.0)
                known.append(0.0)
                if m and has_letter(t):
                    rows.append(p := places(t, flags))
                    sizes.append(len(p))
                    at.append(i)
                    if judge:
                        known[-1] = known_share(places(words(t), flags), m.seen)
            if at:
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                out = np.add.reduceat(m.matrix[np.concatenate(rows)], starts, axis=0) / np.sqrt(sizes)[:, None] + m.matrix[-1]
                for i, x in zip(at, nearness(out, m.matrix[-1]), strict=True):
                    near[i] = float(x)
                e = np.exp(3 * (out - out.max(1, keepdims=True)))
                e /= e.sum(1, keepdims=True)
                for i, k, s in zip(at, e.argmax(1), e.max(1), strict=True):
                    names[i], scores[i] = m.langs[k], float(s)
            kept = [(n, b.column(n)) for n in b.schema.names if n != "whole_"]
            more = [("lang_pred", pa.array(names)), ("score", pa.array(scores)), *([("near", pa.array(near)), ("known", pa.array(known))] if judge else [])]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + more], names=[n for n, _ in kept + more])

    return source.mapInArrow(work, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(common.crc_bucket("doc_id", 5) != 0)


def op7_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, fit(training_rows(docs)))
    return out.select("doc_id", F.coalesce(common.crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
