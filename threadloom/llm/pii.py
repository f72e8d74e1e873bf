"""Operator 8: personal data by candidate gradient boosting, with DataFrame functions only.

Base spans follow fixed rules (email, ip, card, phone; see BASE) and always stay. Generators of high recall (PROPOSALS)
propose further spans that overlap them and each other: written-out addresses, defanged hosts, cards and phones with other
separators. Each candidate has discrete features of its format and context, none of which is a rule's verdict; gradient-boosted trees of
two splits score it; a threshold for each kind, set on documents that the trees were not fitted on, selects what is redacted.

There are no labels for personal data, so the base rules label what they can judge: a match of a base pattern by its check, a proposal
that overlaps a base span of its kind as a positive, and one that breaks the kind's rule however it is read as a negative. What is left -
rewritings that would pass if they were plain - has no label and takes no part in the fit; those are what the trees judge. (Those alone: a
proposal must pass its kind's check when its separators are made plain, so the rule has the last word on what the trees accept.)

Fitting uses all documents; their labelled candidates are counted by Spark by feature values, of which there are few combinations
(FEATURES), so what reaches the driver doesn't grow with the documents. The trees are one SQL expression, so scoring is a projection: one pass
over the texts, no shuffle.

Defined cases: null texts are empty and have no spans; candidates of one kind never overlap (the leftmost stays, then
the longest), and none overlaps a base span; where there is nothing to learn from, only base spans are given; rows that repeat
are treated alike; offsets count code points; other columns are kept by redact() and left behind by the query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
# The given patterns, over texts in which joined() has marked what joins their parts: Java's engine recurses for each turn of a
# repeated group, so long runs would overflow its stack, while repeated character classes are loops. `(?:\G|(?<!...))`, and `++`
# where nothing could be given back, keep runs from being scanned anew from each of their characters. What matches is the same.
SEPARATOR, DOT = "\ue000", "\ue001"
BASE = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{SEPARATOR}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: One character between two that belong together, and its mark: it keeps every offset.
JOINT = {"email": (r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT), "card": (r"(?<=[0-9])[\x20-](?=[0-9])", SEPARATOR)}
#: What a text must hold for a kind's pattern to be tried.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{15}", "phone": r"\+[0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Generators of further candidates.
AT, STOP = r"\x20?(?:\(at\)|\[at\]|\{at\}|<at>)\x20?|\x20at\x20", r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|\(\.\)|\[\.\])\x20?|\x20dot\x20"
PROPOSALS = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:(?:{AT})[A-Za-z0-9-]{{1,63}}+(?:(?:{STOP})[A-Za-z0-9-]{{1,63}}+){{1,8}}|\x20?(?:\(at\)|\[at\]|\{{at\}}|<at>)\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?\.\x20?[A-Za-z0-9-]{{1,63}}+){{0,8}})",
    "ip": rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:(?:{STOP})[0-9]{{1,3}}){{3}}(?![0-9])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}(?:[./_\x20-][0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
}
PROPOSAL_HINT = {"email": r"(?i)[\(\[\{<]at[\)\]\}>]|\x20dot\x20", "ip": rf"(?i)[0-9](?:{STOP})[0-9]", "card": r"[0-9]{4}[./_\x20-][0-9]{4}[./_\x20-]", "phone": r"[0-9]{2}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3}"}
#: A proposal of an address that is one, once it is plain.
ADDRESS = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"
ROUNDS, RATE, LEAST_PRECISION = 30, 0.3, 0.9
#: The features of a candidate, and how many values each may have.
FEATURES = {"kind_": 4, "digits_": 8, "joints_": 4, "first_": 5, "group_": 4, "before_": 5, "after_": 4, "word_": 6}
#: Words before a candidate, by the value of word_.
CUES = ("tel|phone|call|fax|mobile", "mail|contact|write", "token|version|license|id|key|isbn|no|order", "card|visa|credit|pay", "ip|host|server|address|addr")
EMPTY = "array<struct<start:int,stop:int,hit:string,before:string,after:string>>"


def joined(text: Column, kind: str) -> Column:
    """The text with the joints of a kind marked, character for character; marks that it holds itself become spaces."""
    if kind not in JOINT:
        return text
    pattern, mark = JOINT[kind]
    return F.regexp_replace(F.translate(text, mark, " "), pattern, mark)


def based(text: Column, kind: str) -> Column:
    """The matches of a kind's base pattern."""
    return F.when(text.rlike(HINT[kind]), found(joined(text, kind), BASE[kind])).otherwise(F.array().cast(EMPTY))


def proposed(text: Column, kind: str) -> Column:
    """The matches of a kind's generator."""
    return F.when(text.rlike(PROPOSAL_HINT[kind]), found(text, PROPOSALS[kind])).otherwise(F.array().cast(EMPTY))


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, stop, hit, the 24 characters before, the one after)."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    pairs = F.transform(F.arrays_zip(pairs.alias("pair"), F.slice(pieces, 2, F.size(hits)).alias("next")), lambda x: F.struct(x["pair"]["p"].alias("p"), x["pair"]["h"].alias("h"), F.substring(x["next"], 1, 1).alias("n")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        stop = start + F.char_length(x["h"])
        one = F.struct(start.alias("start"), stop.alias("stop"), x["h"].alias("hit"), F.right(x["p"], F.lit(24)).alias("before"), x["n"].alias("after"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("out"))
    return F.aggregate(pairs, start, add, lambda acc: acc["out"])


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda x, i: F.when(i % 2 == 1, F.when(x >= 5, x * 2 - 9).otherwise(x * 2)).otherwise(x)
    total = F.aggregate(F.transform(F.split(F.reverse(d), ""), lambda c, i: value(c.cast("int"), i)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def obeys(kind: str, hit: Column) -> Column:
    """Whether a match passes the check of its kind."""
    n = F.length(digits(hit))
    return {
        "email": F.lit(True),
        "ip": hit.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$"),
        "card": F.when(n.between(16, 19), luhn(digits(hit))).otherwise(F.lit(False)),
        "phone": n.between(8, 15),
    }[kind]


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(based(text, kind), lambda m: obeys(kind, m["hit"]))


def plain(kind: str, hit: Column) -> Column:
    """A proposal with its separators made those of the base rule."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, f"(?i)(?:{AT})", "@"), f"(?i)(?:{STOP})", "."), r"\x20?\.\x20?", ".")
    if kind == "ip":
        return F.regexp_replace(hit, f"(?i)(?:{STOP})", ".")
    return digits(hit)


def sound(kind: str, hit: Column) -> Column:
    """Whether a proposal would be a base span if it were written plainly."""
    return plain(kind, hit).rlike(ADDRESS) if kind == "email" else obeys(kind, plain(kind, hit))


def featured(kind: str, m: Column) -> list[Column]:
    """The discrete features of a candidate, in the order of FEATURES."""
    hit, before, after = m["hit"], m["before"], m["after"]
    n, first = F.length(digits(hit)), F.substring(digits(hit), 1, 1)
    cue = F.lit(0)
    for k in range(len(CUES), 0, -1):
        cue = F.when(before.rlike(rf"(?i)(?:{CUES[k - 1]})[^A-Za-z]{{0,4}}$"), k).otherwise(cue)
    return [
        F.lit(KINDS.index(kind)),
        F.when(n == 0, 0).when(n < 7, 1).when(n < 9, 2).when(n < 11, 3).when(n < 13, 4).when(n < 16, 5).when(n == 16, 6).otherwise(7),
        # the joints as they are read, so that a rewriting looks like what it rewrites
        F.least(F.length(F.regexp_replace(plain(kind, hit) if kind in ("email", "ip") else hit, "[A-Za-z0-9]", "")), F.lit(3)),
        F.when(first == "", 0).when(first == "0", 1).when(first < "3", 2).when(first < "7", 3).otherwise(4),
        # the first digit of the greatest group of three digits
        F.when(hit.rlike("(?<![0-9])[3-9][0-9]{2}(?![0-9])"), 3).when(hit.rlike("(?<![0-9])2[0-9]{2}(?![0-9])"), 2).when(hit.rlike("(?<![0-9])[0-9]{3}(?![0-9])"), 1).otherwise(0),
        F.when((before == "") | before.rlike(r"\n$"), 0).when(before.rlike(r"\x20$"), 1).when(before.rlike("[\"'(<\\[:=]$"), 2).when(before.rlike("[0-9+.$-]$"), 3).otherwise(4),
        F.when(after.isNull() | (after == "") | (after == "\n"), 0).when(after.rlike("[\\x20,;.!?]"), 1).when(after.rlike("[\"')>\\]]"), 2).otherwise(3),
        cue,
    ]


def candidate(kind: str, m: Column, y: Column) -> Column:
    cols = [c.cast("int").alias(n) for n, c in zip(FEATURES, featured(kind, m), strict=True)]
    return F.struct(m["start"].alias("start"), m["stop"].alias("stop"), y.alias("y"), *cols)


def overlaps(spans: Column, m: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))


def labelled(text: Column, kind: str, base: Column) -> Column:
    """The candidates of one kind that the base rules can judge: y is 1 or 0."""
    raw = F.transform(based(text, kind), lambda m: candidate(kind, m, obeys(kind, m["hit"]).cast("int")))
    more = F.transform(proposed(text, kind), lambda m: candidate(kind, m, F.when(overlaps(base, m), 1).when(~sound(kind, m["hit"]), 0)))
    return F.filter(F.concat(raw, more), lambda c: c["y"].isNotNull())


class Boosted:
    """Gradient-boosted trees of two splits over discrete features, for the log-loss of weighted cells."""

    def __init__(self, cells: list[tuple[tuple[int, ...], int, int]], rounds: int = ROUNDS, rate: float = RATE):
        """cells: (feature values, negatives, positives)."""
        self.rate = rate
        x, neg, pos = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], dtype=float), np.array([c[2] for c in cells], dtype=float)
        self.base = math.log((pos.sum() + 1) / (neg.sum() + 1))
        self.trees: list[tuple] = []
        f = np.full(len(cells), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            grad, hess = pos - (neg + pos) * p, (neg + pos) * p * (1 - p)
            every = np.ones(len(cells), dtype=bool)
            if not (split := self._split(x, every, grad, hess)):
                break
            parts = []
            for side in (x[:, split[0]] <= split[1], x[:, split[0]] > split[1]):
                inner = self._split(x, side, grad, hess)
                low = side & (x[:, inner[0]] <= inner[1]) if inner else side
                parts.append((inner, *(float(grad[g].sum() / (hess[g].sum() + 1)) for g in (low, side & ~low))))
            self.trees.append((split, *parts))
            f = f + rate * np.array([self._value(self.trees[-1], c[0]) for c in cells])

    @staticmethod
    def _split(x: np.ndarray, inside: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int] | None:
        best, at = 1e-6, None
        g, h = grad[inside].sum(), hess[inside].sum()
        for k in range(x.shape[1]):
            of = x[inside, k]
            gl, hl = np.cumsum(np.bincount(of, grad[inside])), np.cumsum(np.bincount(of, hess[inside]))
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            for v in sorted(set(of.tolist()))[:-1]:
                if gain[v] > best:
                    best, at = gain[v], (k, int(v))
        return at

    @staticmethod
    def _value(tree: tuple, x: tuple[int, ...]) -> float:
        split, low, high = tree
        inner, a, b = low if x[split[0]] <= split[1] else high
        return a if inner is None or x[inner[0]] <= inner[1] else b

    def score(self, x: tuple[int, ...]) -> float:
        return self.base + self.rate * sum(self._value(t, x) for t in self.trees)

    def expression(self, feature: Callable[[str], Column]) -> Column:
        """score() of the features that `feature` gives by name."""
        names = list(FEATURES)

        def side(part: tuple) -> Column:
            inner, a, b = part
            return F.lit(a) if inner is None else F.when(feature(names[inner[0]]) <= inner[1], a).otherwise(b)

        out = F.lit(self.base)
        for (k, v), low, high in self.trees:
            out = out + F.lit(self.rate) * F.when(feature(names[k]) <= v, side(low)).otherwise(side(high))
        return out


#: The fitted trees, and the least score of each kind that may have proposals accepted.
Detector = tuple[Boosted | None, dict[str, float]]


def fit(docs: DataFrame) -> Detector:
    """Trees fitted on the labelled candidates of one half of the documents, and thresholds calibrated on those of the other."""
    text = F.col("text")
    part = common.whole_texts(docs).withColumns({f"base_{k}": base_spans(text, k) for k in KINDS})
    every = part.select(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("half"), F.explode(F.concat(*(labelled(text, k, F.col(f"base_{k}")) for k in KINDS))).alias("c"))
    counted = every.groupBy("half", *(f"c.{n}" for n in FEATURES)).agg(F.sum("c.y").alias("pos"), F.count("*").alias("all")).collect()  # a row a combination of feature values and half at most
    halves: tuple[list, list] = ([], [])
    for r in counted:
        halves[r["half"]].append((tuple(r[n] for n in FEATURES), r["all"] - r["pos"], r["pos"]))
    halves[0].sort()
    if not any(c[2] for c in halves[0]):
        return None, {}
    trees = Boosted(halves[0])
    limit = {}
    for k, kind in enumerate(KINDS):
        # the lowest score from which on the held-out candidates of the kind have the precision asked for
        tp = fp = 0
        by_score: dict[float, list[int]] = {}
        for x, bad, good in halves[1]:
            if x[0] == k:
                both = by_score.setdefault(trees.score(x), [0, 0])
                both[0] += bad
                both[1] += good
        for s in sorted(by_score, reverse=True):
            fp, tp = fp + by_score[s][0], tp + by_score[s][1]
            if tp and tp >= LEAST_PRECISION * (tp + fp):
                limit[kind] = s
    return trees, limit


def kept_apart(spans: Column) -> Column:
    """Of spans in order, those that don't overlap the one kept before."""
    kind = "array<struct<start:int,stop:int>>"

    def add(acc: Column, m: Column) -> Column:
        return F.when(m["start"] >= acc["at"], F.struct(m["stop"].alias("at"), F.concat(acc["out"], F.array(m)).alias("out"))).otherwise(acc)

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), add, lambda acc: acc["out"])


def accepted_spans(text: Column, kind: str, model: Detector, base: Column) -> Column:
    """The base spans of a kind and its accepted proposals that overlap no base span, in order."""
    own, (trees, limit) = F.col(f"base_{kind}"), model
    if kind not in limit:
        return own
    offered = F.transform(proposed(text, kind), lambda m: candidate(kind, m, sound(kind, m["hit"]).cast("int")))
    # the rounding of sums in two places
    chosen = F.filter(offered, lambda c: (c["y"] == 1) & ~overlaps(base, c) & (trees.expression(lambda n: c[n]) >= limit[kind] - 1e-9))
    return F.array_sort(F.concat(own, kept_apart(bare(chosen))))


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop")))


def detect(docs: DataFrame, model: Detector) -> DataFrame:
    """docs and, for each kind, base_<kind> and all_<kind>: arrays of (start, stop) in order."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumns({f"base_{k}": bare(base_spans(text, k)) for k in KINDS})
    base = F.concat(*(F.col(f"base_{k}") for k in KINDS))
    return out.withColumns({f"all_{k}": accepted_spans(text, k, model, base) for k in KINDS})


def spelled(prefix: str) -> Column:
    """kind:start:end of every span, by kind as listed and then by start, joined by commas."""

    def of(kind: str) -> Column:
        return F.transform(F.col(f"{prefix}_{kind}"), lambda m: F.concat(F.lit(f"{kind}:"), m["start"].cast("string"), F.lit(":"), m["stop"].cast("string")))

    return F.array_join(F.concat(*(of(k) for k in KINDS)), ",")


def redact(docs: DataFrame, model: Detector) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans become one."""
    columns = docs.columns
    found_ = detect(docs.select("doc_id", "text", F.struct(*(docs[c] for c in columns)).alias("row_")), model)

    def named(kind: str) -> Column:
        return F.transform(F.col(f"all_{kind}"), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(kind).alias("kind")))

    every = F.array_sort(F.concat(*(named(k) for k in KINDS)))

    def add(acc: Column, m: Column) -> Column:
        fresh = m["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, F.when(fresh, m["start"] - acc["at"]).otherwise(F.lit(0)))
        put = F.when(fresh, F.concat(gap, F.lit("["), m["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], m["stop"]).alias("at"), F.concat(acc["out"], F.array(put)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.aggregate(every, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.lit(2**31 - 1))))
    new = F.when(F.size(every) > 0, text).otherwise(F.col("text"))
    return found_.select(*(new.alias("text") if c == "text" else F.col("row_")[c].alias(c) for c in columns))


def op8_boosted_candidates_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = detect(docs, fit(docs))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("all").alias("spans"))
