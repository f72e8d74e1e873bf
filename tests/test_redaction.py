"""The automaton against trying every pattern at every place, and JSON trees."""

from __future__ import annotations

import json
import random

from threadloom.operators import redaction as R


def plain(text: str, patterns: list[str]) -> str:
    out, at = "", 0
    while at < len(text):
        fits = [p for p in patterns if p and text.startswith(p, at)]
        out += R.REDACTED if fits else text[at]
        at += len(max(fits, key=len)) if fits else 1
    return out


def test_leftmost_longest():
    rng = random.Random(1)
    for _ in range(400):
        alphabet = rng.choice(["ab", "ab.*", "a\\E(", "é😀x"])
        patterns = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 6))]
        text = "".join(rng.choice(alphabet) for _ in range(40))
        assert R.Redactor(patterns).text(text) == (plain(text, patterns), False)


def test_it_fails_closed_beyond_its_bounds():
    assert R.Redactor([f"p{k}" for k in range(256)]).text("p3") == (R.REDACTED, False)
    assert R.Redactor([f"p{k}" for k in range(257)]).text("harmless") == (R.HIDDEN, True)
    assert R.Redactor([f"p{k}" for k in range(256)] * 2).text("p3") == (R.REDACTED, False)
    assert R.Redactor(["x" * (256 * 1024 + 1)]).preview("harmless") == (R.HIDDEN, True)


def test_cuts_keep_whole_characters():
    assert R.Redactor(["b"]).text("é😀b", 5) == ("é", True)
    assert R.Redactor([]).text("é😀", 6) == ("é😀", False)


def test_trees():
    value = {"password": {"a": 1}, "list": [{"x_api_key": "s"}, "hide me", 5, None, True], "hideous": "no"}
    shown, cut = R.Redactor(["hide me"]).preview(json.dumps(value))
    assert json.loads(shown) == {"password": R.REDACTED, "list": [{"x_api_key": R.REDACTED}, R.REDACTED, 5, None, True], "hideous": "no"} and not cut
    assert R.Redactor(["1"]).preview('{"a": 1}') == (R.HIDDEN, True)
    assert R.Redactor(["a"]).preview("a text") == (f"{R.REDACTED} text", False)
    assert R.Redactor(["name"]).preview('{"name": 2}') == (f'{{"{R.REDACTED}":2}}', False)


def test_null_texts_stay_null_and_too_many_patterns_close_it(spark):
    df = spark.createDataFrame([(1, None), (2, "a b")], "key long, text string")
    assert [tuple(r) for r in R.redacted(df, ["b"]).orderBy("key").collect()] == [(1, None, None), (2, f"a {R.REDACTED}", False)]
    assert [r.preview for r in R.redacted(df, [f"p{k}" for k in range(400)]).orderBy("key").collect()] == [None, R.HIDDEN]
