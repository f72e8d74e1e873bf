"""Ignore rules against a plain reading of each path."""

from __future__ import annotations

import random

import pytest

from threadloom.operators import ignore


@pytest.mark.parametrize(("rules", "left", "out"), [
    ([("", "*.log")], ["a.txt", "log"], ["a.log", "x/y/b.log"]),
    ([("", "*.log"), ("", "!keep.log")], ["keep.log", "x/keep.log"], ["a.log"]),
    ([("", "/build")], ["x/build/a", "builds/a"], ["build/a", "build"]),
    ([("", "build/"), ("", "!build/keep.txt")], ["build"], ["build/keep.txt", "x/build/z/q"]),
    ([("", "a/*"), ("", "!a/b")], ["a/b/c", "a/b"], ["a/x", "a/x/y"]),
    ([("", "doc/**/x?.md")], ["doc/x.md", "other/doc/xa.md"], ["doc/xa.md", "doc/q/r/xb.md"]),
    ([("", "**/tmp"), ("", "logs/**")], ["tmpx", "logs"], ["tmp", "a/tmp/z", "logs/a/b"]),
    ([("", "*.txt"), ("sub", "!*.txt"), ("sub/deep", "no.txt")], ["sub/a.txt", "sub/deep/b.txt"], ["a.txt", "sub/deep/no.txt", "x/sub/a.txt"]),
    ([("", "[!ab]x"), ("", r"\#y"), ("", r"\!z"), ("", "# note"), ("", ""), ("", "q  ")], ["ax", "bx", "note"], ["cx", "#y", "!z", "q"]),
    ([("sub", "/a.(b)+")], ["a.(b)+", "sub/x/a.(b)+", "sub/ax(b)+"], ["sub/a.(b)+"]),
])
def test_rules(spark, rules, left, out):
    r = spark.createDataFrame([(f, k, p) for k, (f, p) in enumerate(rules)], "folder string, nth int, pattern string")
    got = {x.path: x.ignored for x in ignore.ignored(spark.createDataFrame([(p,) for p in left + out + [None]], "path string"), r).collect()}
    assert got == dict.fromkeys(left, False) | dict.fromkeys(out, True)


def glob(pattern: list[str], parts: list[str]) -> bool:
    """Whether a pattern's segments match a path's, one by one."""
    if not pattern:
        return not parts
    if pattern[0] == "**":
        if len(pattern) == 1:
            return bool(parts)
        return any(glob(pattern[1:], parts[k:]) for k in range(len(parts) + 1))

    def segment(p: str, s: str) -> bool:
        if not p:
            return not s
        if p[0] == "*":
            return any(segment(p[1:], s[k:]) for k in range(len(s) + 1))
        return bool(s) and p[0] in ("?", s[0]) and segment(p[1:], s[1:])

    return bool(parts) and segment(pattern[0], parts[0]) and glob(pattern[1:], parts[1:])


def plain(path: str, rules: list[tuple[str, int, str]]) -> bool:
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        verdict = False
        for folder, _, pattern in sorted(rules, key=lambda r: (r[0].count("/") + bool(r[0]), r[1])):
            home = folder.split("/") if folder else []
            if parts[: len(home)] != home or len(home) >= n:
                continue
            negated, text = pattern.startswith("!"), pattern.lstrip("!")
            if text.endswith("/") and n == len(parts):
                continue
            text = text.rstrip("/")
            segments = text.lstrip("/").split("/") if "/" in text else ["**", text]
            if glob(segments, parts[len(home) : n]):
                verdict = not negated
        if verdict:
            return True
    return False


def test_random_trees(spark):
    rng = random.Random(12)
    name = lambda: rng.choice(["a", "b", "ab", "c.x", "b.x"])
    part = lambda: rng.choice(["a", "b", "*", "?", "*.x", "a*", "**"])
    paths = sorted({"/".join(name() for _ in range(rng.randint(1, 4))) for _ in range(150)})
    for _ in range(3):
        rules = [(rng.choice(["", "a", "a/b", "ab"]), k, rng.choice(["", "", "!"]) + rng.choice(["", "/"]) + "/".join(part() for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "/"])) for k in range(9)]
        rules = [r for r in rules if "**/**" not in r[2] and r[2].strip("!/") != "**"]
        got = {x.path: x.ignored for x in ignore.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(rules, "folder string, nth int, pattern string")).collect()}
        assert got == {p: plain(p, rules) for p in paths}, rules
