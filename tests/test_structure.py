"""Document structure on small documents with known answers."""

from __future__ import annotations

import pytest

from threadloom.operators import structure as S


def heads(text: str, form: str):
    return [(p[2], p[8]) for p in S.parts_of(text, form) if p[1] == "heading"]


@pytest.mark.parametrize(("form", "text", "want"), [
    ("markdown", "# A\n## B ##\n###no\n#\n   ### C\n    # indented\n####### seven", [(1, "A"), (2, "B"), (3, "C")]),
    ("markdown", "A\n===\nB\n---\n\n---\nC\n--", [(1, "A"), (2, "B")]),
    ("markdown", "# A\n===\nB\n***", [(1, "A")]),
    ("markdown", "```\n# no\n````\n# yes", [(1, "yes")]),
    ("markdown", "````\n# no\n```\n# no\n```` x\n# no\n````  \n# yes", [(1, "yes")]),
    ("markdown", "~~~\n```\n# no\n~~~\n# yes\n```\n# open to the end", [(1, "yes")]),
    ("markdown", "    ```\n# yes", [(1, "yes")]),
    ("markdown", "# a#\n# b #c\n# d ###\r\n# e", [(1, "a#"), (1, "b #c"), (1, "d"), (1, "e")]),
    ("rst", "A\n=====\nB\n-----\nC\n^^^\nD\n***\n# no\n\n====\nE\n====", [(1, "A"), (2, "B"), (4, "C"), (5, "D"), (1, "E")]),
    ("asciidoc", "= A\n== B\n[source,py]\n----\n= no\n----\n[source]\n\n....\n= no\n....\n----\n=== C", [(1, "A"), (2, "B"), (3, "C")]),
    ("asciidoc", "[source]\ntext\n----\n= yes", [(1, "yes")]),
    ("plain", "# A\nB\n===", []),
    ("markdown", "", []),
])
def test_headings(form, text, want):
    assert heads(text, form) == want


def test_owners_are_the_nearest_shallower_headings():
    text = "zero\n# A\none\n### B\ntwo\n## C\nthree\n# D\nfour"
    rows = {p[8]: p for p in S.parts_of(text, "markdown")}
    over = {k: next((o[8] for o in rows.values() if o[0] == p[7]), None) for k, p in rows.items()}
    assert over == {"zero": None, "A": None, "one": "A", "B": "A", "two": "B", "C": "A", "three": "C", "D": None, "four": "D"}


def test_columns_count_utf16_units():
    rows = list(S.parts_of("  ## 😀 x ##\n\n 😀 a\nb 😀 ", "markdown"))
    assert rows[0][4:7] == (1, 6, 10) and rows[0][8] == "😀 x"
    assert rows[1][4:7] == (3, 2, 5) and rows[1][8] == "😀 a\nb 😀"


def test_edges(spark):
    df = spark.createDataFrame([(1, "# A\nOne. Two.\n\nThree", "markdown"), (2, None, "markdown"), (3, "x", None)], "key long, text string, form string")
    found = S.structure(df)
    labels = {(r.key, r.part, r.nth): r.label for r in found.collect()}
    assert sorted(labels.values()) == ["A", "One.", "Three", "Two.", "x"]
    chain = {labels[r.key, r.part, r.nth]: labels[r.key, r.next_part, r.next_nth] for r in S.follows(found).collect()}
    assert chain == {"A": "One.", "One.": "Two.", "Two.": "Three"}
    held = {labels[r.key, r.part, r.nth]: r.owner for r in S.contains(found).collect()}
    assert held == {"A": None, "One.": 0, "Two.": 0, "Three": 0, "x": None}
