"""Structure of written documents: fenced regions, headings of four formats, paragraphs, what contains what and what follows.

A small automaton reads the lines of one document after the other (tasks hold one at a time): which lines are fenced or rules, which are headings,
which make up a paragraph, and under which heading each stands: the nearest before it with a smaller level. All else is Spark's: sentences of
paragraphs, edges, order. Columns are those of an editor: they count UTF-16 units, from 1; lines from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.operators.documents import sentences_of
from threadloom.sources import tables as T

# Extensions of each format, levels of underlines, marks of the deepest level.
FORMATS = {"md": "markdown", "markdown": "markdown", "mdx": "markdown", "rst": "rst", "adoc": "asciidoc", "asciidoc": "asciidoc", "txt": "plain"}
UNDERLINES = {"markdown": {"=": 1, "-": 2}, "rst": {"=": 1, "-": 2, "~": 3, "^": 4} | dict.fromkeys("\"'`:._*+#", 5)}
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)", re.DOTALL).fullmatch
DIRECT = {"markdown": re.compile(r"(\s{0,3})(#{1,6})(?:\s(.*))?", re.DOTALL).fullmatch, "asciidoc": re.compile(r"(\s*)(={1,6})(?:\s(.*))?", re.DOTALL).fullmatch}
CLOSING = re.compile(r"\s#+$").search
PARTS = "part int, kind string, level int, style string, line int, start_column int, end_column int, owner int, body string"


def units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def fenced(lines: list[str], form: str) -> list[bool]:
    """Which lines belong to fenced regions, their first and last ones included. A region without an end runs to the end of the document."""
    out, end, armed = [], None, False
    for line in lines:
        bare = line.strip()
        if form == "asciidoc":
            if end is not None:
                out.append(True)
                end = None if bare == end else end
            elif bare.startswith("[source") and bare.endswith("]"):
                out.append(True)
                armed = True
            else:
                opens = armed and bare in ("----", "....")
                out.append(opens)
                end, armed = (bare, False) if opens else (None, armed and not bare)
            continue
        mark = FENCE(line)
        out.append(end is not None or mark is not None)
        if end is None:
            end = mark[1] if mark else None
        elif mark and mark[1].startswith(end) and not mark[2].strip(" \t\r\f\v"):
            end = None
    return out


def parts_of(text: str, form: str) -> Iterator[tuple]:
    """(part, kind, level, style, line, start, end, owner, body) of each heading and paragraph; owner: the part that it stands under, or None."""
    lines = [line.removesuffix("\r") for line in text.split("\n")]
    closed = fenced(lines, form)
    heads: dict[int, tuple[int, str, str]] = {}
    if form in DIRECT:
        for k, line in enumerate(lines):
            m = None if closed[k] else DIRECT[form](line)
            if m and (body := (m[3] or "").strip()):
                if form == "markdown" and (c := CLOSING(" " + body)):
                    body = (" " + body)[: c.start()].strip()
                if body:
                    heads[k] = (len(m[2]), "atx" if form == "markdown" else "asciiDoc", body)
    for k, line in enumerate(lines):
        rule = line.strip()
        level = UNDERLINES.get(form, {}).get(rule[:1])
        if closed[k] or level is None or len(rule) < 3 or rule.strip(rule[0]):
            continue
        closed[k] = True
        if k and not closed[k - 1] and k - 1 not in heads and (above := lines[k - 1].strip()):
            heads[k - 1] = (level, "setext" if form == "markdown" else "reStructuredTextUnderline", above)
    open_: list[tuple[int, int]] = []
    part, held, first = 0, [], 0

    def owner() -> int | None:
        return open_[-1][1] if open_ else None

    for k, line in enumerate([*lines, ""]):
        plain = k < len(lines) and k not in heads and not closed[k] and line.strip()
        if plain:
            first = first if held else k
            held.append(line)
            continue
        if held:
            start = units(held[0]) - units(held[0].lstrip()) + 1
            yield part, "paragraph", None, None, first + 1, start, units(held[-1].rstrip()) + 1, owner(), "\n".join(held).strip()
            part, held = part + 1, []
        if k in heads and k < len(lines):
            level, style, body = heads[k]
            while open_ and open_[-1][0] >= level:
                open_.pop()
            start = units(line[: line.index(body)]) + 1
            yield part, "heading", level, style, k + 1, start, start + units(body), owner(), body
            open_.append((level, part))
            part += 1


def structure(documents: DataFrame) -> DataFrame:
    """(key, part, nth, kind, level, style, line, start_column, end_column, owner, label) of documents (key, text, form): headings and sentences."""

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4, pa.string()]
        names = ["key", *(c.split()[0] for c in PARTS.split(", "))]
        for b in it:
            for at in range(b.num_rows):
                rows = list(parts_of(b.column("text")[at].as_py() or "", b.column("form")[at].as_py() or "plain"))
                if rows:
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array([at] * len(rows))), *cols], names=names)

    key = documents.schema["key"].dataType.simpleString()
    parts = documents.select("key", "text", "form").mapInArrow(work, f"key {key}, {PARTS}")
    labels = F.when(F.col("kind") == "heading", F.array("body")).otherwise(sentences_of(F.col("body")))
    each = parts.select("*", F.posexplode(labels).alias("nth", "label"))
    return each.select("key", "part", "nth", F.when(F.col("kind") == "heading", "heading").otherwise("sentence").alias("kind"), "level", "style", "line", "start_column", "end_column", "owner", "label")


def contains(found: DataFrame) -> DataFrame:
    """(key, owner, part, nth): each segment under the heading that holds it, or under the file (owner null)."""
    return found.select("key", "owner", "part", "nth")


def follows(found: DataFrame) -> DataFrame:
    """(key, part, nth, next_part, next_nth): each segment and the one after it."""
    order = Window.partitionBy("key").orderBy("part", "nth")
    return found.select("key", "part", "nth", F.lead("part").over(order).alias("next_part"), F.lead("nth").over(order).alias("next_nth")).where("next_part is not null")


#: Around the given texts, by doc_id: a title before, notes and a fenced part behind, in each format.
AROUND = {
    0: ("markdown", "# Part\n\n", "\n\n  ## Notes ##\n```\n# no heading\n```\n😀 Then this.\n---\nLast words. And more"),
    1: ("rst", "Part\n====\n\n", "\n\nNotes\n-----\n~~~\nno heading\n-----\n~~~\n😀 Then this.\n^^^^^\n  Last words. And more"),
    2: ("asciidoc", "= Part\n\n", "\n\n== Notes\n[source,x]\n----\n= no heading\n----\n=== 😀 Then this.\nLast words. And more"),
    3: ("plain", "# Part\n\n", "\n\nNotes\n=====\nLast words. And more"),
}


def given_documents(spark, sf_dir: str) -> DataFrame:
    d = T.files(spark, sf_dir).select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    pick = lambda at: F.element_at(F.array(*(F.lit(AROUND[k][at]) for k in range(4))), F.expr("cast(key % 4 as int) + 1"))
    return d.select("key", pick(0).alias("form"), F.concat(pick(1), "text", pick(2)).alias("text"))


LINES = "SELECT doc_id, doc_id % 4 AS f, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents"


@query(
    "x10_headings",
    f"""WITH d AS ({LINES}) SELECT doc_id, level, style, CAST(line AS INTEGER) AS line, start_column, end_column, label, owner FROM (
    SELECT doc_id, 1 AS level, ['atx', 'reStructuredTextUnderline', 'asciiDoc'][f + 1] AS style, 1 AS line, [3, 1, 3][f + 1] AS start_column, [7, 5, 7][f + 1] AS end_column, 'Part' AS label, CAST(NULL AS VARCHAR) AS owner FROM d WHERE f < 3
    UNION ALL SELECT doc_id, 2, ['atx', 'reStructuredTextUnderline', 'asciiDoc'][f + 1], n + [4, 5, 4][f + 1], [6, 1, 4][f + 1], [11, 6, 9][f + 1], 'Notes', 'Part' FROM d WHERE f < 3
    UNION ALL SELECT doc_id, [2, 4, 3][f + 1], ['setext', 'reStructuredTextUnderline', 'asciiDoc'][f + 1], n + [8, 11, 9][f + 1], [1, 1, 5][f + 1], [14, 14, 18][f + 1], '😀 Then this.', ['Part', 'Notes', 'Notes'][f + 1] FROM d WHERE f < 3)""",
)
def x10(spark, sf_dir):
    """Headings of every document, with their places and the heading above each."""
    found = structure(given_documents(spark, sf_dir)).where("kind = 'heading'")
    above = found.select("key", F.col("part").alias("owner"), F.col("label").alias("owner_label"))
    return found.join(above, ["key", "owner"], "left").select(F.col("key").alias("doc_id"), "level", "style", "line", "start_column", "end_column", "label", F.col("owner_label").alias("owner"))


SPLIT = r"""len(list_filter(string_split(regexp_replace(p, '([.!?]["'')\]}”’]*)(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> ''))"""


@query(
    "x12_contains",
    rf"""WITH p AS (SELECT doc_id, doc_id % 4 AS f, unnest(regexp_split_to_array(coalesce(text, ''), '\n\s*\n')) AS p FROM documents), s AS (SELECT doc_id, f, CAST(sum({SPLIT}) AS BIGINT) AS n FROM p GROUP BY ALL)
  SELECT doc_id, owner, sum(n)::BIGINT AS sentences FROM (
    SELECT doc_id, CASE WHEN f < 3 THEN 'Part' END AS owner, n FROM s WHERE n > 0 UNION ALL SELECT doc_id, NULL, 3 FROM s WHERE f = 3 UNION ALL SELECT doc_id, '😀 Then this.', 2 FROM s WHERE f < 3) GROUP BY ALL""",
)
def x12_contains(spark, sf_dir):
    """How many sentences stand under each heading, or under the file."""
    found = structure(given_documents(spark, sf_dir))
    heads = found.where("kind = 'heading'").select("key", F.col("part").alias("owner"), F.col("label").alias("owner_label"))
    mine = found.where("kind = 'sentence'").join(heads, ["key", "owner"], "left")
    return mine.groupBy(F.col("key").alias("doc_id"), F.col("owner_label").alias("owner")).agg(F.count("*").alias("sentences"))
