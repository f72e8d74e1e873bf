"""Redaction of known secrets by one automaton over all of them, and of JSON trees by the names of their fields.

The automaton is built once a task and finds all occurrences in one pass, however many patterns there are; the leftmost, then longest, are masked. Beyond its bounds
on patterns it fails closed: nothing of a text is shown. What is cut to a number of bytes ends with a whole character.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.sources import tables as T

# Bounds, and what stands in the place of a secret.
PATTERNS, PATTERN_BYTES, SHOWN_BYTES = 256, 256 * 1024, 1 << 20
#: Texts that are Python objects at a time.
SENT_ROWS = 256
REDACTED, HIDDEN = "[REDACTED]", "[CONTENT HIDDEN: REDACTION LIMIT]"
SENSITIVE = re.compile("|".join(X.SENSITIVE_TOKENS)).search


class Redactor:
    """Masks what a bounded set of patterns finds; closed if there are too many of them."""

    def __init__(self, patterns):
        import ahocorasick

        held = sorted({p for p in patterns if p})
        self.closed = len(held) > PATTERNS or sum(len(p.encode()) for p in held) > PATTERN_BYTES
        self.finder = None
        if held and not self.closed:
            self.finder = ahocorasick.Automaton()
            for p in held:
                self.finder.add_word(p, len(p))
            self.finder.make_automaton()

    def text(self, value: str, most: int = SHOWN_BYTES) -> tuple[str, bool]:
        """The masked text in at most so many bytes, and whether it was cut (a closed redactor's always is)."""
        if self.closed:
            return HIDDEN, True
        longest: dict[int, int] = {}
        for end, size in self.finder.iter(value) if self.finder else ():
            longest[end + 1 - size] = max(size, longest.get(end + 1 - size, 0))
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                out += [value[at:start], REDACTED]
                at = start + longest[start]
        whole = "".join([*out, value[at:]])
        shown = whole.encode("utf-8", "surrogatepass")
        if len(shown) <= most:
            return whole, False
        return shown[:most].decode("utf-8", "ignore"), True

    def tree(self, value):
        """A JSON value whose fields of sensitive names are masked, and whose texts are masked like others."""
        if isinstance(value, dict):
            return {k: REDACTED if SENSITIVE(re.sub("[^A-Za-z0-9]", "", k).lower()) else self.tree(v) for k, v in value.items()}
        if isinstance(value, list):
            return [self.tree(v) for v in value]
        return self.text(value)[0] if isinstance(value, str) else value

    def preview(self, value: str, most: int = SHOWN_BYTES) -> tuple[str, bool]:
        """A text, or a JSON document as such: masked before it is parsed, since a secret may be a name or a number in it. What was JSON and is none any
        more is hidden."""
        if self.closed:
            return HIDDEN, True
        masked, cut = self.text(value, most)
        try:
            tree = json.loads(masked)
        except ValueError:
            return (HIDDEN, True) if _is_json(value) else (masked, cut)
        if isinstance(tree, str | int | float | bool) or tree is None:
            return masked, cut
        shown = json.dumps(self.tree(tree), ensure_ascii=False, separators=(",", ":"))
        within = shown.encode("utf-8", "surrogatepass")
        return (shown, cut) if len(within) <= most else (within[:most].decode("utf-8", "ignore"), True)


def _is_json(value: str) -> bool:
    try:
        json.loads(value)
    except ValueError:
        return False
    return True


def redacted(rows: DataFrame, patterns: list[str], column: str = "text", most: int = SHOWN_BYTES) -> DataFrame:
    """rows (key, ...) as (key, preview, cut): the column's texts masked; null texts stay null."""
    secrets = rows.sparkSession.sparkContext.broadcast(list(patterns[: PATTERNS + 1]))  # one more than the bound closes it, as all would

    def work(it: Iterator) -> Iterator:
        import pyarrow as pa

        redactor = Redactor(secrets.value)
        for b in (whole.slice(at, SENT_ROWS) for whole in it for at in range(0, whole.num_rows, SENT_ROWS)):
            found = [(None, None) if t is None else redactor.preview(t, most) for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_())], names=["key", "preview", "cut"])

    return rows.select("key", column).mapInArrow(work, f"key {rows.schema['key'].dataType.simpleString()}, preview string, cut boolean")


GIVEN = ("token", 'token = "', "license", "the", "the ", "in", "int", "$$$", "***", "###", "(", "\\E", "a+")
ALTERNATIVES = "|".join(re.sub(r"([\\$*(+])", r"\\\1", p) for p in sorted(GIVEN, key=lambda p: (-len(p), p))).replace("'", "''")


@query("p20_automaton", f"SELECT doc_id, md5(regexp_replace(text, '{ALTERNATIVES}', '[REDACTED]', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def p20_automaton(spark, sf_dir):
    """Texts without what thirteen patterns find, some of which hold or overlap others."""
    d = T.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("key"), "text")
    return redacted(d, list(GIVEN)).select(F.col("key").alias("doc_id"), F.md5("preview").alias("digest"))


@query(
    "p19_json_fields",
    f"""WITH {T.EVENTS} SELECT event_id, '{{"kind":"' || kind || '","auth":{{"Api-Key":"[REDACTED]","list":[' || event_id || ',{{"setCookie":"[REDACTED]","note":"a [REDACTED] b"}}]}}}}' AS preview FROM runtime_events""",
)
def p19_json(spark, sf_dir):
    """Events as JSON trees with fields that only their names give away, and texts that hold a secret."""
    e = T.runtime_events(spark, sf_dir)
    tree = F.concat(F.lit('{"kind": "'), "kind", F.lit('", "auth": {"Api-Key": {"deep": 1}, "list": ['), F.col("event_id").cast("string"), F.lit(', {"setCookie": "x", "note": "a hunter2 b"}]}}'))
    return redacted(e.select(F.col("event_id").alias("key"), tree.alias("text")), ["hunter2", "hunter"]).select(F.col("key").alias("event_id"), "preview")
