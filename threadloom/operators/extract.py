"""Facts from source texts: Python definitions, imports, calls and routes by the standard library's parser; environment names by pattern.

Spark partitions the files; the parser is a helper for one file, which yields at most MOST facts, and tells when it stopped short.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 5_000
FACTS = "relative_path string, kind string, label string, owner string, line int, end_line int, confidence double, truncated boolean"
ROUTE_METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")


def python_file(text: str) -> Iterator[tuple[str, str, str | None, int, int, float | None]]:
    """(kind, label, owner, line, end_line, confidence) in the order of the source; nothing for a text that isn't Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    routed = any("fastapi" in ast.unparse(n).lower() for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)))
    todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while todo:
        node, owner = todo.pop()
        inside = owner
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if owner and owner[:1].isupper() else "function"
            yield kind, node.name, owner, node.lineno, node.end_lineno, None
            inside = node.name
            for d in node.decorator_list if routed else ():
                f = d.func if isinstance(d, ast.Call) else None
                if isinstance(f, ast.Attribute) and f.attr in ROUTE_METHODS and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                    yield "endpoint", f"{f.attr.upper()} {d.args[0].value}", node.name, d.lineno, d.end_lineno, None
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            yield "module", ast.unparse(node), owner, node.lineno, node.end_lineno, None
        elif isinstance(node, ast.Call):
            yield "callTarget", ast.unparse(node.func)[:256], owner, node.lineno, node.end_lineno, 0.55
        todo += [(child, inside) for child in reversed(list(ast.iter_child_nodes(node)))]


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of the Python files among (relative_path, text)."""

    def work(batches: Iterator) -> Iterator:
        from itertools import islice

        import pandas as pd

        columns = [c.split()[0] for c in FACTS.split(", ")]
        for b in batches:
            rows = []
            for path, text in zip(b["relative_path"], b["text"], strict=True):
                found = list(islice(python_file(text or ""), MOST + 1))
                rows += [(path, *f, len(found) > MOST) for f in found[:MOST]]
            yield pd.DataFrame(rows, columns=columns)

    return files.where(F.col("relative_path").rlike(r"\.pyi?$")).select("relative_path", "text").mapInPandas(work, FACTS)


def contains_edges(facts: DataFrame) -> DataFrame:
    """(source, target, kind): the file, or the one definition of the owner's name in it, holds each fact."""
    owners = facts.where(F.col("kind").isin("class", "function", "method")).groupBy("relative_path", F.col("label").alias("owner")).agg(F.count("*").alias("n"))
    held = facts.join(owners, ["relative_path", "owner"], "left")
    source = F.when(F.col("n") == 1, F.concat_ws("#", "relative_path", "owner")).otherwise(F.col("relative_path"))
    return held.select(source.alias("source"), F.concat_ws("#", "relative_path", "label").alias("target"), F.lit("contains").alias("kind")).distinct()


def environment_names(files: DataFrame, most: int = 32) -> DataFrame:
    """(relative_path, name): the environment variables that code and configuration read, the first `most` of each file by name."""
    pattern = r"(?:environ(?:\.get)?[\[(]\s*[\"']|getenv\(\s*[\"']|process\.env\.|process\.env\[[\"']|env::var\(\")([A-Z][A-Z0-9_]*)"
    names = files.select("relative_path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("name"))
    ranked = names.groupBy("relative_path").agg(F.slice(F.sort_array(F.collect_set("name")), 1, most).alias("names"))
    return ranked.select("relative_path", F.explode("names").alias("name"))
