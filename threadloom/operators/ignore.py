"""Ignore rules of source trees: an ordered table of patterns by folder, the last match of the deepest folder wins, and what an ignored folder holds
stays ignored.

Rules become regular expressions once. A path is every folder above it and itself; each of these meets the rules of the folders above it by an equal
join on the folder, so paths are compared with the rules that may concern them and no others.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.sources import tables as T


def expression(pattern: str) -> tuple[str, bool, bool] | None:
    """(regular expression over the path below the rule's folder, negated, folders only) of a line of an ignore file; None for blank lines and notes."""
    line = re.sub(r"(?<!\\) +$", "", pattern.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    folders = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out = "" if anchored else "(?:.*/)?"
    at = 0
    while at < len(line):
        for glob, regex in (("/**/", "/(?:.*/)?"), ("**/", "(?:.*/)?" if at == 0 else None), ("/**", "/.*" if at + 3 == len(line) else None), ("*", "[^/]*"), ("?", "[^/]")):
            if regex and line.startswith(glob, at):
                out, at = out + regex, at + len(glob)
                break
        else:
            held = re.match(r"\[([!^]?)(\]?[^\]]*)\]", line[at:])
            if held:
                out += f"[{'^/' if held[1] else ''}{re.sub(r'([\\[&])', r'\\\\\1', held[2])}]"
                at += held.end()
            else:
                at += line[at] == "\\" and at + 1 < len(line)
                out += re.escape(line[at])
                at += 1
    return f"^{out}$", negated, folders


def compiled(rules: DataFrame) -> DataFrame:
    """(folder, nth, regex, negated, folders) of rules (folder: "" for the root, nth, pattern)."""

    def work(it):
        import pyarrow as pa

        for b in it:
            found = [expression(p) if p else None for p in b.column("pattern").to_pylist()]
            keep = [k for k, f in enumerate(found) if f]
            cols = [b.column(c).take(pa.array(keep, pa.int64())) for c in ("folder", "nth")]
            more = [pa.array([found[k][i] for k in keep], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*cols, *more], names=["folder", "nth", "regex", "negated", "folders"])

    return rules.select("folder", F.col("nth").cast("long").alias("nth"), "pattern").mapInArrow(work, "folder string, nth long, regex string, negated boolean, folders boolean")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored) of the distinct files of paths (path)."""
    files = paths.select("path").where("path is not null").distinct()
    parts = F.split("path", "/")
    upto = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(upto(n).alias("entry"), (n < F.size(parts)).alias("is_folder"), n.alias("depth")))
    entries = files.select("path", F.explode(above).alias("e")).select("path", "e.*")
    # an entry that many files share is judged once
    each = entries.select("entry", "is_folder", "depth").distinct()
    names = F.split("entry", "/")
    owners = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.struct(F.when(n == 0, "").otherwise(F.array_join(F.slice(names, F.lit(1), n), "/")).alias("folder"), F.array_join(F.slice(names, n + 1, F.size(names)), "/").alias("below"), n.alias("level")))
    met = each.select("entry", "is_folder", F.explode(owners).alias("o")).select("entry", "is_folder", "o.*").join(compiled(rules), "folder")
    fits = met.where((~F.col("folders") | F.col("is_folder")) & F.rlike(F.col("below"), F.col("regex")))
    judged = fits.groupBy("entry", "is_folder").agg(F.max_by("negated", F.struct("level", "nth")).alias("kept"))
    out = entries.join(judged.where("not kept"), ["entry", "is_folder"], "left_semi").select("path").distinct().withColumn("ignored", F.lit(True))
    return files.join(out, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


#: Patterns of each source's own ignore file, in order.
GIVEN = ("*.ts", "!en/*.ts", "!/src/en/**", "node_modules/", ".env.*", "!.env.*0", "tests/*[1-5].test.ts", "models/**/repository.*", "!models/fr/", "# note", "")


@query(
    "s1_ignored_paths",
    f"""WITH {T.FILES} SELECT relative_path AS path, CASE doc_id % 8 WHEN 0 THEN lang <> 'en' WHEN 1 THEN true WHEN 5 THEN true WHEN 6 THEN doc_id % 10 <> 0 WHEN 7 THEN true ELSE false END AS ignored FROM files""",
)
def s1_ignored(spark, sf_dir):
    """Which files the sources' ignore rules leave out."""
    files = T.files(spark, sf_dir).select(F.col("relative_path").alias("path"), "source")
    given = F.posexplode(F.array(*map(F.lit, GIVEN))).alias("nth", "pattern")
    return ignored(files, files.select(F.col("source").alias("folder")).distinct().select("folder", given))
