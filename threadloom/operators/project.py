"""Projects and changes: stacks from rule tables, preferred profiles, Git status and diffs, HTTP facts in texts, event facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.sources import tables as T

#: Fixed rules: a language's stack, its tool, and the rank of the profile that starts it.
RULES = (("TypeScript", "node", "npm", 1), ("JavaScript", "node", "npm", 2), ("Python", "python", "pip", 3), ("Rust", "cargo", "cargo", 4), ("Markdown", "docs", "none", 9))


def stacks(files: DataFrame) -> DataFrame:
    """Files by the stack of their language: both dimensions are fixed and small, so they are broadcast."""
    spark = files.sparkSession
    languages = F.broadcast(spark.createDataFrame([(k, v[0]) for k, v in X.LANGUAGES.items()], "ext string, language string"))
    rules = F.broadcast(spark.createDataFrame(RULES, "language string, stack string, tool string, priority int"))
    return files.withColumn("ext", X.extension(F.col("relative_path"))).join(languages, "ext").join(rules, "language")


def parse_status(raw: Column) -> Column:
    """NUL-delimited porcelain records as array of (index, worktree, path, staged, conflicted). A rename's old path follows it."""
    parts = F.filter(F.split(raw, "\u0000"), lambda s: s != "")
    rows = F.filter(F.transform(parts, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda r: (r["i"] == 0) | ~F.get(parts, r["i"] - 1).rlike("^[RC].? ") | r["s"].rlike("^[ MADRCU?!]{2} "))
    conflict = ("DD", "AU", "UD", "UA", "DU", "AA", "UU")
    return F.transform(rows, lambda r: F.struct(F.substring(r["s"], 1, 1).alias("index"), F.substring(r["s"], 2, 1).alias("worktree"), F.expr("1").alias("one"), F.substring(r["s"], 4, 4096).alias("path"), (~F.substring(r["s"], 1, 1).isin(" ", "?")).alias("staged"), F.substring(r["s"], 1, 2).isin(*conflict).alias("conflicted")))


def changed_lines(patches: DataFrame, key: str, patch: str, most: int = 512) -> DataFrame:
    """(key, line): numbers of the new side's lines that hunks of a unified diff add. The number runs on from the hunk's header."""
    rows = patches.select(key, F.posexplode(F.split(patch, "\n")).alias("n", "s"))
    start = F.regexp_extract("s", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    order = Window.partitionBy(key).orderBy("n")
    rows = rows.withColumn("hunk", F.sum(F.when(start != "", 1).otherwise(0)).over(order)).withColumn("start", F.expr(r"try_cast(nullif(regexp_extract(s, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)', 1), '') as bigint)"))
    inside = Window.partitionBy(key, "hunk").orderBy("n")
    step = F.when(F.col("start").isNotNull() | F.col("s").startswith("-") | F.col("s").startswith("\\"), 0).otherwise(1)
    line = F.first("start").over(inside) + F.sum(step).over(inside) - 1
    return rows.withColumn("line", line).where((F.col("hunk") > 0) & F.col("s").startswith("+")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select(key, "line")


FILES = f"WITH {T.FILES}"
LANGUAGE = "CASE lower(regexp_extract(relative_path, '[^/]\\.([^./]*)$', 1)) WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' WHEN 'md' THEN 'Markdown' WHEN 'py' THEN 'Python' WHEN 'rs' THEN 'Rust' END"
STACK = f"""{FILES}, l AS (SELECT source, relative_path, {LANGUAGE} AS language FROM files), s AS (SELECT source, relative_path, language, CASE language WHEN 'TypeScript' THEN 'node' WHEN 'JavaScript' THEN 'node' WHEN 'Python' THEN 'python' WHEN 'Rust' THEN 'cargo' ELSE 'docs' END AS stack,
  CASE language WHEN 'TypeScript' THEN 1 WHEN 'JavaScript' THEN 2 WHEN 'Python' THEN 3 WHEN 'Rust' THEN 4 ELSE 9 END AS priority FROM l WHERE language IS NOT NULL)"""


@query("j21_stacks", f"{STACK} SELECT source, stack, count(*) AS files, count(DISTINCT language) AS languages FROM s GROUP BY ALL")
def j21(spark, sf_dir):
    return stacks(T.files(spark, sf_dir)).groupBy("source", "stack").agg(F.count("*").alias("files"), F.count_distinct("language").alias("languages"))


@query("l11_preferred_profile", f"{STACK} SELECT source, min_by(relative_path, (priority, relative_path)) AS preferred FROM s GROUP BY source")
def l11(spark, sf_dir):
    return stacks(T.files(spark, sf_dir)).groupBy("source").agg(F.min_by("relative_path", F.struct("priority", "relative_path")).alias("preferred"))


CODE = "CASE doc_id % 5 WHEN 0 THEN 'M ' WHEN 1 THEN ' M' WHEN 2 THEN '??' WHEN 3 THEN 'UU' ELSE 'A ' END"


@query("s18_git_status", f"{FILES} SELECT source, relative_path AS path, left({CODE}, 1) AS index, right({CODE}, 1) AS worktree, doc_id % 5 IN (0, 3, 4) AS staged, doc_id % 5 = 3 AS conflicted FROM files")
def s18(spark, sf_dir):
    """Status records of each source's files, written as porcelain text, 256 ids a text at most, and parsed back."""
    code = F.element_at(F.array(*(F.lit(c) for c in ("M ", " M", "??", "UU", "A "))), F.expr("cast(doc_id % 5 as int) + 1"))
    raw = T.files(spark, sf_dir).groupBy("source", F.expr("doc_id div 256")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(code, F.lit(" "), "relative_path"))), "\u0000").alias("raw"))
    return raw.select("source", F.explode(parse_status(F.col("raw"))).alias("s")).select("source", "s.path", "s.index", "s.worktree", "s.staged", "s.conflicted")


@query("s19_diff_lines", r"WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), m AS (SELECT *, n % 3 AS m FROM ln), k AS (SELECT doc_id, m, 10 + doc_id % 7 + count(*) FILTER (m <> 2) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS line, row_number() OVER (PARTITION BY doc_id, m ORDER BY n) AS r FROM m) SELECT doc_id, CAST(line AS BIGINT) AS line FROM k WHERE m = 1 AND r <= 512")
def s19(spark, sf_dir):
    """Each document as a hunk: every third line added, every third removed, the others kept; the added lines' numbers read back."""
    d = T.table(spark, sf_dir, "documents")
    mark = lambda s, i: F.concat(F.when((i + 1) % 3 == 1, "+").when((i + 1) % 3 == 2, "-").otherwise(" "), s)
    patch = F.concat(F.lit("--- a\n+++ b\n@@ -1,1 +"), F.expr("cast(10 + doc_id % 7 as string)"), F.lit(",1 @@\n"), F.array_join(F.transform(F.split("text", "\n"), mark), "\n"))
    return changed_lines(d.select("doc_id", patch.alias("patch")), "doc_id", "patch")


@query("x5_page_links", r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM h GROUP BY ALL""")
def x5(spark, sf_dir):
    """Requests that a page's markup makes: its link targets."""
    h = T.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return h.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("x3_event_facts", r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '([a-z]+)\(([0-9]+)\);', 1)) AS callee FROM pages) SELECT callee, count(*) AS calls, count(DISTINCT page_id) AS pages FROM t GROUP BY callee""")
def x3(spark, sf_dir):
    """Calls with static arguments in inline scripts."""
    t = T.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"([a-z]+)\(([0-9]+)\);"), F.lit(1))).alias("callee"))
    return t.groupBy("callee").agg(F.count("*").alias("calls"), F.count_distinct("page_id").alias("pages"))


@query("j22_change_markers", f"{FILES}, {T.NODES} SELECT n.kind, count(*) AS marked FROM nodes n JOIN (SELECT DISTINCT string_split(relative_path, '/')[1] AS s FROM files WHERE doc_id % 5 = 3) f ON f.s = 'src' || (length(n.label) % 20) GROUP BY n.kind")
def j22(spark, sf_dir):
    """Nodes whose source has conflicted files."""
    f = T.files(spark, sf_dir).where("doc_id % 5 = 3").select(F.split("relative_path", "/")[0].alias("s")).distinct()
    n = T.nodes(spark, sf_dir).withColumn("s", F.concat(F.lit("src"), F.expr("cast(char_length(label) % 20 as string)")))
    return n.join(f, "s").groupBy("kind").agg(F.count("*").alias("marked"))
