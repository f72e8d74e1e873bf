"""Documents as facts and as search corpora: files, headings, sentences, reading order, matches with exact places, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.sources import tables as T

K1, B = 1.2, 0.75


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, line_no, line): a row for each line, without its line break."""
    return files.select("doc_id", *keep, F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "line")).select("doc_id", *keep, (F.col("n") + 1).cast("long").alias("line_no"), "line")


def sentences_of(text: Column) -> Column:
    """Sentences of a paragraph: . ! ? with any closing quotes and brackets, before white space or the end; ten abbreviations don't end one."""
    ended = F.regexp_replace(text, r"(?<!\b(?i:e\.g|i\.e|mr|mrs|ms|dr|prof|sr|jr|vs)(?=\.))([.!?]['\")\]}”’]*)(?=\s)", "$1\u0001")
    return F.filter(F.transform(F.split(ended, "\u0001"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def segments(files: DataFrame) -> DataFrame:
    """(doc_id, position, kind, label): headings (#) and sentences of each document in reading order."""
    parts = F.transform(F.split("text", r"\n"), lambda line: F.when(line.rlike("^#{1,6} "), F.array(F.struct(F.lit("heading").alias("kind"), F.regexp_replace(line, "^#+ ", "").alias("label")))).otherwise(F.transform(sentences_of(line), lambda s: F.struct(F.lit("sentence").alias("kind"), s.alias("label")))))
    return files.select("doc_id", F.posexplode(F.flatten(parts)).alias("position", "s")).select("doc_id", F.col("position").cast("long").alias("position"), "s.kind", "s.label")


def precedes(found: DataFrame) -> DataFrame:
    """(doc_id, source, target): each segment and the one after it."""
    order = Window.partitionBy("doc_id").orderBy("position")
    return found.select("doc_id", F.col("position").alias("source"), F.lead("position").over(order).alias("target")).where("target is not null")


def bm25(files: DataFrame, term: str) -> DataFrame:
    """(doc_id, relative_path, tf, score): documents that hold a literal, by BM25 over lengths in characters."""
    rest = F.replace(X.ascii_fold(F.col("text")), F.lit(X.fold(term)), F.lit(""))
    tf = ((F.char_length("text") - F.char_length(rest)) / len(term)).cast("long")
    sized = files.select("doc_id", "relative_path", F.char_length("text").alias("size"), tf.alias("tf"))
    corpus = sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.count_if(F.col("tf") > 0).alias("df"))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean"))
    return sized.where("tf > 0").join(F.broadcast(corpus)).select("doc_id", "relative_path", "tf", (idf * F.col("tf") * (K1 + 1) / norm).alias("score"))


def line_matches(files: DataFrame, term: str, most: int = 50) -> DataFrame:
    """(doc_id, line_no, start_column, end_column, preview, truncated): literal hits without regard to ASCII case, with 1-based UTF-16
    columns, the first `most` of a file and whether it has more."""
    folded = X.ascii_fold(F.col("line"))
    pieces = F.split(folded, F.lit(X.quoted(X.fold(term))), -1)
    per = lines(files, "relative_path").where(X.contains_fold(F.col("line"), term)).select("doc_id", "relative_path", "line_no", "line", F.posexplode(pieces).alias("k", "piece"))
    upto = Window.partitionBy("doc_id", "line_no").orderBy("k")
    at = F.sum(F.char_length("piece")).over(upto) + F.col("k") * len(term)  # characters before the hit
    hits = per.withColumn("at", at).withColumn("last_", F.max("k").over(Window.partitionBy("doc_id", "line_no"))).where("k < last_")
    before = F.expr("substring(line, 1, cast(at as int))")
    start = X.utf16_length(before) + 1
    nth = Window.partitionBy("doc_id").orderBy("line_no", "k")
    ranked = hits.withColumn("nth", F.row_number().over(nth)).withColumn("truncated", F.count("*").over(Window.partitionBy("doc_id")) > most).where(F.col("nth") <= most)
    return ranked.select("doc_id", "relative_path", "line_no", start.cast("long").alias("start_column"), (start + len(term)).cast("long").alias("end_column"), X.preview_window(F.col("line"), F.col("at") + 1).alias("preview"), "truncated")


def merged_search(files: DataFrame, term: str, limit: int) -> DataFrame:
    """Labels, then paths, then contents, until more than `limit` are found; the cut is told."""
    semantic = segments(files.select("doc_id", "text")).where(X.contains_fold(F.col("label"), term)).join(files.select("doc_id", "relative_path"), "doc_id").select(F.lit(0).alias("phase"), F.when(F.col("kind") == "heading", 2).otherwise(3).alias("rank"), "relative_path", F.col("position").alias("place"))
    path = files.where(X.contains_fold(F.col("relative_path"), term)).select(F.lit(1).alias("phase"), F.lit(5).alias("rank"), "relative_path", F.lit(1).cast("long").alias("place"))
    content = line_matches(files, term).select(F.lit(2).alias("phase"), F.lit(6).alias("rank"), "relative_path", F.col("line_no").alias("place"))
    every = semantic.unionByName(path).unionByName(content)
    counts = every.groupBy("phase").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # three rows
    reached = counts.select("phase", (earlier <= limit).alias("reached"), F.sum("n").over(Window.partitionBy()).alias("found"))
    kept = every.join(F.broadcast(reached), "phase").where("reached")
    return kept.orderBy("rank", "relative_path", "place").limit(limit).select("phase", "rank", "relative_path", "place", (F.col("found") > limit).alias("truncated"))


#: Files that a query of under three characters looks through.
SHORT_QUERY_FILES = 4_000
FILES = f"WITH {T.FILES}"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("s5_file_list", f"{FILES} SELECT doc_id, relative_path, size_bytes FROM files ORDER BY relative_path LIMIT 500")
def s5(spark, sf_dir):
    return T.files(spark, sf_dir).select("doc_id", "relative_path", "size_bytes").orderBy("relative_path").limit(500)


@query("a1_counts", f"{FILES} SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes, count(DISTINCT content_hash) AS contents FROM files")
def a1(spark, sf_dir):
    return T.files(spark, sf_dir).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count_distinct("content_hash").alias("contents"))


LANGUAGE = "CASE lower(regexp_extract(relative_path, '[^/]\\.([^./]*)$', 1)) WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' WHEN 'md' THEN 'Markdown' WHEN 'py' THEN 'Python' WHEN 'rs' THEN 'Rust' ELSE 'Text' END"


@query("a3_language_histogram", f"{FILES} SELECT {LANGUAGE} AS language, CASE {LANGUAGE} WHEN 'Python' THEN 'syntaxOnly' WHEN 'Rust' THEN 'syntaxOnly' WHEN 'Text' THEN 'textOnly' ELSE 'semantic' END AS capability, count(*) AS n FROM files GROUP BY ALL")
def a3(spark, sf_dir):
    dim = spark.createDataFrame([(k, *v) for k, v in X.LANGUAGES.items()], "ext string, language string, capability string")
    named = T.files(spark, sf_dir).withColumn("ext", X.extension(F.col("relative_path"))).join(F.broadcast(dim), "ext", "left")
    return named.groupBy(F.coalesce("language", F.lit("Text")).alias("language"), F.coalesce("capability", F.lit("textOnly")).alias("capability")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


@query("s3_denied_paths", f"{FILES} SELECT doc_id, relative_path, doc_id % 8 IN (5, 6) AS denied FROM files")
def s3(spark, sf_dir):
    return T.files(spark, sf_dir).select("doc_id", "relative_path", X.denied_path(F.col("relative_path")).alias("denied"))


@query("f1_path_search", f"{FILES} SELECT doc_id, relative_path FROM files WHERE contains({FOLD.format('relative_path')}, 'jobs/1')")
def f1(spark, sf_dir):
    return T.files(spark, sf_dir).where(X.contains_fold(F.col("relative_path"), "JOBS/1")).select("doc_id", "relative_path")


@query("l4_exact_first", f"{FILES} SELECT doc_id, relative_path FROM files WHERE contains({FOLD.format('relative_path')}, 'latest') ORDER BY relative_path = 'src/latest3/latest.ts' DESC, {FOLD.format('relative_path')}, relative_path LIMIT 25")
def l4(spark, sf_dir):
    p = F.col("relative_path")
    return T.files(spark, sf_dir).where(X.contains_fold(p, "latest")).orderBy(F.desc(p == "src/latest3/latest.ts"), X.ascii_fold(p), p).limit(25).select("doc_id", "relative_path")


@query(
    "f6_f9_test_paths",
    f"""{FILES}, p AS (SELECT doc_id, {FOLD.format("relative_path")} AS p FROM files) SELECT doc_id,
  p LIKE 'test/%' OR p LIKE 'tests/%' OR p LIKE 'e2e/%' OR p LIKE '%/test/%' OR p LIKE '%/tests/%' OR p LIKE '%/e2e/%' OR p LIKE '%/__tests__/%' OR p LIKE '%/fixtures/%' OR p LIKE '%.test.%' OR p LIKE '%.spec.%' OR p GLOB '*_test.*' AS inventory,
  p LIKE '%/tests/%' OR p LIKE '%/test/%' OR p LIKE '%/e2e/%' OR p LIKE '%/fixtures/%' OR p LIKE '%.test.%' OR p LIKE '%.spec.%' OR p GLOB '*_test.*' OR p GLOB '*_tests.*' AS flow,
  p LIKE '%/tests/%' OR p LIKE 'tests/%' OR p LIKE '%/test/%' OR p LIKE '%.test.%' OR p LIKE '%.spec.%' OR p LIKE '%_test.%' OR p LIKE '%_tests.%' OR p LIKE '%-test.%' AS overview,
  contains('/' || p, '/tests/') OR contains(p, '.test.') OR contains(p, '_test.') AS literal FROM p""",
)
def f6(spark, sf_dir):
    """The four variants side by side: they differ on src/latest.ts."""
    p = F.col("relative_path")
    return T.files(spark, sf_dir).select("doc_id", X.test_path_inventory(p).alias("inventory"), X.test_path_flow(p).alias("flow"), X.test_path_overview(p).alias("overview"), X.test_path_literal(p).alias("literal"))


@query("f10_f12_path_classes", f"{FILES} SELECT doc_id, false AS auxiliary, doc_id % 8 = 4 AS job, doc_id % 8 = 7 AS data, string_split(relative_path, '/')[1] AS first, CASE WHEN contains(relative_path, '/src/') THEN string_split(relative_path, '/src/')[1] WHEN relative_path LIKE 'src/%' THEN 'Workspace root' ELSE string_split(relative_path, '/')[1] END AS service_root FROM files")
def f10(spark, sf_dir):
    p = F.col("relative_path")
    return T.files(spark, sf_dir).select("doc_id", X.auxiliary_path(p).alias("auxiliary"), X.job_path(p).alias("job"), X.data_path(p, F.lit("struct")).alias("data"), F.split(p, "/")[0].alias("first"), X.service_root(p).alias("service_root"))


@query("s10_remove_subtree", f"{FILES} SELECT count(*) AS kept, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files WHERE NOT starts_with(relative_path, 'docs/src1/')")
def s10(spark, sf_dir):
    return T.files(spark, sf_dir).where(~F.col("relative_path").startswith("docs/src1/")).agg(F.count("*").alias("kept"), F.sum("size_bytes").alias("bytes"))


@query("a23_directory_tree", f"{FILES}, d AS (SELECT string_split(relative_path, '/') AS s FROM files), f AS (SELECT unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS folder FROM d) SELECT folder, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') END AS parent, count(*) AS files FROM f GROUP BY ALL")
def a23(spark, sf_dir):
    s = F.split("relative_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))
    f = T.files(spark, sf_dir).select(F.explode(folders).alias("folder"))
    return f.groupBy("folder", F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", "")).alias("parent")).agg(F.count("*").alias("files"))


SEGMENTS = rf"""{FILES}, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM files),
  part AS (SELECT doc_id, n, unnest(string_split(regexp_replace(line, '([.!?][''")\]}}”’]*)(\s)', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(line, '([.!?][''")\]}}”’]*)(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS k FROM ln),
  seg AS (SELECT doc_id, trim(s, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS label, n, k FROM part), kept AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS position FROM seg WHERE label <> '')"""


@query("x11_sentences", f"{SEGMENTS} SELECT doc_id, count(*) AS sentences, CAST(sum(length(label)) AS BIGINT) AS characters, max(position) AS last_position FROM kept GROUP BY doc_id")
def x11(spark, sf_dir):
    return segments(T.files(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.char_length("label")).alias("characters"), F.max("position").alias("last_position"))


@query("x12_precedes", f"{SEGMENTS} SELECT doc_id, position AS source, position + 1 AS target FROM kept QUALIFY lead(position) OVER (PARTITION BY doc_id ORDER BY position) IS NOT NULL")
def x12(spark, sf_dir):
    return precedes(segments(T.files(spark, sf_dir)))


MATCHES = rf"""{FILES}, ln AS (SELECT doc_id, relative_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM files),
  pieces AS (SELECT *, string_split({FOLD.format("line")}, 'token') AS p FROM ln WHERE contains({FOLD.format("line")}, 'token')),
  hits AS (SELECT doc_id, relative_path, line_no, line, unnest(list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + 5 * (i - 1) AS BIGINT))) AS pos FROM pieces),
  placed AS (SELECT *, length(left(line, pos)) + length(regexp_replace(left(line, pos), '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) + 1 AS start_column, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS nth, count(*) OVER (PARTITION BY doc_id) > 50 AS truncated FROM hits)"""


@query("h5_line_matches", f"{MATCHES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(start_column AS BIGINT) AS start_column, CAST(start_column + 5 AS BIGINT) AS end_column, truncated FROM placed WHERE nth <= 50")
def h5(spark, sf_dir):
    return line_matches(T.files(spark, sf_dir), "TOKEN").select("doc_id", "line_no", "start_column", "end_column", "truncated")


@query("a19_grouped_matches", f"{MATCHES} SELECT doc_id, count(*) AS hits, CAST(min(line_no) AS BIGINT) AS first_line, string_agg(DISTINCT CAST(line_no AS VARCHAR), ',' ORDER BY CAST(line_no AS VARCHAR)) AS lines FROM placed WHERE nth <= 50 GROUP BY doc_id")
def a19(spark, sf_dir):
    m = line_matches(T.files(spark, sf_dir), "token")
    return m.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("line_no").alias("first_line"), F.array_join(F.sort_array(F.collect_set(F.col("line_no").cast("string"))), ",").alias("lines"))


HITS = rf"""{MATCHES}, seg AS (SELECT doc_id, n, k, trim(s, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS label FROM (SELECT doc_id, n, unnest(string_split(regexp_replace(line, '([.!?][''")\]}}”’]*)(\s)', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(line, '([.!?][''")\]}}”’]*)(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS k
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM files))),
  segs AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS position FROM seg WHERE label <> ''),
  every AS (SELECT 0 AS phase, 3 AS rank, relative_path, position AS place FROM segs JOIN files USING (doc_id) WHERE contains({FOLD.format("label")}, 'token')
    UNION ALL SELECT 1, 5, relative_path, 1 FROM files WHERE contains({FOLD.format("relative_path")}, 'token') UNION ALL SELECT 2, 6, relative_path, line_no FROM placed WHERE nth <= 50)"""


@query(
    "h6_merged_search",
    f"""{HITS}, counts AS (SELECT phase, count(*) AS n FROM every GROUP BY phase), reached AS (SELECT phase, coalesce(sum(n) OVER (ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 500 AS reached, sum(n) OVER () AS found FROM counts)
  SELECT phase, rank, relative_path, place, found > 500 AS truncated FROM every JOIN reached USING (phase) WHERE reached ORDER BY rank, relative_path, place LIMIT 500""",
)
def h6(spark, sf_dir):
    return merged_search(T.files(spark, sf_dir), "token", 500)


@query("h2_short_query", f"{FILES}, first AS (SELECT * FROM files ORDER BY relative_path LIMIT {SHORT_QUERY_FILES}) SELECT doc_id FROM first WHERE contains({FOLD.format('text')}, 'zz')")
def h2(spark, sf_dir):
    """Texts of under three characters are looked for in the first files by path only."""
    return T.files(spark, sf_dir).orderBy("relative_path").limit(SHORT_QUERY_FILES).where(X.contains_fold(F.col("text"), "zz")).select("doc_id")


@query("s9_incremental_replace", f"{FILES}, changed AS (SELECT doc_id, relative_path, 'changed ' || text AS text FROM files WHERE doc_id % 10 = 0), now AS (SELECT doc_id, relative_path, text FROM files WHERE doc_id NOT IN (SELECT doc_id FROM changed) UNION ALL FROM changed) SELECT doc_id, length(text) AS size FROM now")
def s9(spark, sf_dir):
    """Changed files replace their former selves; the others stay."""
    base = T.files(spark, sf_dir).select("doc_id", "relative_path", "text")
    changed = base.where("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("changed "), "text"))
    return base.join(changed, "doc_id", "left_anti").unionByName(changed).select("doc_id", F.char_length("text").cast("long").alias("size"))


@query("f16_sensitive_names", r"SELECT key, bool_or(sensitive) AS sensitive, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([A-Za-z_]+) ?= ?\"', 1)) AS key FROM documents), LATERAL (SELECT regexp_matches(lower(regexp_replace(key, '[^A-Za-z0-9]', '', 'g')), 'authorization|cookie|token|apikey|key|password|passwd|secret|credential') AS sensitive) GROUP BY key")
def f16(spark, sf_dir):
    """Names that something is assigned to in the texts, and whether they promise a secret."""
    keys = T.table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit('([A-Za-z_]+) ?= ?"'), F.lit(1))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).withColumn("sensitive", X.sensitive_name(F.col("key")))


@query("p19_redaction", r"SELECT doc_id, md5(regexp_replace(text, '(token = )\"[^\"]*\"', '\1[REDACTED]', 'g')) AS digest FROM documents WHERE contains(text, 'token = ')")
def p19(spark, sf_dir):
    """Assigned secrets, masked in place."""
    d = T.table(spark, sf_dir, "documents").where(F.col("text").contains("token = "))
    return d.select("doc_id", F.md5(F.regexp_replace("text", '(token = )"[^"]*"', "$1[REDACTED]")).alias("digest"))


@query("p13_short_labels", r"SELECT doc_id, CASE WHEN length(t) > 160 THEN left(t, 159) || '…' ELSE t END AS label FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def p13(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", X.short_label(F.col("text")).alias("label"))


@query("p16_utf16_length", r"SELECT doc_id, length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS units FROM documents")
def p16(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", X.utf16_length(F.col("text")).cast("long").alias("units"))


@query("h7_freshness", f"{FILES}, hit AS (SELECT doc_id, relative_path, content_hash FROM files WHERE contains({FOLD.format('text')}, 'token')), now AS (SELECT relative_path, sha256(CASE WHEN doc_id % 10 = 0 THEN 'changed ' || text ELSE text END) AS content_hash FROM files WHERE doc_id % 17 <> 0) SELECT h.doc_id, h.relative_path, (SELECT count(*) FROM hit h LEFT JOIN now USING (relative_path, content_hash) WHERE now.relative_path IS NULL) > 0 AS truncated FROM hit h JOIN now USING (relative_path, content_hash)")
def h7(spark, sf_dir):
    """Hits of an index whose file still has the indexed contents; stale and removed ones are dropped, and that is told."""
    files = T.files(spark, sf_dir)
    hits = files.where(X.contains_fold(F.col("text"), "token")).select("doc_id", "relative_path", "content_hash")
    now = files.where("doc_id % 17 <> 0").select("relative_path", F.when(F.expr("doc_id % 10 = 0"), F.sha2(F.concat(F.lit("changed "), "text"), 256)).otherwise(F.col("content_hash")).alias("now"))
    judged = hits.join(now, "relative_path", "left").select("doc_id", "relative_path", F.coalesce(F.col("now") == F.col("content_hash"), F.lit(False)).alias("fresh"))
    stale = judged.agg((F.count_if(~F.col("fresh")) > 0).alias("truncated"))  # one row
    return judged.where("fresh").join(F.broadcast(stale)).select("doc_id", "relative_path", "truncated")


SECRETS = ("token", "token = ", "license", "idiot", "copyright")


def mask_patterns(text: Column, patterns: tuple[str, ...]) -> Column:
    """The text with each leftmost-longest occurrence of a pattern masked."""
    longest_first = sorted(set(patterns), key=lambda p: (-len(p), p))
    return F.regexp_replace(text, "|".join(map(X.quoted, longest_first)), "[REDACTED]")


@query("p20_multi_redaction", f"SELECT doc_id, md5(regexp_replace(text, '{'|'.join(sorted(SECRETS, key=lambda p: (-len(p), p)))}', '[REDACTED]', 'g')) AS digest, regexp_matches(text, '{'|'.join(SECRETS)}') AS masked FROM documents WHERE text IS NOT NULL")
def p20(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").where("text is not null")
    masked = mask_patterns(F.col("text"), SECRETS)
    return d.select("doc_id", F.md5(masked).alias("digest"), (masked != F.col("text")).alias("masked"))


@query("s11_quotas", f"{FILES} SELECT source, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CASE WHEN count(*) > 50 THEN 'files' WHEN sum(size_bytes) > 110000 THEN 'bytes' END AS exceeded FROM files GROUP BY source")
def s11(spark, sf_dir):
    """What each source holds, and the quota that it exceeds first."""
    held = T.files(spark, sf_dir).groupBy("source").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    return held.withColumn("exceeded", F.when(F.col("files") > 50, "files").when(F.col("bytes") > 110_000, "bytes"))
