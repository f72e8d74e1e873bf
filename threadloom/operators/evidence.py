"""Evidence about projects and runs: dependency lists and what they hint at, previews without values, summaries of communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.sources import tables as T

# Dependency sections, names that hint at a store, bounds, what a community is marked with.
SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
POSTGRESQL = ("asyncpg", "pg", "pg8000", "postgres", "postgresql", "psycopg", "psycopg2", "psycopg2-binary", "tokio-postgres")
REDIS = ("deadpool-redis", "ioredis", "redis", "redis-py")
DEPENDENCIES = 256
PREVIEW_FIELDS, NAME_CHARS = 32, 128


def package_dependencies(source: Column) -> Column:
    """Names in the dependency sections of a package manifest (JSON), in lower case; none if it can't be read."""
    parsed = F.from_json(source, ", ".join(f"{s} map<string, string>" for s in SECTIONS))
    none = F.array().cast("array<string>")
    names = F.concat(*(F.coalesce(F.sort_array(F.map_keys(parsed[s])), none) for s in SECTIONS))
    return F.array_distinct(F.slice(F.transform(names, X.ascii_fold), 1, DEPENDENCIES))


def requirement_dependencies(source: Column) -> Column:
    """Names in a list of requirements, in lower case: comments, options and lines without a name are left out."""
    lines = F.filter(F.transform(F.split(source, r"\r?\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: ~s.rlike("^[#-]"))
    names = F.filter(F.transform(lines, lambda s: X.ascii_fold(F.regexp_extract(s, r"^[A-Za-z0-9._-]*", 0))), lambda s: s != "")
    return F.array_distinct(F.slice(names, 1, DEPENDENCIES))


def hints(names: Column, of: tuple[str, ...]) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, of)))


def sanitized_fields(fields: Column, most_chars: int = NAME_CHARS) -> Column:
    """Fields (name, type) of a preview with sensitive names masked; null if there are too many, or one isn't a plain name."""
    plain = lambda s: s.rlike(rf"\A[A-Za-z0-9 _.:/-]{{1,{most_chars}}}\z")
    masked = F.transform(fields, lambda f: F.struct(F.when(X.sensitive_name(f["name"]), "[sensitive-field]").otherwise(f["name"]).alias("name"), f["type"].alias("type")))
    return F.when((F.size(fields) <= PREVIEW_FIELDS) & F.forall(fields, lambda f: plain(f["name"]) & plain(f["type"])), masked)


def consensus(value: Column) -> Column:
    """The value that all rows of a group have, else null."""
    return F.when((F.count(value) == F.count("*")) & (F.min(value) == F.max(value)), F.min(value))


def community_summary(nodes: DataFrame, algorithm: str, truncated: bool) -> DataFrame:
    """Communities of nodes (community_id, size, algorithm, complete): what was returned, what all of their nodes say, and whether that holds."""
    groups = nodes.where("community_id is not null").groupBy("community_id")
    said = groups.agg(F.count("*").alias("returned"), *(consensus(F.col(c)).alias(c) for c in ("size", "algorithm", "complete")))
    holds = (F.col("size") == F.col("returned")) & (F.col("algorithm") == algorithm) & (F.col("complete") == (not truncated))
    return said.withColumn("consistent", F.coalesce(holds, F.lit(False)))


NAMES = ("pg", "ioredis", "React", "psycopg2-binary", "redis", "left-pad", "asyncpg", "flask", "Tokio-Postgres", "predis", "deadpool-redis")


@query(
    "x15_dependency_hints",
    f"""WITH p AS (SELECT 'package:' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN '{{}}' ELSE '{{"dependencies": {{"' || {list(NAMES)}[s_suppkey % 11 + 1] || '": "1"}}, "devDependencies": {{"' || {list(NAMES)}[s_suppkey * 3 % 11 + 1] || '": "2", "x": "3"}}}}' END AS source FROM supplier),
  r AS (SELECT 'requirements:' || c_custkey AS id, '# pinned' || chr(10) || '-r base.txt' || chr(10) || '  ' || {list(NAMES)}[c_custkey % 11 + 1] || '>=1.0' || chr(10) || {list(NAMES)}[c_custkey * 5 % 11 + 1] || '[x]; y' || chr(10) || chr(10) || '==bad' AS source FROM customer),
  n AS (SELECT id, list_concat(coalesce(json_keys(source, '$.dependencies'), []), coalesce(json_keys(source, '$.devDependencies'), [])) AS names FROM p
    UNION ALL SELECT id, [regexp_extract(trim(x), '^[A-Za-z0-9._-]*') FOR x IN string_split(source, chr(10)) IF trim(x) NOT LIKE '#%' AND trim(x) NOT LIKE '-%' AND regexp_matches(trim(x), '^[A-Za-z0-9._-]')] FROM r),
  d AS (SELECT id, list_sort(list_distinct([lower(x) FOR x IN names])) AS names FROM n)
  SELECT id, array_to_string(names, ',') AS dependencies, list_has_any(names, {list(POSTGRESQL)}) AS postgresql, list_has_any(names, {list(REDIS)}) AS redis FROM d""",
)
def x15(spark, sf_dir):
    """Dependency lists of manifests, JSON and plain, and the stores that they hint at."""
    name = lambda at: F.element_at(F.array(*map(F.lit, NAMES)), F.expr(f"cast({at} % 11 as int) + 1"))
    whole = F.concat(F.lit('{"dependencies": {"'), name("s_suppkey"), F.lit('": "1"}, "devDependencies": {"'), name("s_suppkey * 3"), F.lit('": "2", "x": "3"}}'))
    package = F.when(F.expr("s_suppkey % 10 = 0"), '{"dependencies": ').otherwise(whole)
    plain = F.concat(F.lit("# pinned\n-r base.txt\n  "), name("c_custkey"), F.lit(">=1.0\n"), name("c_custkey * 5"), F.lit("[x]; y\n\n==bad"))
    found = T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("package:"), F.col("s_suppkey").cast("string")).alias("id"), package_dependencies(package).alias("names"))
    found = found.unionByName(T.table(spark, sf_dir, "customer").select(F.concat(F.lit("requirements:"), F.col("c_custkey").cast("string")).alias("id"), requirement_dependencies(plain).alias("names")))
    return found.select("id", F.array_join(F.sort_array("names"), ",").alias("dependencies"), hints(F.col("names"), POSTGRESQL).alias("postgresql"), hints(F.col("names"), REDIS).alias("redis"))


@query(
    "a12_community_summary",
    f"""WITH {T.NODES}, c AS (SELECT CASE WHEN kind <> 'model' THEN 'community:' || kind END AS community_id, CASE kind WHEN 'service' THEN 5 WHEN 'controller' THEN 24 WHEN 'class' THEN length(label) + length(id) END AS size,
    CASE WHEN kind = 'repository' AND id LIKE '%1' THEN 'other' ELSE 'propagation' END AS algorithm, kind <> 'endpoint' AS complete FROM nodes)
  SELECT community_id, count(*) AS returned, CAST(CASE WHEN count(size) = count(*) AND min(size) = max(size) THEN min(size) END AS BIGINT) AS size, CASE WHEN min(algorithm) = max(algorithm) THEN min(algorithm) END AS algorithm, CASE WHEN bool_and(complete) = bool_or(complete) THEN bool_and(complete) END AS complete,
    coalesce(count(size) = count(*) AND min(size) = max(size) AND min(size) = count(*) AND min(algorithm) = 'propagation' AND max(algorithm) = 'propagation' AND bool_and(complete), false) AS consistent FROM c WHERE community_id IS NOT NULL GROUP BY community_id""",
)
def a12(spark, sf_dir):
    """Nodes by kind as communities: what they declare of themselves against what there is."""
    k = F.col("kind")
    size = F.when(k == "service", 5).when(k == "controller", 24).when(k == "class", F.length("label") + F.length("id")).cast("long")
    algorithm = F.when((k == "repository") & F.col("id").endswith("1"), "other").otherwise("propagation")
    marked = T.nodes(spark, sf_dir).select(F.when(k != "model", F.concat(F.lit("community:"), k)).alias("community_id"), size.alias("size"), algorithm.alias("algorithm"), (k != "endpoint").alias("complete"))
    return community_summary(marked, "propagation", truncated=False)
