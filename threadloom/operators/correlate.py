"""Requests and the templated routes that they match, through an index of literal segments.

A template's wildcards ({name}, :name, *) stand for one segment each. Its mask says where they are, its key is the route with a mark in their place. A
concrete path has one key for each mask of its length that any template has; templates and paths then meet by equal keys, however many there are of
either. What is broadcast are the distinct masks, after a count; beyond MOST_MASKS they are joined by length like any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.plans.stages import drop_written, written
from threadloom.sources import tables as T

MOST_MASKS = 10_000
WILD = r"^(?:\{[^/{}]+\}|:[^/]+|\*)$"
KINDS = ("endpoint", "api", "external-api")  # fixed values: kinds that serve or send requests
CONFIDENCE = 0.8


def request_path(value: Column) -> Column:
    """The path of a URL or of a bare path, without query, fragment and a trailing slash."""
    path = F.regexp_replace(F.regexp_replace(value, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    bare = F.regexp_replace(path, "/$", "")
    return F.when(value.isNotNull() & (value != ""), F.when(bare == "", "/").otherwise(bare))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def keyed(parts: Column, mask: Column) -> Column:
    """A path's segments under a mask, as one text; a mask has a 1 for each wildcard."""
    return F.array_join(F.transform(parts, lambda s, i: F.when(F.substr(mask, i + 1, F.lit(1)) == "1", "\u0000").otherwise(s)), "/")


def keyed_routes(routes: DataFrame) -> DataFrame:
    """routes as (route, made_, mask, key)."""
    named = routes.withColumn("parts_", segments(request_path(F.col("template"))))
    mask = F.array_join(F.transform("parts_", lambda s: F.when(s.rlike(WILD), "1").otherwise("0")), "")
    return named.select("route", F.upper("method").alias("made_"), mask.alias("mask"), keyed(F.col("parts_"), mask).alias("key"))


def keyed_paths(paths: DataFrame, templates: DataFrame) -> DataFrame:
    """paths (path, ...) under each mask of their length that any template has, with mask and key instead of the path."""
    masks = written(templates.select("mask").distinct().withColumn("n_", F.length("mask")), "masks")
    few = masks.count() <= MOST_MASKS
    parts = paths.withColumn("parts_", segments(request_path(F.col("path")))).where("parts_ is not null").withColumn("n_", F.size("parts_"))
    tried = parts.join(F.broadcast(masks) if few else masks, "n_").withColumn("key", keyed(F.col("parts_"), F.col("mask"))).drop("n_", "parts_")
    tried.masks_ = masks
    return tried


AGREED = "asked_ is null or made_ is null or asked_ = made_"


def matches(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(request, route): pairs of requests (request, method, path) and routes (route, method, template) whose path matches and whose methods, where
    both are known, agree. Every pair is a row; correlated() makes none."""
    templates = keyed_routes(routes)
    tried = keyed_paths(requests.select("request", F.upper("method").alias("asked_"), "path"), templates)
    met = tried.join(templates, ["mask", "key"]).where(AGREED).select("request", "route").distinct()
    met.masks_ = tried.masks_
    return met


def correlated(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(request, route, confidence): requests that match exactly one route.

    A route is the only one where the smallest and the largest that match are the same. So routes of one key and method are one row with both, paths and
    methods are looked up once each, and requests meet what was found for theirs: rows are those of the requests, however many routes share a key."""
    ends = [F.min("low").alias("low"), F.max("high").alias("high"), F.max("none").alias("none")]
    of_route = keyed_routes(routes).withColumns({"low": F.col("route"), "high": F.col("route"), "none": F.col("route").isNull()})
    templates = of_route.groupBy("mask", "key", "made_").agg(*ends)
    asked = requests.select("request", F.upper("method").alias("asked_"), "path")
    tried = keyed_paths(asked.select("asked_", "path").distinct(), templates)
    found = tried.join(templates, ["mask", "key"]).where(AGREED).groupBy("asked_", "path").agg(*ends)
    found = found.select(F.col("asked_").alias("found_asked_"), F.col("path").alias("found_path_"), "low", "high", "none")
    met = asked.join(found, F.col("asked_").eqNullSafe(F.col("found_asked_")) & (F.col("path") == F.col("found_path_")))
    only = met.groupBy("request").agg(*ends).where("(low = high and not none) or (low is null and none)")
    out = only.select("request", F.col("low").alias("route"), F.lit(CONFIDENCE).alias("confidence"))
    out.masks_ = tried.masks_
    return out


def given_routes(spark, sf_dir: str) -> DataFrame:
    """Three forms of templates over types and sizes of parts; those of odd keys name no method."""
    p = T.table(spark, sf_dir, "part")
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    template = F.when(k == 0, F.concat(F.lit("/"), "p_type", F.lit("/"), size, F.lit("/*"))).when(k == 1, F.concat(F.lit("/"), "p_type", F.lit("/:size/x/"))).otherwise(F.concat(F.lit("/{kind}/"), size, F.lit("/x")))
    return p.select(F.col("p_partkey").alias("route"), F.when(F.col("p_partkey") % 2 == 0, "GET").alias("method"), template.alias("template"))


def given_requests(spark, sf_dir: str) -> DataFrame:
    o = T.operations(spark, sf_dir).select("id", "method", "route_path")
    path = F.concat(F.lit("https://host:80"), F.regexp_replace("route_path", "/[0-6]$", ""), F.when(F.col("route_path").rlike("/[0-2]$"), "/x").otherwise("/y"), F.lit("/?q=1#a"))
    return o.select(F.col("id").alias("request"), "method", path.alias("path"))


@query(
    "j16_templated_paths",
    f"""WITH {T.OPERATIONS}, r AS (SELECT p_partkey AS route, CASE WHEN p_partkey % 2 = 0 THEN 'GET' END AS method, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_type END AS a, CASE p_partkey % 3 WHEN 1 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS b, CASE p_partkey % 3 WHEN 0 THEN NULL ELSE 'x' END AS c FROM part),
  q AS (SELECT id, method, string_split(route_path, '/')[2] AS a, string_split(route_path, '/')[3] AS b, CASE WHEN string_split(route_path, '/')[4] IN ('0', '1', '2') THEN 'x' ELSE 'y' END AS c FROM operations),
  d AS (SELECT DISTINCT method, a, b, c FROM q), m AS (SELECT d.*, count(*) AS n, min(route) AS route FROM d JOIN r ON (r.a IS NULL OR r.a = d.a) AND (r.b IS NULL OR r.b = d.b) AND (r.c IS NULL OR r.c = d.c) AND (r.method IS NULL OR r.method = d.method) GROUP BY ALL)
  SELECT q.id AS request, m.route, CAST(0.8 AS DOUBLE) AS confidence FROM q JOIN m ON m.method = q.method AND m.a = q.a AND m.b = q.b AND m.c = q.c WHERE m.n = 1""",
)
def j16_paths(spark, sf_dir):
    """Observed requests and the one templated route that each matches."""
    return correlated(given_requests(spark, sf_dir), given_routes(spark, sf_dir))
