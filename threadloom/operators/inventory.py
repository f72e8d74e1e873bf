"""Operation inventory: canonical operations, producer matching, coverage counts, keyset pages.

Uniqueness, not best match, joins a consumer with a producing service: zero or several services link nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.sources import tables as T

KEY = ["service", "method", "route_path"]


def eligible(operations: DataFrame) -> DataFrame:
    route = F.col("route_path")
    plain = (route.startswith("/") & ~route.startswith("//")) | ((F.col("role") == "consumer") & route.rlike("^https?://"))
    return operations.where(F.col("method").isin(*X.HTTP_METHODS) & (F.char_length(route) <= 1024) & plain & ~route.contains("?") & ~route.contains("#") & ~X.test_path_inventory(F.col("file_path")))


def producer_services(operations: DataFrame) -> DataFrame:
    """The services that produce each (method, route): how many, and the first."""
    made = operations.where(F.col("role") == "producer")
    return made.groupBy("method", "route_path").agg(F.count_distinct("source_service").alias("services"), F.min("source_service").alias("only_service"))


def with_service(operations: DataFrame) -> DataFrame:
    """Operations under their service: what isn't a producer goes to the one service that produces its route, if there is just one."""
    adopted = F.when((F.col("role") != "producer") & (F.col("services") == 1), F.col("only_service")).otherwise(F.col("source_service"))
    return operations.join(producer_services(operations), ["method", "route_path"], "left").withColumn("service", adopted)


def canonical(operations: DataFrame) -> DataFrame:
    """One operation for each (service, method, route), with the counts of its group and its first client, in one pass over the facts.

    First a row for each (source service, method, route, role): its count, its first operation in canonical order and its first by path. Facts are
    summed before they are shuffled, and what is left of a route are a few rows, however busy it is. A window over those sees which services
    produce the route; the last aggregate finds its rows where the window has put them."""
    rank = F.when(F.col("framework") == "OpenAPI", "0").when(F.col("framework") == "Utoipa", "1").otherwise("2")
    order = F.struct(F.concat(rank, F.when(F.col("role") == "producer", "0").otherwise("1")).alias("rank"), "file_path", "id", "framework", "api_group")
    per_role = eligible(operations).groupBy("source_service", "method", "route_path", "role").agg(F.min(order).alias("c"), F.min(F.struct("file_path", "id")).alias("client"), F.count("*").alias("n"))
    makes = F.when(F.col("role") == "producer", F.col("source_service"))
    route = Window.partitionBy("method", "route_path")
    adopted = F.when((F.col("role") != "producer") & (F.min(makes).over(route) == F.max(makes).over(route)), F.min(makes).over(route)).otherwise(F.col("source_service"))
    count = lambda role: F.sum(F.when(F.col("role") == role, F.col("n")).otherwise(0))
    return (
        per_role.withColumn("service", adopted)
        .groupBy(*KEY)
        .agg(F.min("c").alias("c"), count("producer").alias("producers"), count("consumer").alias("consumers"), count("unknown").alias("unknowns"), F.sum("n").alias("occurrences"), F.min(F.when(F.col("role") == "consumer", F.col("client"))).alias("client"))
        .select(*KEY, "c.id", "c.file_path", "c.framework", "c.api_group", "producers", "consumers", "unknowns", "occurrences", F.col("client.id").alias("first_client"))
        .withColumn("role", F.when(F.col("producers") > 0, "producer").when(F.col("consumers") > 0, "consumer").otherwise("unknown"))
    )


def page(operations: DataFrame, after: str | None, limit: int) -> DataFrame:
    """The `limit` operations after an id, and whether more follow (one row more is looked for)."""
    rows = operations if after is None else operations.where(F.col("id") > after)
    more = rows.orderBy("id").limit(limit + 1)
    n = Window.orderBy("id")
    return more.withColumn("position", F.row_number().over(n)).withColumn("truncated", F.max("position").over(Window.partitionBy()) > limit).where(F.col("position") <= limit)


def cursor(last_id: str, text: str | None) -> str:
    """A page cursor is bound to the query that it continues."""
    return f"{last_id}:{hashlib.sha256((text or '').encode()).hexdigest()[:12]}"


def cursor_id(value: str, text: str | None) -> str:
    last, _, bound = value.rpartition(":")
    if not last or cursor(last, text) != value:
        raise ValueError("the cursor belongs to another query")
    return last


CANONICAL = f"""WITH {T.OPERATIONS}, matched AS (
  SELECT method, route_path, count(DISTINCT source_service) AS services, min(source_service) AS only_service FROM operations WHERE role = 'producer' GROUP BY ALL
), placed AS (
  SELECT o.*, CASE WHEN role <> 'producer' AND services = 1 THEN only_service ELSE source_service END AS service
  FROM operations o LEFT JOIN matched m ON m.method = o.method AND m.route_path = o.route_path
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY service, method, route_path ORDER BY CASE framework WHEN 'OpenAPI' THEN 0 WHEN 'Utoipa' THEN 1 ELSE 2 END, CASE role WHEN 'producer' THEN 0 ELSE 1 END, file_path, id) AS r,
    count(*) FILTER (role = 'producer') OVER g AS producers, count(*) FILTER (role = 'consumer') OVER g AS consumers, count(*) FILTER (role = 'unknown') OVER g AS unknowns, count(*) OVER g AS occurrences
  FROM placed WINDOW g AS (PARTITION BY service, method, route_path)
), canonical AS (
  SELECT service, method, route_path, id, file_path, framework, api_group, producers, consumers, unknowns, occurrences,
    CASE WHEN producers > 0 THEN 'producer' WHEN consumers > 0 THEN 'consumer' ELSE 'unknown' END AS role
  FROM ranked WHERE r = 1
)"""


@query("w1_canonical_operation", f"{CANONICAL} SELECT * FROM canonical")
def w1(spark, sf_dir):
    return canonical(T.operations(spark, sf_dir)).drop("first_client")


@query("a4_unique_producer", f"WITH {T.OPERATIONS} SELECT method, route_path, count(DISTINCT source_service) AS services, min(source_service) AS only_service FROM operations WHERE role = 'producer' GROUP BY ALL")
def a4(spark, sf_dir):
    return producer_services(eligible(T.operations(spark, sf_dir)))


@query(
    "j6_consumer_match",
    f"""{CANONICAL} SELECT o.source_service, o.method, CASE WHEN services IS NULL THEN 'none' WHEN services = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome, count(*) AS n
  FROM operations o LEFT JOIN matched m ON m.method = o.method AND m.route_path = o.route_path WHERE o.role = 'consumer' GROUP BY ALL""",
)
def j6(spark, sf_dir):
    o = eligible(T.operations(spark, sf_dir))
    outcome = F.when(F.col("services").isNull(), "none").when(F.col("services") == 1, "unique").otherwise("ambiguous")
    return o.where("role = 'consumer'").join(producer_services(o), ["method", "route_path"], "left").groupBy("source_service", "method", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "a5_inventory_counts",
    f"""{CANONICAL} SELECT count(*) AS indexed_total, count(*) FILTER (route_path LIKE '%promo%' OR service LIKE '%1%') AS total, count(*) FILTER (producers > 0) AS producers,
  count(*) FILTER (producers = 0 AND consumers > 0) AS consumer_only, count(*) FILTER (producers > 0 AND consumers > 0) AS client_covered, count(*) FILTER (producers = 0 AND consumers = 0) AS unknown FROM canonical""",
)
def a5(spark, sf_dir):
    p, c = F.col("producers") > 0, F.col("consumers") > 0
    text = X.contains_fold(F.col("route_path"), "PROMO") & F.col("route_path").contains("promo") | F.col("service").contains("1")
    return canonical(T.operations(spark, sf_dir)).agg(F.count("*").alias("indexed_total"), F.count_if(text).alias("total"), F.count_if(p).alias("producers"), F.count_if(~p & c).alias("consumer_only"), F.count_if(p & c).alias("client_covered"), F.count_if(~p & ~c).alias("unknown"))


@query("l2_inventory_page", f"{CANONICAL}, cut AS (SELECT * FROM canonical WHERE id > 'endpoint:4' ORDER BY id LIMIT 201) SELECT id, service, method, route_path, row_number() OVER (ORDER BY id) AS position, (SELECT count(*) FROM cut) > 200 AS truncated FROM cut QUALIFY position <= 200")
def l2(spark, sf_dir):
    return page(canonical(T.operations(spark, sf_dir)), "endpoint:4", 200).select("id", "service", "method", "route_path", F.col("position").cast("long").alias("position"), "truncated")


@query(
    "j11_first_client",
    f"""{CANONICAL} SELECT c.id, c.service, c.method, c.route_path, (SELECT min_by(p.id, (p.file_path, p.id)) FROM placed p WHERE p.role = 'consumer' AND p.service = c.service AND p.method = c.method AND p.route_path = c.route_path) AS first_client FROM canonical c""",
)
def j11(spark, sf_dir):
    return canonical(T.operations(spark, sf_dir)).select("id", *KEY, "first_client")


@query(
    "j7_suffix_handler",
    f"""WITH {T.OPERATIONS}, short AS (SELECT DISTINCT source_service, method, api_group, regexp_extract(route_path, '^/[^/]*(/.*)$', 1) AS suffix FROM operations WHERE role = 'producer' AND framework = 'Utoipa'),
  full_ AS (SELECT DISTINCT source_service, method, api_group, route_path FROM operations WHERE framework = 'OpenAPI')
  SELECT f.source_service, f.method, f.api_group, f.route_path, CAST(count(s.suffix) AS BIGINT) AS handlers, CASE WHEN count(s.suffix) = 1 THEN min(s.suffix) END AS handler
  FROM full_ f LEFT JOIN short s ON s.source_service = f.source_service AND s.method = f.method AND s.api_group = f.api_group AND ends_with(f.route_path, s.suffix) GROUP BY ALL""",
)
def j7(spark, sf_dir):
    """Mounted routes and the one handler route that they end with: equal keys first, the suffix as what is left of the condition."""
    o = T.operations(spark, sf_dir)
    keys = ["source_service", "method", "api_group"]
    short = o.where("role = 'producer' and framework = 'Utoipa'").select(*keys, F.regexp_extract("route_path", "^/[^/]*(/.*)$", 1).alias("suffix")).distinct().alias("s")
    full = o.where("framework = 'OpenAPI'").select(*keys, "route_path").distinct().alias("f")
    on = [F.col(f"f.{k}") == F.col(f"s.{k}") for k in keys] + [F.endswith(F.col("f.route_path"), F.col("s.suffix"))]
    return full.join(short, on, "left").groupBy(*(F.col(f"f.{k}") for k in [*keys, "route_path"])).agg(F.count("suffix").alias("handlers"), F.when(F.count("suffix") == 1, F.min("suffix")).alias("handler"))


@query("j9_handler_text_filter", f"""{CANONICAL} SELECT id, service, method, route_path FROM canonical c WHERE EXISTS (SELECT 1 FROM placed p WHERE p.role = 'producer' AND p.service = c.service AND p.method = c.method AND p.route_path = c.route_path AND contains(p.api_group, 'Brand#1'))""")
def j9(spark, sf_dir):
    o = T.operations(spark, sf_dir)
    handlers = with_service(eligible(o)).where((F.col("role") == "producer") & X.contains_fold(F.col("api_group"), "bRAND#1"))
    return canonical(o).join(handlers, KEY, "left_semi").select("id", *KEY)


@query("p8_grouping", f"{CANONICAL} SELECT CASE WHEN framework = 'OpenAPI' THEN service || ' › ' || api_group ELSE array_to_string(string_split(file_path, '/')[:-2], ' › ') END AS grouping, count(*) AS operations, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM canonical GROUP BY 1")
def p8(spark, sf_dir):
    folders = F.slice(F.split("file_path", "/"), F.lit(1), F.size(F.split("file_path", "/")) - 1)
    grouping = F.when(F.col("framework") == "OpenAPI", F.array("service", "api_group")).otherwise(folders)
    return canonical(T.operations(spark, sf_dir)).groupBy(F.array_join(grouping, " › ").alias("grouping")).agg(F.count("*").alias("operations"), F.sum("occurrences").alias("occurrences"))


@query("p10_route_branch", f"{CANONICAL} SELECT string_split(route_path, '/')[2] AS branch, count(*) AS operations, count(DISTINCT method) AS methods FROM canonical GROUP BY 1")
def p10(spark, sf_dir):
    return canonical(T.operations(spark, sf_dir)).groupBy(F.array_join(X.route_branch(F.col("route_path")), "/").alias("branch")).agg(F.count("*").alias("operations"), F.count_distinct("method").alias("methods"))


@query("a17_role_counts", f"{CANONICAL} SELECT role, method, count(*) AS n FROM canonical GROUP BY ALL")
def a17(spark, sf_dir):
    return canonical(T.operations(spark, sf_dir)).groupBy("role", "method").agg(F.count("*").alias("n"))


@query(
    "a18_catalog_hierarchy",
    f"""{CANONICAL}, leaf AS (SELECT service, string_split(route_path, '/')[2] AS branch, method, count(*) AS n FROM canonical GROUP BY ALL)
  SELECT service, branch, string_agg(method || '=' || n, ',' ORDER BY method) AS methods, CAST(sum(n) AS BIGINT) AS n FROM leaf GROUP BY service, branch""",
)
def a18(spark, sf_dir):
    leaf = canonical(T.operations(spark, sf_dir)).groupBy("service", F.get(X.route_branch(F.col("route_path")), F.lit(0)).alias("branch"), "method").agg(F.count("*").alias("n"))
    methods = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("method", "n"))), lambda m: F.concat_ws("=", m["method"], m["n"])), ",")
    return leaf.groupBy("service", "branch").agg(methods.alias("methods"), F.sum("n").alias("n"))


@query("f18_coverage_filter", f"{CANONICAL} SELECT id, method, route_path FROM canonical WHERE producers > 0 AND consumers = 0 AND method = 'GET'")
def f18(spark, sf_dir):
    return canonical(T.operations(spark, sf_dir)).where("producers > 0 and consumers = 0 and method = 'GET'").select("id", "method", "route_path")


PAGES = r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?://)[^/@]*@', '\1') AS target FROM pages"""


@query("p11_sanitized_target", PAGES)
def p11(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", X.sanitized_target(F.col("url")).alias("target"))


@query("f11_remote_target", r"SELECT page_id, NOT (regexp_extract(lower(url), 'https?://([^/?#:]*)', 1) IN ('localhost', '0.0.0.0') OR regexp_extract(lower(url), 'https?://([^/?#:]*)', 1) LIKE '127.%') AND regexp_matches(lower(url), 'https?://') AS remote FROM pages")
def f11(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", X.remote_target(F.col("url")).alias("remote"))


@query("p25_request_path", r"SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/+$', '') AS p FROM pages)")
def p25(spark, sf_dir):
    """The path of a URL or of a bare path, without query and trailing slashes."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "/+$", "")
    return T.table(spark, sf_dir, "pages").select("page_id", F.when(bare == "", "/").otherwise(bare).alias("path"))


@query("a7_first_two_services", f"WITH {T.OPERATIONS}, d AS (SELECT DISTINCT method, route_path, source_service FROM operations WHERE role = 'producer') SELECT method, route_path, source_service, row_number() OVER (PARTITION BY method, route_path ORDER BY source_service) AS nth FROM d QUALIFY nth <= 2")
def a7(spark, sf_dir):
    """Two services at most of each route: enough to tell one from several."""
    made = eligible(T.operations(spark, sf_dir)).where("role = 'producer'").select("method", "route_path", "source_service").distinct()
    nth = F.row_number().over(Window.partitionBy("method", "route_path").orderBy("source_service"))
    return made.withColumn("nth", nth).where("nth <= 2").select("method", "route_path", "source_service", F.col("nth").cast("long").alias("nth"))


@query("a8_route_scalars", f"WITH {T.OPERATIONS} SELECT method, count(DISTINCT source_service) AS services, count(DISTINCT route_path) AS routes, min(source_service) AS first_service, min(id) AS first_id FROM operations WHERE role = 'consumer' GROUP BY method")
def a8(spark, sf_dir):
    o = eligible(T.operations(spark, sf_dir)).where("role = 'consumer'")
    return o.groupBy("method").agg(F.count_distinct("source_service").alias("services"), F.count_distinct("route_path").alias("routes"), F.min("source_service").alias("first_service"), F.min("id").alias("first_id"))
