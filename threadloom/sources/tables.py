"""The given tables as facts: files, nodes, edges, operations, runtime events and workflow steps.

Each adapter has its SQL twin (a common table expression for DuckDB) beside it, which oracle queries start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.identity import stable_id, stable_id_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores, where it comes in fewer parts than there are cores (one row group is one task): what is computed from them
    then costs more than dealing them out. Scans of many parts stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def distinct_by(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows, dealt by some of their columns to as many tasks as shuffles have: numbers take little room, so left to itself Spark puts many
    more of them in a task than of the strings that are made of them there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a source tree, with paths that meet every path policy."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    n, i = F.expr("doc_id % 8"), F.col("doc_id").cast("string")
    path = (
        F.when(n == 0, F.concat("source", F.lit("/src/"), "lang", F.lit("/"), i, F.lit(".ts")))
        .when(n == 1, F.concat("source", F.lit("/tests/"), i, F.lit(".test.ts")))
        .when(n == 2, F.concat(F.lit("docs/"), "source", F.lit("/"), i, F.lit(".md")))
        .when(n == 3, F.concat(F.lit("src/latest"), i, F.lit("/latest.ts")))
        .when(n == 4, F.concat("source", F.lit("/src/Jobs/"), i, F.lit("_test.py")))
        .when(n == 5, F.concat("source", F.lit("/node_modules/"), i, F.lit(".js")))
        .when(n == 6, F.concat("source", F.lit("/.env."), i))
        .otherwise(F.concat("source", F.lit("/models/"), "lang", F.lit("/repository."), i, F.lit(".rs")))
    )
    return d.select("doc_id", path.alias("relative_path"), "lang", "source", "text", F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("content_hash"))


FILES = """files AS (
  SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN source || '/src/' || lang || '/' || doc_id || '.ts'
    WHEN 1 THEN source || '/tests/' || doc_id || '.test.ts'
    WHEN 2 THEN 'docs/' || source || '/' || doc_id || '.md'
    WHEN 3 THEN 'src/latest' || doc_id || '/latest.ts'
    WHEN 4 THEN source || '/src/Jobs/' || doc_id || '_test.py'
    WHEN 5 THEN source || '/node_modules/' || doc_id || '.js'
    WHEN 6 THEN source || '/.env.' || doc_id
    ELSE source || '/models/' || lang || '/repository.' || doc_id || '.rs' END AS relative_path,
    lang, source, text, strlen(text) AS size_bytes, sha256(text) AS content_hash
  FROM documents
)"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as HTTP operation facts: the supplier's nation is the service, part and supplier give the route."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    o = li.join(part, "l_partkey").join(supplier, "l_suppkey").join(nation, "s_nationkey")
    method = F.when(F.col("l_returnflag") == "R", "GET").when(F.col("l_returnflag") == "A", "POST").otherwise("PUT")
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int"))
    return o.select(
        stable_id("endpoint", key).alias("id"),
        F.concat("n_name", F.lit("/src/"), "p_brand", F.lit(".ts")).alias("file_path"),
        F.when(F.expr("l_linenumber % 4 = 1"), "producer").when(F.expr("l_linenumber % 7 = 0"), "unknown").otherwise("consumer").alias("role"),
        method.alias("method"),
        F.concat(F.lit("/"), "p_type", F.lit("/"), F.col("p_size").cast("string"), F.lit("/"), F.expr("cast(l_suppkey % 7 as string)")).alias("route_path"),
        F.when(F.col("l_linestatus") == "O", "OpenAPI").when(F.expr("l_quantity > 25"), "Utoipa").alias("framework"),
        F.col("n_name").alias("source_service"),
        F.col("p_brand").alias("api_group"),
    )


OPERATIONS = f"""operations AS (
  SELECT {stable_id_sql("endpoint", "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER))")} AS id,
    n_name || '/src/' || p_brand || '.ts' AS file_path,
    CASE WHEN l_linenumber % 4 = 1 THEN 'producer' WHEN l_linenumber % 7 = 0 THEN 'unknown' ELSE 'consumer' END AS role,
    CASE l_returnflag WHEN 'R' THEN 'GET' WHEN 'A' THEN 'POST' ELSE 'PUT' END AS method,
    '/' || p_type || '/' || p_size || '/' || (l_suppkey % 7) AS route_path,
    CASE WHEN l_linestatus = 'O' THEN 'OpenAPI' WHEN l_quantity > 25 THEN 'Utoipa' END AS framework,
    n_name AS source_service, p_brand AS api_group
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, label, file_path): one node for each row of the entity tables."""
    t = lambda name: table(spark, sf_dir, name)
    put = lambda df, kind, key, label, path: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label"), path.alias("file_path"))
    return (
        put(t("region"), "service", "r_regionkey", "r_name", F.concat(F.lit("regions/src/"), F.lower("r_name"), F.lit(".ts")))
        .unionByName(put(t("nation"), "controller", "n_nationkey", "n_name", F.concat(F.lit("nations/src/"), F.lower("n_name"), F.lit(".ts"))))
        .unionByName(put(t("customer"), "class", "c_custkey", "c_name", F.concat(F.lit("customers/"), F.lower("c_mktsegment"), F.lit("/model.ts"))))
        .unionByName(put(t("supplier"), "repository", "s_suppkey", "s_name", F.lit("suppliers/storage/repository.rs")))
        .unionByName(put(t("part"), "model", "p_partkey", "p_name", F.concat(F.lit("parts/"), F.lower("p_type"), F.lit(".rs"))))
        .unionByName(put(t("orders"), "endpoint", "o_orderkey", "o_orderpriority", F.concat(F.lit("orders/src/"), F.lower("o_orderstatus"), F.lit("/api.ts"))))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, target, kind, evidence, confidence): foreign keys of the entity tables as directed edges."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    put = lambda df, a, b, kind, evidence: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"), F.lit(evidence).alias("evidence"))
    items = spread(t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey"))
    all_ = (
        put(t("nation"), node("service", "n_regionkey"), node("controller", "n_nationkey"), "contains", "declared")
        .unionByName(put(t("customer"), node("controller", "c_nationkey"), node("class", "c_custkey"), "contains", "declared"))
        .unionByName(put(t("supplier"), node("controller", "s_nationkey"), node("repository", "s_suppkey"), "contains", "declared"))
        .unionByName(put(t("orders"), node("class", "o_custkey"), node("endpoint", "o_orderkey"), "requests", "resolved"))
        .unionByName(put(distinct_by(items.select("l_orderkey", "l_partkey"), "l_orderkey"), node("endpoint", "l_orderkey"), node("model", "l_partkey"), "accesses", "observed"))
        .unionByName(put(distinct_by(items.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey"), node("model", "l_partkey"), node("repository", "l_suppkey"), "queries", "inferred"))
    )
    return all_.select(F.concat_ws(">", "source", "target", "kind").alias("id"), "source", "target", "kind", "evidence", F.when(F.col("evidence") == "inferred", F.lit(0.6)).alias("confidence"))


NODES = """nodes AS (
  SELECT 'service:' || r_regionkey AS id, 'service' AS kind, r_name AS label, 'regions/src/' || lower(r_name) || '.ts' AS file_path FROM region
  UNION ALL SELECT 'controller:' || n_nationkey, 'controller', n_name, 'nations/src/' || lower(n_name) || '.ts' FROM nation
  UNION ALL SELECT 'class:' || c_custkey, 'class', c_name, 'customers/' || lower(c_mktsegment) || '/model.ts' FROM customer
  UNION ALL SELECT 'repository:' || s_suppkey, 'repository', s_name, 'suppliers/storage/repository.rs' FROM supplier
  UNION ALL SELECT 'model:' || p_partkey, 'model', p_name, 'parts/' || lower(p_type) || '.rs' FROM part
  UNION ALL SELECT 'endpoint:' || o_orderkey, 'endpoint', o_orderpriority, 'orders/src/' || lower(o_orderstatus) || '/api.ts' FROM orders
)"""
EDGES = """edges AS (
  SELECT source || '>' || target || '>' || kind AS id, source, target, kind, evidence, CASE evidence WHEN 'inferred' THEN 0.6 END AS confidence FROM (
    SELECT 'service:' || n_regionkey AS source, 'controller:' || n_nationkey AS target, 'contains' AS kind, 'declared' AS evidence FROM nation
    UNION ALL SELECT 'controller:' || c_nationkey, 'class:' || c_custkey, 'contains', 'declared' FROM customer
    UNION ALL SELECT 'controller:' || s_nationkey, 'repository:' || s_suppkey, 'contains', 'declared' FROM supplier
    UNION ALL SELECT 'class:' || o_custkey, 'endpoint:' || o_orderkey, 'requests', 'resolved' FROM orders
    UNION ALL SELECT DISTINCT 'endpoint:' || l_orderkey, 'model:' || l_partkey, 'accesses', 'observed' FROM lineitem
    UNION ALL SELECT DISTINCT 'model:' || l_partkey, 'repository:' || l_suppkey, 'queries', 'inferred' FROM lineitem
  )
)"""


def runtime_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runtime observations: the user is the trace, the event the span, the user's event before it the parent."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("at"),
        F.concat(F.lit("trace-"), F.col("user_id").cast("string")).alias("trace_id"),
        F.concat(F.lit("span-"), F.expr("cast(event_id div 3 as string)")).alias("span_id"),
        F.element_at(F.array(F.lit("start"), F.lit("event"), F.lit("end")), F.expr("cast(event_id % 3 as int) + 1")).alias("phase"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("value"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.concat(F.lit("endpoint:"), F.expr("cast(event_id % 997 as string)")).alias("node_id"),
    )


EVENTS = """runtime_events AS (
  SELECT event_id, ts AS seen_at, 'trace-' || user_id AS trace_id, 'span-' || (event_id // 3) AS span_id,
    CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'event' ELSE 'end' END AS phase, event_type AS kind, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'endpoint:' || (event_id % 997) AS node_id
  FROM events
)"""


def workflow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as debug workflows: the turn is the sequence, the role the kind of step."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "request").when(F.col("role") == "assistant", "response").otherwise("method")
    return c.select(F.col("conv_id").alias("workflow_id"), F.col("turn").alias("sequence"), kind.alias("kind"), X.short_label(F.col("text"), 40).alias("label"), F.char_length("text").cast("long").alias("size"))


STEPS = r"""workflow_steps AS (
  SELECT conv_id AS workflow_id, turn AS sequence, CASE role WHEN 'user' THEN 'request' WHEN 'assistant' THEN 'response' ELSE 'method' END AS kind,
    CASE WHEN length(t) > 40 THEN left(t, 39) || '…' ELSE t END AS label, length(text) AS size
  FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
)"""
