"""Wire sources: OTLP/JSON trace exports, prefixed trace lines, OpenAPI documents, source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.operators.evidence import sanitized_fields
from threadloom.operators.runtime import span_category
from threadloom.sources import tables as T

VALUE = "struct<stringValue:string,intValue:string,doubleValue:double>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRIBUTES},status:struct<code:int>>"
EXPORT = f"struct<resourceSpans:array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeSpans:array<struct<spans:array<{SPAN}>>>>>>"
TRACE_FIELDS = ("event", "trace", "span", "phase")
# Fields of a debug line, its kinds, stages, states and outcomes, kinds that need an operation, bounds.
DEBUG_SOURCE = "relativePath:string,line:long,lineEnd:long,nodeId:string"
DEBUG_PREVIEW = "kind:string,typeName:string,fields:array<struct<name:string,valueType:string,nullable:boolean>>,itemCount:long,rowCount:long,nullCount:long,truncated:boolean"
DEBUG_TEXTS = ("nonce", "debugSessionId", "workflowId", "stepId", "parentStepId", "kind", "flowStage", "safePointState", "branchOutcome", "operation", "resource")
DEBUG_KINDS = ("request", "method", "line", "branch", "database", "agent", "external", "response")
DEBUG_STAGES = ("trigger", "api", "backend", "service", "data", "external", "response")
DEBUG_STATES = ("running", "paused", "workflowCompleted", "workflowFailed")
DEBUG_OUTCOMES = ("then", "else", "case", "loop", "shortCircuit", "unknown")
WITH_OPERATION = ("method", "database", "agent", "external")
DEBUG_EVENTS, DEBUG_LINE, DEBUG_COUNT = 2_000, 10_000_000, 1_000_000_000
DAY_NANOS = 86_400_000_000_000


def attribute(attributes: str, key: str):
    found = F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))
    return F.coalesce(found["value"]["stringValue"], found["value"]["intValue"])


def otlp_spans(raw: DataFrame, column: str = "value") -> DataFrame:
    """Exports (JSON text) to the spans that are accepted: ids of 32 and 16 hex digits that aren't zero, a parent that is another span or none, a
    plain name, and up to a day of duration."""
    body = raw.select(F.from_json(column, EXPORT).alias("e"))
    resource = body.select(F.explode("e.resourceSpans").alias("r"))
    scope = resource.select(attribute("r.resource.attributes", "service.name").alias("service"), F.explode("r.scopeSpans").alias("s"))
    span = scope.select("service", F.explode("s.spans").alias("x")).select("service", "x.*")
    start, stop = F.expr("try_cast(startTimeUnixNano as bigint)"), F.expr("try_cast(endTimeUnixNano as bigint)")
    named = span.select(
        "service", F.lower("traceId").alias("trace_id"), F.lower("spanId").alias("span_id"), F.nullif(F.lower("parentSpanId"), F.lit("")).alias("parent_id"), "name", F.coalesce("kind", F.lit(0)).alias("kind"),
        start.alias("start_nanos"), (stop - start).alias("nanos"), attribute("attributes", "db.system.name").alias("db"), attribute("attributes", "messaging.system").alias("messaging"),
        attribute("attributes", "http.route").alias("route"), attribute("attributes", "http.request.method").alias("method"), attribute("attributes", "error.type").alias("error"), F.coalesce("status.code", F.lit(0)).alias("code"),
    )
    ok = (
        F.col("trace_id").rlike("^[0-9a-f]{32}$") & ~F.col("trace_id").rlike("^0+$") & F.col("span_id").rlike("^[0-9a-f]{16}$") & ~F.col("span_id").rlike("^0+$")
        & (F.col("parent_id").isNull() | (F.col("parent_id").rlike("^[0-9a-f]{16}$") & (F.col("parent_id") != F.col("span_id"))))
        & (F.char_length("name") > 0) & ~F.col("name").rlike(r"\p{Cntrl}") & (F.col("start_nanos") > 0) & F.col("nanos").between(0, DAY_NANOS)
    )
    status = F.when((F.col("code") == 2) | F.col("error").isNotNull(), "error").when(F.col("code") == 1, "ok").otherwise("unset")
    return named.where(ok).select("service", "trace_id", "span_id", "parent_id", span_category("db", "messaging", "kind", "route", "method").alias("category"), "start_nanos", F.expr("nanos div 1000000").alias("duration_ms"), status.alias("status"))


def trace_lines(lines: DataFrame, prefix: str, column: str = "value", most_bytes: int = 16384) -> DataFrame:
    """Lines with the prefix and a JSON object of known fields only; longer lines and unknown fields are refused."""
    own = lines.where(F.col(column).startswith(prefix) & (F.octet_length(column) <= most_bytes)).select(F.substring(column, len(prefix) + 1, most_bytes).alias("body"))
    keys = F.expr("json_object_keys(body)")
    known = own.where(keys.isNotNull() & F.forall(keys, lambda k: k.isin(*TRACE_FIELDS)))
    return known.select(F.from_json("body", "event long, trace string, span string, phase string").alias("j")).select("j.*").where("event is not null and trace is not null")


def only_fields(body, names):
    """Whether a JSON object has no other fields than these; null if it is none."""
    return F.forall(F.json_object_keys(body), lambda k: k.isin(*names))


def debug_lines(lines: DataFrame, prefix: str, nonce: str, session: str, column: str = "value") -> DataFrame:
    """Safe points of a debugged run: lines with the prefix, each with `reason` (null: accepted; else malformed, identity, steps, sequence, source,
    branch, semantics or preview) and its fields. Previews are of shapes only; sensitive names in them are masked. Other lines are left out."""
    schema = f"{', '.join(f'{t} string' for t in DEBUG_TEXTS)}, sequence long, controlEpoch long, source struct<{DEBUG_SOURCE}>, dataPreview struct<{DEBUG_PREVIEW}>"
    own = lines.where(F.col(column).startswith(prefix)).select(F.substr(column, F.lit(len(prefix) + 1)).alias("body"))
    part = lambda name, fields: only_fields(F.get_json_object("body", f"$.{name}"), [f.split(":")[0] for f in fields])
    shape = only_fields(F.col("body"), (*DEBUG_TEXTS, "sequence", "controlEpoch", "source", "dataPreview"))
    shape &= part("source", DEBUG_SOURCE.split(",")) & F.coalesce(part("dataPreview", ("kind", "typeName", "fields", "itemCount", "rowCount", "nullCount", "truncated")), F.lit(True))
    d = own.select("body", shape.alias("shape"), F.from_json("body", schema).alias("j")).select("shape", "j.*")
    c, within = F.col, lambda v, values: F.coalesce(v.isin(*values), F.lit(False))
    whole = X.any_of(*(c(n).isNull() for n in ("nonce", "debugSessionId", "workflowId", "stepId", "sequence", "controlEpoch", "source.relativePath", "source.line")))
    whole = c("shape") & ~whole & within(c("kind"), DEBUG_KINDS) & within(c("flowStage"), DEBUG_STAGES) & within(c("safePointState"), DEBUG_STATES) & (c("branchOutcome").isNull() | within(c("branchOutcome"), DEBUG_OUTCOMES))
    identity = lambda v: v.rlike(r"\A[A-Za-z0-9_.:-]{1,128}\z")
    plain = lambda v: v.isNull() | v.rlike(r"\A[A-Za-z0-9 _.:/-]{1,128}\z")
    none = lambda v, test: F.coalesce(test(v), F.lit(True))
    steps = identity(c("workflowId")) & identity(c("stepId")) & none(c("parentStepId"), lambda v: identity(v) & (v != c("stepId")))
    path, line, end = c("source.relativePath"), c("source.line"), c("source.lineEnd")
    place = path.rlike(r"\A[^\p{Cntrl}]{1,1024}\z") & ~path.rlike(r"^/|^\./|^\.$|(^|/)\.\.(/|$)") & ~X.denied_path(path) & line.between(1, DEBUG_LINE)
    place &= none(end, lambda v: v.between(line, DEBUG_LINE)) & none(c("source.nodeId"), identity)
    said = plain(c("operation")) & plain(c("resource")) & (~c("kind").isin(*WITH_OPERATION) | c("operation").isNotNull())
    fields = sanitized_fields(F.transform("dataPreview.fields", lambda f: F.struct(f["name"].alias("name"), f["valueType"].alias("type"))))
    counts = [none(c(f"dataPreview.{n}"), lambda v: v.between(0, DEBUG_COUNT)) for n in ("itemCount", "rowCount", "nullCount")]
    shown = c("dataPreview").isNull() | (fields.isNotNull() & counts[0] & counts[1] & counts[2] & plain(c("dataPreview.typeName")))
    tests = {
        "malformed": whole, "identity": (c("nonce") == nonce) & (c("debugSessionId") == session), "steps": steps, "sequence": c("sequence").between(1, DEBUG_EVENTS),
        "source": place, "branch": (c("kind") == "branch") == c("branchOutcome").isNotNull(), "semantics": said, "preview": shown,
    }
    reason = F.coalesce(*(F.when(~F.coalesce(test, F.lit(False)), name) for name, test in tests.items()))
    kept = ("workflowId", "sequence", "controlEpoch", "stepId", "parentStepId", "kind", "flowStage", "source", "safePointState", "branchOutcome", "operation", "resource")
    return d.select(reason.alias("reason"), *kept, fields.alias("fields"))


def openapi_operations(files: DataFrame) -> DataFrame:
    """(relative_path, title, method, route_path, operation_id, api_group) of OpenAPI documents in JSON."""
    spec = files.where(F.col("relative_path").endswith(".json")).select("relative_path", F.from_json("text", "openapi string, swagger string, info struct<title:string>, paths map<string,map<string,struct<operationId:string,tags:array<string>>>>").alias("s"))
    routes = spec.where("s.openapi is not null or s.swagger is not null").select("relative_path", "s.info.title", F.explode("s.paths").alias("route_path", "item"))
    ops = routes.select("relative_path", "title", "route_path", F.explode("item").alias("verb", "o"))
    return ops.where(F.upper("verb").isin(*X.HTTP_METHODS)).select("relative_path", "title", F.upper("verb").alias("method"), "route_path", F.col("o.operationId").alias("operation_id"), F.get("o.tags", F.lit(0)).alias("api_group"))


def source_tree(spark: SparkSession, root: str, most_files: int = 20_000, most_bytes: int = 256 << 20, largest: int = 2 << 20) -> DataFrame:
    """(relative_path, language, capability, size_bytes, content_hash, text) of a folder's readable files; beyond the bounds it is an error."""
    clean = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(clean)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^.*?{clean.rsplit('/', 1)[-1]}/", "")
    found = raw.where(F.col("length") <= largest).withColumn("relative_path", path).where(~X.denied_path(F.col("relative_path")))
    n, size = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n > most_files or size > most_bytes:
        raise ValueError(f"{n} files of {size} bytes exceed the scan's bounds")
    languages = F.broadcast(spark.createDataFrame([(k, *v) for k, v in X.LANGUAGES.items()], "ext string, language string, capability string"))
    text = found.where(F.expr("is_valid_utf8(cast(content as string))") & ~F.contains(F.col("content"), F.lit(b"\x00")))
    out = text.withColumn("ext", X.extension(F.col("relative_path"))).join(languages, "ext", "left")
    return out.select("relative_path", F.coalesce("language", F.lit("Text")).alias("language"), F.coalesce("capability", F.lit("textOnly")).alias("capability"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("text"))


EV = f"WITH {T.EVENTS}"
HEX = "lower(lpad(to_hex({}), {}, '0'))"


@query(
    "s13_otlp_spans",
    f"""{EV} SELECT 'user-' || (k % 5) AS service, {HEX.format("k + 1", 32)} AS trace_id, {HEX.format("event_id + 1", 16)} AS span_id, CASE WHEN event_id > 0 THEN {HEX.format("event_id", 16)} END AS parent_id,
  CASE WHEN kind = 'purchase' THEN 'Database' WHEN k % 6 IN (4, 5) THEN 'Event' WHEN k % 6 = 2 THEN 'HttpServer' WHEN k % 6 = 3 THEN 'External' ELSE 'Function' END AS category,
  CAST(epoch_us(seen_at) * 1000 AS BIGINT) AS start_nanos, CAST(floor(value) AS BIGINT) AS duration_ms, CASE kind WHEN 'error' THEN 'error' WHEN 'click' THEN 'ok' ELSE 'unset' END AS status FROM runtime_events WHERE k % 11 <> 0""",
)
def s13(spark, sf_dir):
    """Events written as trace exports and decoded again; those with an all-zero span id are refused."""
    e = T.runtime_events(spark, sf_dir)
    hex_ = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    nanos = F.unix_micros("at") * 1000
    attribute_ = lambda key, value: F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))
    span = F.struct(
        hex_(F.col("k") + 1, 32).alias("traceId"),
        F.when(F.expr("k % 11 = 0"), "0" * 16).otherwise(hex_(F.col("event_id") + 1, 16)).alias("spanId"),
        F.when(F.col("event_id") > 0, hex_(F.col("event_id"), 16)).otherwise("").alias("parentSpanId"),
        F.col("kind").alias("name"),
        F.expr("cast(k % 6 as int)").alias("kind"),
        nanos.cast("string").alias("startTimeUnixNano"),
        (nanos + F.floor("value") * 1_000_000).cast("string").alias("endTimeUnixNano"),
        F.when(F.col("kind") == "purchase", F.array(attribute_("db.system.name", F.lit("sql")))).otherwise(F.array(attribute_("note", F.lit("none")))).alias("attributes"),
        F.struct(F.when(F.col("kind") == "error", 2).when(F.col("kind") == "click", 1).otherwise(0).alias("code")).alias("status"),
    )
    service = F.array(attribute_("service.name", F.concat(F.lit("user-"), F.expr("cast(k % 5 as string)"))))
    export = F.to_json(F.struct(F.array(F.struct(F.struct(service.alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    return otlp_spans(e.select(export.alias("value")))


@query("s14_trace_lines", f"{EV} SELECT event_id AS event, trace_id AS trace, span_id AS span, phase FROM runtime_events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def s14(spark, sf_dir):
    """Events as prefixed lines among others; lines without the prefix and with unknown fields are refused."""
    e = T.runtime_events(spark, sf_dir)
    extra = F.when(F.expr("event_id % 5 = 0"), F.lit("?"))  # an unknown field: to_json leaves nulls out
    body = F.to_json(F.struct(F.col("event_id").alias("event"), F.col("trace_id").alias("trace"), F.col("span_id").alias("span"), "phase", extra.alias("extra")))
    line = F.when(F.expr("event_id % 7 = 0"), body).otherwise(F.concat(F.lit("@trace "), body))
    return trace_lines(e.select(line.alias("value")), "@trace ")


@query(
    "s15_debug_lines",
    f"""WITH {T.STEPS} SELECT workflow_id, sequence + 1 AS step, CASE WHEN workflow_id % 13 = 0 THEN 'identity' WHEN workflow_id % 17 = 0 THEN 'source' WHEN workflow_id % 19 = 0 THEN 'branch'
    WHEN workflow_id % 3 = 0 AND kind = 'method' THEN 'semantics' WHEN workflow_id % 23 = 0 THEN 'preview' END AS reason, CASE WHEN workflow_id % 23 <> 0 THEN CASE WHEN size % 4 = 0 THEN '[sensitive-field]' ELSE 'label' END END AS field FROM workflow_steps WHERE workflow_id % 11 <> 0""",
)
def s15(spark, sf_dir):
    """Workflow steps as debug lines among others, and what is said of each."""
    w, k = T.workflow_steps(spark, sf_dir), lambda n: F.expr(f"workflow_id % {n} = 0")
    field = F.struct(F.when(F.expr("size % 4 = 0"), "password").otherwise("label").alias("name"), F.when(k(23), "a<b>").otherwise("text").alias("valueType"), F.lit(True).alias("nullable"))
    preview = F.struct(F.lit("record").alias("kind"), F.array(field).alias("fields"), F.col("size").alias("itemCount"), F.lit(False).alias("truncated"))
    source = F.struct(F.when(k(17), "src/../x").otherwise("src/x.ts").alias("relativePath"), F.lit(3).alias("line"))
    step = F.concat(F.lit("step:"), F.col("sequence").cast("string"))
    body = F.to_json(F.struct(
        F.when(k(13), "other").otherwise("n1").alias("nonce"), F.lit("d1").alias("debugSessionId"), F.col("workflow_id").cast("string").alias("workflowId"), (F.col("sequence") + 1).alias("sequence"), F.lit(0).alias("controlEpoch"),
        step.alias("stepId"), "kind", F.lit("service").alias("flowStage"), source.alias("source"), F.lit("running").alias("safePointState"), F.when(k(19), "then").alias("branchOutcome"), F.when(~k(3), "run").alias("operation"), preview.alias("dataPreview"),
    ))
    line = F.concat(F.when(k(11), "").otherwise("@debug "), body)
    found = debug_lines(w.select(line.alias("value")), "@debug ", "n1", "d1")
    return found.select(F.col("workflowId").cast("long").alias("workflow_id"), F.col("sequence").alias("step"), "reason", F.get("fields", F.lit(0))["name"].alias("field"))
