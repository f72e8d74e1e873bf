"""What a reader of a graph walks along: lanes and stages of a node, its key facts, hits of an index, handlers, changes, run profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalog import query
from threadloom.functions import text as X
from threadloom.operators import graph, overview
from threadloom.plans.stages import written
from threadloom.sources import tables as T

# Stages of a flow and other names for them, kinds by stage, lanes by declared layer and by what a kind's name holds.
STAGES = ("trigger", "api", "backend", "service", "data", "external")
STAGE_NAMES = {
    "trigger": ("frontend", "ui", "source", "configuration"),
    "api": ("interface", "event", "web"),
    "backend": ("entry", "entrypoint", "controller"),
    "service": ("agent", "application", "domain", "other"),
    "data": ("repository", "database"),
    "external": ("outbound",),
}
FRONTEND_KINDS = ("button", "client", "component", "frontend", "page", "screen", "ui", "view")
API_KINDS = ("api", "endpoint", "event", "functionapp", "graphql", "listener", "publication", "route", "subscription", "topic", "webhook")
DATA_KINDS = ("cache", "collection", "dao", "database", "document", "entity", "heading", "model", "persistence", "queue", "record", "repository", "schema", "store", "table", "sentence")
EXTERNAL_KINDS = ("cloudservice", "dependency", "externalapi", "externalservice", "sdk", "thirdparty", "vendor")
BACKEND_KINDS = ("application", "backend", "command", "controller", "entry", "entrypoint", "handler", "main", "orchestrator", "router", "server")
LAYER_LANES = {
    "source": ("configuration", "entry", "source"),
    "domain": ("application", "domain"),
    "interface": ("web", "ui", "api", "interface"),
    "data": ("data",),
    "external": ("external",),
    "runtime": ("runtime", "analysis"),
}
LANE_TOKENS = {
    "runtime": ("runtime", "trace", "span", "observation", "log", "risk", "analysis", "warning"),
    "external": ("external", "vendor", "sdk", "dependency", "broker", "queue", "topic"),
    "data": ("repository", "model", "entity", "schema", "table", "database", "collection", "document", "heading", "sentence", "record", "store", "cache", "persistence", "dao"),
    "interface": ("api", "endpoint", "event", "listener", "subscription", "publication", "route", "router", "controller", "handler", "component", "page", "view", "screen", "hook", "web", "client", "http", "rest", "graphql"),
    "source": ("file", "module", "namespace", "package", "directory", "folder", "import", "export"),
}
KEY_FACTS = (
    "method", "route", "url", "host", "role", "resolver", "table", "database", "engine", "status", "statuscode", "durationms", "traceid", "requestid", "eventid", "eventapi", "eventdirection", "eventoperation",
    "staticeventname", "profileid", "confidence", "observationmode", "documentformat", "headinglevel", "documentorder", "communityid", "communitysize", "communityalgorithm", "communitybasis", "communitycomplete",
    "basis", "reason", "detail", "note",
)
WORD_FORMS = {"api": "API", "http": "HTTP", "id": "ID", "url": "URL", "ms": "ms"}
CHANGE_LABELS = {"insert": "Inserted", "delete": "Deleted", "conflict": "Conflict", "modify": "Modified"}
# Manifests that a run profile comes from (label, executable, arguments, kind), scripts that come first, lock files, bounds.
MANIFESTS = {
    "Cargo.toml": ("Cargo run", "cargo", "run", "cargo"),
    "go.mod": ("Go run", "go", "run .", "go"),
    "manage.py": ("Django development server", "python3", "manage.py runserver", "python"),
    "compose.yaml": ("Docker Compose", "docker", "compose up", "dockerCompose"),
    "compose.yml": ("Docker Compose", "docker", "compose up", "dockerCompose"),
    "docker-compose.yaml": ("Docker Compose", "docker", "compose up", "dockerCompose"),
    "docker-compose.yml": ("Docker Compose", "docker", "compose up", "dockerCompose"),
    "pom.xml": ("Maven application", "mvn", "spring-boot:run", "java"),
    "build.gradle": ("Gradle application", "gradle", "run", "java"),
    "build.gradle.kts": ("Gradle application", "gradle", "run", "java"),
}
FIRST_SCRIPTS = ("dev", "start", "serve", "preview")
LOCKS = {"pnpm": ("pnpm-lock.yaml",), "yarn": ("yarn.lock",), "bun": ("bun.lock", "bun.lockb")}
MOST_MANIFESTS, MOST_PROFILES, MOST_SCRIPTS, MOST_PARTS = 100, 100, 30, 8
MANIFEST_BYTES = 1 << 20


def token(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "[^a-zA-Z0-9]", ""))


def renamed(value: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """The key whose names hold the value, else null."""
    return F.coalesce(*(F.when(value.isin(*also), key) for key, also in names.items()))


def view_stage(kind: Column, label: Column, path: Column, *declared: Column) -> Column:
    """The stage of a flow that a node is shown in: the first of the declared values that names one, else by kind, path and label."""
    names = {stage: (stage, *STAGE_NAMES[stage]) for stage in STAGES}
    k, p = token(kind), F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    page = p.rlike(r"\.(jsx|tsx|vue|svelte)$") & ~p.rlike("(server|backend|api|route)")
    folder = p.rlike(r"(^|/)(frontend|client|ui|views?|pages?|screens?|components?|admin)(/|$)")
    front = k.isin(*FRONTEND_KINDS) | page | folder | label.rlike(r"(?i)\b(click|submit|refresh|button)\b")
    route = label.rlike(r"(?i)^(get|post|put|patch|delete|options|head|connect|trace)\s+/")
    told = [renamed(token(d), names) for d in declared]
    by_kind = F.when(k.isin("runtimeevent", "runtimespan") | front, "trigger").when(k.isin(*API_KINDS) | route, "api").when(k.isin(*DATA_KINDS), "data").when(k.isin(*EXTERNAL_KINDS), "external").when(k.isin(*BACKEND_KINDS), "backend")
    return F.coalesce(*told, by_kind, F.lit("service"))


def lane(kind: Column, *declared: Column) -> Column:
    """The lane of a node: by the first declared layer that is there, if it is known, else by what the kind's name holds."""
    k = token(kind)
    by_kind = F.coalesce(*(F.when(X.any_of(*(k.contains(t) for t in tokens)), name) for name, tokens in LANE_TOKENS.items()))
    return F.coalesce(renamed(token(F.coalesce(*declared)), LAYER_LANES), by_kind, F.lit("domain"))


def fact_label(key: Column) -> Column:
    """A key of metadata as words."""
    words = F.regexp_replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.split(F.trim(F.regexp_replace(words, r"[-_\s]+", " ")), " ")
    form = F.create_map(*(F.lit(x) for kv in WORD_FORMS.items() for x in kv))
    shown = lambda w, i: F.coalesce(form[F.lower(w)], F.when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))).otherwise(F.lower(w)))
    return F.array_join(F.transform(words, shown), " ")


def presented(metadata: Column) -> tuple[Column, Column]:
    """(key facts by rank, the rest by key) of a map of texts, as arrays of (rank, key, label, value); an empty value is "(empty)"."""
    entry = lambda e: F.struct(
        F.array_position(F.array(*map(F.lit, KEY_FACTS)), token(e["key"])).alias("rank"), e["key"].alias("key"), fact_label(e["key"]).alias("label"),
        F.when(e["value"] == "", "(empty)").otherwise(F.coalesce(e["value"], F.lit("null"))).alias("value"),
    )
    entries = F.transform(F.map_entries(metadata), entry)
    return F.array_sort(F.filter(entries, lambda e: e["rank"] > 0)), F.array_sort(F.filter(entries, lambda e: e["rank"] == 0))


def index_hits(texts: DataFrame, key: str, text: str, terms: tuple[str, ...]) -> DataFrame:
    """(key, terms): rows that hold any of the terms (ASCII words in lower case), and how many different ones. No text is shuffled."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    found = F.array_intersect(words, F.array(*map(F.lit, terms)))
    return texts.select(key, F.size(found).cast("long").alias("terms")).where("terms > 0")


def unique_handlers(operations: DataFrame, handles: DataFrame) -> DataFrame:
    """(method, route_path, service, owner, operation_id) of operations (id, method, route_path, service) that one owner alone handles, by
    links handles (owner, target). Least and greatest owner tell that: nothing is gathered a group."""
    linked = operations.join(handles.withColumnRenamed("target", "id"), "id")
    found = linked.groupBy("method", "route_path", "service").agg(F.min("owner").alias("owner"), F.max("owner").alias("last_"), F.min("id").alias("operation_id"))
    return found.where(F.col("owner") == F.col("last_")).drop("last_")


def handlers_by_operation_id(endpoints: DataFrame, operations: DataFrame, handles: DataFrame) -> DataFrame:
    """(id, owner, operation_id): declared endpoints (id, method, route_path, service, declared_id) to the one owner whose label begins their
    declared id and whose operation (id, method, route_path, service) ends their route, in the same service. Every end of a route is a row,
    so that the join is on equality; `handles` has owner, label and target."""
    ends = F.transform(F.sequence(F.lit(2), F.char_length("route_path")), lambda i: F.substr("route_path", i))
    asked = endpoints.where(F.char_length("route_path") > 1).select("id", "method", "service", "declared_id", F.explode(F.filter(ends, lambda e: e != "/")).alias("route_path"))
    known = operations.withColumnRenamed("id", "target").join(handles, "target")
    found = asked.join(known, ["method", "service", "route_path"]).where(F.startswith("declared_id", F.concat("label", F.lit("_"))))
    alone = found.groupBy("id").agg(F.min("owner").alias("owner"), F.max("owner").alias("last_"), F.min("target").alias("operation_id"))
    return alone.where(F.col("owner") == F.col("last_")).drop("last_")


def change_kind(index: Column, tree: Column, conflicted: Column) -> Column:
    """What a file's status says: conflict, insert, delete or modify."""
    return F.when(conflicted, "conflict").when((index == "?") | (tree == "?") | (index == "A"), "insert").when((index == "D") | (tree == "D"), "delete").otherwise("modify")


def change_projection(nodes: DataFrame, edges: DataFrame, changes: DataFrame, focus: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what leads to changed files (file_path, change), with a marker for each file. Only `focus` and its ancestry if that
    is a node of a changed file."""
    changes = written(changes, "changes")  # asked by nodes, markers and links; files have many nodes, so nodes aren't dealt by file
    changed = nodes.join(graph.near(changes, "file_path"), "file_path").select("id", "file_path", "change")
    if focus is not None and not (one := changed.where(F.col("id") == focus)).isEmpty():
        changed = one
    ids = written(graph.reachable(graph.reverse(edges), changed.select("id").distinct()).select("id"), "led")  # layers hold an id once
    near = graph.near(ids)
    led = nodes.join(near, "id", "left_semi").join(changed.select("id", "change"), "id", "left")
    marker = F.concat(F.lit("git-change:"), F.col("file_path"))
    said = F.create_map(*(F.lit(x) for kv in CHANGE_LABELS.items() for x in kv))
    shown = F.concat_ws(" ", said[F.col("change")], X.basename(F.col("file_path")))
    marks = changes.select(marker.alias("id"), F.concat(F.lit("git-"), "change").alias("kind"), shown.alias("label"), "change")
    links = changed.select(F.concat_ws(":", marker, "id").alias("id"), F.col("id").alias("source"), marker.alias("target"), F.lit("changedIn").alias("kind"), "change")
    # what leads to a shown node is shown, so an edge's target tells of both its ends
    inner = edges.where("source is not null").join(near.withColumnRenamed("id", "target"), "target", "left_semi")
    none = F.lit(None).cast("string").alias("change")
    return led.select("id", "kind", "label", "change").unionByName(marks), inner.select("id", "source", "target", "kind", none).unionByName(links)


def overview_detail(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The neighbourhood (4 steps, 500 nodes) of what the overview shows: its first 50 ids are the roots."""
    edges = written(edges.select("id", "source", "target", "kind", "evidence"), "detail-edges")  # asked by both
    roots = sorted(r["id"] for r in overview.overview(nodes, edges).select("id").collect())[:50]  # the overview has 60 nodes at most
    return graph.neighborhood(nodes, edges, roots, depth=4, limit=500)[0]


def run_profiles(files: DataFrame) -> DataFrame:
    """(root, source, label, executable, arguments, cwd, kind): how the projects of each root's files (root, path, content) are run. Manifests
    in denied folders or below eight parts are left out; the first hundred of a root by path, thirty scripts of a package and a hundred
    profiles of a root count. A package runs with the tool whose lock file lies beside it; one that can't be read gives none."""
    name, cwd = X.basename(F.col("path")), F.regexp_replace("path", r"/?[^/]*$", "")
    allowed = files.where(~X.denied_path(F.col("path")) & (F.size(F.split("path", "/")) <= MOST_PARTS)).withColumns({"name": name, "cwd": cwd})
    by_path = Window.partitionBy("root").orderBy("path")
    chosen = allowed.where(F.col("name").isin("package.json", *MANIFESTS) | F.col("name").endswith(".csproj"))
    chosen = chosen.withColumn("nth", F.row_number().over(by_path)).where(F.col("nth") <= MOST_MANIFESTS)
    tools = F.coalesce(*(F.when(F.col("name").isin(*locks), k) for k, locks in enumerate(LOCKS.values())))
    beside = allowed.withColumn("tool", tools).where("tool is not null or name = 'gradlew'").groupBy("root", "cwd").agg(F.min("tool").alias("tool"), F.max(F.col("name") == "gradlew").alias("wrapper"))
    chosen = chosen.join(beside, ["root", "cwd"], "left")
    scripts = F.map_keys(F.from_json("content", "scripts map<string,string>")["scripts"])
    first = lambda s: F.array_position(F.array(*map(F.lit, FIRST_SCRIPTS)), s)
    ranked = F.array_sort(F.transform(scripts, lambda s: F.struct(F.when(first(s) > 0, first(s)).otherwise(99).alias("rank"), s.alias("script"))))
    tool = F.coalesce(F.get(F.array(*map(F.lit, LOCKS)), F.col("tool")), F.lit("npm"))
    packages = chosen.where((F.col("name") == "package.json") & (F.octet_length("content") <= MANIFEST_BYTES)).select("root", "path", "cwd", tool.alias("executable"), F.posexplode(F.slice(ranked, 1, MOST_SCRIPTS)).alias("place", "s"))
    script = F.col("s.script")
    packages = packages.select("root", "path", "place", F.concat_ws("#", "path", script).alias("source"), F.concat(F.col("executable"), F.lit(" run "), script).alias("label"), "executable", F.concat(F.lit("run "), script).alias("arguments"), "cwd", F.lit("node").alias("kind"))
    known = F.create_map(*(x for m, values in MANIFESTS.items() for x in (F.lit(m), F.array(*map(F.lit, values)))))
    how = F.coalesce(known[F.col("name")], F.array(*map(F.lit, (".NET run", "dotnet", "run", "dotnet"))))
    executable = F.when(F.col("wrapper") & F.col("name").startswith("build.gradle"), "./gradlew").otherwise(how[1])
    others = chosen.where("name <> 'package.json'").select("root", "path", F.lit(0).alias("place"), F.col("path").alias("source"), how[0].alias("label"), executable.alias("executable"), how[2].alias("arguments"), "cwd", how[3].alias("kind"))
    order = F.row_number().over(Window.partitionBy("root").orderBy("path", "place"))
    return packages.unionByName(others).withColumn("nth", order).where(F.col("nth") <= MOST_PROFILES).drop("nth", "path", "place")


def truncation(reached: dict[str, Column]) -> Column:
    """Names of the bounds that an analysis ran into."""
    return F.filter(F.array(*(F.when(hit, name) for name, hit in reached.items())), lambda r: r.isNotNull())


GRAPH = f"WITH {T.NODES}, {T.EDGES}"
SHOWN = f"""{GRAPH}, v AS (SELECT id, CASE WHEN id LIKE 'class:%9' THEN 'Function-App' WHEN id LIKE 'class:%4' THEN 'Audit-Log' ELSE kind END AS kind,
    CASE WHEN id LIKE '%6' THEN 'Get  /items' WHEN id LIKE '%5' THEN 'Submit form' ELSE label END AS label,
    CASE WHEN id LIKE 'class:%7' THEN 'app\\Views\\List.rs' WHEN id LIKE 'class:%8' THEN 'web/api/list.tsx' WHEN id LIKE 'class:%3' THEN 'web/list.tsx' ELSE file_path END AS path,
    CASE length(label) % 9 WHEN 1 THEN 'Entry-Point' WHEN 2 THEN 'frontend' WHEN 3 THEN 'nonsense' END AS stage, CASE length(id) % 7 WHEN 1 THEN 'Data' WHEN 2 THEN 'web' END AS layer FROM nodes)"""


def shown_nodes(spark, sf_dir):
    i, end = F.col("id"), lambda prefix, digit: F.col("id").startswith(prefix) & F.col("id").endswith(digit)
    kind = F.when(end("class:", "9"), "Function-App").when(end("class:", "4"), "Audit-Log").otherwise(F.col("kind"))
    label = F.when(i.endswith("6"), "Get  /items").when(i.endswith("5"), "Submit form").otherwise(F.col("label"))
    path = F.when(end("class:", "7"), "app\\Views\\List.rs").when(end("class:", "8"), "web/api/list.tsx").when(end("class:", "3"), "web/list.tsx").otherwise(F.col("file_path"))
    n, m = F.char_length("label") % 9, F.char_length("id") % 7
    stage = F.when(n == 1, "Entry-Point").when(n == 2, "frontend").when(n == 3, "nonsense")
    return T.nodes(spark, sf_dir).select("id", kind.alias("kind"), label.alias("label"), path.alias("path"), stage.alias("stage"), F.when(m == 1, "Data").when(m == 2, "web").alias("layer"))


@query(
    "p5_view_stage",
    f"""{SHOWN} SELECT id, CASE WHEN stage = 'Entry-Point' THEN 'backend' WHEN stage = 'frontend' THEN 'trigger' WHEN layer = 'Data' THEN 'data' WHEN layer = 'web' THEN 'api'
    WHEN label = 'Submit form' OR path IN ('app\\Views\\List.rs', 'web/list.tsx') THEN 'trigger' WHEN kind IN ('endpoint', 'Function-App') OR label = 'Get  /items' THEN 'api'
    WHEN kind IN ('model', 'repository') THEN 'data' WHEN kind = 'controller' THEN 'backend' ELSE 'service' END AS stage FROM v""",
)
def p5(spark, sf_dir):
    """The stage that each node is shown in."""
    return shown_nodes(spark, sf_dir).select("id", view_stage(F.col("kind"), F.col("label"), F.col("path"), F.col("stage"), F.col("layer")).alias("stage"))


@query(
    "p7_lane",
    f"""{SHOWN} SELECT id, CASE WHEN layer = 'Data' THEN 'data' WHEN layer = 'web' THEN 'interface' WHEN kind = 'Audit-Log' THEN 'runtime' WHEN kind IN ('model', 'repository') THEN 'data'
    WHEN kind IN ('endpoint', 'controller') THEN 'interface' ELSE 'domain' END AS lane FROM v""",
)
def p7(spark, sf_dir):
    """The lane that each node is shown in."""
    return shown_nodes(spark, sf_dir).select("id", lane(F.col("kind"), F.col("layer")).alias("lane"))


@query(
    "p21_key_facts",
    """SELECT o_orderkey AS id, 'Status=' || o_orderstatus || ';Duration ms=' || (o_orderkey % 97) || ';Trace ID=' || CASE WHEN o_orderkey % 5 = 0 THEN '(empty)' ELSE 't' || o_custkey END AS key_facts,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Custom key=1;' ELSE '' END || 'Ship API URL=' || o_orderpriority AS raw_evidence FROM orders""",
)
def p21(spark, sf_dir):
    """Metadata of orders: what ranks first, and the rest."""
    o = T.table(spark, sf_dir, "orders")
    trace = F.when(F.expr("o_orderkey % 5 = 0"), "").otherwise(F.concat(F.lit("t"), F.col("o_custkey").cast("string")))
    custom = F.when(F.expr("o_orderkey % 3 = 0"), "1")
    body = F.to_json(F.struct(F.col("o_orderpriority").alias("shipAPIUrl"), trace.alias("traceId"), custom.alias("custom_key"), F.expr("o_orderkey % 97").alias("duration_ms"), F.col("o_orderstatus").alias("Status")))
    first, rest = presented(F.from_json(body, "map<string,string>"))
    line = lambda facts: F.array_join(F.transform(facts, lambda e: F.concat_ws("=", e["label"], e["value"])), ";")
    return o.select(F.col("o_orderkey").alias("id"), line(first).alias("key_facts"), line(rest).alias("raw_evidence"))


TERMS = ("license", "benchmark", "email", "water")


@query(
    "j1_document_hits",
    f"""WITH {T.FILES}, w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS term FROM documents)
  SELECT relative_path, content_hash, size_bytes, count(*) AS terms FROM w JOIN files USING (doc_id) WHERE term IN {TERMS} GROUP BY ALL""",
)
def j1(spark, sf_dir):
    """Index hits to their documents and files."""
    hits = index_hits(T.table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    return hits.join(T.files(spark, sf_dir).select("doc_id", "relative_path", "content_hash", "size_bytes"), "doc_id").drop("doc_id")


@query(
    "j2_semantic_hits",
    f"""{GRAPH}, f AS (SELECT file_path, count(*) AS facts FROM nodes GROUP BY 1), w AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all(label, '[A-Za-z]+'))) AS term FROM nodes)
  SELECT n.id, n.kind, n.label, f.file_path, f.facts, count(*) AS terms FROM w JOIN nodes n USING (id) JOIN f ON f.file_path = n.file_path WHERE term IN ('red', 'urgent', 'china', 'customer') GROUP BY ALL""",
)
def j2(spark, sf_dir):
    """Index hits on labels to their nodes and files."""
    n = T.nodes(spark, sf_dir)
    hits = index_hits(n, "id", "label", ("red", "urgent", "china", "customer"))
    per_file = n.groupBy("file_path").agg(F.count("*").alias("facts"))
    return hits.join(n, "id").join(per_file, "file_path").select("id", "kind", "label", "file_path", "facts", "terms")


@query(
    "j5_handler_owner",
    f"""WITH {T.OPERATIONS}, u AS (SELECT method, route_path, source_service AS service, min('handler:' || file_path || '#' || id[-1:]) AS owner, min(id) AS operation_id FROM operations WHERE role = 'producer' GROUP BY 1, 2, 3
    HAVING min('handler:' || file_path || '#' || id[-1:]) = max('handler:' || file_path || '#' || id[-1:]))
  SELECT o.id, u.owner, u.operation_id FROM operations o JOIN u ON o.method = u.method AND o.route_path = u.route_path AND o.source_service = u.service WHERE o.role = 'consumer'""",
)
def j5(spark, sf_dir):
    """Requests to the one handler of their operation in the same service."""
    o = T.operations(spark, sf_dir).select("id", "role", "method", "route_path", F.col("source_service").alias("service"), "file_path")
    producers = o.where("role = 'producer'")
    handles = producers.select(F.concat(F.lit("handler:"), "file_path", F.lit("#"), F.expr("right(id, 1)")).alias("owner"), F.col("id").alias("target"))
    found = unique_handlers(producers.select("id", "method", "route_path", "service"), handles)
    return o.where("role = 'consumer'").join(found, ["method", "route_path", "service"]).select("id", "owner", "operation_id")


@query(
    "g21_change_ancestry",
    f"""WITH RECURSIVE {T.NODES}, {T.EDGES}, c AS (SELECT file_path, CASE length(file_path) % 7 WHEN 0 THEN 'conflict' WHEN 1 THEN 'insert' WHEN 2 THEN 'delete' WHEN 3 THEN 'modify' END AS change FROM nodes WHERE length(file_path) % 7 < 4 GROUP BY ALL),
  changed AS (SELECT id, file_path, change FROM nodes JOIN c USING (file_path)), up(id) AS (SELECT id FROM changed UNION SELECT e.source FROM edges e JOIN up ON e.target = up.id)
  SELECT 'node' AS element, n.id, n.kind, g.change FROM nodes n JOIN up USING (id) LEFT JOIN changed g USING (id)
  UNION ALL SELECT 'node', 'git-change:' || file_path, 'git-' || change, change FROM c
  UNION ALL SELECT 'edge', id, kind, NULL FROM edges WHERE source IN (FROM up) AND target IN (FROM up)
  UNION ALL SELECT 'edge', 'git-change:' || file_path || ':' || id, 'changedIn', change FROM changed""",
)
def g21(spark, sf_dir):
    """Changed files, what leads to them, and markers."""
    n, k = T.nodes(spark, sf_dir), F.expr("char_length(file_path) % 7")
    status = n.select("file_path").distinct().where(k < 4)
    index, tree = F.when(k == 1, "?").when(k == 3, "M").otherwise(" "), F.when(k == 2, "D").otherwise(" ")
    nodes, edges = change_projection(n, T.edges(spark, sf_dir), status.select("file_path", change_kind(index, tree, k == 0).alias("change")))
    return nodes.select(F.lit("node").alias("element"), "id", "kind", "change").unionByName(edges.select(F.lit("edge").alias("element"), "id", "kind", "change"))


@query("g22_overview_detail")
def g22(spark, sf_dir):
    """What lies around the overview."""
    return overview_detail(T.nodes(spark, sf_dir), T.edges(spark, sf_dir)).select("id", "kind", "label")


OTHERS = ("Cargo.toml", "go.mod", "app.csproj", "build.gradle", "README.md", "pom.xml", "compose.yml")


@query(
    "s17_run_profiles",
    f"""WITH m AS (SELECT 'nation-' || s_nationkey AS root, CASE WHEN s_suppkey % 9 = 0 THEN 'node_modules/' ELSE '' END || 'web/' || s_suppkey AS cwd, s_suppkey AS k, 'package.json' AS name FROM supplier
    UNION ALL SELECT 'nation-' || c_nationkey, CASE WHEN c_custkey % 8 = 0 THEN 'a/b/c/d/e/f/' ELSE '' END || 'app/' || c_custkey, c_custkey, {list(OTHERS)}[c_custkey % 7 + 1] FROM customer),
  t AS (SELECT *, cwd || '/' || name AS path FROM m WHERE name <> 'README.md' AND cwd NOT LIKE 'node_modules/%' AND cwd NOT LIKE 'a/%'),
  c AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY root ORDER BY path) <= 100),
  p AS (SELECT root, path, place, path || '#' || script AS source, tool || ' run ' || script AS label, tool AS executable, 'run ' || script AS arguments, cwd, 'node' AS kind FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 'yarn' ELSE 'npm' END AS tool FROM c WHERE name = 'package.json' AND k % 7 <> 0), (VALUES (0, 'dev'), (1, 'serve'), (2, 'build')) AS x(place, script)
    UNION ALL SELECT root, path, 0, path, CASE name WHEN 'Cargo.toml' THEN 'Cargo run' WHEN 'go.mod' THEN 'Go run' WHEN 'app.csproj' THEN '.NET run' WHEN 'build.gradle' THEN 'Gradle application' WHEN 'pom.xml' THEN 'Maven application' ELSE 'Docker Compose' END,
      CASE name WHEN 'Cargo.toml' THEN 'cargo' WHEN 'go.mod' THEN 'go' WHEN 'app.csproj' THEN 'dotnet' WHEN 'build.gradle' THEN CASE WHEN k % 2 = 0 THEN './gradlew' ELSE 'gradle' END WHEN 'pom.xml' THEN 'mvn' ELSE 'docker' END,
      CASE name WHEN 'go.mod' THEN 'run .' WHEN 'pom.xml' THEN 'spring-boot:run' WHEN 'compose.yml' THEN 'compose up' ELSE 'run' END, cwd,
      CASE name WHEN 'Cargo.toml' THEN 'cargo' WHEN 'go.mod' THEN 'go' WHEN 'app.csproj' THEN 'dotnet' WHEN 'compose.yml' THEN 'dockerCompose' ELSE 'java' END FROM c WHERE name <> 'package.json')
  SELECT root, source, label, executable, arguments, cwd, kind FROM p QUALIFY row_number() OVER (PARTITION BY root ORDER BY path, place) <= 100""",
)
def s17(spark, sf_dir):
    """Suppliers as packages and customers as other projects of their nation."""
    s, c = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "customer")
    web = F.concat(F.when(F.expr("s_suppkey % 9 = 0"), "node_modules/").otherwise(""), F.lit("web/"), F.col("s_suppkey").cast("string"))
    scripts = F.when(F.expr("s_suppkey % 7 = 0"), '{"scripts": 3').otherwise('{"name": "x", "scripts": {"build": "b", "serve": "s", "dev": "d"}}')
    packages = s.select(F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("root"), F.explode(F.array(F.struct(F.concat(web, F.lit("/package.json")).alias("path"), scripts.alias("content")), F.when(F.expr("s_suppkey % 4 = 0"), F.struct(F.concat(web, F.lit("/yarn.lock")).alias("path"), F.lit("").alias("content"))))).alias("f")).where("f is not null")
    app = F.concat(F.when(F.expr("c_custkey % 8 = 0"), "a/b/c/d/e/f/").otherwise(""), F.lit("app/"), F.col("c_custkey").cast("string"))
    name = F.element_at(F.array(*map(F.lit, OTHERS)), F.expr("cast(c_custkey % 7 as int) + 1"))
    plain = lambda path: F.struct(path.alias("path"), F.lit("").alias("content"))
    others = c.select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("root"), F.explode(F.array(plain(F.concat_ws("/", app, name)), F.when(F.expr("c_custkey % 2 = 0"), plain(F.concat(app, F.lit("/gradlew")))))).alias("f")).where("f is not null")
    return run_profiles(packages.unionByName(others).select("root", "f.path", "f.content"))


@query(
    "x16_truncation",
    r"""WITH n AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, length(text) - length(replace(text, '. ', '.')) AS facts FROM documents)
  SELECT doc_id, CASE WHEN lines > 40 THEN 'lines,' ELSE '' END || CASE WHEN facts > 60 THEN 'facts' ELSE '' END AS reasons, lines > 40 OR facts > 60 AS parse_errors FROM n""",
)
def x16(spark, sf_dir):
    """Whole documents whose structure would be cut: the bounds of lines and of sentences that they run into."""
    lines = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    facts = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit(". "), F.lit(".")))
    hit = truncation({"lines,": lines > 40, "facts": facts > 60})
    return T.table(spark, sf_dir, "documents").select("doc_id", F.array_join(hit, "").alias("reasons"), (F.size(hit) > 0).alias("parse_errors"))
