"""Scalar expressions: ASCII folding, path policies, classifications. All are Columns, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values of the path policies and classifications.
DENIED_DIRECTORIES = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", "vendor", "target", "dist", "build", "out", "coverage",
    ".next", ".nuxt", ".turbo", ".cache", ".docker", ".kube", ".aws", ".azure", ".ssh", ".gnupg", ".terraform", ".gradle",
    ".idea", ".venv", "venv", "__pycache__", "pods", "deriveddata",
)
DENIED_NAMES = (
    ".npmrc", ".pypirc", ".netrc", "credentials", "credentials.json", "service-account.json", "id_rsa", "id_dsa", "id_ecdsa",
    "id_ed25519", ".git-credentials", "application_default_credentials.json",
)
DENIED_EXTENSIONS = ("pem", "key", "p12", "pfx", "jks", "keystore", "crt", "cer", "der")
SENSITIVE_TOKENS = ("authorization", "proxyauthorization", "cookie", "setcookie", "token", "apikey", "key", "password", "passwd", "secret", "credential")
AUXILIARY = ("evaluation", "evaluations", "eval", "example", "examples", "benchmark", "benchmarks")
JOB_PARTS = ("job", "jobs", "worker", "workers", "cron", "batch", "background", "queue", "queues", "command", "commands", "task", "tasks")
DATA_PARTS = ("data", "database", "databases", "repository", "repositories", "persistence", "model", "models", "schema", "schemas", "migration", "migrations")
DATA_CODE_KINDS = ("function", "method", "class", "service", "repository", "model", "interface", "trait", "struct", "enum", "implementation", "object", "type")
HTTP_METHODS = ("CONNECT", "DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT", "TRACE")
CONFIG_NAMES = (
    "package.json", "cargo.toml", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle",
    "settings.gradle.kts", "tsconfig.json", "jsconfig.json", "tauri.conf.json", "docker-compose.yml", "docker-compose.yaml",
    "compose.yml", "compose.yaml", "cmakelists.txt", "makefile", ".editorconfig", "config.toml", "config.json", "config.yml",
    "config.yaml", "application.yml", "application.yaml",
)
ENTRY_NAMES = ("main.rs", "main.go", "main.py", "main.kt", "main.ts", "main.tsx", "main.js", "main.jsx", "server.ts", "server.js", "app.ts", "app.js")
LANGUAGES = {
    "rs": ("Rust", "syntaxOnly"), "ts": ("TypeScript", "semantic"), "mts": ("TypeScript", "semantic"), "cts": ("TypeScript", "semantic"),
    "tsx": ("TypeScript", "semantic"), "js": ("JavaScript", "semantic"), "mjs": ("JavaScript", "semantic"), "cjs": ("JavaScript", "semantic"),
    "jsx": ("JavaScript", "semantic"), "py": ("Python", "syntaxOnly"), "pyi": ("Python", "syntaxOnly"), "go": ("Go", "syntaxOnly"),
    "java": ("Java", "syntaxOnly"), "cs": ("C#", "syntaxOnly"), "kt": ("Kotlin", "syntaxOnly"), "kts": ("Kotlin", "syntaxOnly"),
    "c": ("C++", "syntaxOnly"), "cc": ("C++", "syntaxOnly"), "cpp": ("C++", "syntaxOnly"), "cxx": ("C++", "syntaxOnly"),
    "h": ("C++", "syntaxOnly"), "hh": ("C++", "syntaxOnly"), "hpp": ("C++", "syntaxOnly"), "hxx": ("C++", "syntaxOnly"),
    "json": ("JSON", "textOnly"), "toml": ("TOML", "textOnly"), "yaml": ("YAML", "textOnly"), "yml": ("YAML", "textOnly"),
    "md": ("Markdown", "semantic"), "mdx": ("Markdown", "semantic"), "txt": ("Text", "semantic"), "rst": ("reStructuredText", "semantic"),
    "adoc": ("AsciiDoc", "semantic"), "asciidoc": ("AsciiDoc", "semantic"), "sql": ("SQL", "textOnly"), "graphql": ("GraphQL", "textOnly"),
    "gql": ("GraphQL", "textOnly"), "proto": ("Protocol Buffers", "textOnly"), "sh": ("Shell", "textOnly"), "bash": ("Shell", "textOnly"),
    "zsh": ("Shell", "textOnly"), "html": ("HTML", "textOnly"), "htm": ("HTML", "textOnly"), "css": ("CSS", "textOnly"),
    "scss": ("CSS", "textOnly"), "sass": ("CSS", "textOnly"), "less": ("CSS", "textOnly"),
}


def alternatives(names: tuple[str, ...]) -> str:
    """A pattern of literal names, for use inside rlike."""
    return "|".join(n.replace(".", r"\.") for n in names)


def ascii_fold(c: Column) -> Column:
    """A-Z in lower case and nothing else: É stays É."""
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def fold(text: str) -> str:
    """ascii_fold() of a text at hand."""
    return text.translate(str.maketrans(UPPER, LOWER))


def quoted(text: str) -> str:
    """A regular expression for a text as it stands, whatever marks it holds."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def contains_fold(c: Column, text: str) -> Column:
    return F.contains(ascii_fold(c), ascii_fold(F.lit(text)))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return ascii_fold(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def denied_path(path: Column) -> Column:
    """Paths that are never read: build and secret folders, credential and key files, environment and state files."""
    p = ascii_fold(path)
    name = basename(p)
    return any_of(
        p.rlike(f"(?:^|/)(?:{alternatives(DENIED_DIRECTORIES)})(?:/|$)"),
        p.rlike(r"(?:^|/)\.{1,2}(?:/|$)") | p.startswith("/") | (p == ""),
        (name == ".env") | name.startswith(".env."),
        name.isin(*DENIED_NAMES),
        name.startswith("secrets.") | name.startswith("secret."),
        p.rlike(r"(?:^|/)\.config/gcloud(?:/|$)") | p.rlike(r"(?:^|/)\.cargo/credentials(?:\.toml)?(?:/|$)"),
        (name == "terraform.tfstate") | name.startswith("terraform.tfstate.") | name.endswith(".tfstate") | name.endswith(".tfstate.backup"),
        extension(p).isin(*DENIED_EXTENSIONS),
    )


def test_path_inventory(path: Column) -> Column:
    p = ascii_fold(path)
    return p.rlike(r"(?:^|/)(?:test|tests|e2e)/|/(?:__tests__|fixtures)/|\.test\.|\.spec\.|_test\.")


def test_path_flow(path: Column) -> Column:
    p = ascii_fold(path)
    return p.rlike(r"(?:^|/)(?:test|tests|e2e)/|/(?:__tests__|fixtures)/|\.test\.|\.spec\.|_tests?\.|_live_tests?\.")


def test_path_overview(path: Column) -> Column:
    """The variant in which `_` is a wildcard: latest.ts counts as a test."""
    p = ascii_fold(path)
    return p.rlike(r"(?:^|/)(?:test|tests|e2e|__tests__)/|\.test\.|\.spec\.|.tests?\.|-tests?\.")


def test_path_literal(path: Column) -> Column:
    p = F.concat(F.lit("/"), ascii_fold(path))
    return p.rlike(r"/(?:tests?|e2e|__tests__)/|\.test\.|\.spec\.|[_-]tests?\.")


def auxiliary_path(path: Column) -> Column:
    return F.concat(F.lit("/"), ascii_fold(path), F.lit("/")).rlike(f"/(?:{alternatives(AUXILIARY)})/")


def job_path(path: Column) -> Column:
    return F.concat(F.lit("/"), ascii_fold(path), F.lit("/")).rlike(f"/(?:{alternatives(JOB_PARTS)})/")


def data_path(path: Column, kind: Column) -> Column:
    padded = F.concat(F.lit("/"), ascii_fold(path), F.lit("/"))
    strong = padded.rlike(f"/(?:{alternatives(DATA_PARTS)})/|[/_-](?:repository|model)\\.")
    storage = padded.contains("/storage/") & ~kind.isin("function", "method")
    return kind.isin(*DATA_CODE_KINDS) & (strong | storage)


def sensitive_name(name: Column) -> Column:
    return ascii_fold(F.regexp_replace(name, "[^A-Za-z0-9]", "")).rlike("|".join(SENSITIVE_TOKENS))


def config_path(path: Column) -> Column:
    name = ascii_fold(basename(path))
    return name.isin(*CONFIG_NAMES) | name.rlike(r"^(?:vite|next|webpack)\.config\.")


def entry_path(path: Column) -> Column:
    p = ascii_fold(path)
    return basename(p).isin(*ENTRY_NAMES) | p.rlike(r"^(?:src/)?index\.[tj]sx?$")


def remote_target(label: Column) -> Column:
    """Whether a label holds an absolute HTTP(S) target whose host isn't this machine."""
    authority = F.regexp_extract(ascii_fold(label), r"https?://([^/?#\s]*)", 1)
    host_port = F.regexp_replace(authority, "^.*@", "")
    host = F.when(host_port.startswith("["), F.regexp_extract(host_port, r"^\[([^\]]*)", 1)).otherwise(F.split(host_port, ":")[0])
    return ascii_fold(label).rlike("https?://") & ~(host.isin("localhost", "::1", "0.0.0.0") | host.startswith("127."))


def system_layer(kind: Column, label: Column, path: Column) -> Column:
    """(layer, certainty) of a node; the first rule that holds decides."""
    k, name = ascii_fold(kind), ascii_fold(F.trim(label))
    put = lambda layer, certainty: F.struct(F.lit(layer).alias("layer"), F.lit(certainty).alias("certainty"))
    return (
        F.when((k == "file") & config_path(path), put("configuration", "exact"))
        .when(k.isin("function", "method") & (name == "main"), put("entry", "exact"))
        .when((k == "file") & entry_path(path), put("entry", "inferred"))
        .when(k.isin("endpoint", "controller", "event"), put("interface", "exact"))
        .when(job_path(path), put("interface", "inferred"))
        .when(k.isin("repository", "model", "database", "table", "schema", "entity"), put("data", "exact"))
        .when(data_path(path, k), put("data", "inferred"))
        .when(k.isin("api", "external-api", "externalapi") & remote_target(label), put("external", "inferred"))
        .when(k.isin("api", "external-api", "externalapi"), put("interface", "inferred"))
        .when(k == "service", put("application", "exact"))
        .otherwise(put("application", "inferred"))
    )


def has_part(path: Column, *names: str) -> Column:
    return ascii_fold(path).rlike(f"(?:^|[/_.-])(?:{'|'.join(names)})(?:[/_.-]|$)")


def flow_stage(kind: Column, label: Column, path: Column, role: Column, route: Column) -> Column:
    """The stage of a node in an execution flow; the first rule that holds decides."""
    k, name = ascii_fold(kind), ascii_fold(label)
    backend = has_part(path, "backend", "server", "servers", "api")
    frontend = has_part(path, "frontend", "web", "ui", "components", "pages", "views") | ascii_fold(path).endswith(".tsx")
    data = k.isin("database", "repository", "model", "entity", "schema", "table", "store", "cache", "dao") | name.contains("repository") | (backend & has_part(path, "repository", "repositories", "storage"))
    consumer = (k == "api") & (role == "consumer")
    return (
        F.when(k == "event", "event")
        .when(data, "data")
        .when((k == "agent") | name.contains("agent") | has_part(path, "agent", "agents"), "agent")
        .when(consumer & route.startswith("http"), "external")
        .when(consumer & frontend, "frontend")
        .when(k.isin("endpoint", "api", "apiservice", "apigroup"), "api")
        .when(frontend, "frontend")
        .when(k.isin("service", "trait", "implementation", "method", "class", "utility") | name.contains("service") | has_part(path, "service", "services", "utility", "utilities"), "service")
        .when(k.isin("function", "controller", "handler", "entrypoint"), "backend")
        .otherwise("other")
    )


def flow_group(path: Column) -> Column:
    """What stands before /src/, else the first segment, else Workspace."""
    first = F.split(path, "/")[0]
    return F.when(F.instr(path, "/src/") > 0, F.substring_index(path, "/src/", 1)).when(first != "", first).otherwise("Workspace")


def service_root(path: Column) -> Column:
    return F.when(F.instr(path, "/src/") > 0, F.substring_index(path, "/src/", 1)).when(path.startswith("src/") | (F.instr(path, "/") == 0), "Workspace root").otherwise(F.split(path, "/")[0])


def sanitized_target(target: Column, most: int = 1024) -> Column:
    """An HTTP target without user info, query and fragment; null if it is longer than `most` bytes."""
    bare = F.regexp_replace(F.regexp_replace(target, r"[?#].*$", ""), r"^(https?://)[^/@]*@", "$1")
    return F.when(F.octet_length(bare) <= most, bare)


def route_branch(route: Column) -> Column:
    """The leading static segments of a route: three at most, two of an absolute one."""
    absolute = route.rlike("^https?://")
    parts = F.filter(F.split(F.regexp_replace(route, r"^https?://[^/]*", ""), "/"), lambda s: s != "")
    stop = F.coalesce(F.nullif(F.array_position(F.transform(parts, lambda s: s.rlike(r"[:{}*\[\]]|^[0-9]+$")), F.lit(True)), F.lit(0)) - 1, F.size(parts))
    return F.slice(parts, F.lit(1), F.least(stop.cast("int"), F.when(absolute, 2).otherwise(3)))


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_label(text: Column, most: int = 160) -> Column:
    t = compact(text)
    return F.when(F.char_length(t) > most, F.concat(F.left(t, F.lit(most - 1)), F.lit("…"))).otherwise(t)


def preview_window(line: Column, at: Column, width: int = 320) -> Column:
    """`width` characters of a line around the 1-based place `at`."""
    start = F.greatest(F.lit(1), F.least(at - F.lit(width // 2), F.char_length(line) - F.lit(width - 1)))
    return F.substring(line, start.cast("int"), F.lit(width))


def utf16_length(text: Column) -> Column:
    """Code units: one for each character, and another for each beyond the basic plane."""
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def redact_assignments(text: Column) -> Column:
    """What follows = or : after a sensitive name, up to the end of its line."""
    names = "authorization|cookie|token|api[_-]?key|key|password|passwd|secret|credential"
    return F.regexp_replace(text, rf"(?im)^([^=:\n]*(?:{names})[^=:\n]*[=:][ \t]*)[^\n]+$", "$1[REDACTED]")
