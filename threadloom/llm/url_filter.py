"""Operator 10: URL filters as a temporal list join, with DataFrame functions only.

A filter list is dated changes (pattern, changed_at, change_id, action add or remove). They become validity intervals: an added
pattern holds from its change to the next change of the same pattern. A pattern is a host (it covers the hosts below it,
too) or a host with leading path segments. A capture (page_id, url, fetched_at) is checked against every pattern that could cover
it - its host, the domains above, and its path prefixes - as of its fetch time.

The as-of join is an equi-join: the intervals of a pattern don't overlap, so cut at week bounds they are at most its
changes plus its weeks, and a capture meets its pattern's intervals of its own week only. A host with a third of all captures is
thus spread over its weeks, and adaptive execution splits what is still large.

Defined cases: a capture whose url is null or has no host, or whose fetched_at is null, matches nothing; changes without a
pattern or date are no changes; of changes of one pattern at one instant the largest change_id counts; a removal of what was not added, and a
repeated add, change nothing (the interval goes on under the later change); captures that repeat give one row; an empty list leaves every
capture unmatched; other columns are left behind. The longest pattern is reported; of any pattern one interval at most is active.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Days in a bucket of the as-of join, and the path segments that a pattern may have.
WEEK, SEGMENTS = 7, 3
EPOCH = "2024-01-01"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def patterns_of(url: Column, segments: int = SEGMENTS) -> Column:
    """Every pattern that covers a url: domains of at least two labels, the host itself, and host with leading path segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.least(F.size(path), F.lit(segments))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def week_of(at: Column) -> Column:
    return F.floor(F.datediff(at.cast("date"), F.lit("1970-01-05").cast("date")) / WEEK)


def intervals(changes: DataFrame) -> DataFrame:
    """(pattern, change_id, valid_from, valid_to): when each added pattern holds; valid_to is null where it still does."""
    clean = changes.where("pattern is not null and changed_at is not null")
    last = clean.groupBy("pattern", "changed_at").agg(F.max_by(F.struct("action", "change_id"), F.col("change_id")).alias("c"))
    order = Window.partitionBy("pattern").orderBy("changed_at")
    return last.withColumn("valid_to", F.lead("changed_at").over(order)).where(F.col("c.action") == "add").select("pattern", "c.change_id", F.col("changed_at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, blocked, n_active, pattern, change_id) of every capture."""
    span = captures.agg(F.min(week_of(F.col("fetched_at"))).alias("first_"), F.max(week_of(F.col("fetched_at"))).alias("last_"))
    first, last = span.first() or (None, None)
    first, last = (0, -1) if first is None else (first, last)
    held = intervals(changes).withColumn("a_", F.greatest(week_of(F.col("valid_from")), F.lit(first))).withColumn("b_", F.least(F.coalesce(week_of(F.col("valid_to")), F.lit(last)), F.lit(last))).where("a_ <= b_")
    held = held.select("pattern", "change_id", "valid_from", "valid_to", F.explode(F.sequence("a_", "b_")).alias("week_"))
    tried = captures.select("page_id", "url", "fetched_at").distinct().withColumn("week_", week_of(F.col("fetched_at"))).withColumn("pattern", F.explode_outer(patterns_of(F.col("url"))))
    t, h = tried.alias("t"), held.alias("h")
    active = (F.col("t.pattern") == F.col("h.pattern")) & (F.col("t.week_") == F.col("h.week_")) & (F.col("h.valid_from") <= F.col("t.fetched_at")) & (F.col("h.valid_to").isNull() | (F.col("t.fetched_at") < F.col("h.valid_to")))
    joined = t.join(h, active, "left").select("t.page_id", "t.url", "t.fetched_at", "h.pattern", "h.change_id")
    best = F.max_by(F.struct("pattern", "change_id"), F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern"), F.col("pattern"))))
    out = joined.groupBy("page_id", "url", "fetched_at").agg(F.count("pattern").alias("n_active"), best.alias("b"))
    return out.select("page_id", "url", "fetched_at", (F.col("n_active") > 0).alias("blocked"), "n_active", "b.pattern", "b.change_id")


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures from the pages, dated over a year by their ids (the table itself has no fetch times)."""
    day = F.expr(f"timestamp_ntz'{EPOCH} 00:00:00' + make_dt_interval(cast(pmod(page_id * 53, 365) as int), 0, 0, pmod(page_id * 977, 86400))")
    return pages.select("page_id", "url", day.alias("fetched_at"))


def changes_of(pages: DataFrame) -> DataFrame:
    """A filter list that grows with the pages: a third of them each date a change of one pattern of their url."""
    host, path = host_of(F.col("url")), F.filter(F.split(F.regexp_extract("url", PATH, 1), "/"), lambda s: s != "")
    labels = F.split(host, r"\.")
    pattern = (
        F.when(F.expr("page_id % 9 = 0"), host)
        .when(F.expr("page_id % 9 = 3") & (F.size(path) > 0), F.concat(host, F.lit("/"), F.get(path, F.lit(0))))
        .when(F.expr("page_id % 9 = 6"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), "."))
    )
    at = F.expr(f"timestamp_ntz'{EPOCH} 00:00:00' + make_dt_interval(cast(pmod(page_id * 37, 365) as int), 0, 0, 0)")
    action = F.when(F.expr("page_id % 5 < 3"), "add").otherwise("remove")
    return pages.where("page_id % 3 = 0").select(F.col("page_id").alias("change_id"), pattern.alias("pattern"), at.alias("changed_at"), action.alias("action")).where(F.col("pattern") != "")


def op10_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return evaluate(captures_of(pages), changes_of(pages)).select("page_id", F.col("fetched_at").cast("string").alias("fetched_at"), "blocked", "n_active", "pattern", "change_id")


SQL = rf"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '{HOST}', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda s: s <> '') AS segments
  FROM pages
), c AS (
  SELECT DISTINCT page_id, url, host, segments, string_split(host, '.') AS labels,
    TIMESTAMP '{EPOCH}' + to_days(CAST((page_id * 53) % 365 AS INTEGER)) + to_seconds((page_id * 977) % 86400) AS fetched_at
  FROM p
), change AS (
  SELECT page_id AS change_id, CASE WHEN page_id % 5 < 3 THEN 'add' ELSE 'remove' END AS action,
    TIMESTAMP '{EPOCH}' + to_days(CAST((page_id * 37) % 365 AS INTEGER)) AS changed_at,
    CASE WHEN page_id % 9 = 0 THEN host
         WHEN page_id % 9 = 3 AND len(segments) > 0 THEN host || '/' || segments[1]
         WHEN page_id % 9 = 6 THEN array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 2, 1), len(string_split(host, '.'))), '.') END AS pattern
  FROM p WHERE page_id % 3 = 0
), last AS (
  SELECT pattern, changed_at, max(change_id) AS change_id, arg_max(action, change_id) AS action
  FROM change WHERE pattern <> '' GROUP BY pattern, changed_at
), valid AS (
  SELECT *, lead(changed_at) OVER (PARTITION BY pattern ORDER BY changed_at) AS valid_to FROM last
), tried AS (
  SELECT page_id, url, fetched_at, unnest(CASE WHEN host = '' THEN [NULL] ELSE list_distinct(list_concat(
    list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(list_slice(labels, i, len(labels)), '.')),
    list_transform(range(1, least(len(segments), {SEGMENTS}) + 1), lambda i: host || '/' || array_to_string(list_slice(segments, 1, i), '/')))) END) AS pattern
  FROM c
)
SELECT t.page_id, CAST(t.fetched_at AS VARCHAR) AS fetched_at, count(v.pattern) > 0 AS blocked, count(v.pattern) AS n_active,
  max_by(v.pattern, (length(v.pattern), v.pattern)) AS pattern, max_by(v.change_id, (length(v.pattern), v.pattern)) AS change_id
FROM tried t LEFT JOIN valid v ON t.pattern = v.pattern AND v.action = 'add' AND v.changed_at <= t.fetched_at AND (v.valid_to IS NULL OR t.fetched_at < v.valid_to)
GROUP BY t.page_id, t.url, t.fetched_at
"""
