"""Operator 4: chat formatting over reply trees, with DataFrame functions only.

A reply tree is rows (tree_id, node_id, parent_id, role, text, score). Self-joins double the reach of every node's
ancestor pointer each round, so paths of any length take a logarithm of rounds; leaves are ranked by the mean score of
their path within their tree; each chosen root-to-leaf path becomes one conversation.

Template: `<|turn|>` role `<|text|>` text `<|end|>`, turn after turn. In roles and texts every backslash is doubled
and then `<|` becomes `<\\|`, so no control string is left inside and unescaping gives back exactly what was there.

Defined cases: null role or text is empty; a node whose parent is missing is a root; rows on a reply cycle, and those
that hang off one, have no root and give no path; of conversation rows that share a turn, order is by role and text;
rows without conv_id form a conversation of their own; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL_SAMPLE = "</s>[INST] ok [/INST]"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def ancestor_tables(nodes: DataFrame) -> list[DataFrame]:
    """Tables k = 0, 1, ... of (tree_id, node_id, anc, depth, total): anc is the 2^k-th ancestor, or null where the root
    is nearer; depth and total are the number and the score of the nodes from node_id up to before anc. A node is in
    table k only while table k - 1 had an ancestor for it, so short paths drop out of the later rounds. In the last
    table no anc is left, but for nodes on or below a cycle."""
    own = nodes.select("tree_id", "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    there = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there")).distinct()
    first = own.join(there, ["tree_id", "parent_id"], "left")
    levels = [common.written(first.select("tree_id", "node_id", F.when(F.col("there"), F.col("parent_id")).alias("anc"), F.lit(1).alias("depth"), "total"), "anc")]
    n = levels[0].count()
    for _ in range(max(1, n.bit_length())):
        active = levels[-1].where("anc is not null")
        if active.isEmpty():
            break
        known = active.unionByName(finished(levels))
        up = known.select("tree_id", F.col("node_id").alias("anc"), F.col("anc").alias("up"), F.col("depth").alias("more"), F.col("total").alias("gain"))
        nxt = active.join(up, ["tree_id", "anc"]).select("tree_id", "node_id", F.col("up").alias("anc"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("gain")).alias("total"))
        levels.append(common.written(nxt, "anc"))
    return levels


def finished(levels: list[DataFrame]) -> DataFrame:
    """The nodes whose root has been reached, with the depth and the score of their whole path."""
    return reduce(DataFrame.unionByName, [level.where("anc is null") for level in levels])


def reply_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """The `per_tree` best root-to-leaf paths of each tree: (tree_id, leaf, branch_rank, path_score, node_id, above),
    one row for each node of a path; above counts the steps from the leaf. Ties go to the longer path, then the
    smaller leaf."""
    levels = ancestor_tables(nodes)
    inner = nodes.select("tree_id", F.col("parent_id").alias("node_id")).where("node_id is not null")
    leaves = finished(levels).join(inner, ["tree_id", "node_id"], "left_anti")
    best = Window.partitionBy("tree_id").orderBy(F.desc("path_score"), F.desc("depth"), "node_id")
    leaves = leaves.withColumn("path_score", F.col("total") / F.col("depth")).withColumn("branch_rank", F.row_number().over(best)).where(F.col("branch_rank") <= per_tree)
    paths = leaves.select("tree_id", F.col("node_id").alias("leaf"), "branch_rank", "path_score", "node_id", F.lit(0).alias("above"))
    for k, level in enumerate(levels[:-1]):
        jump = level.select("tree_id", "node_id", "anc").where("anc is not null")
        higher = paths.join(jump, ["tree_id", "node_id"]).select("tree_id", "leaf", "branch_rank", "path_score", F.col("anc").alias("node_id"), (F.col("above") + (1 << k)).alias("above"))
        # each round reads the one before twice, so plans that weren't cut would double with every round
        longer = common.written(paths.unionByName(higher), "paths")
        common.drop_written(paths)
        paths = longer
    out = paths if hasattr(paths, "path_") else common.written(paths, "paths")
    common.drop_written(*levels)
    return out


def format_paths(nodes: DataFrame, paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a path: formatted text, and its segments in order, each with the loss mask (only texts of `loss_role`)."""
    turns = paths.join(nodes.select("tree_id", "node_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree_id", "node_id"])
    grouped = turns.groupBy("tree_id", "leaf", "branch_rank", "path_score").agg(F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("at"), escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text")))).alias("t"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("t", lambda t: F.array(piece(F.concat(F.lit(TURN), t["role"], F.lit(TEXT)), F.lit(False)), piece(t["text"], t["role"] == loss_role), piece(F.lit(END), F.lit(False)))))
    return grouped.select("tree_id", "leaf", "branch_rank", "path_score", segments.alias("segments")).withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, read back."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t != "")
    pair = lambda t: F.split(F.substring(t, len(TURN) + 1, 2**31 - 1), r"<\|text\|>")
    return F.transform(turns, lambda t: F.struct(unescaped(pair(t)[0]).alias("role"), unescaped(pair(t)[1]).alias("text")))


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Conversations as reply trees: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).alias("node_id"))
    return numbered.select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.char_length(F.coalesce("text", F.lit(""))).alias("score"))


def written_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of conversations, written; `value` holds the conv_id."""
    nulls = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))  # join keys hold no null
    return common.written(conversation_nodes(rows.withColumn("conv_id", F.struct(nulls.alias("key"), "conv_id"))).withColumn("value", F.col("tree_id.conv_id")).withColumn("tree_id", F.col("tree_id.key")), "nodes")


def format_conversations(rows: DataFrame, per_tree: int = 1) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one formatted conversation each, through their reply trees."""
    nodes = written_nodes(rows)
    return conversations_of(nodes, reply_paths(nodes, per_tree))


def conversations_of(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The conversations of paths over written_nodes()."""
    out = format_paths(nodes, paths)
    return out.withColumn("conv_id", F.when(F.col("tree_id") != "null", F.col("tree_id").cast(nodes.schema["value"].dataType)))


def op4_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql(f"SELECT -1L conv_id, i turn, r role, '{CONTROL_SAMPLE}' text FROM VALUES (0L, 'user'), (1L, 'assistant') t(i, r)")
    nodes = written_nodes(rows.unionByName(control))
    paths = reply_paths(nodes)
    out = conversations_of(nodes, paths)
    turns = parsed(F.col("formatted"))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    out = out.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digests = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")
    return common.settled(digests, "chat", nodes, paths)


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_SAMPLE}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_SAMPLE}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + TEXT + END)}
      + length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'))
      + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
