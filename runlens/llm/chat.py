"""Chat formatting: reply trees, their best root-to-leaf paths, and each path as one formatted conversation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import materialize

#: Fixed values of the template. In roles and texts, backslashes are doubled and then <| becomes <\| .
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """A single backslash stands only between < and |, all others in pairs, so this undoes escape exactly."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def jump_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes (conv_id, node_id, parent_id, score) -> tables of ancestors 1, 2, 4, ... steps up, and each node's whole way to its root.

    Each table is a self-join of the one before, so a path of n messages takes log2(n) joins; conversations all of
    whose nodes have reached their root take no part in the next. The second result has path_score and path_length;
    nodes on a circle never reach a root and are missing there.
    """
    up = nodes.select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_p"))
    known = nodes.join(up, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("parent_id") == F.col("_p")), "left")
    state = materialize(known.select("conv_id", "node_id", F.col("_p").alias("up"), F.col("score").alias("path_score"), F.lit(1).cast("long").alias("path_length")), "reply-steps")
    tables, ended, most = [], [state.where("up IS NULL")], state.count()
    active = state.where("up IS NOT NULL")
    while 2 ** len(tables) < 2 * most and not active.isEmpty():
        tables.append(active)
        left = active.select(F.col("conv_id").alias("_l")).distinct()
        state = state.join(left, F.col("conv_id").eqNullSafe(F.col("_l")), "left_semi")
        a, b = active.alias("a"), state.alias("b")
        joined = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.up") == F.col("b.node_id")))
        further = joined.select("a.conv_id", "a.node_id", F.col("b.up").alias("up"), (F.col("a.path_score") + F.col("b.path_score")).alias("path_score"), (F.col("a.path_length") + F.col("b.path_length")).alias("path_length"))
        state = materialize(further.withColumn("moved", F.lit(True)).unionByName(state.where("up IS NULL").select(*further.columns, F.lit(False).alias("moved"))), "reply-steps")
        ended.append(state.where("up IS NULL AND moved").drop("moved"))
        active, state = state.where("up IS NOT NULL").drop("moved"), state.drop("moved")
    return tables, functools.reduce(DataFrame.unionByName, ended).drop("up")


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """messages (conv_id, node_id, parent_id, role, text, score) -> (conv_id, path, pos, node_id, role, text, path_score).

    path is 1 for a conversation's branch with the highest mean score, and so on up to top; ties go to the longer
    branch, then to the smaller leaf. pos counts from 0 at the root. A parent that isn't in the conversation makes its
    reply a root; a missing score counts as 0; messages on a circle of parents belong to no path. Of messages of one
    conversation with the same node_id the one stays that is least by parent, role, text and score, nulls first; a null
    node_id is a node like others, to which nothing replies. Null conv_ids are one conversation; empty tables give
    empty ones, and other columns are left out.
    """
    rest = F.struct("parent_id", "role", "text", F.col("score").cast("double").alias("score"))
    messages = materialize(messages.groupBy("conv_id", "node_id").agg(F.min(rest).alias("m")).select("conv_id", "node_id", "m.*"), "messages")
    nodes = messages.select("conv_id", "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    tables, whole = jump_tables(nodes)
    parents = nodes.select(F.col("conv_id").alias("_c"), F.col("parent_id").alias("_p")).distinct()
    leaves = whole.join(parents, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node_id") == F.col("_p")), "left_anti").withColumn("path_score", F.col("path_score") / F.col("path_length"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("path_score"), F.desc("path_length"), "node_id")
    paths = leaves.withColumn("path", F.row_number().over(order)).where(F.col("path") <= top)
    paths = paths.select("conv_id", "path", "path_score", "path_length", "node_id", (F.col("path_length") - 1).alias("pos"))
    for k in reversed(range(len(tables))):
        step = tables[k].select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"), "up")
        higher = paths.join(step, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node_id") == F.col("_n")))
        paths = materialize(paths.unionByName(higher.select("conv_id", "path", "path_score", "path_length", F.col("up").alias("node_id"), (F.col("pos") - 2**k).alias("pos"))), "reply-paths")
    told = messages.select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"), "role", "text")
    return paths.join(told, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node_id") == F.col("_n"))).drop("_c", "_n", "path_length")


def format_paths(paths: DataFrame) -> DataFrame:
    """(conv_id, path, pos, role, text) -> (conv_id, path, n_turns, formatted, loss_spans).

    formatted is TURN role TEXT text END for each turn, with escape on role and text (null: empty). loss_spans are
    (start, length) in code points of the escaped assistant texts, in order.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turns = paths.select("conv_id", "path", "pos", F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"), F.concat(F.lit(TURN), role, F.lit(TEXT)).alias("head"), text.alias("body"))
    before = Window.partitionBy("conv_id", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("pos", F.concat("head", "body", F.lit(END)).alias("piece"), "loss", "start", F.length("body").cast("long").alias("length"))
    whole = turns.groupBy("conv_id", "path").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.select("conv_id", "path", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both read back from formatted and loss_spans."""
    parts = F.split("formatted", "<\\|turn\\|>", -1)
    pieces = F.slice(parts, F.lit(2), F.size(parts))
    turn = lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"))
    lost = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(lost, "")})


def as_reply_trees(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages whose parent is the turn before; equal turns are ordered by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("node_id"), "role", "text")
    return rows.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def format_chats(messages: DataFrame, top: int = 1) -> DataFrame:
    """Reply trees as formatted conversations, the best top paths of each (see best_paths, format_paths)."""
    return format_paths(best_paths(messages, top))
