"""Chat formatting from reply trees.

Messages point to the message they reply to.  Paths from each leaf to its root
are found by self-joins that double the distance covered each time, so a
thread of depth d takes about log2(d) joins.  Branches of a tree are ranked by
their mean score and each chosen path becomes one conversation.

Defined cases: rows without conversation or message id are left out; of rows
that share both, the least (parent, role, text) stands; a parent that isn't
there, or null, makes a root; messages on or below a cycle of replies are in
no path; a null role is 'unknown', a null text is empty, a null score 0; ties
of score are ranked by the leaf's id; what looks like a turn mark in a text or
a role is broken up by a space.
Texts of any length stand whole; an empty table has no path; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, pick


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, msg_id, parent_id, score) with unique ids -> (conv_id, leaf_id, path, total): message ids from root to leaf."""
    nodes = messages.select("conv_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0)).cast("double").alias("score"))
    known = nodes.select("conv_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("there"))
    has_reply = nodes.where("parent_id is not null").select("conv_id", F.col("parent_id").alias("msg_id"), F.lit(True).alias("replied")).distinct()
    nodes = nodes.join(known, ["conv_id", "parent_id"], "left").join(has_reply, ["conv_id", "msg_id"], "left")
    steps = cut(nodes.select(
        "conv_id", "msg_id", F.when(F.col("there"), F.col("parent_id")).alias("up"),
        F.array("msg_id").alias("path"), F.col("score").alias("total"), F.col("replied").isNull().alias("leaf"),
    ))
    open_ = steps.where("up is not null").count()
    while open_:
        above = steps.select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("total").alias("total2"))
        steps = cut(steps.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "msg_id", F.col("up2").alias("up"), F.concat(F.coalesce("path2", F.array().cast("array<bigint>")), "path").alias("path"),
            (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"), "leaf",
        ))
        still = steps.where("up is not null").count()
        if still == open_:  # a join that finishes no path: only cycles are left
            steps = steps.where("up is null")
            break
        open_ = still
    return steps.where("leaf").select("conv_id", F.col("msg_id").alias("leaf_id"), "path", "total")


def format_trees(messages: DataFrame, *, branches: int | None = None) -> DataFrame:
    """(conv_id, msg_id, parent_id, role, text, score) -> one row for each
    chosen path: conv_id, leaf_id, branch (its rank), score, n_turns, path, text.

    branches: how many of each conversation's paths to keep, all by default."""
    m = pick(messages, "conv_id", "msg_id", "parent_id", "role", "text", "score").where("conv_id is not null and msg_id is not null")
    m = m.groupBy(m["conv_id"].cast("bigint").alias("conv_id"), m["msg_id"].cast("bigint").alias("msg_id")).agg(F.min(F.struct(
        m["parent_id"].cast("bigint").alias("parent_id"), F.coalesce(m["role"], F.lit("unknown")).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text"), m["score"].cast("double").alias("score"),
    )).alias("m")).select("conv_id", "msg_id", "m.*")
    m = cut(m)
    found = paths(m).withColumn("score", F.col("total") / F.size("path"))
    order = W.partitionBy("conv_id").orderBy(F.desc("score"), "leaf_id")
    found = found.withColumn("branch", F.row_number().over(order).cast("bigint"))
    if branches is not None:
        found = found.where(F.col("branch") <= branches)
    turns = found.select("conv_id", "leaf_id", "branch", "score", "path", F.posexplode("path").alias("pos", "msg_id"))
    role = F.replace(F.replace("role", F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    body = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("\n"))
    turns = turns.join(m.select("conv_id", "msg_id", body.alias("body")), ["conv_id", "msg_id"])
    whole = turns.groupBy("conv_id", "leaf_id").agg(
        F.first("branch").alias("branch"), F.first("score").alias("score"), F.first("path").alias("path"),
        F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("parts"),
    )
    return whole.select("conv_id", "leaf_id", "branch", "score", F.size("path").cast("bigint").alias("n_turns"), "path", F.concat_ws("", "parts.body").alias("text"))


def from_turns(conversations: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text): a turn replies to the
    latest earlier one of another role, so consecutive turns of one role are
    branches.  Rows that share a turn are alternatives, told apart by role and
    text.  A message's score is its length in characters."""
    c = pick(conversations, "conv_id", "turn", "role", "text")
    rows = c.where(c["conv_id"].isNotNull() & c["turn"].isNotNull()).select(
        c["conv_id"].cast("bigint").alias("conv_id"), c["turn"].alias("turn"), F.coalesce(c["role"], F.lit("unknown")).alias("role"), F.coalesce(c["text"], F.lit("")).alias("text")
    ).distinct()
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("msg_id", F.row_number().over(order).cast("bigint"))
    before = F.lag("role").over(order)
    opens = F.when(before.isNull() | (before != F.col("role")), F.col("msg_id") - 1)
    parent = F.last(opens, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("conv_id", "msg_id", F.nullif(parent, F.lit(0)).alias("parent_id"), "role", "text", F.length("text").cast("double").alias("score"))
