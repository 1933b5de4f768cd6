"""Transitive closure by stored steps; cycles end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(x, y) distinct: y reached from x by one edge or more.

    starts: (x), to follow only from there, a step at a time.  Otherwise each
    round doubles the length of the paths known, so a chain of n edges takes
    about log2(n) rounds.  What is known is stored after each step, so a lost
    executor repeats one step at most."""
    edges = cut(edges.select("x", "y").where("x is not null and y is not null").distinct())
    if starts is not None:
        return _from(edges, starts)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a union would add partitions each round
    known = power = edges  # paths of 1 to 2^k - 1 edges, and of just 2^(k - 1)
    while not power.isEmpty():
        after = power.select(F.col("x").alias("y"), F.col("y").alias("z"))
        power = cut(power.join(after, "y").select("x", F.col("z").alias("y")).distinct())
        step = power.select(F.col("x").alias("y"), F.col("y").alias("z"))
        more = power.unionByName(known.join(step, "y").select("x", F.col("z").alias("y"))).distinct()
        fresh = cut(more.join(known, ["x", "y"], "left_anti"))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh).coalesce(parts)  # both are stored already
    return known


def sources(edges: DataFrame) -> DataFrame:
    """(y, n): from how many x it is reached by one edge or more.

    Where each x has one edge, as revisions have one parent, no pairs are made:
    a node keeps how many of up to 2^k - 1 edges below it there are, and the
    node 2^k edges up, whose number it adds to.  Rounds double k, and each has a
    row a node.  What is on or below a cycle, or branches, is followed in pairs."""
    edges = cut(edges.select("x", "y").where("x is not null and y is not null").distinct())
    if not edges.groupBy("x").count().where("count > 1").isEmpty():
        return closure(edges).groupBy("y").agg(F.count("*").alias("n"))
    nodes = edges.unionByName(edges.select(F.col("y").alias("x"), F.lit(None).cast(edges.schema["y"].dataType).alias("y")))
    state = cut(nodes.groupBy("x").agg(F.max("y").alias("up"), F.lit(1).cast("bigint").alias("n")))
    total, reach = state.count(), 1
    while not (climbing := state.where("up is not null")).isEmpty() and reach <= total:
        added = climbing.groupBy("up").agg(F.sum("n").alias("more")).select(F.col("up").alias("x"), "more")
        above = climbing.select(F.col("x").alias("up"), F.col("up").alias("above"))
        moved = climbing.join(above, "up").select("x", "above")
        state = cut(state.join(added, "x", "left").join(moved, "x", "left").select("x", F.col("above").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        reach *= 2
    ends = state.where("up is null and n > 1").select(F.col("x").alias("y"), (F.col("n") - 1).alias("n"))
    if climbing.isEmpty():
        return ends
    round_ = closure(edges.join(climbing.select("x"), "x", "left_semi"))
    return ends.unionByName(round_.groupBy("y").agg(F.count("*").alias("n")))


def _from(edges: DataFrame, starts: DataFrame) -> DataFrame:
    known = frontier = cut(edges.join(starts.select("x").distinct(), "x", "left_semi"))
    step = edges.select(F.col("x").alias("y"), F.col("y").alias("z"))
    while not frontier.isEmpty():
        frontier = cut(frontier.join(step, "y").select("x", F.col("z").alias("y")).distinct().join(known, ["x", "y"], "left_anti"))
        known = known.unionByName(frontier)
    return known
