"""Joins of revisions with the intervals that contain them.

Without an equality key the condition rev_start <= r < rev_end is no hash join.
Here each interval is cut into its canonical dyadic blocks, at most two a
level, and each revision lies in one block of each level: the join is then an
equality on (level, block), exact and without duplicates, and partitions by
hash like any other.  Open ends are first brought to the last revision asked.

Where only the number of intervals that contain a revision is wanted, no pair
is made: see counts.  A few revisions meet the intervals where these are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals as I

#: Points of up to so many rows are sent to the intervals.
FEW = 1000


def _blocks(start: str, end: str, levels: int) -> str:
    low, high = f"shiftright({start} + shiftleft(1L, k) - 1, k)", f"shiftright({end}, k)"
    at = f"array_distinct(concat(if({low} % 2 = 1, array({low}), array()), if({high} % 2 = 1, array({high} - 1), array())))"
    return f"flatten(transform(sequence(0, {levels}), k -> if({low} < {high}, transform({at}, b -> struct(k as level, b as block)), array())))"


def contains(points: DataFrame, intervals: DataFrame, point: str, start: str = "rev_start", end: str = "rev_end", levels: int | None = None) -> DataFrame:
    """Rows of points and intervals with start <= point < end, points being 0 or more."""
    if levels is None:
        last = points.agg(F.max(point)).first()[0]
        levels = max(int(last or 0).bit_length() + 1, 1)
    top = (1 << levels) - 1
    cut_ = intervals.where(f"{start} <= {top}").withColumn("at", F.explode(F.expr(_blocks(f"greatest({start}, 0L)", f"least({end}, {top + 1}L)", levels))))
    cut_ = cut_.withColumn("_level", F.col("at.level")).withColumn("_block", F.col("at.block")).drop("at")
    asked = points.where(f"{point} between 0 and {top}").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    asked = asked.withColumn("_block", F.expr(f"shiftright({point}, _level)"))
    return asked.join(cut_, ["_level", "_block"]).drop("_level", "_block")


def contains_few(points: DataFrame, intervals: DataFrame, point: str, start: str = "rev_start", end: str = "rev_end") -> DataFrame:
    """The same for points known to be at most FEW rows: each interval is compared with them where it is."""
    p = F.col(point)
    return intervals.join(F.broadcast(points), (F.col(start) <= p) & (p < F.col(end)))


def counts(points: DataFrame, intervals: DataFrame, point: str, start: str = "rev_start", end: str = "rev_end") -> DataFrame:
    """(point, n): how many intervals contain each different point, if any; by running sums, so the work follows the rows and not their pairs."""
    held = I.state_counts(intervals.select(F.col(start).alias("rev_start"), F.col(end).alias("rev_end")), points.select(F.col(point).alias("revision_id")))
    return held.where("n > 0").withColumnRenamed("revision_id", point)
