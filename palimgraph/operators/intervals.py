"""From statements per revision to validity intervals, and their algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import parts_for
from ..vocabulary import MAX


def build(statements: DataFrame, axis: DataFrame | None = None, keep: tuple[str, ...] = ("s", "p", "o")) -> DataFrame:
    """(page, rev, *keep), a row for each statement present in a revision ->
    (*keep, rev_start, rev_end), adjacent revisions being one interval.

    axis: (page, rev) of all parsed revisions, needed where one may have no
    statement; a revision that wasn't parsed isn't in it, so the state before
    it goes on.  keep: the columns of a statement, page too if it is wanted.

    Statements and axis go by page in one shuffle, and all windows are over
    what is sorted in it: no join, no hash table, and rows may occur twice."""
    own = [c for c in keep if c != "page"]
    axis = (statements if axis is None else axis).select("page", "rev", F.lit(True).alias("_axis"), *[F.lit(None).cast(t).alias(c) for c, t in statements.dtypes if c in own])
    rows = axis.unionByName(statements.select("page", "rev", F.lit(False).alias("_axis"), *own)).where("page is not null and rev is not null")
    rows = rows.repartition(parts_for(rows), "page")
    down = W.partitionBy("page").orderBy(F.desc("rev"), F.desc("_axis"))
    here = F.when(F.col("_axis"), F.col("rev"))
    so_far = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_after", F.last(here, True).over(down.rowsBetween(W.unboundedPreceding, -1))).withColumn("_at", F.last(here, True).over(so_far))
    opens = F.col("_axis") & ~F.col("_after").eqNullSafe(F.col("rev"))
    rows = rows.withColumn("_nth", F.sum(F.when(opens, 1).otherwise(0)).over(so_far)).withColumn("_next", F.last(F.when(opens, F.coalesce("_after", F.lit(MAX))), True).over(so_far))
    rows = rows.where(~F.col("_axis") & (F.col("_at") == F.col("rev"))).select("page", "rev", "_nth", "_next", *own)
    # From the last revision to the first: an interval's end is known where its last revision is met.
    run = W.partitionBy("page", *own).orderBy("_nth")
    rows = rows.withColumn("_before", F.lag("_nth").over(run)).withColumn("_later", F.lead("_nth").over(run))
    last = F.col("_before").isNull() | (F.col("_nth") - F.col("_before") > 1)
    rows = rows.withColumn("rev_end", F.last(F.when(last, F.col("_next")), True).over(run.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.where("_later is null or _later - _nth > 1").select(*keep, F.col("rev").alias("rev_start"), "rev_end")


def union(intervals: DataFrame) -> DataFrame:
    """Overlapping and touching intervals of equal triples become one."""
    order = W.partitionBy("s", "p", "o").orderBy("rev_start", "rev_end")
    before = F.max("rev_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = intervals.where("rev_start < rev_end").withColumn("opens", F.when(before >= F.col("rev_start"), 0).otherwise(1))
    numbered = opens.withColumn("nth", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("s", "p", "o", "nth").agg(F.min("rev_start").alias("rev_start"), F.max("rev_end").alias("rev_end")).drop("nth")


def unsorted_ranges(ranges: DataFrame) -> DataFrame:
    """Data quality: rows (s, p, o, ranges) whose bounds don't strictly increase or aren't in pairs."""
    steps = F.zip_with(F.slice("ranges", 1, F.greatest(F.size("ranges") - 1, F.lit(0))), F.slice("ranges", 2, F.greatest(F.size("ranges") - 1, F.lit(1))), lambda a, b: b <= a)
    return ranges.where((F.size("ranges") % 2 != 0) | F.exists(steps, lambda x: F.coalesce(x, F.lit(False))))


def collect_ranges(intervals: DataFrame) -> DataFrame:
    """One row for each triple: s, p, o, ranges (start0, end0, start1, ...)."""
    pairs = F.sort_array(F.collect_list(F.struct("rev_start", "rev_end")))
    return intervals.groupBy("s", "p", "o").agg(F.flatten(F.transform(pairs, lambda x: F.array(x.rev_start, x.rev_end))).alias("ranges"))


def state_counts(intervals: DataFrame, revisions: DataFrame, width: int = 1 << 18) -> DataFrame:
    """(revision_id, n): how many triples hold at each revision, by running
    sums of what begins and ends.

    Sums run within buckets of so many revision numbers and, over one row a
    bucket, between them; no task sees all revisions.  The intervals are read once."""
    bounds = F.array(F.struct(F.col("rev_start").alias("rev"), F.lit(1).alias("d")), F.struct(F.col("rev_end").alias("rev"), F.lit(-1).alias("d")))
    moves = intervals.where("rev_start < rev_end").select(F.inline(bounds)).where(F.col("rev") < MAX).groupBy("rev").agg(F.sum("d").alias("d"), F.lit(False).alias("asked"))
    here = revisions.select(F.col("revision_id").alias("rev"), F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("asked")).where("rev is not null")
    changes = moves.unionByName(here).groupBy("rev").agg(F.sum("d").alias("d"), F.max("asked").alias("asked"))
    changes = changes.withColumn("bucket", F.floor(F.col("rev") / width))
    within = F.sum("d").over(W.partitionBy("bucket").orderBy("rev"))
    counted = changes.withColumn("within", within)
    # The same columns as for the window, so that the rows are made and shuffled once.
    sums = changes.groupBy("bucket").agg(F.sum("d").alias("all"), F.max("asked").alias("any")).where("any is not null")
    sums = sums.select("bucket", (F.sum("all").over(W.orderBy("bucket")) - F.col("all")).alias("before"))
    return counted.where("asked").join(sums, "bucket").select(F.col("rev").alias("revision_id"), (F.col("within") + F.col("before")).alias("n"))
