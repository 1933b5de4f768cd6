"""Validity intervals of a stream of revisions.

Each micro-batch holds whole revisions, in any order within it, later than
those of the batches before.  What still holds is kept in a table; a batch
closes intervals, which are final and appended, and opens others.  The table of
open intervals has a version for each batch, so a batch that is run again after
a failure starts from the same state and writes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import intervals
from ..vocabulary import MAX

OPEN = "page bigint, s string, p string, o string, rev_start bigint"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder + "/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def advance(statements: DataFrame, axis: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page, rev, s, p, o) of new revisions, their (page, rev) and the open
    intervals before -> closed intervals and the open ones after."""
    # What was open is put at revision -1 of pages that go on; the interval keeps its own start.
    touched = axis.select("page").distinct()
    going = held.join(touched, "page", "left_semi")
    before = going.select("page", F.lit(-1).cast("bigint").alias("rev"), "s", "p", "o")
    line = axis.select("page", "rev").unionByName(held.join(touched, "page", "left_semi").select("page", F.lit(-1).cast("bigint").alias("rev")))
    keyed = lambda df: df.select("page", "rev", F.to_json(F.struct("page", "s")).alias("s"), "p", "o")
    made = intervals.build(keyed(statements.unionByName(before)), line).withColumn("k", F.from_json("s", "page bigint, s string")).select("k.page", "k.s", "p", "o", "rev_start", "rev_end")
    starts = going.select("page", "s", "p", "o", F.col("rev_start").alias("was"))
    made = made.join(starts.withColumn("rev_start", F.lit(-1).cast("bigint")), ["page", "s", "p", "o", "rev_start"], "left").withColumn("rev_start", F.coalesce("was", "rev_start")).drop("was")
    closed = made.where(F.col("rev_end") < MAX).select("s", "p", "o", "rev_start", "rev_end")
    after = made.where(F.col("rev_end") == MAX).select("page", "s", "p", "o", "rev_start").unionByName(held.join(touched, "page", "left_anti"))
    return closed, after


def maintain(statements: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs a stream (page, rev, statements array<struct<s,p,o>>), a row for
    each revision, into folder/closed/batch=n and folder/open/batch=n."""
    spark = statements.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        earlier = [k for k in range(n - 1, -1, -1) if _exists(spark, f"{folder}/open/batch={k}")][:1]
        held = spark.read.schema(OPEN).parquet(f"{folder}/open/batch={earlier[0]}") if earlier else spark.createDataFrame([], OPEN)
        rows = batch.select("page", "rev", F.inline("statements"))
        closed, after = advance(rows, batch.select("page", "rev"), held)
        closed.write.mode("overwrite").parquet(f"{folder}/closed/batch={n}")
        after.write.mode("overwrite").parquet(f"{folder}/open/batch={n}")

    return statements.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """(s, p, o, rev_start, rev_end) of all intervals up to a batch."""
    closed = spark.read.parquet(f"{folder}/closed").where(F.col("batch") <= batch).drop("batch")
    return closed.unionByName(spark.read.schema(OPEN).parquet(f"{folder}/open/batch={batch}").select("s", "p", "o", "rev_start", F.lit(MAX).alias("rev_end")))
