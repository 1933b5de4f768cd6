"""Where intermediate tables are kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def use_shared_folder(spark: SparkSession) -> None:
    """Checkpoints go where spark.checkpoint.dir says.  A temporary folder
    serves only a single-process session (tests); on a cluster without the
    setting this raises, as executors share no local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimgraph-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder, without lineage."""
    use_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parts_for(df: DataFrame, each: int = 4 << 20, least: int | None = None) -> int:
    """How many partitions its rows should be dealt to: the least number (of the session's shuffles, unless given), or one for
    so many bytes of the files that are read, if that is more.  Shuffled rows of few different texts compress to almost nothing, so their
    own size says little of the work that is left with them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(s for s in sizes if s < 1 << 50) // each)  # what isn't known is taken to be huge
