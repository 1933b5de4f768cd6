"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimgraph.shared import cut, use_shared_folder

__all__ = ["TOKEN", "by_place", "cut", "doc_key", "n_tokens", "pick", "place", "prefix", "read", "table", "use_shared_folder"]

#: A token, where an operator counts tokens: a run of characters between ASCII white space.
TOKEN = r"[^ \t\n\r\f]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_tokens(text: Column) -> Column:
    """Number of white-space separated tokens; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def doc_key(doc_id: Column, text: Column) -> Column:
    """doc_id, or a hash of the text for rows that have no id."""
    return F.coalesce(doc_id.cast("bigint"), F.xxhash64(F.lit("no id"), text))


def prefix(rows: int, per: int = 20_000) -> int:
    """How many hex digits of a hash part so many rows into buckets of about that many."""
    digits = 1
    while rows > per * 16**digits:
        digits += 1
    return digits


def place(df: DataFrame, name: str) -> int:
    """Where the column of exactly that name is; without one, that which differs in case only.
    ValueError if there is none, or more than one of the exact name."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}")
    return found[0]


def by_place(df: DataFrame) -> DataFrame:
    """The same columns named _0, _1 and so on, so that no names clash."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, whatever the others are called."""
    return by_place(df).select(*(F.col(f"_{place(df, n)}").alias(n) for n in names))


def table(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder as Parquet, of which readers take the columns they use.
    The files go when the session ends."""
    spark = df.sparkSession
    use_shared_folder(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)
