"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; what it returns is written as Parquet and read again for the next.

Defined cases: an empty table goes through all stages and gives no sequence;
columns beside those of documents are kept by all stages but the last, whatever
their names (Parquet itself refuses names that differ in case only); texts of
any length are read whole.  What a stage does with nulls, empty texts, ties and
repeated rows is said at each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimgraph.llm import languages, mixing, near_dups, packing, toxicity
from palimgraph.llm.common import read, use_shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels, finds toxic go.

    A null or empty text stays; so does every row if the labels are empty or all
    alike; a row without doc_id is judged by its text; equal texts fare alike."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go.

    A text without letters (null, empty, digits) goes; so does every row if no
    row names a language; equal texts fare alike; rows without doc_id are judged
    by their text; a tie between a language and the unknown is known."""
    return languages.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id.

    A text without words is no duplicate; rows equal in doc_id and text are one;
    different texts of one doc_id are documents of their own; a null doc_id is
    stood for by a hash of the text."""
    return near_dups.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of all sources stay, dealt to shards by target proportions; a scarce source limits no other.

    Rows are in the order of the mix, shard after shard, which is the order that packing goes by.
    A null source is one of its own; a source without tokens gets no block, so
    its empty texts go; ties of quotients fall to the source first by name."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' pieces, with the position of the first of them in the mix.

    Of the documents of a length, the first in the mix take the first sequences of the plan.
    A text without tokens is in none; a repeated row is packed each time; a null
    doc_id is packed as null; a text longer than a sequence is cut into pieces."""
    return packing.pack(docs, in_order=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier, the language models and the best-fit plan have no SQL; a brute-force version tests run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
