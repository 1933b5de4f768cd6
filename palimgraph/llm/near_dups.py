"""MinHash near-dedup with b-bit signatures (Li and König, "b-Bit Minwise
Hashing", 2010): band candidates come from the full minima, only the low bits
of the minima are kept, and similarity is estimated from bit counts with the
correction for accidental agreement.

Defined cases: a text without words (null, empty, only punctuation) has no
signature and is never a duplicate; one of fewer words than a shingle is one
shingle; rows that share a doc_id and a text are one document, rows that share
the doc_id alone are documents of their own, with the same id in the result; a
null doc_id is stood for by a hash of its text; other columns are not looked at.
Texts of any length are read whole; an empty table has no group; the filter
carries other columns along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textvec
from .common import by_place, doc_key, pick, place
from .neargroups import columns, similar_groups, with_groups

SHINGLE, K, ROWS, BITS, LEAST, SEED = 3, 192, 4, 4, 0.5, 11


def signatures(docs: DataFrame, *, shingle: int = SHINGLE, k: int = K, rows: int = ROWS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(id, row_key, sig, bands) of each row; sig is null where the text has no words."""
    if k * bits % 64 or 8 % bits or k % rows:
        raise ValueError("k * bits must be a multiple of 64, bits of 1, 2, 4 or 8, rows a divisor of k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            for a, b in textvec.chunks(texts):
                hashes, offsets = textvec.shingles(*textvec.word_hashes(texts[a:b]), shingle)
                mins = textvec.minima(hashes, offsets, k, seed)
                empty = offsets[1:] == offsets[:-1]
                yield pa.RecordBatch.from_pydict({
                    "id": ids.slice(a, b - a),
                    "row_key": batch.column("row_key").slice(a, b - a),
                    **columns(mins, empty, rows, bits),
                })

    given = pick(docs, "doc_id", "text")
    keyed = given.select(doc_key(F.col("doc_id"), F.col("text")).alias("id"), _row_key("doc_id", "text").alias("row_key"), "text")
    return keyed.mapInArrow(run, "id bigint, row_key bigint, sig binary, bands array<bigint>")


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(doc_id, text)


def near_duplicates(docs: DataFrame, *, least: float = LEAST, **options) -> DataFrame:
    """One row for each row: id, row_key (a hash of doc_id and text) and, in a
    group, node (of the signature), root, group_id, group_size and links."""
    options = {"k": K, "bits": BITS} | options
    return with_groups(*similar_groups(signatures(docs, **options), least, options["k"], options["bits"]))


def near_duplicate_groups(docs: DataFrame, **options) -> DataFrame:
    """One row for each document of a group of two or more: doc_id, group_id (its
    least doc_id), group_size and links, the number of other signatures that the
    document's own was found similar to (0: all the others are copies of it)."""
    rows = near_duplicates(docs, **options).groupBy("id", "group_id").agg(F.max("group_size").alias("group_size"), F.coalesce(F.max("links"), F.lit(0)).alias("links"))
    return rows.where("group_size > 1").select(F.col("id").alias("doc_id"), "group_id", "group_size", "links")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each group stays, of the least doc_id and, among texts that share it, of the least hash."""
    rows = near_duplicates(docs, **options).where("root is not null").select("root", "id", "row_key")
    first = rows.groupBy("root").agg(F.count_distinct("row_key").alias("n"), F.min(F.struct("id", "row_key")).alias("first")).where("n > 1")
    gone = rows.distinct().join(first, "root").where("id <> first.id or row_key <> first.row_key").select("id", "row_key")
    plain, doc_id, text = by_place(docs), f"_{place(docs, 'doc_id')}", f"_{place(docs, 'text')}"
    keyed = plain.withColumn("id", doc_key(F.col(doc_id), F.col(text))).withColumn("row_key", _row_key(doc_id, text))
    one = W.partitionBy("id", "row_key").orderBy("row_key")
    kept = keyed.join(gone, ["id", "row_key"], "left_anti").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return kept.select(plain.columns).toDF(*docs.columns)
