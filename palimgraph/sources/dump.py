"""XML history dumps.

A page with its revisions is one XML row; bz2 files are read in splits.  The
revisions are spread right after, so nothing later holds a whole page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals
from ..vocabulary import PREFIXES
from .entities import entity_triples

_REVISION = "struct<id: bigint, parentid: bigint, timestamp: string, contributor: struct<username: string, id: bigint, ip: string>, comment: string, text: string>"
PAGE = f"title string, ns int, id bigint, revision array<{_REVISION}>"
_TITLE = r"^(?:Item:|Property:|)([PQ]\d+)$"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, entity, rev, parent_id, ts_sec, contributor, comment, text) of
    each revision of a page whose title names an item or a property."""
    pages = spark.read.format("xml").option("rowTag", "page").option("recursiveFileLookup", "true").schema(PAGE).load(path)
    rows = pages.select(F.col("id").alias("page"), F.regexp_extract("title", _TITLE, 1).alias("entity"), F.explode("revision").alias("r")).where("entity <> ''")
    # ISO-8601 text in UTC, whatever the session's zone
    seconds = F.unix_micros(F.try_to_timestamp("r.timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ssX"))) / 1_000_000
    who = F.coalesce("r.contributor.username", "r.contributor.ip", F.lit(""))
    return rows.select("page", "entity", F.col("r.id").alias("rev"), F.col("r.parentid").alias("parent_id"), F.floor(seconds).alias("ts_sec"), who.alias("contributor"), F.col("r.comment").alias("comment"), F.col("r.text").alias("text"))


def revisions(pages: DataFrame) -> DataFrame:
    """The table of revisions; also of those whose text can't be parsed."""
    topic = F.concat(F.lit("<" + PREFIXES["wd"]), "entity", F.lit(">"))
    return pages.select(F.col("rev").alias("revision_id"), "parent_id", topic.alias("topic"), "ts_sec", "contributor", "comment")


def triples(pages: DataFrame, property_info: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """(s, p, o, rev_start, rev_end).  A revision that can't be parsed leaves the state before it in force."""
    statements, parsed = entity_triples(pages.select("page", "rev", "text"), property_info, sites)
    return intervals.union(intervals.build(statements, parsed))
