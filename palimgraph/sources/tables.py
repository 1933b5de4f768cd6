"""Interchange files: revisions and triples as tab-separated text, gzip or plain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import intervals
from ..vocabulary import PREFIXES, iri

_DIRECT = "<" + PREFIXES["wdt"]
_ALWAYS = [iri(n) for n in ("owl:sameAs", "rdfs:label", "schema:description", "skos:altLabel", "schema:about")]


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """Columns of a line: revision, parent, entity, seconds, contributor and (not
    read) comment.  A parent under 0 is none; lines without a number are left out."""
    fields = F.split(F.col("value"), "\t", -1)
    line = spark.read.text(path).select(fields.alias("f")).where(F.size("f") >= 5)
    number = lambda i: F.get("f", F.lit(i)).try_cast("bigint")
    topic = F.when(F.get("f", F.lit(2)).startswith("<"), F.get("f", F.lit(2))).otherwise(T.iri_column(PREFIXES["wd"], F.get("f", F.lit(2))))
    rows = line.select(number(0).alias("revision_id"), F.when(number(1) >= 0, number(1)).alias("parent_id"), topic.alias("topic"), number(3).alias("ts_sec"), F.get("f", F.lit(4)).alias("contributor"), F.lit(None).cast("string").alias("comment"))
    return rows.where("revision_id is not null")


def read_triples(spark: SparkSession, path: str, *, direct_only: bool = False, merge: bool = True) -> DataFrame:
    """Columns of a line: subject, predicate, object and the bounds of its ranges -> (s, p, o, rev_start, rev_end).

    direct_only: only labels, descriptions, redirects, sitelinks and direct
    claims.  merge: ranges of a triple that occurs on several lines are united."""
    fields = F.split(F.col("value"), "\t", -1)
    line = spark.read.text(path).select(fields.alias("f")).where(F.size("f") >= 4)
    line = line.select(F.get("f", F.lit(0)).alias("s"), F.get("f", F.lit(1)).alias("p"), T.canonical_column(F.get("f", F.lit(2))).alias("o"), F.transform(F.split(F.trim(F.get("f", F.lit(3))), " "), lambda x: x.try_cast("bigint")).alias("ranges"))
    if direct_only:
        line = line.where(F.col("p").isin(_ALWAYS) | F.col("p").startswith(_DIRECT))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("ranges") / 2).cast("int") - 1), lambda i: F.struct(F.get("ranges", 2 * i).alias("rev_start"), F.get("ranges", 2 * i + 1).alias("rev_end")))
    rows = line.where(F.size("ranges") >= 2).select("s", "p", "o", F.inline(pairs)).where("rev_start < rev_end")
    return intervals.union(rows) if merge else rows


def revision_lines(revisions: DataFrame) -> DataFrame:
    """(value) lines as read_revisions reads them; the entity by its local name, the comment escaped."""
    entity = F.regexp_replace("topic", r"^<(?:.*/)?([^/>]*)>$", "$1")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return revisions.select(F.concat_ws("\t", "revision_id", F.coalesce("parent_id", F.lit(-1)), entity, "ts_sec", text("contributor"), F.coalesce(T.escape_column(F.col("comment")), F.lit(""))).alias("value"))


def triple_lines(triples: DataFrame) -> DataFrame:
    """(value) lines as read_triples reads them, one for each triple."""
    ranges = F.array_join(F.transform("ranges", lambda x: x.cast("string")), " ")
    return intervals.collect_ranges(triples).select(F.concat_ws("\t", "s", "p", "o", ranges).alias("value"))


def write_lines(lines: DataFrame, path: str, *, compression: str = "gzip") -> None:
    lines.write.mode("overwrite").option("compression", compression).text(path)


def ntriples(triples: DataFrame) -> DataFrame:
    """(value) lines of N-Triples from (s, p, o)."""
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))
