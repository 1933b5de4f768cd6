"""Revision attributes as statements (s, p, o) over the table of revisions.

A side that is given and only needs arithmetic is answered without a scan,
whether or not the revision exists, as the endpoints that users know do."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..vocabulary import SNAPSHOTS, XSD, iri, snapshot

_GRAPHS = {iri("hist:globalState"): "G", iri("hist:additions"): "A", iri("hist:deletions"): "D"}
REVISION_ID, PREVIOUS, NEXT = iri("hist:revisionId"), iri("hist:previousRevision"), iri("hist:nextRevision")
ABOUT, DATE, PARENT, AUTHOR, STATE_AT = iri("schema:about"), iri("schema:dateCreated"), iri("schema:isBasedOn"), iri("schema:author"), iri("hist:globalStateAt")
PREDICATES = (*_GRAPHS, REVISION_ID, PREVIOUS, NEXT, ABOUT, DATE, PARENT, AUTHOR, STATE_AT)
#: What kind of revision IRI the objects (or, of globalStateAt, subjects) are.
OBJECT_KIND = _GRAPHS | {PREVIOUS: "N", NEXT: "N", PARENT: "N"}


def _rows(revisions: DataFrame, p: str, rows: list[tuple[str, str]]) -> DataFrame:
    spark = revisions.sparkSession
    return spark.createDataFrame([(s, p, o) for s, o in rows], "s string, p string, o string")


def _number(term: str) -> int | None:
    end = f'"^^<{XSD}integer>'
    return int(term[1 : -len(end)]) if term.endswith(end) and term[1 : -len(end)].lstrip("+-").isdigit() else None


def _computed(p: str, s: str | None, o: str | None) -> list[tuple[str, str]] | None:
    """Answers of arithmetic attributes with a given side; None if revisions must be read."""
    subject, object_ = s and snapshot(s), o and snapshot(o)
    if s is not None and not subject:
        return []
    if p in _GRAPHS:
        made = f"<{SNAPSHOTS[_GRAPHS[p]]}{subject[1]}>" if subject else o
        if s is None:
            s = f"<{SNAPSHOTS['N']}{object_[1]}>" if object_ and object_[0] == _GRAPHS[p] else None
    elif p == REVISION_ID:
        made = f'"{subject[1]}"^^<{XSD}integer>' if subject else o
        if s is None:
            s = f"<{SNAPSHOTS['N']}{n}>" if (n := _number(o)) is not None else None
    else:
        step = -1 if p == PREVIOUS else 1
        made = f"<{SNAPSHOTS[subject[0]]}{subject[1] + step}>" if subject else o
        if s is None:
            s = f"<{SNAPSHOTS[object_[0]]}{object_[1] - step}>" if object_ else None
    return [(s, made)] if s is not None and (o is None or o == made) else []


#: Attributes that follow from a side that is given, and such as are columns of the revisions.
ARITHMETIC, STORED = (*_GRAPHS, REVISION_ID, PREVIOUS, NEXT), (ABOUT, DATE, PARENT, AUTHOR)


def object_of(p: str, s: Column) -> Column:
    """The object of an arithmetic attribute of the subjects in a column, existing revisions or not; null of other terms."""
    revision = T.snapshot_revision(s)
    if p in _GRAPHS:
        return T.iri_column(SNAPSHOTS[_GRAPHS[p]], revision)
    if p == REVISION_ID:
        return T.integer_literal(revision)
    return _moved(s, revision + (-1 if p == PREVIOUS else 1))


def subject_of(p: str, o: Column) -> Column:
    """The same the other way round."""
    if p in _GRAPHS:
        return F.when(o.startswith("<" + SNAPSHOTS[_GRAPHS[p]]), T.iri_column(SNAPSHOTS["N"], T.snapshot_revision(o)))
    if p == REVISION_ID:
        return F.when(T.is_datatype(o, "integer"), T.iri_column(SNAPSHOTS["N"], T.lexical(o).try_cast("bigint")))
    return _moved(o, T.snapshot_revision(o) + (1 if p == PREVIOUS else -1))


def _moved(term: Column, revision: Column) -> Column:
    """A revision IRI of the term's kind."""
    return F.concat(F.regexp_extract(term, "^(<.*?)-?[0-9]+>$", 1), revision.cast("string"), F.lit(">"))


#: The columns of revisions that stored attributes are made of; an attribute is there where its column is.
COLUMN = {ABOUT: "topic", DATE: "ts_sec", PARENT: "parent_id", AUTHOR: "contributor"}


def attribute(p: str) -> Column:
    """The object column of an attribute, over the columns of revisions."""
    revision = F.col("revision_id")
    if p in _GRAPHS:
        return T.iri_column(SNAPSHOTS[_GRAPHS[p]], revision)
    return {
        REVISION_ID: lambda: T.integer_literal(revision),
        PREVIOUS: lambda: T.iri_column(SNAPSHOTS["N"], revision - 1),
        NEXT: lambda: T.iri_column(SNAPSHOTS["N"], revision + 1),
        ABOUT: lambda: F.col("topic"),
        DATE: lambda: T.date_literal(F.col("ts_sec")),
        PARENT: lambda: T.iri_column(SNAPSHOTS["N"], F.col("parent_id")),
        AUTHOR: lambda: T.text_literal(F.col("contributor")),
    }[p]()


def seconds_of(date: str) -> int | None:
    """Seconds since 1970 of a dateTime literal; None of another term or one without a zone."""
    text = date.split('"')[1].lstrip("+") if date.endswith(f'"^^<{XSD}dateTime>') else ""
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return math.floor(at.timestamp()) if at.tzinfo else None


def states_at_dates(revisions: DataFrame, dates: DataFrame, date: str) -> DataFrame:
    """(o, s): for each different term in a column of dateTimes the state of the least revision of just that second."""
    asked = dates.select(F.col(date).alias("o")).distinct().withColumn("_sec", T.date_seconds(F.col("o"))).where("_sec is not null")
    found = asked.join(revisions.select("ts_sec", "revision_id"), F.col("_sec") == F.col("ts_sec")).groupBy("o").agg(F.min("revision_id").alias("r"))
    return found.select("o", T.iri_column(SNAPSHOTS["G"], F.col("r")).alias("s"))


def with_object(revisions: DataFrame, p: str, o: str) -> DataFrame:
    """Revisions whose stored attribute is that term; the filter is on the stored column, for pushdown.  A date is an instant, however spelled."""
    at = snapshot(o)
    if p == DATE:
        seconds = seconds_of(o)
        return revisions.where(F.lit(False)) if seconds is None else revisions.where(F.col("ts_sec") == F.lit(seconds).cast("bigint"))
    if p == ABOUT:
        return revisions.where(F.col("topic") == o)
    if p == PARENT:
        return revisions.where(F.col("parent_id") == at[1]) if at and at[0] == "N" else revisions.where(F.lit(False))
    return revisions.where(F.col("contributor") == T.lexical(F.lit(o))) if o.endswith('"') else revisions.where(F.lit(False))


def state_at_date(revisions: DataFrame, date: str, mode: str = "exact") -> DataFrame:
    """(revision_id): the least revision of just that second, or (mode 'asof') the last one up to it."""
    seconds = seconds_of(date)
    if seconds is None:
        return revisions.select("revision_id").where(F.lit(False))
    if mode == "asof":
        found = revisions.where(F.col("ts_sec") <= seconds).agg(F.max(F.struct("ts_sec", "revision_id")).getField("revision_id").alias("revision_id"))
    else:
        found = revisions.where(F.col("ts_sec") == seconds).agg(F.min("revision_id").alias("revision_id"))
    return found.where("revision_id is not null")


def statements(revisions: DataFrame, p: str, s: str | None = None, o: str | None = None, mode: str = "exact") -> DataFrame:
    if p == STATE_AT:
        if o is None or not o.endswith(f'"^^<{XSD}dateTime>'):
            return _rows(revisions, p, [])
        found = state_at_date(revisions, o, mode).select(T.iri_column(SNAPSHOTS["G"], F.col("revision_id")).alias("s"), F.lit(p).alias("p"), F.lit(o).alias("o"))
        return found if s is None else found.where(F.col("s") == s)
    if p in _GRAPHS or p in (REVISION_ID, PREVIOUS, NEXT):
        if s is not None or o is not None:
            return _rows(revisions, p, _computed(p, s, o))
        rows = revisions
    else:
        rows = revisions
        if s is not None:
            at = snapshot(s)
            rows = rows.where(F.col("revision_id") == at[1]) if at else rows.where(F.lit(False))
    subject = T.iri_column(SNAPSHOTS["N"], F.col("revision_id")) if s is None else F.lit(s)
    if o is not None:
        rows = with_object(rows, p, o)
    return rows.select(subject.alias("s"), F.lit(p).alias("p"), (attribute(p) if o is None else F.lit(o)).alias("o")).where("o is not null")
