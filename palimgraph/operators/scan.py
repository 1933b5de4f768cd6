"""Triple-pattern scans in the contexts of a history.

Filters are on plain columns, so they reach the Parquet scan; of a table's
sorted copies the one is read whose row groups a pattern's constants prune."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..vocabulary import MAX, SNAPSHOTS, snapshot


@dataclass
class Tables:
    """The same triples in several orders: by (p, s, o), by (s, p, o), by (o, p, s), by rev_start and by rev_end.  Only the first must be there."""

    triples: DataFrame
    by_subject: DataFrame | None = None
    by_object: DataFrame | None = None
    by_start: DataFrame | None = None
    by_end: DataFrame | None = None

    def of(self, s: str | None = None, p: str | None = None, o: str | None = None, kind: str | None = None) -> DataFrame:
        """The copy to read for a pattern with these constants; kind: of the context, where it is one revision's."""
        found = None
        if kind in ("A", "D"):
            found = self.by_start if kind == "A" else self.by_end
        elif s is not None and p is None:
            found = self.by_subject
        elif s is None and o is not None:
            found = self.by_object
        return self.triples if found is None else found


def where_terms(df: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    for column, value in (("p", p), ("s", s), ("o", o)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def state_at(triples: DataFrame, revision: int | Column) -> DataFrame:
    r = revision if isinstance(revision, Column) else F.lit(revision).cast("bigint")
    return triples.where((F.col("rev_start") <= r) & (F.col("rev_end") > r))


def additions_at(triples: DataFrame, revision: int) -> DataFrame:
    return triples.where(F.col("rev_start") == F.lit(revision).cast("bigint"))


def deletions_at(triples: DataFrame, revision: int) -> DataFrame:
    r = F.lit(revision).cast("bigint")
    return triples.where((F.col("rev_end") == r) & (r < MAX))


def in_context(tables: Tables, context: str, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Quads (s, p, o, g) of one named graph; none where it isn't a state, additions or deletions of a revision."""
    at = snapshot(context)
    of = {"G": state_at, "A": additions_at, "D": deletions_at}
    triples = where_terms(tables.of(s, p, o, at and at[0]), s, p, o)
    found = of[at[0]](triples, at[1]) if at and at[0] in of else triples.where(F.lit(False))
    return found.select("s", "p", "o", F.lit(context).alias("g"))


def boundary_quads(triples: DataFrame) -> DataFrame:
    """Quads of all additions and deletions: a row for each bound of each interval."""
    bounds = F.array(
        F.struct(F.lit("A").alias("kind"), F.col("rev_start").alias("rev")),
        F.struct(F.lit("D").alias("kind"), F.col("rev_end").alias("rev")),
    )
    rows = triples.select("s", "p", "o", F.inline(bounds)).where(~((F.col("kind") == "D") & (F.col("rev") == MAX)))
    g = F.when(F.col("kind") == "A", T.iri_column(SNAPSHOTS["A"], F.col("rev"))).otherwise(T.iri_column(SNAPSHOTS["D"], F.col("rev")))
    return rows.select("s", "p", "o", g.alias("g"))


def quads(tables: Tables, revisions: DataFrame | None, s: str | None = None, p: str | None = None, o: str | None = None, contexts: tuple[str, ...] = ()) -> DataFrame:
    """The statements of a pattern (s, p, o, g).

    Without contexts: a revision attribute's statements where p is one,
    those together with all additions and deletions where p is open, else
    additions and deletions.  With contexts: the bag union of theirs."""
    from . import magic

    if contexts:
        return reduce(DataFrame.unionByName, [in_context(tables, c, s, p, o) for c in contexts])
    if p in magic.PREDICATES:
        return magic.statements(revisions, p, s, o).withColumn("g", F.lit(None).cast("string"))
    found = boundary_quads(where_terms(tables.of(s, p, o), s, p, o))
    if p is None and revisions is not None:
        for name in magic.PREDICATES:
            found = found.unionByName(magic.statements(revisions, name, s, o).withColumn("g", F.lit(None).cast("string")))
    return found
