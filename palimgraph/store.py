"""A history: its tables, pattern scans and queries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as T
from .operators import scan
from .plans.algebra import Pattern, Query, Var
from .plans.compile import Compiler
from .plans.parser import UnsupportedQuery, parse
from .shared import parts_for
from .vocabulary import REVISIONS, TRIPLES


#: Sorted copies of the triples, by folder.
ORDERS = {"triples": ["p", "s", "o", "rev_start"], "by_subject": ["s", "p", "o", "rev_start"], "by_object": ["o", "p", "s", "rev_start"], "by_start": ["rev_start", "p", "s", "o"], "by_end": ["rev_end", "p", "s", "o"]}
#: Columns of revisions that are looked up but not sorted by.
LOOKED_UP = ("topic", "contributor", "parent_id", "ts_sec")


class HistoryStore:
    """Triples with the intervals in which they hold, and revisions.

    triples: (s, p, o, rev_start, rev_end), terms in canonical form;
    revisions: (revision_id, parent_id, topic, ts_sec, contributor, comment).
    services: stores that SERVICE may name, by term; orders: sorted copies of
    the triples, by their names in ORDERS."""

    def __init__(self, spark: SparkSession, triples: DataFrame | None = None, revisions: DataFrame | None = None, services: dict[str, HistoryStore] | None = None, orders: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.triples = triples if triples is not None else spark.createDataFrame([], TRIPLES)
        self.revisions = revisions if revisions is not None else spark.createDataFrame([], REVISIONS)
        self.services = services or {}
        self.tables = scan.Tables(self.triples, **(orders or {}))
        self._bits: int | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: Any) -> HistoryStore:
        """A saved store; the copies that were saved with it are used."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        there = {f.getPath().getName() for f in files.listStatus(at)}
        orders = {n: spark.read.parquet(f"{path}/{n}") for n in ORDERS if n != "triples" and n in there}
        return cls(spark, spark.read.parquet(f"{path}/triples"), spark.read.parquet(f"{path}/revisions"), orders=orders, **options)

    def save(self, path: str, partitions: int | None = None, orders: tuple[str, ...] = tuple(ORDERS)) -> None:
        """Copies sorted in ranges, so that row-group statistics prune a scan by any prefix of an order.
        Revisions are sorted by number, which follows the time; Bloom filters tell where the values of other columns aren't.
        The triples are made once, and each copy is sorted from what was written of them; without partitions there are as many as their size asks for."""
        unsorted = f"{path}/_unsorted"
        self.triples.write.mode("overwrite").option("compression", "zstd").parquet(unsorted)
        made = self.spark.read.parquet(unsorted)
        many = [partitions or parts_for(made, least=8)]
        for name in dict.fromkeys(("triples", *orders)):
            keys = ORDERS[name]
            ranged = made.repartitionByRange(*many, *keys[:3])
            ranged.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(unsorted)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        ids = self.revisions.repartitionByRange(*many, "revision_id").sortWithinPartitions("revision_id").write.mode("overwrite").option("compression", "zstd")
        for c in LOOKED_UP:
            ids = ids.option(f"parquet.bloom.filter.enabled#{c}", "true")
        ids.parquet(f"{path}/revisions")

    def revision_bits(self) -> int:
        """Binary digits of the last revision number, for temporal joins."""
        if self._bits is None:
            bounds = self.triples.agg(F.max("rev_start").alias("m")).unionByName(self.revisions.agg(F.max("revision_id").alias("m"))).agg(F.max("m")).first()[0]
            self._bits = max(1, int(bounds or 0).bit_length() + 1)
        return self._bits

    # -- patterns

    def quads(self, s: str | None = None, p: str | None = None, o: str | None = None, contexts: tuple[str, ...] = ()) -> DataFrame:
        return scan.quads(self.tables, self.revisions, s, p, o, contexts)

    def has_statement(self, s: str | None = None, p: str | None = None, o: str | None = None, contexts: tuple[str, ...] = ()) -> bool:
        return not self.quads(s, p, o, contexts).isEmpty()

    def at(self, revision: int) -> DataFrame:
        return scan.state_at(self.triples, revision)

    def additions(self, revision: int) -> DataFrame:
        return scan.additions_at(self.tables.of(kind="A"), revision)

    def deletions(self, revision: int) -> DataFrame:
        return scan.deletions_at(self.tables.of(kind="D"), revision)

    # -- queries

    def sparql(self, text: str) -> DataFrame:
        """SELECT: a column for each variable; ASK: one row (result boolean);
        CONSTRUCT and DESCRIBE: distinct triples (s, p, o)."""
        q = parse(text)
        return {"SELECT": self.select, "ASK": self.ask, "CONSTRUCT": self.construct, "DESCRIBE": self.describe}[q.form](q)

    def _rows(self, q: Query) -> tuple[Any, list[str]]:
        return Compiler(self, self.services).query(q)

    def select(self, q: Query) -> DataFrame:
        rel, names = self._rows(q)
        return rel.df.select(*[F.col(rel.cols[n]).alias(n) for n in names])

    def ask(self, q: Query) -> DataFrame:
        rel, _ = self._rows(q)
        return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))

    def construct(self, q: Query) -> DataFrame:
        rel, _ = self._rows(q)
        rel.df = rel.df.withColumn("_row", F.monotonically_increasing_id()) if any(self._is_blank(x) for t in q.template for x in (t.s, t.o)) else rel.df
        return self._triples([F.struct(*[self._side(rel, x).alias(n) for x, n in ((t.s, "s"), (t.p, "p"), (t.o, "o"))]) for t in q.template], rel.df)

    @staticmethod
    def _is_blank(x: Any) -> bool:
        return isinstance(x, Var) and x.name.startswith(".")

    def _side(self, rel: Any, x: Any) -> Any:
        if isinstance(x, str):
            return F.lit(x)
        if self._is_blank(x) and x.name not in rel.cols:  # a new blank node for each solution
            return F.concat(F.lit(f"_:c{x.name.strip('._:')}x"), F.col("_row").cast("string"))
        c = rel.column(x.name)
        return F.lit(None).cast("string") if c is None else c

    @staticmethod
    def _triples(structs: list[Any], df: DataFrame) -> DataFrame:
        made = df.select(F.inline(F.array(*structs))) if structs else df.select(*[F.lit(None).cast("string").alias(c) for c in "spo"])
        return made.where(made.s.isNotNull() & made.p.startswith("<") & made.o.isNotNull() & ~made.s.startswith('"')).distinct()

    def describe(self, q: Query) -> DataFrame:
        """The statements with a resource as subject or object."""
        names = [x.name for x in q.describe if isinstance(x, Var)]
        terms = self.spark.createDataFrame([(x,) for x in q.describe if isinstance(x, str)], "t string")
        if names or not q.describe:
            rel, all_ = self._rows(Query("SELECT", where=q.where))
            for n in names or all_:
                if n in rel.cols:
                    terms = terms.unionByName(rel.df.select(F.col(rel.cols[n]).alias("t")))
        terms = terms.where("t is not null").distinct()
        quads = self.quads().select("s", "p", "o")
        return quads.join(terms, F.col("s") == F.col("t"), "left_semi").unionByName(quads.join(terms, F.col("o") == F.col("t"), "left_semi")).distinct()


def plain(df: DataFrame) -> DataFrame:
    """The same rows with texts and addresses in place of terms."""
    return df.select(*[(T.plain(F.col(c)) if t == "string" else F.col(c)).alias(c) for c, t in df.dtypes])


__all__ = ["HistoryStore", "Pattern", "UnsupportedQuery", "parse", "plain"]
