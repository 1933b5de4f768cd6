"""Relational tables read as histories: each is a store of triples and revisions.

`edits`: a user's event is a revision of the user's page, on which it leaves
its type, its value's band and the tens of its property.  `orders`: an order is
a revision of the customer's page.  `facts`: customers, suppliers, nations and
regions as triples that always held.  `texts`: documents as literals with a
language.  `talk`: turns are revisions of their conversation, lines its content.

The SQL of the same tables stands beside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import terms as T
from .operators import intervals
from .shared import parts_for
from .store import HistoryStore
from .vocabulary import MAX, REVISION, XSD

BASE = "http://example.org/"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def name(*parts: Column | str) -> Column:
    """The term of an IRI under BASE."""
    return F.concat(F.lit("<" + BASE), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit(">"))


def statement(p: str, o: Column) -> Column:
    return F.struct(name(p).alias("p"), o.alias("o"))


def seconds(c: Column) -> Column:
    return F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)


def edit_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    made = F.array(
        statement("type", T.text_literal(e.event_type)),
        statement("band", T.integer_literal(F.floor(e.value / 50))),
        statement("k", T.integer_literal(F.floor(k / 10))),
    )
    return e.select(F.col("user_id").alias("page"), F.col("event_id").alias("rev"), name("u/", e.user_id).alias("s"), F.inline(made)).where("o is not null")


def edits(spark: SparkSession, sf_dir: str) -> HistoryStore:
    e = read(spark, sf_dir, "events")
    axis = e.select(F.col("user_id").alias("page"), F.col("event_id").alias("rev"))
    parent = F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    revisions = e.select(e.event_id.alias("revision_id"), parent.alias("parent_id"), name("u/", e.user_id).alias("topic"), seconds(e.ts).alias("ts_sec"), e.event_type.alias("contributor"), F.lit(None).cast("string").alias("comment"))
    # The subject follows from the page, so it isn't shuffled.
    found = intervals.build(edit_statements(spark, sf_dir).drop("s"), axis, ("page", "p", "o"))
    return HistoryStore(spark, found.select(name("u/", F.col("page")).alias("s"), "p", "o", "rev_start", "rev_end"), revisions)


def orders(spark: SparkSession, sf_dir: str) -> HistoryStore:
    o, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    own = o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("rev"), F.inline(F.array(statement("status", T.text_literal(o.o_orderstatus)))))
    bought = items.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = bought.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("rev"), F.inline(F.array(statement("supplier", name("s/", F.col("l_suppkey"))))))
    parent = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    revisions = o.select(o.o_orderkey.alias("revision_id"), parent.alias("parent_id"), name("c/", o.o_custkey).alias("topic"), seconds(o.o_orderdate).alias("ts_sec"), o.o_orderpriority.alias("contributor"), F.lit(None).cast("string").alias("comment"))
    axis = o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("rev"))
    found = intervals.build(own.unionByName(bought), axis, ("page", "p", "o"))
    return HistoryStore(spark, found.select(name("c/", F.col("page")).alias("s"), "p", "o", "rev_start", "rev_end"), revisions)


def _always(df: DataFrame) -> DataFrame:
    return df.where("s is not null and o is not null").select("s", "p", "o", F.lit(0).cast("bigint").alias("rev_start"), F.lit(MAX).alias("rev_end"))


def facts(spark: SparkSession, sf_dir: str) -> HistoryStore:
    c, s, n, r = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    c = c.repartition(parts_for(c, 1 << 20))  # a file is read by as many tasks as it has row groups, however much is made of a row
    amount = lambda x: T.typed_literal(F.format_string("%.2f", x), XSD + "decimal")
    parts = [
        c.select(name("c/", c.c_custkey).alias("s"), F.inline(F.array(statement("in", name("n/", c.c_nationkey)), statement("name", T.text_literal(c.c_name)), statement("segment", T.text_literal(c.c_mktsegment)), statement("balance", amount(c.c_acctbal))))),
        s.select(name("s/", s.s_suppkey).alias("s"), F.inline(F.array(statement("in", name("n/", s.s_nationkey)), statement("name", T.text_literal(s.s_name)), statement("sells", amount(s.s_acctbal))))),
        n.select(name("n/", n.n_nationkey).alias("s"), F.inline(F.array(statement("part", name("r/", n.n_regionkey)), statement("name", T.text_literal(n.n_name))))),
        r.select(name("r/", r.r_regionkey).alias("s"), F.inline(F.array(statement("name", T.text_literal(r.r_name))))),
    ]
    all_ = parts[0]
    for x in parts[1:]:
        all_ = all_.unionByName(x)
    return HistoryStore(spark, _always(all_))


def texts(spark: SparkSession, sf_dir: str) -> HistoryStore:
    d = read(spark, sf_dir, "documents")
    made = d.select(name("d/", d.doc_id).alias("s"), F.inline(F.array(statement("text", T.lang_literal(d.text, d.lang)), statement("source", T.text_literal(d.source)), statement("chars", T.integer_literal(d.n_chars)))))
    return HistoryStore(spark, _always(made))


def talk(spark: SparkSession, sf_dir: str) -> HistoryStore:
    c = read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    rows = c.select(F.col("conv_id").alias("page"), (F.col("conv_id") * 1000 + F.col("turn")).alias("rev"), "role", "text")
    lines = rows.select("page", "rev", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    st = lines.select("page", "rev", name("v/", F.col("page")).alias("s"), name("line").alias("p"), T.text_literal(F.col("line")).alias("o"))
    revisions = rows.select(F.col("rev").alias("revision_id"), F.lit(None).cast("bigint").alias("parent_id"), name("v/", F.col("page")).alias("topic"), F.lit(None).cast("bigint").alias("ts_sec"), F.col("role").alias("contributor"), F.lit(None).cast("string").alias("comment"))
    return HistoryStore(spark, intervals.build(st, rows.select("page", "rev")), revisions)


# -- the same in SQL: st (page, rev, s, p, o) and rv (revision_id, parent_id, topic, ts_sec, contributor) give ti and q

_INTERVALS = f"""
ax AS (SELECT page, rev, row_number() OVER (PARTITION BY page ORDER BY rev) AS n, coalesce(lead(rev) OVER (PARTITION BY page ORDER BY rev), {MAX}) AS nxt FROM axis),
isl AS (SELECT s, p, o, st.page, st.rev, nxt, n - row_number() OVER (PARTITION BY st.page, s, p, o ORDER BY n) AS g FROM (SELECT DISTINCT * FROM st) st JOIN ax ON st.page = ax.page AND st.rev = ax.rev),
ti AS (SELECT s, p, o, min(rev) AS rev_start, max(nxt) AS rev_end FROM isl GROUP BY page, s, p, o, g),
q AS (SELECT s, p, o, '{REVISION}additions/' || rev_start AS g FROM ti UNION ALL SELECT s, p, o, '{REVISION}deletions/' || rev_end FROM ti WHERE rev_end < {MAX})
"""

EDITS = f"""
axis AS (SELECT user_id AS page, event_id AS rev FROM events),
st AS (SELECT user_id AS page, event_id AS rev, '{BASE}u/' || user_id AS s, '{BASE}' || unnest(['type', 'band', 'k']) AS p,
  unnest([event_type, floor(value / 50)::BIGINT::VARCHAR, floor((props->>'$.k')::BIGINT / 10)::BIGINT::VARCHAR]) AS o FROM events),
rv AS (SELECT event_id AS revision_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_id, '{BASE}u/' || user_id AS topic, epoch_us(ts) // 1000000 AS ts_sec, event_type AS contributor FROM events),
{_INTERVALS}"""

ORDERS = f"""
axis AS (SELECT o_custkey AS page, o_orderkey AS rev FROM orders),
st AS (SELECT o_custkey AS page, o_orderkey AS rev, '{BASE}c/' || o_custkey AS s, '{BASE}status' AS p, o_orderstatus AS o FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, '{BASE}c/' || o_custkey, '{BASE}supplier', '{BASE}s/' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rv AS (SELECT o_orderkey AS revision_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent_id, '{BASE}c/' || o_custkey AS topic, epoch_us(o_orderdate) // 1000000 AS ts_sec, o_orderpriority AS contributor FROM orders),
{_INTERVALS}"""

FACTS = f"""
t AS (
  SELECT '{BASE}c/' || c_custkey AS s, '{BASE}' || unnest(['in', 'name', 'segment', 'balance']) AS p, unnest(['{BASE}n/' || c_nationkey, c_name, c_mktsegment, printf('%.2f', c_acctbal)]) AS o FROM customer
  UNION ALL SELECT '{BASE}s/' || s_suppkey, '{BASE}' || unnest(['in', 'name', 'sells']), unnest(['{BASE}n/' || s_nationkey, s_name, printf('%.2f', s_acctbal)]) FROM supplier
  UNION ALL SELECT '{BASE}n/' || n_nationkey, '{BASE}' || unnest(['part', 'name']), unnest(['{BASE}r/' || n_regionkey, n_name]) FROM nation
  UNION ALL SELECT '{BASE}r/' || r_regionkey, '{BASE}name', r_name FROM region)
"""

TALK = f"""
axis AS (SELECT conv_id AS page, conv_id * 1000 + turn AS rev FROM conversations),
st AS (SELECT conv_id AS page, conv_id * 1000 + turn AS rev, '{BASE}v/' || conv_id AS s, '{BASE}line' AS p, unnest(string_split(text, chr(10))) AS o FROM conversations),
rv AS (SELECT conv_id * 1000 + turn AS revision_id, NULL::BIGINT AS parent_id, '{BASE}v/' || conv_id AS topic, NULL::BIGINT AS ts_sec, role AS contributor FROM conversations),
{_INTERVALS.replace("SELECT DISTINCT * FROM st", "SELECT DISTINCT * FROM st WHERE o <> ''")}"""
