"""The registered queries of the graph engine and their SQL.

Each works over whole tables.  A limit stands only in a top-k query."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import histories as H
from .operators import intervals, temporal_join
from .shared import use_shared_folder
from .sources import entities, tables
from .store import HistoryStore, plain
from .vocabulary import REVISION, TYPE, XSD

Query = Callable[[SparkSession, str], DataFrame]
_STORES = {"edits": (H.edits, H.EDITS), "orders": (H.orders, H.ORDERS), "facts": (H.facts, H.FACTS), "texts": (H.texts, ""), "talk": (H.talk, H.TALK)}
_PROLOGUE = f"PREFIX e: <{H.BASE}>\nPREFIX rev: <{REVISION}>\n"
_E, _R = H.BASE, REVISION
_ALL: dict[str, tuple[Query, str | None]] = {}


def _cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    df = plain(df)
    return df.select(*[(F.col(c).cast(types[c]) if c in types else F.col(c)).alias(c) for c in df.columns])


def _sql(store: str, sql: str | None) -> str | None:
    if sql is None:
        return None
    common = _STORES[store][1]
    return f"WITH {common} {sql}" if common else sql


def _sparql(name: str, store: str, text: str, sql: str | None, **types: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cast(_STORES[store][0](spark, sf_dir).sparql(_PROLOGUE + text), types)

    _ALL[name] = run, _sql(store, sql)


def _frame(name: str, store: str, make: Callable[[HistoryStore], DataFrame], sql: str | None, **types: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cast(make(_STORES[store][0](spark, sf_dir)), types)

    _ALL[name] = run, _sql(store, sql)


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s is not None}


# -- intervals


def _holding(revisions: DataFrame, triples: DataFrame) -> DataFrame:
    """(revision_id, n): a revision's number of rows times how many triples hold at it."""
    times = revisions.groupBy("revision_id").agg(F.count("*").alias("times"))
    return temporal_join.counts(times, triples, "revision_id").join(times, "revision_id").select("revision_id", (F.col("n") * F.col("times")).alias("n"))


_TI = ["s", "p", "o", "rev_start", "rev_end"]
_frame("interval_build", "edits", lambda h: h.triples.select(*_TI), "SELECT s, p, o, rev_start, rev_end FROM ti")
_frame("interval_build_orders", "orders", lambda h: h.triples.select(*_TI), "SELECT s, p, o, rev_start, rev_end FROM ti")
_frame("interval_build_lines", "talk", lambda h: h.triples.select(*_TI), "SELECT s, p, o, rev_start, rev_end FROM ti")
_frame(
    "interval_union", "edits",
    lambda h: intervals.union(h.triples.select("s", F.lit("<x:any>").alias("p"), F.lit('"any"').alias("o"), "rev_start", "rev_end")),
    """, iv AS (SELECT s AS k, rev_start AS a, rev_end AS b FROM ti),
    m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM iv),
    f AS (SELECT *, sum(CASE WHEN pm >= a THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM m)
    SELECT k AS s, 'x:any' AS p, 'any' AS o, min(a) AS rev_start, max(b) AS rev_end FROM f GROUP BY k, grp""",
)
_frame(
    "interval_ranges", "edits", lambda h: intervals.collect_ranges(h.triples).select("s", "p", "o", F.array_join(F.transform("ranges", lambda x: x.cast("string")), " ").alias("ranges")),
    "SELECT s, p, o, string_agg(rev_start || ' ' || rev_end, ' ' ORDER BY rev_start) AS ranges FROM ti GROUP BY s, p, o",
)
_frame("ranges_unsorted", "edits", lambda h: intervals.unsorted_ranges(intervals.collect_ranges(h.triples)).select("s", "p", "o"), "SELECT s, p, o FROM ti WHERE rev_start >= rev_end")
_frame(
    "state_count_over_time", "edits", lambda h: intervals.state_counts(h.triples, h.revisions),
    """, d AS (SELECT rev_start AS rev, 1 AS d FROM ti UNION ALL SELECT rev_end, -1 FROM ti WHERE rev_end < 9223372036854775807 UNION ALL SELECT revision_id, 0 FROM rv)
    SELECT rev AS revision_id, (sum(sum(d)) OVER (ORDER BY rev))::BIGINT AS n FROM d GROUP BY rev""",
)
_frame(
    "state_count_over_time_orders", "orders", lambda h: intervals.state_counts(h.triples, h.revisions),
    """, d AS (SELECT rev_start AS rev, 1 AS d FROM ti UNION ALL SELECT rev_end, -1 FROM ti WHERE rev_end < 9223372036854775807 UNION ALL SELECT revision_id, 0 FROM rv)
    SELECT rev AS revision_id, (sum(sum(d)) OVER (ORDER BY rev))::BIGINT AS n FROM d GROUP BY rev""",
)
_frame(
    "revision_axis_gaps", "talk", lambda h: _holding(h.revisions, h.triples),
    "SELECT revision_id, count(*) AS n FROM rv JOIN ti ON rev_start <= revision_id AND revision_id < rev_end GROUP BY 1",
)

# -- pattern scans

_U, _TYPE_P, _CLICK = f"<{_E}u/7>", f"<{_E}type>", '"click"'
_MAGIC_SQL = ", ".join([
    f"""mg AS (SELECT '{_R}' || revision_id AS s, unnest(['hist:globalState', 'hist:additions', 'hist:deletions', 'hist:revisionId', 'hist:previousRevision', 'hist:nextRevision', 'schema:about', 'schema:dateCreated', 'schema:isBasedOn', 'schema:author']) AS n,
    unnest(['{_R}global/' || revision_id, '{_R}additions/' || revision_id, '{_R}deletions/' || revision_id, revision_id::VARCHAR, '{_R}' || (revision_id - 1), '{_R}' || (revision_id + 1), topic,
      strftime(make_timestamp(ts_sec * 1000000), '%Y-%m-%dT%H:%M:%SZ'), '{_R}' || parent_id, contributor]) AS o FROM rv)""",
    "mq AS (SELECT s, replace(replace(n, 'hist:', 'http://wikiba.se/history/ontology#'), 'schema:', 'http://schema.org/') AS p, o, NULL::VARCHAR AS g FROM mg WHERE o IS NOT NULL UNION ALL SELECT s, p, o, g FROM q)",
])
for _name, _s, _p, _o in (("all", None, None, None), ("s", _U, None, None), ("p", None, _TYPE_P, None), ("o", None, None, _CLICK), ("sp", _U, _TYPE_P, None), ("so", _U, None, _CLICK), ("po", None, _TYPE_P, _CLICK), ("spo", _U, _TYPE_P, _CLICK)):
    _where = " AND ".join(["TRUE", *(f"{c} = '{v[1:-1]}'" for c, v in (("s", _s), ("p", _p), ("o", _o)) if v)])
    _frame(f"scan_{_name}", "edits", lambda h, s=_s, p=_p, o=_o: h.quads(s, p, o), f", {_MAGIC_SQL} SELECT s, p, o, g FROM {'q' if _p else 'mq'} WHERE {_where}")
_A, _G, _D = (f"<{_R}{x}/700>" for x in ("additions", "global", "deletions"))
_frame("quads_default_graph", "edits", lambda h: h.quads(p=_TYPE_P), f"SELECT s, p, o, g FROM q WHERE p = '{_E}type'")
_frame("state_at_rev", "edits", lambda h: h.at(700).select(*_TI), "SELECT s, p, o, rev_start, rev_end FROM ti WHERE rev_start <= 700 AND rev_end > 700")
_frame("additions_at", "edits", lambda h: h.additions(700).select("s", "p", "o"), "SELECT s, p, o FROM ti WHERE rev_start = 700")
_frame("deletions_at", "edits", lambda h: h.deletions(700).select("s", "p", "o"), "SELECT s, p, o FROM ti WHERE rev_end = 700")
_frame(
    "multi_context", "edits", lambda h: h.quads(contexts=(_A, _G, _D, _G)),
    f"""SELECT s, p, o, '{_R}additions/700' AS g FROM ti WHERE rev_start = 700 UNION ALL SELECT s, p, o, '{_R}deletions/700' FROM ti WHERE rev_end = 700
    UNION ALL SELECT s, p, o, '{_R}global/700' FROM ti, range(2) WHERE rev_start <= 700 AND rev_end > 700""",
)
_frame("context_invalid", "edits", lambda h: h.quads(contexts=(f"<{_R}700>", "<http://other.example/>")), "SELECT s, p, o, g FROM q WHERE FALSE")
_sparql("context_magic_predicate", "edits", "SELECT ?s ?o { GRAPH <http://www.wikidata.org/revision/global/700> { ?s schema:about ?o } }", "SELECT s, o FROM ti WHERE FALSE")
_sparql("graph_unbound", "edits", "SELECT ?s ?g { GRAPH ?g { ?s e:type 'signup' } }", f"SELECT s, g FROM q WHERE p = '{_E}type' AND o = 'signup'")
_sparql("from_graphs", "edits", "SELECT ?s ?o FROM <http://www.wikidata.org/revision/global/700> FROM <http://www.wikidata.org/revision/additions/701> { ?s e:type ?o }", f"SELECT s, o FROM ti WHERE p = '{_E}type' AND rev_start <= 700 AND rev_end > 700 UNION ALL SELECT s, o FROM ti WHERE p = '{_E}type' AND rev_start = 701")
_sparql(
    "from_named", "edits", "SELECT ?s ?o ?g FROM NAMED <http://www.wikidata.org/revision/global/700> FROM NAMED <http://www.wikidata.org/revision/global/900> { GRAPH ?g { ?s e:band ?o } }",
    f"SELECT s, o, '{_R}global/' || r AS g FROM ti, unnest([700, 900]) AS x(r) WHERE p = '{_E}band' AND rev_start <= r AND r < rev_end", o="bigint",
)

# -- the same from a saved store, whose sorted copies are read

_SAVED: dict[tuple, str] = {}


def _saved(spark: SparkSession, sf_dir: str, store: str = "edits") -> HistoryStore:
    """The store as it is saved in the shared folder, once a session."""
    use_shared_folder(spark)
    key = spark.sparkContext.applicationId, sf_dir, store
    if key not in _SAVED:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _STORES[store][0](spark, sf_dir).save(path.toString())
        _SAVED[key] = path.toString()
    return HistoryStore.open(spark, _SAVED[key])


def _stored(name: str, make: Callable[[HistoryStore], DataFrame], sql: str, **types: str) -> None:
    _ALL[name] = (lambda spark, sf_dir: _cast(make(_saved(spark, sf_dir)), types)), _sql("edits", sql)


for _name, _s, _p, _o in (("s", _U, None, None), ("o", None, None, _CLICK), ("sp", _U, _TYPE_P, None), ("so", _U, None, _CLICK), ("po", None, _TYPE_P, _CLICK)):
    _where = " AND ".join(f"{c} = '{v[1:-1]}'" for c, v in (("s", _s), ("p", _p), ("o", _o)) if v)
    _stored(f"store_scan_{_name}", lambda h, s=_s, p=_p, o=_o: h.quads(s, p, o), f", {_MAGIC_SQL} SELECT s, p, o, g FROM {'q' if _p else 'mq'} WHERE {_where}")
_stored("store_contexts", lambda h: h.quads(contexts=(_A, _G, _D)), f"""SELECT s, p, o, '{_R}additions/700' AS g FROM ti WHERE rev_start = 700 UNION ALL SELECT s, p, o, '{_R}deletions/700' FROM ti WHERE rev_end = 700
    UNION ALL SELECT s, p, o, '{_R}global/700' FROM ti WHERE rev_start <= 700 AND rev_end > 700""")  # fmt: skip
_stored("store_additions", lambda h: h.additions(700).select("s", "p", "o"), "SELECT s, p, o FROM ti WHERE rev_start = 700")
_stored("store_deletions", lambda h: h.deletions(700).select("s", "p", "o"), "SELECT s, p, o FROM ti WHERE rev_end = 700")
_stored("store_state", lambda h: h.at(700).select(*_TI), "SELECT s, p, o, rev_start, rev_end FROM ti WHERE rev_start <= 700 AND rev_end > 700")
_stored(
    "store_state_of_topic", lambda h: h.sparql(_PROLOGUE + "SELECT ?r ?o { ?r schema:about ?s ; schema:author 'signup' ; hist:globalState ?g . GRAPH ?g { ?s e:band ?o } }"),
    f"SELECT '{_R}' || revision_id AS r, o FROM rv JOIN ti ON topic = s AND rev_start <= revision_id AND revision_id < rev_end WHERE p = '{_E}band' AND contributor = 'signup'", o="bigint",
)
_stored(
    "store_topic_at_date", lambda h: h.sparql(_PROLOGUE + f"SELECT ?r ?d {{ ?r schema:about <{_E}u/7> ; schema:dateCreated ?d }}"),
    f"SELECT '{_R}' || revision_id AS r, strftime(make_timestamp(ts_sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS d FROM rv WHERE topic = '{_E}u/7'",
)

# -- revision attributes

for _name, _p in (("global_state", "hist:globalState"), ("additions", "hist:additions"), ("deletions", "hist:deletions"), ("revision_id", "hist:revisionId"), ("prev", "hist:previousRevision"), ("next", "hist:nextRevision"), ("about", "schema:about"), ("date", "schema:dateCreated"), ("parent", "schema:isBasedOn"), ("author", "schema:author")):
    _sparql(f"magic_{_name}", "edits", f"SELECT ?r ?x {{ ?r {_p} ?x }}", f", {_MAGIC_SQL} SELECT s AS r, o AS x FROM mg WHERE n = '{_p}' AND o IS NOT NULL")
_sparql("magic_constant", "edits", "SELECT ?g ?n ?p { rev:999999999 hist:globalState ?g ; hist:revisionId ?n ; hist:previousRevision ?p }", f"SELECT '{_R}global/999999999' AS g, 999999999::BIGINT AS n, '{_R}999999998' AS p", n="bigint")
_sparql("magic_about_topic", "edits", "SELECT ?r { ?r schema:about e:u/7 }".replace("e:u/7", f"<{_E}u/7>"), f"SELECT '{_R}' || revision_id AS r FROM rv WHERE topic = '{_E}u/7'")
_sparql("magic_author_revisions", "edits", "SELECT ?r { ?r schema:author 'signup' }", f"SELECT '{_R}' || revision_id AS r FROM rv WHERE contributor = 'signup'")
_sparql("magic_children", "edits", "SELECT ?r ?c { ?r schema:about ?t . ?c schema:isBasedOn ?r }", f"SELECT '{_R}' || a.revision_id AS r, '{_R}' || b.revision_id AS c FROM rv a JOIN rv b ON b.parent_id = a.revision_id")
_DATE = '"1997-07-27T00:00:00Z"^^xsd:dateTime'
_sparql("magic_date_revisions", "orders", f"SELECT ?r {{ ?r schema:dateCreated {_DATE} }}", f"SELECT '{_R}' || revision_id AS r FROM rv WHERE ts_sec = epoch_us(TIMESTAMP '1997-07-27') // 1000000")
_sparql("magic_state_at", "orders", f"SELECT ?g {{ ?g hist:globalStateAt {_DATE} }}", f"SELECT '{_R}global/' || min(revision_id) AS g FROM rv WHERE ts_sec = epoch_us(TIMESTAMP '1997-07-27') // 1000000 HAVING count(*) > 0")


def _asof(h: HistoryStore) -> DataFrame:
    from .operators import magic

    return magic.state_at_date(h.revisions, f'"1997-07-26T13:00:00Z"^^<{XSD}dateTime>', "asof")


_frame("magic_state_asof", "orders", _asof, "SELECT max_by(revision_id, ts_sec * 1000000000 + revision_id) AS revision_id FROM rv WHERE ts_sec <= epoch_us(TIMESTAMP '1997-07-26 13:00:00') // 1000000")

_sparql(
    "magic_date_offset", "orders", """SELECT ?r { ?r schema:dateCreated '1997-07-27T02:00:00+02:00'^^xsd:dateTime }""",
    f"SELECT '{_R}' || revision_id AS r FROM rv WHERE ts_sec = epoch_us(TIMESTAMP '1997-07-27') // 1000000",
)
_sparql(
    "magic_values_unknown_revision", "edits",
    "SELECT ?r ?g ?a ?d ?n ?p ?q { VALUES ?r { rev:15 rev:999999999 <http://x.test/> } ?r hist:globalState ?g ; hist:additions ?a ; hist:deletions ?d ; hist:revisionId ?n ; hist:previousRevision ?p ; hist:nextRevision ?q }",
    f"SELECT '{_R}' || r AS r, '{_R}global/' || r AS g, '{_R}additions/' || r AS a, '{_R}deletions/' || r AS d, r AS n, '{_R}' || (r - 1) AS p, '{_R}' || (r + 1) AS q FROM unnest([15, 999999999]) AS x(r)", n="bigint",
)
_sparql(
    "magic_bound_objects", "edits", "SELECT ?n ?r ?g ?q { VALUES ?n { 7 888888888 } ?r hist:revisionId ?n . ?q hist:nextRevision ?r ; hist:globalState ?g }",
    f"SELECT n, '{_R}' || n AS r, '{_R}global/' || (n - 1) AS g, '{_R}' || (n - 1) AS q FROM unnest([7, 888888888]) AS x(n)", n="bigint",
)
_sparql(
    "state_at_joined_dates", "orders", "SELECT ?d ?g (COUNT(*) AS ?n) { { SELECT DISTINCT ?d { ?r schema:dateCreated ?d ; schema:author '1-URGENT' } } ?g hist:globalStateAt ?d . GRAPH ?g { ?c e:status 'F' } } GROUP BY ?d ?g",
    f"""SELECT strftime(make_timestamp(d * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS d, '{_R}global/' || r AS g, count(*) AS n
    FROM (SELECT ts_sec AS d, min(revision_id) AS r FROM rv WHERE ts_sec IN (SELECT ts_sec FROM rv WHERE contributor = '1-URGENT') GROUP BY 1) JOIN ti ON rev_start <= r AND r < rev_end WHERE p = '{_E}status' AND o = 'F' GROUP BY 1, 2""", n="bigint",
)
_sparql(
    "state_at_listed_dates", "orders", """SELECT ?d ?g { VALUES ?d { '1997-07-27T00:00:00Z'^^xsd:dateTime '1997-07-26T22:00:00-02:00'^^xsd:dateTime '1900-01-01T00:00:00Z'^^xsd:dateTime 'no date' } ?g hist:globalStateAt ?d }""",
    f"SELECT d, '{_R}global/' || (SELECT min(revision_id) FROM rv WHERE ts_sec = epoch_us(TIMESTAMP '1997-07-27') // 1000000) AS g FROM unnest(['1997-07-27T00:00:00Z', '1997-07-26T22:00:00-02:00']) AS x(d) WHERE g IS NOT NULL",
)
_sparql(
    "dates_joined_by_instant", "orders", "SELECT ?r ?s { ?r schema:author '1-URGENT' ; schema:dateCreated ?d . ?s schema:dateCreated ?d ; schema:author '2-HIGH' }",
    f"SELECT '{_R}' || a.revision_id AS r, '{_R}' || b.revision_id AS s FROM rv a JOIN rv b ON a.ts_sec = b.ts_sec WHERE a.contributor = '1-URGENT' AND b.contributor = '2-HIGH'",
)
_sparql(
    "attributes_of_parents", "edits", "SELECT ?r ?t ?d ?b { ?r schema:isBasedOn ?q ; schema:about ?t ; schema:dateCreated ?d ; schema:author 'click' . ?q schema:author ?b }",
    f"SELECT '{_R}' || a.revision_id AS r, a.topic AS t, strftime(make_timestamp(a.ts_sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS d, b.contributor AS b FROM rv a JOIN rv b ON a.parent_id = b.revision_id WHERE a.contributor = 'click'",
)

# -- histories in SPARQL

_sparql(
    "entities_at_date", "orders", f"SELECT (COUNT(DISTINCT ?c) AS ?n) {{ ?g hist:globalStateAt {_DATE} . GRAPH ?g {{ ?c e:status 'F' }} }}",
    f", r AS (SELECT min(revision_id) AS r FROM rv WHERE ts_sec = epoch_us(TIMESTAMP '1997-07-27') // 1000000) SELECT count(DISTINCT s) AS n FROM ti, r WHERE p = '{_E}status' AND o = 'F' AND rev_start <= r AND r < rev_end", n="bigint",
)
_sparql(
    "contributors_of_property", "orders", "SELECT ?s (COUNT(DISTINCT ?a) AS ?n) { ?r hist:additions ?g ; schema:author ?a . GRAPH ?g { ?c e:supplier ?s } } GROUP BY ?s",
    f"SELECT o AS s, count(DISTINCT contributor) AS n FROM ti JOIN rv ON rev_start = revision_id WHERE p = '{_E}supplier' GROUP BY o", n="bigint",
)
_sparql(
    "removals_by_author", "edits", "SELECT ?a (COUNT(*) AS ?n) { ?r hist:deletions ?g ; schema:author ?a . GRAPH ?g { ?s e:type ?o } } GROUP BY ?a",
    f"SELECT contributor AS a, count(*) AS n FROM ti JOIN rv ON rev_end = revision_id WHERE p = '{_E}type' GROUP BY 1", n="bigint",
)
_sparql(
    "state_join_per_revision", "edits", "SELECT ?r (COUNT(*) AS ?n) { ?r hist:globalState ?g . GRAPH ?g { ?s e:type 'click' } } GROUP BY ?r",
    f"SELECT '{_R}' || revision_id AS r, count(*) AS n FROM rv JOIN ti ON rev_start <= revision_id AND revision_id < rev_end WHERE p = '{_E}type' AND o = 'click' GROUP BY 1", n="bigint",
)
_sparql(
    "state_of_topic_per_revision", "edits", "SELECT ?r ?o { ?r schema:about ?s ; hist:globalState ?g . GRAPH ?g { ?s e:band ?o } }",
    f"SELECT '{_R}' || revision_id AS r, o FROM rv JOIN ti ON topic = s AND rev_start <= revision_id AND revision_id < rev_end WHERE p = '{_E}band'", o="bigint",
)
_sparql(
    "state_change_per_revision", "edits",
    "SELECT ?r ?s ?o { ?r schema:about ?s ; hist:globalState ?g ; hist:previousRevision ?q . ?q hist:globalState ?h . GRAPH ?g { ?s e:type ?o } MINUS { GRAPH ?h { ?s e:type ?o } } }",
    f"""SELECT '{_R}' || revision_id AS r, s, o FROM rv JOIN ti a ON topic = s AND rev_start <= revision_id AND revision_id < rev_end WHERE p = '{_E}type'
    AND NOT EXISTS (SELECT 1 FROM ti b WHERE b.s = a.s AND b.p = a.p AND b.o = a.o AND b.rev_start <= revision_id - 1 AND revision_id - 1 < b.rev_end)""",
)
_sparql(
    "edits_per_topic_and_author", "edits", "SELECT ?t ?a (COUNT(?r) AS ?n) { ?r schema:about ?t ; schema:author ?a } GROUP BY ?t ?a",
    "SELECT topic AS t, contributor AS a, count(*) AS n FROM rv GROUP BY 1, 2", n="bigint",
)
_sparql(
    "edits_per_month", "orders", "SELECT ?y ?m (COUNT(?r) AS ?n) { ?r schema:dateCreated ?d . BIND(YEAR(?d) AS ?y) BIND(MONTH(?d) AS ?m) } GROUP BY ?y ?m",
    "SELECT year(t)::BIGINT AS y, month(t)::BIGINT AS m, count(*) AS n FROM (SELECT make_timestamp(ts_sec * 1000000) AS t FROM rv) GROUP BY 1, 2", y="bigint", m="bigint", n="bigint",
)
_sparql(
    "revision_chain", "edits", "SELECT ?a (COUNT(?r) AS ?n) { ?r schema:isBasedOn+ ?a } GROUP BY ?a",
    f"SELECT '{_R}' || event_id AS a, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) - 1 AS n FROM events) WHERE n > 0", n="bigint",
)

# -- algebra, on facts

_J = lambda a, p, b: f"JOIN t {b} ON {b}.p = '{_E}{p}' AND {b}.s = {a}"
_LJ = lambda a, p, b: "LEFT " + _J(a, p, b)
_sparql(
    "bgp_join", "facts", "SELECT ?c ?nn ?rn { ?c e:segment 'BUILDING' ; e:in ?n . ?n e:name ?nn ; e:part ?r . ?r e:name ?rn }",
    f"SELECT a.s AS c, c.o AS nn, e.o AS rn FROM t a {_J('a.s', 'in', 'b')} {_J('b.o', 'name', 'c')} {_J('b.o', 'part', 'd')} {_J('d.o', 'name', 'e')} WHERE a.p = '{_E}segment' AND a.o = 'BUILDING'",
)
_sparql("same_variable", "facts", "SELECT ?s { ?s ?p ?s }", "SELECT s FROM t WHERE FALSE")
_sparql("predicate_counts", "facts", "SELECT ?p (COUNT(*) AS ?n) { GRAPH <http://www.wikidata.org/revision/global/0> { ?s ?p ?o } } GROUP BY ?p", "SELECT p, count(*) AS n FROM t GROUP BY p", n="bigint")
_sparql(
    "optional", "facts", "SELECT ?x ?n ?seg { ?x e:in ?n OPTIONAL { ?x e:segment ?seg } }",
    f"SELECT a.s AS x, a.o AS n, b.o AS seg FROM t a {_LJ('a.s', 'segment', 'b')} WHERE a.p = '{_E}in'",
)
_sparql(
    "optional_filter", "facts", "SELECT ?c ?b { ?c e:segment ?s OPTIONAL { ?c e:balance ?b FILTER(?b > 5000 && ?s != 'BUILDING') } }",
    f"SELECT a.s AS c, b.o::DOUBLE AS b FROM t a LEFT JOIN t b ON b.s = a.s AND b.p = '{_E}balance' AND try_cast(b.o AS DOUBLE) > 5000 AND a.o <> 'BUILDING' WHERE a.p = '{_E}segment'", b="double",
)
_sparql(
    "optional_chain", "facts", "SELECT ?x ?seg ?k { ?x e:in ?n OPTIONAL { ?x e:segment ?seg } OPTIONAL { ?y e:segment ?seg ; e:balance ?k FILTER(?k > 9900) } }",
    f"""SELECT a.s AS x, coalesce(b.o, y.seg) AS seg, y.k FROM t a {_LJ('a.s', 'segment', 'b')}
    LEFT JOIN (SELECT u.o AS seg, v.o::DOUBLE AS k FROM t u JOIN t v ON u.s = v.s WHERE u.p = '{_E}segment' AND v.p = '{_E}balance' AND v.o::DOUBLE > 9900) y ON b.o IS NULL OR y.seg = b.o WHERE a.p = '{_E}in'""", k="double",
)
_sparql(
    "union", "facts", "SELECT ?x ?seg ?sells { { ?x e:segment ?seg } UNION { ?x e:sells ?sells } }",
    f"SELECT s AS x, o AS seg, NULL::DOUBLE AS sells FROM t WHERE p = '{_E}segment' UNION ALL SELECT s, NULL, o::DOUBLE FROM t WHERE p = '{_E}sells'", sells="double",
)
_sparql("minus", "facts", "SELECT ?x { ?x e:in ?n MINUS { ?x e:segment 'MACHINERY' } }", f"SELECT s AS x FROM t WHERE p = '{_E}in' AND s NOT IN (SELECT s FROM t WHERE p = '{_E}segment' AND o = 'MACHINERY')")
_sparql("minus_disjoint", "facts", "SELECT ?x { ?x e:part ?n MINUS { ?y e:segment 'MACHINERY' } }", f"SELECT s AS x FROM t WHERE p = '{_E}part'")
_sparql("exists", "facts", "SELECT ?n { ?n e:part ?r FILTER EXISTS { ?s e:sells ?b ; e:in ?n } }", f"SELECT s AS n FROM t WHERE p = '{_E}part' AND s IN (SELECT b.o FROM t a JOIN t b ON a.s = b.s WHERE a.p = '{_E}sells' AND b.p = '{_E}in')")
_sparql("not_exists", "facts", "SELECT ?n { ?n e:part ?r FILTER NOT EXISTS { ?s e:sells ?b ; e:in ?n } }", f"SELECT s AS n FROM t WHERE p = '{_E}part' AND s NOT IN (SELECT b.o FROM t a JOIN t b ON a.s = b.s WHERE a.p = '{_E}sells' AND b.p = '{_E}in')")
_sparql(
    "exists_in_expression", "facts", "SELECT ?x { ?x e:in ?n FILTER(?n = e:none || EXISTS { ?x e:balance ?b FILTER(?b < 0) }) }",
    f"SELECT a.s AS x FROM t a JOIN t b ON a.s = b.s WHERE a.p = '{_E}in' AND b.p = '{_E}balance' AND b.o::DOUBLE < 0",
)
_sparql(
    "values", "facts", "SELECT ?c ?seg ?k { VALUES (?seg ?k) { ('BUILDING' 1) ('MACHINERY' 2) (UNDEF 3) } ?c e:segment ?seg }",
    f"SELECT s AS c, o AS seg, k FROM t JOIN (VALUES ('BUILDING', 1::BIGINT), ('MACHINERY', 2), (NULL, 3)) v(seg, k) ON v.seg IS NULL OR o = v.seg WHERE p = '{_E}segment'", k="bigint",
)
_sparql(
    "bind", "facts", "SELECT ?c ?twice ?kind { ?c e:balance ?b BIND(?b * 2 AS ?twice) BIND(IF(?b < 0, 'owes', 'owns') AS ?kind) }",
    f"SELECT s AS c, round(o::DOUBLE * 2, 4) AS twice, CASE WHEN o::DOUBLE < 0 THEN 'owes' ELSE 'owns' END AS kind FROM t WHERE p = '{_E}balance'", twice="double",
)
_sparql(
    "subselect", "facts", "SELECT ?c ?b ?m { { SELECT ?n (MAX(?x) AS ?m) { ?y e:in ?n ; e:balance ?x } GROUP BY ?n } ?c e:in ?n ; e:balance ?b FILTER(?b = ?m) }",
    f"""SELECT c, b::DOUBLE AS b, m FROM (SELECT a.s AS c, b.o::DOUBLE AS b, max(b.o::DOUBLE) OVER (PARTITION BY a.o) AS m FROM t a JOIN t b ON a.s = b.s WHERE a.p = '{_E}in' AND b.p = '{_E}balance') WHERE b = m""", b="double", m="double",
)
_sparql("cartesian", "facts", "SELECT ?r ?n { ?r e:name ?rn . ?n e:part ?q FILTER(STRSTARTS(STR(?r), '" + _E + "r/')) }", f"SELECT a.s AS r, b.s AS n FROM t a, t b WHERE a.p = '{_E}name' AND a.s LIKE '{_E}r/%' AND b.p = '{_E}part'")
_sparql(
    "filter_logic", "facts", "SELECT ?x ?n { ?x e:in ?n OPTIONAL { ?x e:balance ?b } FILTER(?b > 9000 || ?n = <" + _E + "n/3>) }",
    f"SELECT a.s AS x, a.o AS n FROM t a {_LJ('a.s', 'balance', 'b')} WHERE a.p = '{_E}in' AND (b.o::DOUBLE > 9000 OR a.o = '{_E}n/3')",
)
_sparql("filter_in", "facts", "SELECT ?c { ?c e:segment ?s FILTER(?s IN ('BUILDING', 'FURNITURE')) }", f"SELECT s AS c FROM t WHERE p = '{_E}segment' AND o IN ('BUILDING', 'FURNITURE')")
_sparql("filter_not_in", "facts", "SELECT ?c { ?c e:segment ?s FILTER(?s NOT IN ('BUILDING', 'FURNITURE')) }", f"SELECT s AS c FROM t WHERE p = '{_E}segment' AND o NOT IN ('BUILDING', 'FURNITURE')")
_sparql("filter_bound", "facts", "SELECT ?x { ?x e:in ?n OPTIONAL { ?x e:segment ?s } FILTER(!BOUND(?s)) }", f"SELECT s AS x FROM t WHERE p = '{_E}in' AND s LIKE '{_E}s/%'")
_sparql("filter_same_term", "facts", "SELECT ?x ?y { ?x e:part ?r . ?y e:part ?q FILTER(sameTerm(?r, ?q) && ?x != ?y) }", f"SELECT a.s AS x, b.s AS y FROM t a JOIN t b ON a.o = b.o AND a.s <> b.s WHERE a.p = '{_E}part' AND b.p = '{_E}part'")

_sparql(
    "not_exists_owing", "facts", "SELECT ?n { ?n e:part ?r FILTER NOT EXISTS { ?c e:in ?n ; e:segment 'BUILDING' ; e:balance ?b FILTER(?b < 0) } }",
    f"SELECT s AS n FROM t WHERE p = '{_E}part' AND s NOT IN (SELECT a.o FROM t a {_J('a.s', 'segment', 'b')} {_J('a.s', 'balance', 'c')} WHERE a.p = '{_E}in' AND b.o = 'BUILDING' AND try_cast(c.o AS DOUBLE) < 0)",
)
_sparql(
    "exists_in_select", "facts", "SELECT ?n (EXISTS { ?c e:in ?n ; e:balance ?b FILTER(?b < -900) } AS ?owes) (IF(NOT EXISTS { ?n e:part <" + _E + "r/1> }, 'far', 'near') AS ?where) { ?n e:part ?r }",
    f"SELECT s AS n, s IN (SELECT a.o FROM t a {_J('a.s', 'balance', 'b')} WHERE a.p = '{_E}in' AND try_cast(b.o AS DOUBLE) < -900) AS owes, CASE WHEN o = '{_E}r/1' THEN 'near' ELSE 'far' END AS where FROM t WHERE p = '{_E}part'", owes="boolean",
)
_sparql(
    "exists_in_bind", "facts", "SELECT ?k (COUNT(*) AS ?n) { ?x e:in ?m BIND(EXISTS { ?x e:sells ?b } AS ?k) } GROUP BY ?k",
    f"SELECT s LIKE '{_E}s/%' AS k, count(*) AS n FROM t WHERE p = '{_E}in' GROUP BY 1", k="boolean", n="bigint",
)
_sparql(
    "exists_in_having", "facts", "SELECT ?n (COUNT(*) AS ?k) { ?x e:in ?n } GROUP BY ?n HAVING(EXISTS { ?n e:part <" + _E + "r/1> } && COUNT(*) > 2) ORDER BY (EXISTS { ?n e:name 'PERU' }) ?n",
    f"SELECT o AS n, count(*) AS k FROM t WHERE p = '{_E}in' AND o IN (SELECT s FROM t WHERE p = '{_E}part' AND o = '{_E}r/1') GROUP BY 1 HAVING count(*) > 2", k="bigint",
)
_sparql(
    "bind_join", "facts", "SELECT ?c ?m { ?c e:in ?n BIND(IRI(CONCAT('" + _E + "n/', STR(STRLEN(STR(?c))))) AS ?x) ?x e:name ?m }",
    f"SELECT a.s AS c, b.o AS m FROM t a JOIN t b ON b.s = '{_E}n/' || length(a.s) AND b.p = '{_E}name' WHERE a.p = '{_E}in'",
)
_sparql(
    "optional_then_join", "facts", "SELECT ?x ?seg ?y { ?x e:sells ?b OPTIONAL { ?x e:segment ?seg } { SELECT DISTINCT ?seg ?y { ?y e:segment ?seg ; e:in <" + _E + "n/3> } } }",
    f"SELECT a.s AS x, b.o AS seg, b.s AS y FROM t a, t b {_J('b.s', 'in', 'c')} WHERE a.p = '{_E}sells' AND b.p = '{_E}segment' AND c.o = '{_E}n/3'",
)
_sparql(
    "undef_both_sides", "facts", "SELECT ?a ?b ?x ?y { VALUES (?a ?b ?x) { (1 UNDEF 'p') (UNDEF 2 'q') (UNDEF UNDEF 'r') (1 2 's') } OPTIONAL { VALUES (?a ?b ?y) { (1 2 'u') (UNDEF 2 'v') (3 UNDEF 'w') } } }",
    """SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, x, y FROM (VALUES (1::BIGINT, NULL::BIGINT, 'p'), (NULL, 2, 'q'), (NULL, NULL, 'r'), (1, 2, 's')) l(a, b, x)
    LEFT JOIN (VALUES (1::BIGINT, 2::BIGINT, 'u'), (NULL, 2, 'v'), (3, NULL, 'w')) r(a, b, y) ON (l.a = r.a OR l.a IS NULL OR r.a IS NULL) AND (l.b = r.b OR l.b IS NULL OR r.b IS NULL)""",
    a="bigint", b="bigint",
)
_sparql(
    "minus_undef", "facts", "SELECT ?x ?n { ?x e:part ?n MINUS { VALUES (?x ?n) { (UNDEF <" + _E + "r/2>) (<" + _E + "n/1> UNDEF) } } }",
    f"SELECT s AS x, o AS n FROM t WHERE p = '{_E}part' AND o <> '{_E}r/2' AND s <> '{_E}n/1'",
)

# -- aggregates and modifiers

_sparql("agg_count", "facts", "SELECT ?n (COUNT(?x) AS ?k) (COUNT(DISTINCT ?seg) AS ?d) { ?x e:in ?n OPTIONAL { ?x e:segment ?seg } } GROUP BY ?n", f"SELECT a.o AS n, count(*) AS k, count(DISTINCT b.o) AS d FROM t a {_LJ('a.s', 'segment', 'b')} WHERE a.p = '{_E}in' GROUP BY 1", k="bigint", d="bigint")
_sparql("agg_sum", "facts", "SELECT ?n (SUM(?b) AS ?k) { ?x e:in ?n ; e:balance ?b } GROUP BY ?n", f"SELECT a.o AS n, rtrim(rtrim(sum(b.o::DECIMAL(18,2))::VARCHAR, '0'), '.') AS k FROM t a JOIN t b ON a.s = b.s WHERE a.p = '{_E}in' AND b.p = '{_E}balance' GROUP BY 1")
_BIG = "9007199254740993"
_sparql("agg_sum_large", "facts", f"SELECT (SUM(?x) AS ?k) (SUM(DISTINCT ?x) AS ?d) (MAX(?x) AS ?hi) (COUNT(*) AS ?n) {{ ?r e:part ?q BIND({_BIG} + STRLEN(STR(?r)) AS ?x) }}", f"SELECT sum(x)::VARCHAR AS k, sum(DISTINCT x)::VARCHAR AS d, max(x)::VARCHAR AS hi, count(*) AS n FROM (SELECT {_BIG}::HUGEINT + length(s) AS x FROM t WHERE p = '{_E}part')", n="bigint")
_sparql(
    "numbers_large", "facts", f"SELECT ?r ({_BIG} = 9007199254740992 AS ?same) ({_BIG} * 3 AS ?t) ({_BIG} - 9007199254740992 AS ?one) (0.1 + 0.2 AS ?s) (1.25 * 1.5 AS ?p) (xsd:integer('{_BIG}') + 1 AS ?c) (xsd:integer('{_BIG}') > 9007199254740992 AS ?more) {{ ?r e:name 'ASIA' }}",
    f"SELECT s AS r, FALSE AS same, '{int(_BIG) * 3}' AS t, '1' AS one, '0.3' AS s, '1.875' AS p, '{int(_BIG) + 1}' AS c, TRUE AS more FROM t WHERE p = '{_E}name' AND o = 'ASIA'", same="boolean", more="boolean",
)
_sparql("agg_avg", "facts", "SELECT ?seg (ROUND(AVG(?b)) AS ?k) { ?x e:segment ?seg ; e:balance ?b } GROUP BY ?seg", f"SELECT a.o AS seg, floor(sum(b.o::DECIMAL(18,2))::DOUBLE / count(*) + 0.5)::BIGINT AS k FROM t a JOIN t b ON a.s = b.s WHERE a.p = '{_E}segment' AND b.p = '{_E}balance' GROUP BY 1", k="bigint")
_sparql("agg_min_max", "facts", "SELECT ?seg (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) (MAX(?m) AS ?last) { ?x e:segment ?seg ; e:balance ?b ; e:name ?m } GROUP BY ?seg", f"SELECT a.o AS seg, min(b.o::DOUBLE) AS lo, max(b.o::DOUBLE) AS hi, max(c.o) AS last FROM t a JOIN t b ON a.s = b.s JOIN t c ON a.s = c.s WHERE a.p = '{_E}segment' AND b.p = '{_E}balance' AND c.p = '{_E}name' GROUP BY 1", lo="double", hi="double")
_sparql("agg_sample", "facts", "SELECT ?seg (SAMPLE(?m) AS ?one) { ?x e:segment ?seg ; e:name ?m } GROUP BY ?seg", f"SELECT a.o AS seg, min(b.o) AS one FROM t a JOIN t b ON a.s = b.s WHERE a.p = '{_E}segment' AND b.p = '{_E}name' GROUP BY 1")
_sparql("agg_group_concat", "facts", "SELECT ?r (GROUP_CONCAT(?m ; SEPARATOR = ', ') AS ?all) { ?n e:part ?r ; e:name ?m } GROUP BY ?r", f"SELECT a.o AS r, string_agg(b.o, ', ' ORDER BY b.o) AS all FROM t a JOIN t b ON a.s = b.s WHERE a.p = '{_E}part' AND b.p = '{_E}name' GROUP BY 1")
_sparql("agg_implicit", "facts", "SELECT (COUNT(*) AS ?n) (SUM(?b) AS ?none) { ?x e:nothing ?b }", "SELECT 0::BIGINT AS n, 0::DOUBLE AS none", n="bigint", none="double")
_sparql("agg_error", "facts", "SELECT (SUM(?m) AS ?bad) { ?x e:segment ?m }", "SELECT NULL::DOUBLE AS bad", bad="double")
_sparql("having", "facts", "SELECT ?n (COUNT(*) AS ?k) { ?x e:in ?n } GROUP BY ?n HAVING(COUNT(*) > 6)", f"SELECT o AS n, count(*) AS k FROM t WHERE p = '{_E}in' GROUP BY 1 HAVING count(*) > 6", k="bigint")
_sparql("distinct", "facts", "SELECT DISTINCT ?seg ?r { ?c e:segment ?seg ; e:in ?n . ?n e:part ?r }", f"SELECT DISTINCT a.o AS seg, c.o AS r FROM t a {_J('a.s', 'in', 'b')} {_J('b.o', 'part', 'c')} WHERE a.p = '{_E}segment'")
_sparql("order_limit", "facts", "SELECT ?c ?b { ?c e:balance ?b } ORDER BY DESC(?b) ?c LIMIT 10 OFFSET 5", f"SELECT s AS c, o::DOUBLE AS b FROM t WHERE p = '{_E}balance' ORDER BY b DESC, c LIMIT 10 OFFSET 5", b="double")

# -- paths

_sparql("path_seq", "facts", "SELECT ?c ?r { ?c e:in/e:part ?r }", f"SELECT a.s AS c, b.o AS r FROM t a {_J('a.o', 'part', 'b')} WHERE a.p = '{_E}in'")
_sparql("path_alt", "facts", "SELECT ?x ?y { ?x e:in|e:part ?y }", f"SELECT s AS x, o AS y FROM t WHERE p IN ('{_E}in', '{_E}part')")
_sparql("path_inverse", "facts", "SELECT ?n ?c { ?n ^e:in ?c }", f"SELECT o AS n, s AS c FROM t WHERE p = '{_E}in'")
_UP = f"ed AS (SELECT s AS x, o AS y FROM t WHERE p IN ('{_E}in', '{_E}part'))"
_sparql("path_plus", "facts", "SELECT ?x ?y { ?x (e:in|e:part)+ ?y }", f", {_UP} SELECT x, y FROM ed UNION SELECT a.x, b.y FROM ed a JOIN ed b ON a.y = b.x")
_sparql("path_star_from", "facts", f"SELECT ?x {{ ?x (e:in|e:part)* <{_E}r/2> }}", f", {_UP} SELECT x FROM ed WHERE y = '{_E}r/2' UNION SELECT a.x FROM ed a JOIN ed b ON a.y = b.x WHERE b.y = '{_E}r/2' UNION SELECT '{_E}r/2'")
_sparql("path_star", "facts", "SELECT ?x ?y { GRAPH <http://www.wikidata.org/revision/global/1> { ?x e:part* ?y } }", f"SELECT s AS x, o AS y FROM t WHERE p = '{_E}part' UNION SELECT s, s FROM t UNION SELECT o, o FROM t WHERE p IN ('{_E}in', '{_E}part', '{_E}name', '{_E}segment') UNION SELECT o, o FROM t WHERE p IN ('{_E}balance', '{_E}sells')")
_sparql("path_opt", "facts", f"SELECT ?y {{ <{_E}n/3> e:part? ?y }}", f"SELECT o AS y FROM t WHERE p = '{_E}part' AND s = '{_E}n/3' UNION SELECT '{_E}n/3'")
_sparql("path_negated", "facts", "SELECT ?x ?y { ?x !(e:name|e:segment|e:balance|e:sells|^e:part) ?y }", f"SELECT s AS x, o AS y FROM t WHERE p IN ('{_E}in', '{_E}part') UNION ALL SELECT o, s FROM t WHERE p <> '{_E}part'")
_sparql("path_rewrite", "facts", "SELECT DISTINCT ?x ?y { ?x e:part/e:part* ?y }", f"SELECT s AS x, o AS y FROM t WHERE p = '{_E}part'")
_sparql("path_in_graphs", "edits", "SELECT ?g ?o { VALUES ?g { <http://www.wikidata.org/revision/global/400> <http://www.wikidata.org/revision/global/800> } GRAPH ?g { ?s e:type/^e:type ?o } }", f"SELECT '{_R}global/' || r AS g, b.s AS o FROM unnest([400, 800]) AS x(r), ti a, ti b WHERE a.p = '{_E}type' AND b.p = '{_E}type' AND a.o = b.o AND a.rev_start <= r AND r < a.rev_end AND b.rev_start <= r AND r < b.rev_end")

# -- functions, over all documents

_sparql(
    "fn_string", "texts",
    """SELECT ?d (STRLEN(?t) AS ?len) (SUBSTR(?t, 3, 8) AS ?sub) (UCASE(?s) AS ?up) (LCASE(STRBEFORE(?t, ' ')) AS ?first) (STRSTARTS(?t, 'Th') AS ?th) (CONTAINS(?t, 'and') AS ?has) (CONCAT(STR(?s), '-', LANG(?t)) AS ?tag)
    { ?d e:text ?t ; e:source ?s }""",
    f"""SELECT '{_E}d/' || doc_id AS d, length(text)::BIGINT AS len, substr(text, 3, 8) AS sub, upper(source) AS up, CASE WHEN strpos(text, ' ') > 0 THEN lower(substr(text, 1, strpos(text, ' ')::INTEGER - 1)) ELSE '' END AS first,
    starts_with(text, 'Th') AS th, contains(text, 'and') AS has, source || '-' || lang AS tag FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL""",
    len="bigint", th="boolean", has="boolean",
)
_sparql("fn_after_replace", "texts", "SELECT ?d (STRAFTER(?t, '. ') AS ?second) (REPLACE(?s, '[0-9]+', 'N') AS ?r) (ENCODE_FOR_URI(?s) AS ?u) { ?d e:text ?t ; e:source ?s }", f"SELECT '{_E}d/' || doc_id AS d, CASE WHEN strpos(text, '. ') > 0 THEN substr(text, strpos(text, '. ')::INTEGER + 2) ELSE '' END AS second, regexp_replace(source, '[0-9]+', 'N', 'g') AS r, url_encode(source) AS u FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
_sparql("fn_regex", "texts", "SELECT ?d { ?d e:text ?t FILTER(REGEX(?t, '^[a-z]', 'i') && !REGEX(?t, '[0-9]')) }", f"SELECT '{_E}d/' || doc_id AS d FROM documents WHERE regexp_matches(text, '^[a-zA-Z]') AND NOT regexp_matches(text, '[0-9]') AND lang IS NOT NULL")
_sparql("fn_lang", "texts", "SELECT ?l (COUNT(*) AS ?n) { ?d e:text ?t BIND(LANG(?t) AS ?l) FILTER(LANGMATCHES(LANG(?t), '*')) } GROUP BY ?l", "SELECT lang AS l, count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1", n="bigint")
_sparql("fn_hash", "texts", "SELECT ?d (MD5(STR(?t)) AS ?m) (SHA1(STR(?t)) AS ?s) (SHA256(STR(?t)) AS ?h) { ?d e:text ?t }", f"SELECT '{_E}d/' || doc_id AS d, md5(text) AS m, sha1(text) AS s, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
_sparql("fn_numeric", "facts", "SELECT ?c (ABS(?b) AS ?a) (ROUND(?b) AS ?r) (CEIL(?b) AS ?u) (FLOOR(?b) AS ?f) (-?b AS ?m) (?b / 4 AS ?q) { ?c e:balance ?b }", f"SELECT s AS c, abs(b) AS a, floor(b + 0.5)::BIGINT AS r, ceil(b)::BIGINT AS u, floor(b)::BIGINT AS f, -b AS m, round(b / 4, 6) AS q FROM (SELECT s, o::DOUBLE AS b FROM t WHERE p = '{_E}balance')", a="double", r="bigint", u="bigint", f="bigint", m="double", q="double")
_sparql("fn_date", "edits", "SELECT ?r (YEAR(?d) AS ?y) (MONTH(?d) AS ?mo) (DAY(?d) AS ?da) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) (SECONDS(?d) AS ?s) (TZ(?d) AS ?z) (STR(TIMEZONE(?d)) AS ?tz) { ?r schema:dateCreated ?d }", f"SELECT '{_R}' || event_id AS r, year(ts)::BIGINT AS y, month(ts)::BIGINT AS mo, day(ts)::BIGINT AS da, hour(ts)::BIGINT AS h, minute(ts)::BIGINT AS mi, second(ts)::BIGINT AS s, 'Z' AS z, 'PT0S' AS tz FROM events", y="bigint", mo="bigint", da="bigint", h="bigint", mi="bigint", s="bigint")
_sparql("fn_cast", "facts", "SELECT ?c (xsd:integer(?b) AS ?i) (xsd:string(?b) AS ?s) (xsd:boolean(?b) AS ?t) (xsd:double('1e3') AS ?k) (xsd:integer(?g) AS ?bad) { ?c e:balance ?b ; e:segment ?g }", f"SELECT a.s AS c, trunc(a.o::DOUBLE)::BIGINT AS i, a.o AS s, a.o::DOUBLE <> 0 AS t, 1000.0::DOUBLE AS k, NULL::BIGINT AS bad FROM t a {_J('a.s', 'segment', 'b')} WHERE a.p = '{_E}balance'", i="bigint", t="boolean", k="double", bad="bigint")
_sparql("fn_terms", "facts", "SELECT ?n (isIRI(?r) AS ?a) (isLiteral(?m) AS ?b) (isNumeric(?m) AS ?c) (isBlank(?r) AS ?d) (STR(DATATYPE(?m)) AS ?e) (STR(IRI(CONCAT('http://x.test/', ?m))) AS ?f) (COALESCE(?none, STRLANG(?m, 'en')) AS ?g) { ?n e:part ?r ; e:name ?m }", f"SELECT a.s AS n, TRUE AS a, TRUE AS b, FALSE AS c, FALSE AS d, '{XSD}string' AS e, 'http://x.test/' || b.o AS f, b.o AS g FROM t a {_J('a.s', 'name', 'b')} WHERE a.p = '{_E}part'", a="boolean", b="boolean", c="boolean", d="boolean")
_sparql("fn_compare", "facts", "SELECT ?x ?y { ?x e:name ?m . ?y e:name ?k FILTER(STRSTARTS(STR(?x), '" + _E + "r/') && STRSTARTS(STR(?y), '" + _E + "r/') && ?m < ?k) }", f"SELECT a.s AS x, b.s AS y FROM t a, t b WHERE a.p = '{_E}name' AND b.p = '{_E}name' AND a.s LIKE '{_E}r/%' AND b.s LIKE '{_E}r/%' AND a.o < b.o")

# -- other forms

_sparql("ask", "facts", "ASK { ?c e:balance ?b FILTER(?b < 0) }", f"SELECT count(*) > 0 AS result FROM t WHERE p = '{_E}balance' AND o::DOUBLE < 0")
_sparql("construct", "facts", "CONSTRUCT { ?r e:home ?c . ?c e:label ?m } WHERE { ?c e:in/e:part ?r ; e:segment ?g ; e:name ?m }", f", x AS (SELECT a.s AS c, b.o AS r, m.o AS m FROM t a {_J('a.o', 'part', 'b')} {_J('a.s', 'segment', 'g')} {_J('a.s', 'name', 'm')} WHERE a.p = '{_E}in') SELECT r AS s, '{_E}home' AS p, c AS o FROM x UNION SELECT c, '{_E}label', m FROM x")
_sparql("describe", "facts", f"DESCRIBE <{_E}n/3>", f"SELECT DISTINCT s, p, o FROM t WHERE s = '{_E}n/3' OR o = '{_E}n/3'")


def _service(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = H.edits(spark, sf_dir)
    here.services = {"<http://facts.test/>": H.facts(spark, sf_dir)}
    return plain(here.sparql(_PROLOGUE + "SELECT ?n ?m { SERVICE <http://facts.test/> { ?n e:part ?r ; e:name ?m } }"))


_ALL["service"] = _service, f"WITH {H.FACTS} SELECT a.s AS n, b.o AS m FROM t a {_J('a.s', 'name', 'b')} WHERE a.p = '{_E}part'"

# -- interchange and entity documents


def _lines(make: Callable[[HistoryStore], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(H.edits(spark, sf_dir))


_ALL["revision_lines"] = _lines(lambda h: tables.revision_lines(h.revisions)), f"WITH {H.EDITS} SELECT concat_ws(chr(9), revision_id, coalesce(parent_id, -1), string_split(topic, '/')[-1], ts_sec, contributor, '') AS value FROM rv"
_ALL["ntriples"] = (
    lambda spark, sf_dir: tables.ntriples(H.facts(spark, sf_dir).triples),
    f"""WITH {H.FACTS} SELECT '<' || s || '> <' || p || '> ' || CASE WHEN p IN ('{_E}in', '{_E}part') THEN '<' || o || '>' WHEN p IN ('{_E}balance', '{_E}sells') THEN '"' || o || '"^^<{XSD}decimal>' ELSE '"' || o || '"' END || ' .' AS value FROM t""",
)
_ALL["triple_lines"] = (
    lambda spark, sf_dir: tables.triple_lines(H.orders(spark, sf_dir).triples),
    f"""WITH {H.ORDERS} SELECT '<' || s || '>' || chr(9) || '<' || p || '>' || chr(9) || CASE WHEN p = '{_E}status' THEN '"' || o || '"' ELSE '<' || o || '>' END || chr(9) || string_agg(rev_start || ' ' || rev_end, ' ' ORDER BY rev_start) AS value FROM ti GROUP BY s, p, o""",
)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as item documents, mapped; without the value nodes, whose names are hashes."""
    p = H.read(spark, sf_dir, "part")
    snak = lambda pid, kind, v: F.format_string('{"snaktype":"value","property":"%s","datavalue":{"type":"%s","value":%s}}', F.lit(pid), F.lit(kind), v)
    claim = lambda pid, rank, s: F.format_string('"%s":[{"id":"Q%d$%s","rank":"%s","mainsnak":%s}]', F.lit(pid), "p_partkey", F.lit(pid), F.lit(rank), s)
    size = F.format_string('{"amount":"+%d","unit":"1"}', "p_size")
    brand = F.format_string('"%s"', "p_brand")
    label = F.format_string('{"en":{"language":"en","value":"%s"}}', "p_name")
    text = F.format_string('{"id":"Q%d","type":"item","labels":%s,"descriptions":[],"claims":{%s,%s}}', "p_partkey", label, claim("P1", "normal", snak("P1", "string", brand)), claim("P2", "preferred", snak("P2", "quantity", size)))
    docs = p.select(F.col("p_partkey").alias("page"), F.col("p_partkey").alias("rev"), text.alias("text"))
    found, _ = entities.entity_triples(docs)
    return plain(found.where(~F.col("s").contains("/value/") & ~F.col("o").contains("/value/")).select("s", "p", "o"))


def _supplier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as items with terms, all kinds of values, ranks, qualifiers, references and sitelinks; nations as properties."""
    s, n = H.read(spark, sf_dir, "supplier"), H.read(spark, sf_dir, "nation")
    snak = lambda pid, kind, value: f'{{"snaktype":"value","property":"{pid}","datavalue":{{"type":"{kind}","value":{value}}}}}'
    claim = lambda pid, rank, main, rest="": f'"{pid}":[{{"id":"Q%1$d${pid}","rank":"{rank}","mainsnak":{main}{rest}}}]'
    time = '{"time":"+00002001-02-0%3$dT00:00:00Z","timezone":0,"before":0,"after":0,"precision":11,"calendarmodel":"http://www.wikidata.org/entity/Q1985727"}'
    place = '{"latitude":%3$d.5,"longitude":-1.25,"precision":0.5,"globe":"http://www.wikidata.org/entity/Q2"}'
    amount = '{"amount":"+%3$d.50","unit":"1","upperBound":"+%3$d.75","lowerBound":"+%3$d.25"}'
    claims = ",".join([
        claim("P10", "preferred", snak("P10", "time", time), f',"qualifiers":{{"P11":[{snak("P11", "string", chr(34) + "of %2$s" + chr(34))}]}},"references":[{{"snaks":{{"P12":[{snak("P12", "string", chr(34) + "http://x.test/a b" + chr(34))}]}}}}]'),
        claim("P14", "normal", snak("P14", "globecoordinate", place)), claim("P15", "normal", '{"snaktype":"novalue","property":"P15"}'), claim("P16", "deprecated", snak("P16", "quantity", amount)),
        claim("P17", "normal", snak("P17", "monolingualtext", '{"text":"%2$s","language":"no"}')), claim("P18", "normal", snak("P18", "wikibase-entityid", '{"entity-type":"item","numeric-id":%1$d}')),
    ])
    item = (
        '{"id":"Q%1$d","type":"item","labels":{"en":{"language":"en","value":"%2$s"}},"descriptions":{"de":{"language":"de","value":"Lieferant %1$d"}},'
        '"aliases":{"en":[{"language":"en","value":"S%1$d"},{"language":"en","value":"S-%1$d"}]},"claims":{' + claims + '},"sitelinks":{"enwiki":{"site":"enwiki","title":"Supplier %1$d","badges":["Q17437796"]},"xxwiki":{"site":"xxwiki","title":"x"}}}'
    )
    kind = F.element_at(F.array(*[F.lit(x) for x in ("string", "time", "wikibase-item")]), F.col("n_nationkey").cast("int") % 3 + 1)
    property_ = F.format_string('{"id":"P%d","type":"property","datatype":"%s","labels":{"en":{"language":"en","value":"%s"}},"descriptions":[],"claims":[]}', F.col("n_nationkey") + 100, kind, "n_name")
    items = s.select(F.col("s_suppkey").cast("bigint").alias("page"), F.format_string(item, F.col("s_suppkey").cast("bigint"), "s_name", F.col("s_suppkey").cast("bigint") % 9 + 1).alias("text"))
    properties = n.select((-F.col("n_nationkey") - 1).cast("bigint").alias("page"), property_.alias("text"))
    return items.unionByName(properties).select("page", F.col("page").alias("rev"), "text")


def _supplier_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = spark.createDataFrame([("P12", "url", None)], entities.PROPERTY_INFO)
    sites = spark.createDataFrame([("enwiki", "https://en.wiki.test/wiki/$1", "en", "wikipedia")], entities.SITES)
    found, _ = entities.entity_triples(_supplier_documents(spark, sf_dir), info, sites)
    return plain(found.select("s", "p", "o"))


_W = "http://www.wikidata.org/"
_ALL["entity_triples"] = (
    _entities,
    f"""WITH x AS (SELECT '{_W}entity/Q' || p_partkey AS s, '{_W}entity/statement/Q' || p_partkey || '-P1' AS a, '{_W}entity/statement/Q' || p_partkey || '-P2' AS b, * FROM part)
    SELECT s, '{TYPE[1:-1]}' AS p, 'http://wikiba.se/ontology#Item' AS o FROM x UNION ALL SELECT s, 'http://www.w3.org/2000/01/rdf-schema#label', p_name FROM x
    UNION ALL SELECT s, '{_W}prop/direct/P1', p_brand FROM x UNION ALL SELECT s, '{_W}prop/direct/P2', p_size::VARCHAR FROM x
    UNION ALL SELECT s, '{_W}prop/P1', a FROM x UNION ALL SELECT s, '{_W}prop/P2', b FROM x
    UNION ALL SELECT a, '{_W}prop/statement/P1', p_brand FROM x UNION ALL SELECT b, '{_W}prop/statement/P2', p_size::VARCHAR FROM x
    UNION ALL SELECT a, 'http://wikiba.se/ontology#rank', 'http://wikiba.se/ontology#NormalRank' FROM x UNION ALL SELECT b, 'http://wikiba.se/ontology#rank', 'http://wikiba.se/ontology#PreferredRank' FROM x
    UNION ALL SELECT unnest([a, b]), '{TYPE[1:-1]}', 'http://wikiba.se/ontology#Statement' FROM x UNION ALL SELECT unnest([a, b]), '{TYPE[1:-1]}', 'http://wikiba.se/ontology#BestRank' FROM x""",
)

_RDFS, _WB, _OWL, _PROV, _SCHEMA, _SKOS = "http://www.w3.org/2000/01/rdf-schema#", "http://wikiba.se/ontology#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/ns/prov#", "http://schema.org/", "http://www.w3.org/2004/02/skos/core#"
_RDF_TYPE = TYPE[1:-1]
_CAMEL = "CASE k % 3 WHEN 0 THEN 'String' WHEN 1 THEN 'Time' ELSE 'WikibaseItem' END"
_SORT = f"CASE k % 3 WHEN 2 THEN '{_OWL}ObjectProperty' ELSE '{_OWL}DatatypeProperty' END"


def _claims_sql(pid: str, rank: str, best: bool) -> str:
    node = f"'{_W}entity/statement/Q' || k || '-{pid}'"
    rows = [("e", f"'{_W}prop/{pid}'", node), (node, f"'{_RDF_TYPE}'", f"'{_WB}Statement'"), (node, f"'{_WB}rank'", f"'{_WB}{rank}Rank'")]
    if best:
        rows.append((node, f"'{_RDF_TYPE}'", f"'{_WB}BestRank'"))
    return _rows_sql("x", rows)


def _rows_sql(table: str, rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {s} AS s, {p} AS p, {o} AS o FROM {table}" for s, p, o in rows)


def _supplier_sql() -> str:
    wdt, ps, psv, node = (f"{_W}prop/direct/", f"{_W}prop/statement/", f"{_W}prop/statement/value/", f"'{_W}entity/statement/Q' || k || '-")
    time, place, amount = "'2001-02-0' || d || 'T00:00:00Z'", "'Point(-1.25 ' || d || '.5)'", "'+' || d || '.50'"
    calendar = f"{_W}entity/Q1985727"
    value = f"'{_W}value/' || sha1("
    tv = value + f"'time' || '{{\"after\":0,\"before\":0,\"calendarmodel\":\"{calendar}\",\"precision\":11,\"time\":\"+00002001-02-0' || d || 'T00:00:00Z\",\"timezone\":0}}')"
    gv = value + f"'globecoordinate' || '{{\"globe\":\"{_W}entity/Q2\",\"latitude\":' || d || '.5,\"longitude\":-1.25,\"precision\":0.5}}')"
    qv = value + "'quantity' || '{\"amount\":\"+' || d || '.50\",\"lowerBound\":\"+' || d || '.25\",\"unit\":\"1\",\"upperBound\":\"+' || d || '.75\"}')"
    ref = f"""'{_W}reference/' || sha1('{{"P12":[{{"datavalue":{{"type":"string","value":"http://x.test/a b"}},"property":"P12","snaktype":"value"}}]}}')"""
    own = [
        ("e", f"'{_RDF_TYPE}'", f"'{_WB}Item'"), ("e", f"'{_RDFS}label'", "s_name"), ("e", f"'{_SCHEMA}description'", "'Lieferant ' || k"), ("e", f"'{_SKOS}altLabel'", "'S' || k"), ("e", f"'{_SKOS}altLabel'", "'S-' || k"),
        ("e", f"'{wdt}P10'", time), (node + "P10'", f"'{ps}P10'", time), (node + "P10'", f"'{psv}P10'", tv), (node + "P10'", f"'{_W}prop/qualifier/P11'", "'of ' || s_name"), (node + "P10'", f"'{_PROV}wasDerivedFrom'", ref),
        ("e", f"'{wdt}P14'", place), (node + "P14'", f"'{ps}P14'", place), (node + "P14'", f"'{psv}P14'", gv),
        ("e", f"'{_RDF_TYPE}'", f"'{_W}prop/novalue/P15'"), (node + "P15'", f"'{_RDF_TYPE}'", f"'{_W}prop/novalue/P15'"),
        (node + "P16'", f"'{ps}P16'", amount), (node + "P16'", f"'{psv}P16'", qv), ("e", f"'{wdt}P17'", "s_name"), (node + "P17'", f"'{ps}P17'", "s_name"), ("e", f"'{wdt}P18'", "e"), (node + "P18'", f"'{ps}P18'", "e"),
    ]
    page = "'https://en.wiki.test/wiki/Supplier_' || k"
    own += [
        (page, f"'{_RDF_TYPE}'", f"'{_SCHEMA}Article'"), (page, f"'{_SCHEMA}about'", "e"), (page, f"'{_SCHEMA}inLanguage'", "'en'"), (page, f"'{_SCHEMA}name'", "'Supplier ' || k"),
        (page, f"'{_SCHEMA}isPartOf'", "'https://en.wiki.test/'"), (page, f"'{_WB}badge'", f"'{_W}entity/Q17437796'"),
    ]
    # Nodes that items share are of a page each: distinct is within the page.
    nodes = [
        (tv, f"'{_RDF_TYPE}'", f"'{_WB}TimeValue'"), (tv, f"'{_WB}timeValue'", time), (tv, f"'{_WB}timePrecision'", "'11'"), (tv, f"'{_WB}timeTimezone'", "'0'"), (tv, f"'{_WB}timeCalendarModel'", f"'{calendar}'"),
        (gv, f"'{_RDF_TYPE}'", f"'{_WB}GlobecoordinateValue'"), (gv, f"'{_WB}geoLatitude'", "d || '.5'"), (gv, f"'{_WB}geoLongitude'", "'-1.25'"), (gv, f"'{_WB}geoPrecision'", "'0.5'"), (gv, f"'{_WB}geoGlobe'", f"'{_W}entity/Q2'"),
        (qv, f"'{_RDF_TYPE}'", f"'{_WB}QuantityValue'"), (qv, f"'{_WB}quantityAmount'", amount), (qv, f"'{_WB}quantityUpperBound'", "'+' || d || '.75'"), (qv, f"'{_WB}quantityLowerBound'", "'+' || d || '.25'"), (qv, f"'{_WB}quantityUnit'", f"'{_W}entity/Q199'"),
        (ref, f"'{_RDF_TYPE}'", f"'{_WB}Reference'"), (ref, f"'{_W}prop/reference/P12'", "'http://x.test/a%20b'"), ("'https://en.wiki.test/'", f"'{_WB}wikiGroup'", "'wikipedia'"),
    ]
    prop = [("e", f"'{_RDF_TYPE}'", f"'{_WB}Property'"), ("e", f"'{_WB}propertyType'", f"'{_WB}' || {_CAMEL}"), ("e", f"'{_RDFS}label'", "n_name")]
    for role, space, sort in (("directClaim", "direct/", _SORT), ("claim", "", f"'{_OWL}ObjectProperty'"), ("statementProperty", "statement/", _SORT), ("qualifier", "qualifier/", _SORT), ("reference", "reference/", _SORT)):
        prop += [("e", f"'{_WB}{role}'", f"'{_W}prop/{space}P' || n"), (f"'{_W}prop/{space}P' || n", f"'{_RDF_TYPE}'", sort)]
    no, other = f"'{_W}prop/novalue/P' || n", "'_:novalueP' || n"
    prop += [
        ("e", f"'{_WB}novalue'", no), (no, f"'{_RDF_TYPE}'", f"'{_OWL}Class'"), (no, f"'{_OWL}complementOf'", other),
        (other, f"'{_RDF_TYPE}'", f"'{_OWL}Restriction'"), (other, f"'{_OWL}onProperty'", f"'{wdt}P' || n"), (other, f"'{_OWL}someValuesFrom'", f"'{_OWL}Thing'"),
    ]
    full = []
    for role, space in (("statementValue", "statement/value/"), ("qualifierValue", "qualifier/value/"), ("referenceValue", "reference/value/")):
        full += [("e", f"'{_WB}{role}'", f"'{_W}prop/{space}P' || n"), (f"'{_W}prop/{space}P' || n", f"'{_RDF_TYPE}'", f"'{_OWL}ObjectProperty'")]
    claims = [("P10", "Preferred", True), ("P14", "Normal", True), ("P15", "Normal", True), ("P16", "Deprecated", False), ("P17", "Normal", True), ("P18", "Normal", True)]
    return (
        f"WITH x AS (SELECT s_suppkey AS k, s_suppkey % 9 + 1 AS d, '{_W}entity/Q' || s_suppkey AS e, s_name FROM supplier), "
        f"y AS (SELECT n_nationkey AS k, n_nationkey + 100 AS n, '{_W}entity/P' || (n_nationkey + 100) AS e, n_name FROM nation) "
        + " UNION ALL ".join([_rows_sql("x", own), _rows_sql("x", nodes), *(_claims_sql(*c) for c in claims), _rows_sql("y", prop), _rows_sql("(SELECT * FROM y WHERE k % 3 = 1)", full)])
    )


_ALL["entity_rules"] = _supplier_entities, _supplier_sql()
