"""Pattern shapes in contexts, revision attributes, temporal joins."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from palimgraph.operators import closure, intervals, magic, scan, temporal_join
from palimgraph.store import HistoryStore
from palimgraph.vocabulary import MAX, REVISION, REVISIONS, TRIPLES, iri, revision_iri

S, P, O = iri("wd:Q77"), iri("wdt:P8"), iri("wd:Q901")
SHAPES = {"???": {}, "s??": {"s": S}, "sp?": {"s": S, "p": P}, "spo": {"s": S, "p": P, "o": O}, "s?o": {"s": S, "o": O}, "?p?": {"p": P}, "?po": {"p": P, "o": O}, "??o": {"o": O}}
COUNTS = {(): (8, 8, 4, 2, 2, 4, 2, 2), ("A42",): (4, 4, 2, 1, 1, 2, 1, 1), ("G42",): (4, 4, 2, 1, 1, 2, 1, 1), ("G43",): (0,) * 8, ("D43",): (4, 4, 2, 1, 1, 2, 1, 1), ("N42",): (0,) * 8, ("A42", "G42"): (8, 8, 4, 2, 2, 4, 2, 2)}


@pytest.fixture(scope="module")
def store(spark):
    rows = [("wdt:P3", "wd:Q55"), ("wdt:P4", "wd:Q56"), ("wdt:P8", "wd:Q901"), ("wdt:P8", "wd:Q902")]
    return HistoryStore(spark, spark.createDataFrame([(S, iri(p), iri(o), 42, 43) for p, o in rows], TRIPLES))


@pytest.fixture(scope="module")
def revisions(spark):
    rows = [(10, None, S, 100, "Bob", None), (20, 10, S, 200, "Bobby", None), (30, 10, S, 200, "Bob", "x")]
    return spark.createDataFrame(rows, REVISIONS)


@pytest.mark.parametrize("contexts", COUNTS, ids=lambda c: "+".join(c) or "none")
def test_shapes(store, contexts):
    named = tuple(revision_iri(c[0], int(c[1:])) for c in contexts)
    assert [store.quads(**shape, contexts=named).count() for shape in SHAPES.values()] == list(COUNTS[contexts])


def test_open_intervals_have_no_deletion(spark):
    h = HistoryStore(spark, spark.createDataFrame([(S, P, O, 5, MAX)], TRIPLES))
    assert [r.g for r in h.quads(p=P).collect()] == [f"<{REVISION}additions/5>"]
    assert h.quads(contexts=(revision_iri("D", MAX),)).count() == 0
    assert h.quads(contexts=(iri("wd:Q1"),)).count() == 0 and h.has_statement(s=S) and not h.has_statement(s=O)


def answers(revisions, p, s=None, o=None):
    return sorted((r.s, r.o) for r in magic.statements(revisions, iri(p), s, o).collect())


def test_attributes(revisions):
    n = lambda i: revision_iri("N", i)
    assert answers(revisions, "schema:author", o='"Bob"') == [(n(10), '"Bob"'), (n(30), '"Bob"')]
    assert answers(revisions, "schema:isBasedOn", o=n(10)) == [(n(20), n(10)), (n(30), n(10))]
    assert answers(revisions, "hist:previousRevision", n(20), n(19)) == [(n(20), n(19))] and not answers(revisions, "hist:previousRevision", n(20), n(21))
    assert answers(revisions, "hist:nextRevision", o=n(21)) == [(n(20), n(21))]
    assert answers(revisions, "hist:globalState", revision_iri("A", 7)) == [(revision_iri("A", 7), revision_iri("G", 7))]
    assert answers(revisions, "hist:revisionId", o='"77"^^<http://www.w3.org/2001/XMLSchema#integer>')[0][0] == n(77)
    assert answers(revisions, "schema:about", S) == [] and len(answers(revisions, "schema:about", o=S)) == 3
    date = '"1970-01-01T00:03:20Z"^^<http://www.w3.org/2001/XMLSchema#dateTime>'
    assert answers(revisions, "schema:dateCreated", o=date) == [(n(20), date), (n(30), date)]
    assert answers(revisions, "hist:globalStateAt", o=date) == [(revision_iri("G", 20), date)]
    late = date.replace("03:20", "03:21")
    assert not answers(revisions, "hist:globalStateAt", o=late) and not answers(revisions, "hist:globalStateAt")
    assert [r.revision_id for r in magic.state_at_date(revisions, late, "asof").collect()] == [30]


def test_attributes_hide_data_without_graph(spark, revisions):
    h = HistoryStore(spark, spark.createDataFrame([("<x:a>", iri("schema:about"), S, 1, MAX)], TRIPLES), revisions)
    assert h.quads(p=iri("schema:about")).where("s = '<x:a>'").count() == 0
    assert h.quads(p=iri("schema:about"), contexts=(revision_iri("G", 9),)).count() == 1
    assert h.quads(s=revision_iri("N", 20)).count() == 10


def test_temporal_join_equals_loop(spark):
    rng = random.Random(1)
    iv = [(i, a := rng.randint(0, 300), rng.choice([MAX, a + rng.randint(1, 90)])) for i in range(200)]
    points = [(r,) for r in range(0, 320, 3)] * 2
    got = temporal_join.contains(spark.createDataFrame(points, "r bigint"), spark.createDataFrame(iv, "i int, rev_start bigint, rev_end bigint"), "r")
    assert sorted((x.r, x.i) for x in got.collect()) == sorted((r, i) for (r,), (i, a, b) in itertools.product(points, iv) if a <= r < b)


def test_join_has_no_nested_loop(spark):
    joined = temporal_join.contains(spark.range(50).selectExpr("id AS r"), spark.range(50).selectExpr("id AS rev_start", "id + 5 AS rev_end"), "r")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_filters_reach_parquet(spark, store, tmp_path):
    store.save(str(tmp_path))
    found = scan.state_at(scan.where_terms(HistoryStore.open(spark, str(tmp_path)).triples, S, P), 42)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p," in plan and "LessThanOrEqual(rev_start,42)" in plan and found.count() == 2


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """A saved store of many triples in eight files for each order."""
    rows = [(f"<x:s{i % 400:03}>", f"<x:p{i % 7}>", f"<x:o{i * 31 % 500:03}>", i % 1000 + 1, MAX if i % 3 else i % 1000 + 5) for i in range(8000)]
    at = str(tmp_path_factory.mktemp("saved"))
    revisions = [(r, r - 1 or None, f"<x:s{r % 400:03}>", 1000 + r, f"user{r % 50}", None) for r in range(1, 1005)]
    HistoryStore(spark, spark.createDataFrame(rows, TRIPLES), spark.createDataFrame(revisions, REVISIONS)).save(at, partitions=8)
    return HistoryStore.open(spark, at), rows


def scanned(df):
    """The rows that the scans of a plan gave, and their folder and pushed filters."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    out = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if "Scan parquet" in leaf.nodeName():
            text = leaf.toString()
            out.append((leaf.metrics().apply("numOutputRows").value(), text[text.index("Location") :].split("]")[0].rsplit("/", 1)[1], text[text.index("PushedFilters") :]))
    return out


_S, _P, _O = "<x:s123>", "<x:p4>", "<x:o123>"
PRUNED = {"s??": ("by_subject", dict(s=_S)), "s?o": ("by_subject", dict(s=_S, o=_O)), "sp?": ("triples", dict(s=_S, p=_P)), "?p?": ("triples", dict(p=_P)), "spo": ("triples", dict(s=_S, p=_P, o=_O)), "??o": ("by_object", dict(o=_O)), "?po": ("by_object", dict(p=_P, o=_O))}


@pytest.mark.parametrize("shape", PRUNED)
def test_saved_store_reads_the_copy_that_prunes(saved, shape):
    store, rows = saved
    folder, given = PRUNED[shape]
    df = store.tables.of(**given)
    found = scanned(scan.where_terms(df, **given))
    at = {"s": 0, "p": 1, "o": 2}
    want = sum(all(r[at[c]] == v for c, v in given.items()) for r in rows)
    assert scan.where_terms(df, **given).count() == want
    (n, name, filters), *_ = found
    assert name == folder and all(f"EqualTo({c}," in filters for c in given)
    assert n <= len(rows) / 8 * 2.2  # of eight files two or so


def test_saved_store_reads_a_revision_by_its_number(saved):
    store, rows = saved
    for df, name, at in ((store.additions(500), "by_start", 3), (store.deletions(500), "by_end", 4)):
        (n, folder, filters), *_ = scanned(df)
        assert folder == name and "EqualTo(rev_" in filters and n <= len(rows) / 8 * 2.2 and df.count() == sum(r[at] == 500 for r in rows)
    quads = store.quads(contexts=(revision_iri("A", 500), revision_iri("D", 500)))
    assert [x[1] for x in scanned(quads)] == ["by_start", "by_end"] and quads.count() == sum((r[3] == 500) + (r[4] == 500) for r in rows)


def test_saved_store_reads_attributes_once(saved):
    store, _ = saved
    q = store.sparql("SELECT ?r ?t ?d ?g { ?r schema:about ?t ; schema:author 'user7' ; schema:dateCreated ?d ; hist:globalState ?g }")
    found = scanned(q)
    assert len(found) == 1 and "EqualTo(contributor,user7)" in found[0][2] and q.count() == 20


def test_a_store_saved_in_one_order_answers_too(spark, saved, tmp_path):
    store, rows = saved
    store.save(str(tmp_path), partitions=2, orders=())
    again = HistoryStore.open(spark, str(tmp_path))
    assert again.tables.by_object is None and again.quads(o=_O).count() == store.quads(o=_O).count() > 0
    assert again.additions(500).count() == store.additions(500).count()


def test_attributes_of_given_terms(revisions):
    frame = lambda *t: revisions.sparkSession.createDataFrame([(x,) for x in t], "t string")
    values = lambda f, p, *t: [r[0] for r in frame(*t).select(f(iri(p), F.col("t"))).collect()]
    n, g = (lambda i: revision_iri("N", i)), (lambda i: revision_iri("G", i))
    assert values(magic.object_of, "hist:globalState", n(5), g(6), "<x:a>", '"5"') == [g(5), g(6), None, None]
    assert values(magic.object_of, "hist:previousRevision", n(5), g(6)) == [n(4), g(5)] and values(magic.subject_of, "hist:previousRevision", n(5)) == [n(6)]
    assert values(magic.subject_of, "hist:additions", revision_iri("A", 5), g(5)) == [n(5), None]
    assert values(magic.subject_of, "hist:revisionId", '"8"^^<http://www.w3.org/2001/XMLSchema#integer>', '"8"') == [n(8), None]
    assert magic.seconds_of('"1970-01-01T01:00:10+01:00"^^<http://www.w3.org/2001/XMLSchema#dateTime>') == 10 == magic.seconds_of('"1970-01-01T00:00:10.5Z"^^<http://www.w3.org/2001/XMLSchema#dateTime>')
    assert magic.seconds_of('"1970-01-01T01:00:10"^^<http://www.w3.org/2001/XMLSchema#dateTime>') is magic.seconds_of('"x"') is None


def test_closure_of_a_cycle(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a")]
    df = spark.createDataFrame(e, "x string, y string")
    every = {(x, y) for x in "abc" for y in "abcd"}
    assert {tuple(r) for r in closure.closure(df).collect()} == every
    starts = spark.createDataFrame([("d",), ("b",)], "x string")
    assert {tuple(r) for r in closure.closure(df, starts).collect()} == {p for p in every if p[0] == "b"}
    assert closure.closure(df.where("false")).count() == 0


def test_intervals_against_sets(spark):
    rng = random.Random(2)
    present, axis = [], []
    for page in range(4):
        for rev in sorted(rng.sample(range(100), 12)):
            axis.append((page, rev))
            present += [(page, rev, f"s{page}", "p", o) for o in "abc" if rng.random() < 0.5]
    got = intervals.build(spark.createDataFrame(present + present[:5], "page int, rev bigint, s string, p string, o string"), spark.createDataFrame(axis, "page int, rev bigint")).collect()
    for rev in range(101):
        state = {(r.s, r.o) for r in got if r.rev_start <= rev < r.rev_end}
        want = set()
        for page in range(4):
            last = max((r for p, r in axis if p == page and r <= rev), default=None)
            want |= {(s, o) for p, r, s, _, o in present if p == page and r == last}
        assert state == want
    merged = intervals.union(spark.createDataFrame([("s", "p", "o", *x) for x in [(1, 3), (3, 5), (2, 4), (7, 9), (8, MAX), (6, 6)]], TRIPLES))
    assert sorted((r.rev_start, r.rev_end) for r in merged.collect()) == [(1, 5), (7, MAX)]
    ranges = spark.createDataFrame([("a", "p", "o", [1, 2, 3, 4]), ("b", "p", "o", [1, 1]), ("c", "p", "o", [1]), ("d", "p", "o", [3, 2])], "s string, p string, o string, ranges array<bigint>")
    assert sorted(r.s for r in intervals.unsorted_ranges(ranges).collect()) == ["b", "c", "d"]
