"""The query language over small graphs, and the protocol."""

import json

import pytest

from palimgraph.functions import terms as T
from palimgraph.plans.optimize import pick, simplify_path
from palimgraph.plans.algebra import Pattern, Var
from palimgraph.plans.parser import SyntaxError_, UnsupportedQuery, parse
from palimgraph.serving import endpoint, results
from palimgraph.serving.negotiation import negotiate
from palimgraph.store import HistoryStore
from palimgraph.vocabulary import MAX, REVISIONS, TRIPLES, XSD, iri, snapshot

ROWS = [
    ("<x:a>", "<x:p>", '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("<x:b>", "<x:p>", '"1.50"^^<http://www.w3.org/2001/XMLSchema#decimal>'), ("<x:c>", "<x:p>", '"ten"'),
    ("<x:a>", "<x:q>", '"Straße"@de'), ("<x:b>", "<x:q>", '"say \\"hi\\"\\n"'), ("<x:c>", "<x:q>", "_:n"), ("<x:a>", "<x:next>", "<x:b>"), ("<x:b>", "<x:next>", "<x:a>"),
    ("<x:d>", "<x:date>", '"-0200-00-00T00:00:00Z"^^<http://www.w3.org/2001/XMLSchema#dateTime>'), ("<x:e>", "<x:date>", '"2020-12-31T23:59:60Z"^^<http://www.w3.org/2001/XMLSchema#dateTime>'),
]


@pytest.fixture(scope="module")
def store(spark):
    return HistoryStore(spark, spark.createDataFrame([(*r, 1, MAX) for r in ROWS], TRIPLES))


def ask(store, text):
    return sorted(tuple(r) for r in store.sparql("PREFIX x: <x:> " + text).collect())


INT, DEC = f'"^^<{XSD}integer>', f'"^^<{XSD}decimal>'


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT ?s { ?s x:p ?v FILTER(?v > 0) }", [("<x:a>",), ("<x:b>",)]),
        ("SELECT ?s { ?s x:p ?v FILTER(!(?v > 1)) }", [("<x:a>",)]),  # an error is neither
        ("SELECT ?s { ?s x:p ?v FILTER(?v = 1.0 || ?v = 'ten') }", [("<x:a>",), ("<x:c>",)]),
        ("SELECT ?s { ?s x:date ?d FILTER(?d < '2020-01-01T00:00:00Z'^^xsd:dateTime) }", [("<x:d>",)]),
        ("SELECT (STR(?v) AS ?t) (LANG(?v) AS ?l) { x:a x:q ?v }", [('"Straße"', '"de"')]),
        ("SELECT (STRLEN(?v) AS ?n) { x:b x:q ?v }", [(f'"9{INT}',)]),
        ("SELECT (SUM(?v) AS ?n) (COUNT(?v) AS ?k) { VALUES ?s { x:a x:b } ?s x:p ?v }", [(f'"2.5{DEC}', f'"2{INT}')]),
        ("SELECT (1 / 0 AS ?n) (2 + 3 * 4 AS ?k) (-2 - 1 AS ?m) {}", [(None, f'"14{INT}', f'"-3{INT}')]),
        ("SELECT ?x ?y { ?x x:next+ ?y }", [("<x:a>", "<x:a>"), ("<x:a>", "<x:b>"), ("<x:b>", "<x:a>"), ("<x:b>", "<x:b>")]),
        ("SELECT ?y { x:zzz x:next* ?y }", [("<x:zzz>",)]),
        ("SELECT ?y { x:a (x:next|^x:next)/x:p ?y }", [(f'"1.50{DEC}',)] * 2),
        ("SELECT ?s { { ?s x:p 'ten' } UNION { ?s x:next x:a } }", [("<x:b>",), ("<x:c>",)]),
        ("SELECT ?s ?n { ?s x:p ?v OPTIONAL { ?s x:next ?n } }", [("<x:a>", "<x:b>"), ("<x:b>", "<x:a>"), ("<x:c>", None)]),
        ("SELECT ?s { ?s x:p ?v MINUS { ?s x:next ?n } }", [("<x:c>",)]),
        ("SELECT ?s { ?s x:p ?v FILTER NOT EXISTS { ?s x:next ?n FILTER(?v < 1.2) } }", [("<x:b>",), ("<x:c>",)]),
        ("ASK { x:a x:next x:b }", [(True,)]), ("ASK { x:a x:next x:c }", [(False,)]),
        ("SELECT (COUNT(DISTINCT ?s) AS ?n) { ?s ?p ?o FILTER isBlank(?o) }", [(f'"1{INT}',)]),
        ("SELECT ?g { GRAPH ?g { x:a x:next x:b } }", [("<http://www.wikidata.org/revision/additions/1>",)]),
        ("SELECT ?a ?b { VALUES (?a ?b) { (1 UNDEF) } }", [(f'"1{INT}', None)]),
        ("SELECT (GROUP_CONCAT(DISTINCT ?t ; SEPARATOR='|') AS ?all) { ?s x:next ?n BIND(STRAFTER(STR(?s), ':') AS ?t) }", [('"a|b"',)]),
    ],
)
def test_queries(store, text, want):
    assert ask(store, text) == want


def test_paths_stay_in_their_graph(spark):
    rows = [("<x:a>", "<x:n>", "<x:b>", 1, 3), ("<x:b>", "<x:n>", "<x:c>", 2, MAX)]
    h = HistoryStore(spark, spark.createDataFrame(rows, TRIPLES), spark.createDataFrame([(r, None, "<x:a>", r, "A", None) for r in range(1, 121)], REVISIONS))
    found = h.sparql("SELECT ?r ?y { ?r hist:globalState ?g . GRAPH ?g { <x:a> <x:n>+ ?y } }").collect()
    end = lambda x: x.rsplit("/", 1)[1]
    assert sorted((end(r.r), r.y) for r in found) == [("1>", "<x:b>"), ("2>", "<x:b>"), ("2>", "<x:c>")]
    stars = h.sparql("SELECT ?g ?y { VALUES ?i { 2 3 } ?r hist:revisionId ?i ; hist:globalState ?g . GRAPH ?g { <x:a> <x:n>* ?y } }").collect()
    assert sorted((end(r.g), r.y) for r in stars) == [("2>", "<x:a>"), ("2>", "<x:b>"), ("2>", "<x:c>"), ("3>", "<x:a>")]


def test_order_is_by_kind_and_value(store):
    rows = [r.o for r in store.sparql("PREFIX x: <x:> SELECT ?o { ?s ?p ?o FILTER(?p != x:date && ?p != x:q || isBlank(?o)) } ORDER BY ?o").collect()]
    assert rows == ["_:n", "<x:a>", "<x:b>", '"ten"', f'"1{INT}', f'"1.50{DEC}']
    assert [r.s for r in store.sparql("PREFIX x: <x:> SELECT ?s { ?s x:date ?d } ORDER BY DESC(?d)").collect()] == ["<x:e>", "<x:d>"]


LOOSE = [
    "SELECT * { ?s x:next ?t BIND(IRI(STR(?t)) AS ?u) ?u x:p ?v }", "SELECT * { ?s x:p ?v OPTIONAL { ?s x:next ?n } ?n x:q ?w }", "SELECT * { VALUES (?s ?t) { (x:a UNDEF) (UNDEF x:b) } ?s x:next ?t }",
    "SELECT * { ?s x:p ?v OPTIONAL { ?s x:next ?n } OPTIONAL { ?n x:p ?w } }", "SELECT * { ?s x:p ?v OPTIONAL { ?s x:next ?n } MINUS { ?n x:p ?v } }",
    "SELECT * { ?s x:p ?v OPTIONAL { ?s x:next ?n } FILTER EXISTS { ?s x:q ?n } }",
]


@pytest.mark.parametrize("text", LOOSE)
def test_variables_that_may_be_unbound_join_by_equality(spark, store, text):
    """Only rows that leave a shared variable unbound meet all rows of the other side, which has no key then."""
    plan = store.sparql("PREFIX x: <x:> " + text)._jdf.queryExecution().optimizedPlan().toString()
    for join in [line for line in plan.splitlines() if " Join " in f" {line.strip()} " or "Join " in line]:
        assert " OR " not in join.upper() or "ISNULL" not in join.upper(), join


def test_bind_joins_without_nested_loop(store):
    for text in ("SELECT * { ?s x:next ?t BIND(?t AS ?u) ?u x:p ?v }", "SELECT * { ?s x:p ?v OPTIONAL { ?s x:next ?n } OPTIONAL { ?s x:q ?w } }"):
        plan = store.sparql("PREFIX x: <x:> " + text)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unbound_variables_agree_with_all(store):
    """Against the definition: mappings join where they agree in what both bind."""
    import itertools

    values = {"a": [None, "<x:1>", "<x:2>"], "b": [None, "<x:1>"]}
    left = [(a, b, f'"l{i}"') for i, (a, b) in enumerate(itertools.product(values["a"], values["b"]))]
    right = [(a, b, f'"r{i}"') for i, (a, b) in enumerate(itertools.product(values["a"][:2], values["b"]))]
    show = lambda rows: " ".join("(" + " ".join("UNDEF" if x is None else x for x in r) + ")" for r in rows)
    agree = lambda x, y: all(p is None or q is None or p == q for p, q in zip(x[:2], y[:2]))
    share = lambda x, y: any(p is not None and q is not None for p, q in zip(x[:2], y[:2]))
    both = lambda x, y: tuple(p or q for p, q in zip(x[:2], y[:2])) + (x[2], y[2])
    key = lambda rows: sorted(map(str, rows))
    v, w = f"VALUES (?a ?b ?l) {{ {show(left)} }}", f"VALUES (?a ?b ?r) {{ {show(right)} }}"
    joined = [both(x, y) for x in left for y in right if agree(x, y)]
    alone = [(*x[:2], x[2], None) for x in left if not any(agree(x, y) for y in right)]
    assert key(map(tuple, store.sparql(f"SELECT ?a ?b ?l ?r {{ {v} {{ {w} }} }}").collect())) == key(joined)
    assert key(map(tuple, store.sparql(f"SELECT ?a ?b ?l ?r {{ {v} OPTIONAL {{ {w} }} }}").collect())) == key(joined + alone)
    assert key(map(tuple, store.sparql(f"SELECT ?a ?b ?l {{ {v} MINUS {{ {w} }} }}").collect())) == key(x for x in left if not any(agree(x, y) and share(x, y) for y in right))
    assert key(map(tuple, store.sparql(f"SELECT ?a ?b ?l {{ {v} FILTER EXISTS {{ {w} }} }}").collect())) == key(x for x in left if any(agree(x, y) for y in right))


def test_computed_terms_are_computed_once(store):
    """Nesting doesn't multiply a plan's size."""
    size = lambda e: len(store.sparql(f"SELECT ({e} AS ?x) {{ ?s <x:p> ?v }}")._jdf.queryExecution().optimizedPlan().toString())
    one, three = size("STR(STRLEN(STR(?v)) + ?v)"), size("STR(STR(STR(STRLEN(STR(?v)) + ?v)))")
    assert three < 2 * one
    assert store.sparql("SELECT (STRLEN(STR(1.50 + STRLEN(STR(?s)))) AS ?n) { ?s <x:next> <x:a> }").first().n == f'"3{INT}'


def test_construct_and_describe(store):
    made = store.sparql("PREFIX x: <x:> CONSTRUCT { ?b x:of ?s . ?s x:is _:k . ?v x:bad 1 } { ?s x:next ?b ; x:p ?v }").collect()
    assert {(r.s, r.o) for r in made if r.p == "<x:of>"} == {("<x:b>", "<x:a>"), ("<x:a>", "<x:b>")}
    assert len({r.o for r in made if r.p == "<x:is>"}) == 2 and not [r for r in made if r.p == "<x:bad>"]
    assert {(r.s, r.p) for r in store.sparql("DESCRIBE <x:a>").collect()} == {("<x:a>", "<x:p>"), ("<x:a>", "<x:q>"), ("<x:a>", "<x:next>"), ("<x:b>", "<x:next>")}


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?s { ?s ?p }", "SELECT ?s { ?s ?p ?o", "SELECT * { ?s zz:p ?o }", "FOO { }", "SELECT ?s { ?s ?p ?o } LIMIT x"])
def test_malformed(text):
    with pytest.raises(SyntaxError_):
        parse(text)


def test_updates_and_unknown_services_are_refused(store):
    with pytest.raises(UnsupportedQuery):
        parse("INSERT DATA { <x:a> <x:b> <x:c> }")
    with pytest.raises(UnsupportedQuery):
        store.sparql("SELECT * { SERVICE <x:none> { ?s ?p ?o } }")


def test_rewrites_and_order():
    assert simplify_path(("/", "<p>", ("*", "<p>"))) == ("+", "<p>") == simplify_path(("/", ("*", "<p>"), "<p>"))
    assert simplify_path(("/", "<q>", ("*", "<p>"))) == ("/", "<q>", ("*", "<p>"))
    patterns = [Pattern(Var("s"), "<p>", Var("o")), Pattern(Var("s"), "<q>", "<x>"), Pattern(Var("r"), iri("schema:author"), '"Bob"')]
    assert pick(patterns, set()) == 2 and pick(patterns[:2], {"s"}) in (0, 1)


@pytest.mark.parametrize("text, canonical", [('"+5"^^<%sinteger>', '"5"^^<%sinteger>'), ('"-007"^^<%sdecimal>', '"-7"^^<%sdecimal>'), ('"+19.50"^^<%sdecimal>', '"+19.50"^^<%sdecimal>'), ('"+2020-01-01T00:00:00Z"^^<%sdateTime>', '"2020-01-01T00:00:00Z"^^<%sdateTime>'), ('"-9223372036854775808"^^<%sinteger>', '"-9223372036854775808"^^<%sinteger>'), ('"P1D"^^<%sduration>', '"P1D"^^<%sduration>')])
def test_canonical_terms(spark, text, canonical):
    from pyspark.sql import functions as F

    text, canonical = text % XSD, canonical % XSD
    assert T.canonical(text) == canonical
    assert spark.range(1).select(T.canonical_column(F.lit(text)).alias("t")).first().t == canonical


def test_texts_survive(spark):
    from pyspark.sql import functions as F

    for t in ["", "a", 'q"q', "back\\slash\\n", "line\nbreak\ttab\r", "foofoofoofoo", "é\U0001f600"]:
        got = spark.createDataFrame([(t,)], "t string").select(T.lexical(T.text_literal(F.col("t"))).alias("back"), T.text_literal(F.col("t")).alias("term")).first()
        assert got.back == t and got.term == T.literal(t) and results.parts(got.term)[1] == t
    assert snapshot(iri("http://www.wikidata.org/revision/global/5")) == ("G", 5) and snapshot("<x:a>") is None


AVAILABLE = ["application/ld+json", "application/json"]


@pytest.mark.parametrize("accept, mime", [(None, 0), ("*/*", 0), ("*/*; charset=UTF-8", 0), ("application/*", 0), ("application/*;charset=UTF-8", 0), ("application/json", 1), ("application/ld+json", 0), ("application/xml", None), ("application/json;q=0.4, application/ld+json;q=0.5", 0), ("text/html, */*;q=0.1", 0)])
def test_negotiation(accept, mime):
    assert negotiate(accept, AVAILABLE) == (None if mime is None else AVAILABLE[mime])


@pytest.mark.parametrize("accept", ["text", "a/b/c", "a/b;q=2", "a/b;q=x", "a/b;q"])
def test_malformed_ranges(accept):
    with pytest.raises(ValueError):
        negotiate(accept, AVAILABLE)


def test_protocol(store, tmp_path):
    log = endpoint.QueryLog(str(tmp_path / "log"), most=1)
    q = "SELECT ?s ?v\n { ?s <x:q> ?v } ORDER BY ?s"
    status, mime, body = endpoint.answer(store, q, "application/sparql-results+json", log=log)
    found = json.loads("".join(body))
    assert (status, mime) == (200, "application/sparql-results+json") and found["head"]["vars"] == ["s", "v"]
    assert found["results"]["bindings"][0]["v"] == {"type": "literal", "value": "Straße", "xml:lang": "de"}
    text = {m: "".join(endpoint.answer(store, q, m)[2]) for m in results.SELECT}
    assert text["text/csv"].startswith("s,v\r\nx:a,Straße\r\n") and '<literal xml:lang="de">Straße</literal>' in text["application/sparql-results+xml"]
    assert text["text/tab-separated-values"].splitlines()[1] == '<x:a>\t"Straße"@de'
    for m in results.GRAPH:
        out = "".join(endpoint.answer(store, "CONSTRUCT { ?s <x:q> ?v } { ?s <x:q> ?v }", m)[2])
        assert "Straße" in out
    for m in results.ASK:
        assert "true" in "".join(endpoint.answer(store, "ASK { ?s <x:q> ?v }", m)[2])
    status, mime, body = endpoint.answer(store, "SELECT * { SERVICE <x:none> { ?s ?p ?o } }")
    assert (status, mime) == (400, "text/plain") and "<x:none>" in "".join(body)
    assert endpoint.answer(store, "SELECT (<x:nofunction>(1) AS ?x) {}")[0] == 400
    assert endpoint.answer(store, q, "image/png")[0] == 406 and endpoint.answer(store, "SELEC", None)[0] == 400 and endpoint.answer(store, q, "bad")[0] == 400
    endpoint.answer(store, q, None, log=log)
    log.close()
    lines = next((tmp_path / "log").iterdir()).read_text().splitlines()
    assert set(lines) == {" ".join(q.split())} and len(lines) == 2


def test_server(store):
    import threading
    import urllib.parse
    import urllib.request

    server = endpoint.serve(store, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    get = lambda url, data=None, kind=None: urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": kind} if kind else {})).read().decode()
    q = "ASK { ?s <x:q> ?v }"
    assert '"boolean":true' in get(f"{at}/sparql?query={urllib.parse.quote(q)}") == get(f"{at}/sparql", q.encode(), "application/sparql-query")
    assert "<form" in get(f"{at}/")
    for accept, part in (("text/turtle", "@prefix"), ("application/rdf+xml", "<rdf:RDF"), ("application/n-triples", "Service>")):
        assert part in urllib.request.urlopen(urllib.request.Request(f"{at}/sparql", headers={"Accept": accept})).read().decode()
    assert "Service>" in get(f"{at}/sparql") and json.loads(get(f"{at}/prefixes"))["wd"]
    server.shutdown()
