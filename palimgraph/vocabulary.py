"""Names, table schemas and the open end of an interval."""

from __future__ import annotations

#: End of an interval that still holds.
MAX = 9223372036854775807

PREFIXES = dict(
    line.split()
    for line in """
rdf http://www.w3.org/1999/02/22-rdf-syntax-ns#
rdfs http://www.w3.org/2000/01/rdf-schema#
xsd http://www.w3.org/2001/XMLSchema#
owl http://www.w3.org/2002/07/owl#
hist http://wikiba.se/history/ontology#
wikibase http://wikiba.se/ontology#
schema http://schema.org/
skos http://www.w3.org/2004/02/skos/core#
geo http://www.opengis.net/ont/geosparql#
prov http://www.w3.org/ns/prov#
cc http://creativecommons.org/ns#
dct http://purl.org/dc/terms/
ontolex http://www.w3.org/ns/lemon/ontolex#
wd http://www.wikidata.org/entity/
wds http://www.wikidata.org/entity/statement/
wdv http://www.wikidata.org/value/
wdref http://www.wikidata.org/reference/
wdt http://www.wikidata.org/prop/direct/
wdtn http://www.wikidata.org/prop/direct-normalized/
wdno http://www.wikidata.org/prop/novalue/
wdata http://www.wikidata.org/wiki/Special:EntityData/
p http://www.wikidata.org/prop/
ps http://www.wikidata.org/prop/statement/
psv http://www.wikidata.org/prop/statement/value/
psn http://www.wikidata.org/prop/statement/value-normalized/
pq http://www.wikidata.org/prop/qualifier/
pqv http://www.wikidata.org/prop/qualifier/value/
pqn http://www.wikidata.org/prop/qualifier/value-normalized/
pr http://www.wikidata.org/prop/reference/
prv http://www.wikidata.org/prop/reference/value/
prn http://www.wikidata.org/prop/reference/value-normalized/
""".split("\n")
    if line
)
REVISION = "http://www.wikidata.org/revision/"
#: Namespaces of revision IRIs by what they stand for: the revision, the state after it, what it added, what it deleted.
SNAPSHOTS = {"N": REVISION, "G": REVISION + "global/", "A": REVISION + "additions/", "D": REVISION + "deletions/"}
XSD = PREFIXES["xsd"]
TYPE = f"<{PREFIXES['rdf']}type>"

TRIPLES = "s string, p string, o string, rev_start bigint, rev_end bigint"
REVISIONS = "revision_id bigint, parent_id bigint, topic string, ts_sec bigint, contributor string, comment string"


def iri(name: str) -> str:
    """The term of prefix:local or of a full IRI."""
    prefix, _, local = name.partition(":")
    return f"<{PREFIXES[prefix]}{local}>" if prefix in PREFIXES and not local.startswith("//") else f"<{name}>"


def revision_iri(kind: str, revision: int) -> str:
    return f"<{SNAPSHOTS[kind]}{revision}>"


def snapshot(term: str) -> tuple[str, int] | None:
    """(kind, revision) of a revision IRI's term, None of any other."""
    for kind in "GADN":
        start = "<" + SNAPSHOTS[kind]
        number = term[len(start) : -1]
        if term.startswith(start) and number.lstrip("-").isdigit():
            return kind, int(number)
    return None
