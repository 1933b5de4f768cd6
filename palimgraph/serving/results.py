"""Result documents.  Rows come from a DataFrame partition by partition, so a
result needn't fit on the driver."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from ..vocabulary import PREFIXES

SELECT = ("application/sparql-results+json", "application/sparql-results+xml", "text/tab-separated-values", "text/csv")
ASK = ("application/sparql-results+json", "application/sparql-results+xml", "text/boolean")
GRAPH = ("application/n-triples", "text/turtle", "application/rdf+xml")
_UNESCAPED = {"\\\\": "\\", '\\"': '"', "\\n": "\n", "\\r": "\r", "\\t": "\t"}


def parts(term: str) -> tuple[str, str, str, str]:
    """(kind, text, language, datatype) of a term; kind is 'uri', 'bnode' or 'literal'."""
    if term.startswith("<"):
        return "uri", term[1:-1], "", ""
    if term.startswith("_:"):
        return "bnode", term[2:], "", ""
    at = term.rindex('"')
    body, rest, out, i = term[1:at], term[at + 1 :], [], 0
    while i < len(body):
        step = 2 if body[i] == "\\" else 1
        out.append(_UNESCAPED.get(body[i : i + step], body[i : i + step]))
        i += step
    return "literal", "".join(out), rest[1:] if rest.startswith("@") else "", rest[3:-1] if rest.startswith("^^") else ""


def _rows(df: DataFrame) -> Iterator[list[str | None]]:
    for row in df.toLocalIterator():
        yield list(row)


def json_rows(df: DataFrame) -> Iterator[str]:
    yield '{"head":{"vars":' + json.dumps(df.columns) + '},"results":{"bindings":['
    for k, row in enumerate(_rows(df)):
        bound = {}
        for name, term in zip(df.columns, row):
            if term is not None:
                kind, text, lang, datatype = parts(term)
                bound[name] = {"type": kind, "value": text} | ({"xml:lang": lang} if lang else {}) | ({"datatype": datatype} if datatype else {})
        yield "," * bool(k) + json.dumps(bound, ensure_ascii=False)
    yield "]}}"


def xml_rows(df: DataFrame) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>' + "".join(f"<variable name={quoteattr(c)}/>" for c in df.columns) + "</head><results>\n"
    for row in _rows(df):
        out = []
        for name, term in zip(df.columns, row):
            if term is not None:
                kind, text, lang, datatype = parts(term)
                mark = f" xml:lang={quoteattr(lang)}" if lang else f" datatype={quoteattr(datatype)}" if datatype else ""
                out.append(f"<binding name={quoteattr(name)}><{kind}{mark}>{escape(text)}</{kind}></binding>")
        yield "<result>" + "".join(out) + "</result>\n"
    yield "</results></sparql>\n"


def tsv_rows(df: DataFrame) -> Iterator[str]:
    """Terms as they are written in a query."""
    yield "\t".join("?" + c for c in df.columns) + "\n"
    for row in _rows(df):
        yield "\t".join(t or "" for t in row) + "\n"


def csv_rows(df: DataFrame) -> Iterator[str]:
    """Texts alone."""

    def line(values: list[str]) -> str:
        held = io.StringIO()
        csv.writer(held).writerow(values)
        return held.getvalue()

    yield line(df.columns)
    for row in _rows(df):
        yield line(["" if t is None else "_:" + parts(t)[1] if t.startswith("_:") else parts(t)[1] for t in row])


def ntriples(df: DataFrame) -> Iterator[str]:
    for s, p, o in _rows(df.select("s", "p", "o")):
        yield f"{s} {p} {o} .\n"


def turtle(df: DataFrame) -> Iterator[str]:
    """Predicates and objects of a subject together, names shortened."""
    spaces = sorted(PREFIXES.items(), key=lambda x: -len(x[1]))

    def short(term: str) -> str:
        if term == f"<{PREFIXES['rdf']}type>":
            return "a"
        if term.startswith("<"):
            for prefix, space in spaces:
                local = term[1 + len(space) : -1]
                if term.startswith("<" + space) and local.isalnum():
                    return f"{prefix}:{local}"
        return term

    yield "".join(f"@prefix {p}: <{space}> .\n" for p, space in PREFIXES.items())
    subject = None
    for s, p, o in _rows(df.select("s", "p", "o").orderBy("s", "p", "o")):
        yield f" ;\n  {short(p)} {short(o) if o.startswith('<') and short(o) != 'a' else o}" if s == subject else f"{' .' if subject else ''}\n{short(s) if short(s) != 'a' else s} {short(p)} {short(o) if o.startswith('<') and short(o) != 'a' else o}"
        subject = s
    yield " .\n" if subject else ""


def rdfxml(df: DataFrame) -> Iterator[str]:
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{PREFIXES["rdf"]}">\n'
    for s, p, o in _rows(df.select("s", "p", "o")):
        at = max(p.rfind("/"), p.rfind("#")) + 1
        space, local = p[1:at], p[at:-1]
        about = f"rdf:nodeID={quoteattr(s[2:])}" if s.startswith("_:") else f"rdf:about={quoteattr(s[1:-1])}"
        kind, text, lang, datatype = parts(o)
        if kind == "literal":
            mark = f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(datatype)}" if datatype else ""
            value = f"<p:{local} xmlns:p={quoteattr(space)}{mark}>{escape(text)}</p:{local}>"
        else:
            value = f"<p:{local} xmlns:p={quoteattr(space)} rdf:{'resource' if kind == 'uri' else 'nodeID'}={quoteattr(text)}/>"
        yield f"<rdf:Description {about}>{value}</rdf:Description>\n"
    yield "</rdf:RDF>\n"


def boolean(df: DataFrame, mime: str) -> Iterator[str]:
    word = "true" if df.first()[0] else "false"
    yield {
        "text/boolean": word,
        "application/sparql-results+json": '{"head":{},"boolean":' + word + "}",
        "application/sparql-results+xml": f'<?xml version="1.0" encoding="UTF-8"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{word}</boolean></sparql>\n',
    }[mime]


WRITERS: dict[str, Callable[[DataFrame], Iterator[str]]] = dict(zip(SELECT, (json_rows, xml_rows, tsv_rows, csv_rows))) | dict(zip(GRAPH, (ntriples, turtle, rdfxml)))


def write(df: DataFrame, form: str, mime: str) -> Iterator[str]:
    return boolean(df, mime) if form == "ASK" else WRITERS[mime](df)


def service_description() -> list[tuple[str, str, str]]:
    """Triples that say what the endpoint can do."""
    sd = "http://www.w3.org/ns/sparql-service-description#"
    out = [("_:service", f"<{PREFIXES['rdf']}type>", f"<{sd}Service>"), ("_:service", f"<{sd}feature>", f"<{sd}BasicFederatedQuery>")]
    out += [("_:service", f"<{sd}supportedLanguage>", f"<{sd}{x}>") for x in ("SPARQL10Query", "SPARQL11Query")]
    formats = ("SPARQL_Results_JSON", "SPARQL_Results_XML", "SPARQL_Results_TSV", "SPARQL_Results_CSV", "N-Triples", "Turtle", "RDF_XML")
    return out + [("_:service", f"<{sd}resultFormat>", f"<http://www.w3.org/ns/formats/{x}>") for x in formats]


__all__ = ["ASK", "GRAPH", "SELECT", "WRITERS", "parts", "service_description", "write"]
