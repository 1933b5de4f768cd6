"""Entity documents (JSON) to triples.

A document becomes one array of items, plain triples, snaks and sitelinks,
which is exploded once; snaks and sitelinks then meet the small tables of
properties and sites.  Everything is built-in functions over a variant, so a
member of another shape than expected ([] for {}) is no member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..shared import parts_for
from ..vocabulary import PREFIXES, TYPE, XSD, iri

PROPERTY_INFO = "pid string, datatype string, uri_pattern string"
SITES = "site_key string, url_template string, language string, site_group string"
_SNAK = "struct<snaktype: string, property: string, datavalue: struct<type: string, value: variant>>"
_CLAIM = f"struct<id: string, rank: string, mainsnak: {_SNAK}, qualifiers: variant, references: array<struct<snaks: variant>>>"
_TEXT = "struct<language: string, value: string>"
_DATATYPE_PROPERTIES = ("string", "external-id", "math", "globe-coordinate", "time", "quantity", "monolingualtext")
_COMPLEX = ("globe-coordinate", "time", "quantity")
_EARTH = PREFIXES["wd"] + "Q2"
_LANGUAGES = {"als": "gsw", "bat-smg": "sgs", "be-x-old": "be-tarask", "fiu-vro": "vro", "roa-rup": "rup", "simple": "en", "zh-classical": "lzh", "zh-min-nan": "nan", "zh-yue": "yue", "no": "nb", "crh": "crh-Latn", "cbk-zam": "cbk-x-zam", "map-bms": "jv-x-bms", "nrm": "fr-x-nrm", "roa-tara": "nap-x-tara", "de-formal": "de-x-formal", "es-formal": "es-x-formal", "hu-formal": "hu-x-formal", "nl-informal": "nl-x-informal", "eml": "egl", "simple-english": "en"}


def _get(v: Column, path: str, type_: str) -> Column:
    return F.try_variant_get(v, path, type_)


def _escaped_iri(text: Column) -> Column:
    """<...> of an address with the ten characters that N-Triples forbids percent-encoded."""
    out = F.trim(text)
    for c in ' "<>\\`^|{}':
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(F.lit("<"), out, F.lit(">"))


def _language(code: Column) -> Column:
    out = code
    for old, new in _LANGUAGES.items():
        out = F.when(code == old, new).otherwise(out)
    return out


def _lang_text(x: Column) -> Column:
    return T.lang_literal(x["value"], _language(x["language"]))


def _named(prefix: str, local: Column) -> Column:
    return F.concat(F.lit("<" + PREFIXES[prefix]), local, F.lit(">"))


def _item(s: Column, p: Column | str | None = None, o: Column | str | None = None, *, snak: Column | None = None, simple: str | None = None, complex_: str | None = None, context: Column | None = None, link: Column | None = None) -> Column:
    lit = lambda x, t="string": F.lit(x).cast(t) if x is None or isinstance(x, str) else x
    return F.struct(
        s.alias("s"), lit(p).alias("p"), lit(o).alias("o"), lit(simple).alias("simple"), lit(complex_).alias("complex"), lit(context).alias("context"),
        (F.lit(None).cast(_SNAK) if snak is None else snak).alias("snak"), (F.lit(None).cast(_LINK) if link is None else link).alias("link"),
    )


_LINK = "struct<site: string, title: string, badges: array<string>>"


def _terms(v: Column, subject: Column) -> list[Column]:
    def items(texts: Column, p: str) -> Column:
        return F.transform(texts, lambda x: _item(subject, iri(p), _lang_text(x)))

    texts = lambda path: F.map_values(_get(v, path, f"map<string, {_TEXT}>"))
    aliases = F.flatten(F.map_values(_get(v, "$.aliases", f"map<string, array<{_TEXT}>>")))
    return [items(texts("$.labels"), "rdfs:label"), items(texts("$.descriptions"), "schema:description"), items(aliases, "skos:altLabel")]


def _snaks(v: Column) -> Column:
    return F.coalesce(F.flatten(F.map_values(_get(v, "$", f"map<string, array<{_SNAK}>>"))), F.array().cast(f"array<{_SNAK}>"))


def _claim_items(subject: Column, claim: Column, best: Column) -> Column:
    """Items of one statement."""
    node = _named("wds", F.replace(claim["id"], F.lit("$"), F.lit("-")))
    main = claim["mainsnak"]
    rank = F.concat(F.lit(iri("wikibase:")[:-1]), F.initcap(claim["rank"]), F.lit("Rank>"))
    own = F.array(
        _item(subject, _named("p", main["property"]), node),
        _item(node, TYPE, iri("wikibase:Statement")),
        _item(node, iri("wikibase:rank"), rank),
        _item(node, snak=main, simple="ps", complex_="psv", context=node),
    )
    direct = F.when(claim["rank"] == best, F.array(_item(subject, snak=main, simple="wdt", context=node), _item(node, TYPE, iri("wikibase:BestRank"))))
    qualifiers = F.transform(_snaks(claim["qualifiers"]), lambda s: _item(node, snak=s, simple="pq", complex_="pqv", context=node))

    def reference(r: Column) -> Column:
        at = _named("wdref", F.sha1(F.to_json(r["snaks"])))
        heads = F.array(_item(node, iri("prov:wasDerivedFrom"), at), _item(at, TYPE, iri("wikibase:Reference")))
        return F.concat(heads, F.transform(_snaks(r["snaks"]), lambda s: _item(at, snak=s, simple="pr", complex_="prv", context=at)))

    references = F.flatten(F.transform(F.coalesce(claim["references"], F.array().cast("array<struct<snaks: variant>>")), reference))
    return F.flatten(F.filter(F.array(own, direct, qualifiers, references), lambda x: x.isNotNull()))


def _claims(v: Column, subject: Column) -> Column:
    groups = F.map_values(_get(v, "$.claims", f"map<string, array<{_CLAIM}>>"))

    def group(claims: Column) -> Column:
        best = F.when(F.exists(claims, lambda c: c["rank"] == "preferred"), "preferred").otherwise("normal")
        return F.flatten(F.transform(claims, lambda c: _claim_items(subject, c, best)))

    return F.flatten(F.transform(groups, group))


def _property_items(v: Column, subject: Column, pid: Column) -> Column:
    datatype = _get(v, "$.datatype", "string")
    kind = F.when(datatype.isin(*_DATATYPE_PROPERTIES), iri("owl:DatatypeProperty")).otherwise(iri("owl:ObjectProperty"))
    camel = F.array_join(F.transform(F.split(datatype, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")
    roles = (("directClaim", "wdt", kind), ("claim", "p", F.lit(iri("owl:ObjectProperty"))), ("statementProperty", "ps", kind), ("qualifier", "pq", kind), ("reference", "pr", kind))
    out = [_item(subject, TYPE, iri("wikibase:Property")), _item(subject, iri("wikibase:propertyType"), F.concat(F.lit(iri("wikibase:")[:-1]), camel, F.lit(">")))]
    for role, prefix, type_ in roles:
        out += [_item(subject, iri("wikibase:" + role), _named(prefix, pid)), _item(_named(prefix, pid), TYPE, type_)]
    no, other = _named("wdno", pid), F.concat(F.lit("_:novalue"), pid)
    out += [
        _item(subject, iri("wikibase:novalue"), no), _item(no, TYPE, iri("owl:Class")), _item(no, iri("owl:complementOf"), other),
        _item(other, TYPE, iri("owl:Restriction")), _item(other, iri("owl:onProperty"), _named("wdt", pid)), _item(other, iri("owl:someValuesFrom"), iri("owl:Thing")),
    ]
    full = []
    for role, prefix in (("statementValue", "psv"), ("qualifierValue", "pqv"), ("referenceValue", "prv")):
        full += [_item(subject, iri("wikibase:" + role), _named(prefix, pid)), _item(_named(prefix, pid), TYPE, iri("owl:ObjectProperty"))]
    return F.concat(F.array(*out), F.when(datatype.isin(*_COMPLEX), F.array(*full)).otherwise(F.slice(F.array(*full), 1, 0)))


def _decimal(text: Column) -> Column:
    """A decimal with its sign and without exponent; only integral ones lose the plus sign in the canonical form."""
    signed = F.when(text.rlike("^[+-]"), text).otherwise(F.concat(F.lit("+"), text))
    plain = F.when(signed.rlike("[eE]"), F.concat(F.when(signed.startswith("-"), "").otherwise("+"), F.format_string("%s", signed.try_cast("decimal(38,18)")))).otherwise(signed)
    return T.canonical_column(T.typed_literal(plain, XSD + "decimal"))


def _date(time: Column) -> Column:
    """+YYYY-MM-DDThh:mm:ssZ, the plus sign only of years above 0; nothing is normalised but the year's padding."""
    pattern = r"^([+-]?)0*(\d+)-(\d\d)-(\d\d)T(\d\d:\d\d:\d\d)Z$"
    part = lambda i: F.regexp_extract(time, pattern, i)
    year = F.lpad(part(2), F.greatest(F.length(part(2)), F.lit(4)), F.lit("0"))
    minus = F.when((part(1) == "-") & (part(2) != "0"), "-").otherwise("")
    return F.when(part(3) != "", T.typed_literal(F.concat(minus, year, F.lit("-"), part(3), F.lit("-"), part(4), F.lit("T"), part(5), F.lit("Z")), XSD + "dateTime"))


def _simple(kind: Column, v: Column, datatype: Column) -> Column:
    """The term of a value."""
    text = _get(v, "$", "string")
    string = (
        F.when(datatype == "commonsMedia", _escaped_iri(F.concat(F.lit("http://commons.wikimedia.org/wiki/Special:FilePath/"), text)))
        .when(datatype == "url", _escaped_iri(text))
        .when(datatype.isin("geo-shape", "tabular-data"), _escaped_iri(F.concat(F.lit("http://commons.wikimedia.org/data/main/"), text)))
        .otherwise(T.text_literal(text))
    )
    letter = F.when(_get(v, "$['entity-type']", "string") == "property", "P").otherwise("Q")
    entity = _named("wd", F.coalesce(_get(v, "$.id", "string"), F.concat(letter, _get(v, "$['numeric-id']", "string"))))
    globe = _get(v, "$.globe", "string")
    number = lambda path: _get(v, path, "double").cast("string")
    suffix = F.when(globe.isNull() | (globe == _EARTH), "").otherwise(F.concat(F.lit(" <"), globe, F.lit(">")))
    point = F.concat(F.lit("Point("), number("$.longitude"), F.lit(" "), number("$.latitude"), F.lit(")"), suffix)
    return (
        F.when(kind == "string", string)
        .when(kind == "wikibase-entityid", entity)
        .when(kind == "monolingualtext", T.lang_literal(_get(v, "$.text", "string"), _language(_get(v, "$.language", "string"))))
        .when(kind == "time", _date(_get(v, "$.time", "string")))
        .when(kind == "globecoordinate", T.typed_literal(point, PREFIXES["geo"] + "wktLiteral"))
        .when(kind == "quantity", _decimal(_get(v, "$.amount", "string")))
        .otherwise(T.text_literal(F.coalesce(text, F.to_json(v))))
    )


def _triple(s: Column, p: Column | str, o: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(s.alias("s"), lit(p).alias("p"), lit(o).alias("o"))


def _full(kind: Column, v: Column, s: Column, p: Column) -> Column:
    """The value node of a time, a coordinate or a quantity, and the triple that points to it; else null."""
    node = _named("wdv", F.sha1(F.concat(kind, F.to_json(v))))
    of = lambda cls, *rest: F.array(_triple(s, p, node), _triple(node, TYPE, iri("wikibase:" + cls)), *rest)
    at = lambda name, o: _triple(node, iri("wikibase:" + name), o)
    integer = lambda path: T.integer_literal(_get(v, path, "bigint"))
    double = lambda path: T.typed_literal(_get(v, path, "double").cast("string"), XSD + "double")
    address = lambda path: _escaped_iri(_get(v, path, "string"))
    unit = _get(v, "$.unit", "string")
    return (
        F.when(kind == "time", of("TimeValue", at("timeValue", _date(_get(v, "$.time", "string"))), at("timePrecision", integer("$.precision")), at("timeTimezone", integer("$.timezone")), at("timeCalendarModel", address("$.calendarmodel"))))
        .when(kind == "globecoordinate", of("GlobecoordinateValue", at("geoLatitude", double("$.latitude")), at("geoLongitude", double("$.longitude")), at("geoPrecision", double("$.precision")), at("geoGlobe", address("$.globe"))))
        .when(kind == "quantity", of(
            "QuantityValue", at("quantityAmount", _decimal(_get(v, "$.amount", "string"))), at("quantityUpperBound", _decimal(_get(v, "$.upperBound", "string"))),
            at("quantityLowerBound", _decimal(_get(v, "$.lowerBound", "string"))), at("quantityUnit", F.when(unit == "1", iri("wd:Q199")).otherwise(_escaped_iri(unit))),
        ))
    )


def _expanded(snak: Column, datatype: Column) -> Column:
    """Triples of a snak item."""
    s, pid = F.col("s"), snak["property"]
    named = lambda c: F.concat(F.coalesce(*[F.when(F.col(c) == n, "<" + PREFIXES[n]) for n in ("wdt", "ps", "psv", "pq", "pqv", "pr", "prv")]), pid, F.lit(">"))
    kind, v = snak["datavalue"]["type"], snak["datavalue"]["value"]
    some = F.concat(F.lit("_:"), F.sha1(F.concat(F.col("context"), pid)))
    simple = (
        F.when(snak["snaktype"] == "value", F.array(_triple(s, named("simple"), _simple(kind, v, datatype))))
        .when(snak["snaktype"] == "somevalue", F.array(_triple(s, named("simple"), some)))
        .when(snak["snaktype"] == "novalue", F.array(_triple(s, TYPE, _named("wdno", pid))))
    )
    full = F.when((snak["snaktype"] == "value") & F.col("complex").isNotNull(), _full(kind, v, s, named("complex")))
    return F.flatten(F.filter(F.array(simple, full), lambda x: x.isNotNull()))


def _link_triples() -> Column:
    """Triples of a sitelink whose site is known."""
    link = F.col("link")
    title = F.url_encode(F.replace(link["title"], F.lit(" "), F.lit("_")))
    for x, y in (("%3A", ":"), ("%2F", "/"), ("%28", "("), ("%29", ")"), ("%2C", ","), ("%21", "!"), ("%40", "@"), ("%24", "$"), ("%3B", ";"), ("+", "%2B")):
        title = F.replace(title, F.lit(x), F.lit(y))
    address = F.replace(F.col("url_template"), F.lit("$1"), title)
    article, lang = _escaped_iri(address), _language(F.col("language"))
    wiki = F.concat(F.lit("<"), F.element_at(F.split(address, "wiki/"), 1), F.lit(">"))
    own = F.array(
        _triple(article, TYPE, iri("schema:Article")), _triple(article, iri("schema:about"), F.col("s")),
        _triple(article, iri("schema:inLanguage"), T.text_literal(lang)), _triple(article, iri("schema:name"), T.lang_literal(link["title"], lang)),
        _triple(article, iri("schema:isPartOf"), wiki), _triple(wiki, iri("wikibase:wikiGroup"), T.text_literal(F.col("site_group"))),
    )
    badges = F.transform(F.coalesce(link["badges"], F.array().cast("array<string>")), lambda b: _triple(article, iri("wikibase:badge"), _named("wd", b)))
    return F.concat(own, badges)


def entity_triples(documents: DataFrame, property_info: DataFrame | None = None, sites: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, rev, text) -> (page, rev, s, p, o), distinct, and (page, rev) of the documents that could be parsed.

    property_info (pid, datatype, uri_pattern): an unknown property holds
    strings.  sites (site_key, url_template with $1, language, site_group): a
    link to an unknown site gives nothing.  A redirect is one owl:sameAs; an
    entity of another kind is parsed and gives nothing; a text that is null or
    no JSON object isn't parsed."""
    spark: SparkSession = documents.sparkSession
    info = (property_info if property_info is not None else spark.createDataFrame([], PROPERTY_INFO)).select(F.col("pid"), F.regexp_replace("datatype", "^.*#", "").alias("datatype"))
    camel = {"CommonsMedia": "commonsMedia", "Url": "url", "GeoShape": "geo-shape", "TabularData": "tabular-data"}
    for full, short in camel.items():
        info = info.withColumn("datatype", F.when(F.col("datatype") == full, short).otherwise(F.col("datatype")))
    known = sites if sites is not None else spark.createDataFrame([], SITES)
    redirect = r'^\{"entity":"(\w+)","redirect":"(\w+)"\}$'
    # By page before anything is made of a document: what is distinct is distinct in its page, so only documents are shuffled.
    documents = documents.select("page", "rev", "text").repartition(parts_for(documents, 1 << 20), "page")
    docs = documents.select("page", "rev", F.try_parse_json("text").alias("v"), F.regexp_extract("text", redirect, 1).alias("from"), F.regexp_extract("text", redirect, 2).alias("to"))
    type_, id_ = _get(F.col("v"), "$.type", "string"), _get(F.col("v"), "$.id", "string")
    docs = docs.withColumn("type", type_).withColumn("id", id_)
    docs = docs.where((F.col("from") != "") | (F.col("id").isNotNull() & F.col("type").isNotNull()))
    parsed = docs.select("page", "rev").distinct()
    v, subject = F.col("v"), _named("wd", F.col("id"))
    links = F.transform(F.map_values(_get(v, "$.sitelinks", f"map<string, {_LINK}>")), lambda x: _item(subject, link=x))
    common = [*_terms(v, subject), _claims(v, subject)]
    none = lambda parts: F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))
    items = (
        F.when(F.col("from") != "", F.array(_item(_named("wd", F.col("from")), iri("owl:sameAs"), _named("wd", F.col("to")))))
        .when(F.col("type") == "item", none([F.array(_item(subject, TYPE, iri("wikibase:Item"))), *common, links]))
        .when(F.col("type") == "property", none([_property_items(v, subject, F.col("id")), *common]))
    )
    rows = docs.select("page", "rev", F.inline(items))
    rows = rows.join(F.broadcast(info), F.col("snak.property") == F.col("pid"), "left").join(F.broadcast(known), F.col("link.site") == F.col("site_key"), "left")
    made = (
        F.when(F.col("p").isNotNull(), F.array(_triple(F.col("s"), F.col("p"), F.col("o"))))
        .when(F.col("snak").isNotNull(), _expanded(F.col("snak"), F.coalesce("datatype", F.lit("string"))))
        .when(F.col("site_key").isNotNull(), _link_triples())
    )
    out = rows.select("page", "rev", F.explode(made).alias("t")).select("page", "rev", "t.*")
    return out.where("s is not null and p is not null and o is not null").distinct(), parsed
