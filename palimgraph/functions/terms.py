"""RDF terms as canonical N-Triples strings, decoded by built-in functions.

A term column holds <iri>, _:label, "text", "text"@lang or "text"^^<datatype>;
strings have no datatype suffix.  Null stands for unbound or error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import SNAPSHOTS, XSD

NUMERIC = ("integer", "decimal", "double", "float", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
INTEGERS = tuple(n for n in NUMERIC if n not in ("decimal", "double", "float"))
#: Mixed radix of month, day, hour, minute and second, which may be 0 or a leap second.
_RADIX = (13, 32, 25, 62, 62)
_DATE = r"^([+-]?\d{4,})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def literal(text: str, *, lang: str | None = None, datatype: str | None = None) -> str:
    suffix = f"@{lang.lower()}" if lang else f"^^<{datatype}>" if datatype and datatype != XSD + "string" else ""
    return canonical(f'"{escape(text)}"{suffix}')


def canonical(term: str) -> str:
    """Integral numbers lose a plus sign and leading zeros, dates a plus sign."""
    for name in ("integer", "decimal"):
        end = f'"^^<{XSD}{name}>'
        if term.endswith(end):
            body = term[1 : -len(end)]
            return f'"{int(body)}{end}' if body.lstrip("+-").isdigit() else term
    return '"' + term[2:] if term.startswith('"+') and term.endswith(f'"^^<{XSD}dateTime>') else term


def canonical_column(term: Column) -> Column:
    """The same for a column of terms."""
    whole = F.regexp_extract(term, rf'^"([+-]?)0*(\d+)"\^\^<{XSD}(?:integer|decimal)>$', 2)
    minus = F.when(term.startswith('"-') & (whole != "0"), "-").otherwise("")
    number = F.concat(F.lit('"'), minus, whole, suffix_with_quote(term))
    date = F.concat(F.lit('"'), F.substring(term, 3, 1 << 30))
    return F.when(whole != "", number).when(term.startswith('"+') & term.endswith(f'"^^<{XSD}dateTime>'), date).otherwise(term)


def iri_column(namespace: str, name: Column) -> Column:
    return F.concat(F.lit("<" + namespace), name.cast("string"), F.lit(">"))


def escape_column(text: Column) -> Column:
    out = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def text_literal(text: Column) -> Column:
    return F.concat(F.lit('"'), escape_column(text), F.lit('"'))


def lang_literal(text: Column, lang: Column) -> Column:
    return F.concat(F.lit('"'), escape_column(text), F.lit('"@'), F.lower(lang))


def typed_literal(text: Column, datatype: str) -> Column:
    return F.concat(F.lit('"'), text.cast("string"), F.lit(f'"^^<{datatype}>'))


def integer_literal(number: Column) -> Column:
    return typed_literal(number, XSD + "integer")


def date_literal(seconds: Column) -> Column:
    """xsd:dateTime of seconds since 1970, in UTC whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    time = F.concat(two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60))
    return typed_literal(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), time, F.lit("Z")), XSD + "dateTime")


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def _after(t: Column) -> Column:
    """What follows the closing quote; the search goes backwards, so it doesn't read the text."""
    return F.substring_index(t, '"', -1)


def suffix_with_quote(t: Column) -> Column:
    return F.concat(F.lit('"'), _after(t))


def suffix(t: Column) -> Column:
    """What follows a literal's closing quote: '', '@lang' or '^^<datatype>'."""
    return F.when(is_literal(t), _after(t))


def lexical(t: Column) -> Column:
    """The text of a literal, unescaped."""
    body = F.substr(t, F.lit(2), F.length(t) - F.length(_after(t)) - 2)
    plain = body
    for a, b in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.when(is_literal(t), F.when(body.contains("\\"), plain).otherwise(body))


def string_of(t: Column) -> Column:
    """The text of a string literal, with or without language; null of others."""
    return F.when(t.endswith('"') | suffix(t).startswith("@"), lexical(t))


def text_of(t: Column) -> Column:
    """STR: the text of a literal, the address of an IRI."""
    return F.when(is_iri(t), F.substr(t, F.lit(2), F.length(t) - 2)).when(is_literal(t), lexical(t))


def plain(t: Column) -> Column:
    """Any bound term without its marks, for reports."""
    return F.coalesce(text_of(t), t)


def lang_of(t: Column) -> Column:
    s = suffix(t)
    return F.when(s.startswith("@"), F.substr(s, F.lit(2))).when(s.isNotNull(), "")


def datatype_of(t: Column) -> Column:
    s = suffix(t)
    return F.when(s.startswith("^^"), F.substr(s, F.lit(3))).when(s.startswith("@"), "<http://www.w3.org/1999/02/22-rdf-syntax-ns#langString>").when(s == "", f"<{XSD}string>")


def is_text(t: Column) -> Column:
    """Whether it is a string without language."""
    return t.endswith('"') & is_literal(t)


def is_datatype(t: Column, name: str) -> Column:
    return t.endswith(f'"^^<{XSD}{name}>')


def numeric_name(t: Column) -> Column:
    """The numeric datatype's local name, or null."""
    name = F.regexp_extract(t, rf'"\^\^<{XSD}(\w+)>$', 1)
    return F.when(name.isin(*NUMERIC), name)


def number(t: Column) -> Column:
    """The value of a numeric literal as a double."""
    return F.when(numeric_name(t).isNotNull(), lexical(t).try_cast("double"))


#: Integers and decimals of up to 20 digits before and 18 after the point are reckoned exactly.
EXACT = "decimal(38,18)"


def exact(t: Column) -> Column:
    """The value of an integer or decimal literal; null of others, and of too many digits."""
    value = let(lexical(t), lambda x: F.when(~x.rlike(r"\.\d{19}"), x.try_cast(EXACT)))
    return F.when(numeric_name(t).isin(*INTEGERS, "decimal"), value)


def number_rank(t: Column) -> Column:
    """0 integer, 1 decimal, 2 float, 3 double."""
    n = numeric_name(t)
    return F.when(n == "double", 3).when(n == "float", 2).when(n == "decimal", 1).when(n.isNotNull(), 0)


def with_numbers(df: DataFrame, term: str, at: str) -> DataFrame:
    """df with number, exact and number_rank of a term in columns (at_n, at_e, at_r); its datatype and text are read once."""
    df = df.withColumns({f"{at}_k": numeric_name(F.col(term)), f"{at}_t": lexical(F.col(term))})
    kind, text = F.col(f"{at}_k"), F.col(f"{at}_t")
    value = F.when(kind.isin(*INTEGERS, "decimal") & ~text.rlike(r"\.\d{19}"), text.try_cast(EXACT))
    rank = F.when(kind == "double", 3).when(kind == "float", 2).when(kind == "decimal", 1).when(kind.isNotNull(), 0)
    return df.withColumns({f"{at}_n": F.when(kind.isNotNull(), text.try_cast("double")), f"{at}_e": value, f"{at}_r": rank})


def number_text(value: Column, rank: Column, exact: Column) -> Column:
    """The lexical form of a number of the rank's datatype; exact: its value where that is known exactly."""
    size = F.abs(exact)
    digits = F.concat(F.when(exact < 0, "-").otherwise(""), F.floor(size).cast("decimal(38,0)").cast("string"))
    rest = F.rtrim(F.lpad(((size - F.floor(size)) * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)").cast("string"), 18, "0"), F.lit("0"))
    whole = F.coalesce(digits, F.format_string("%.0f", value))
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", value), "0+$", ""), r"\.$", "")
    short = F.coalesce(F.when(rest == "", digits).otherwise(F.concat(digits, F.lit("."), rest)), short)
    return F.when(value.isNull() | rank.isNull(), None).when(rank == 0, whole).when(rank == 1, short).otherwise(value.cast("string"))


def number_term(value: Column, rank: Column, exact: Column | None = None) -> Column:
    """A numeric literal of the datatype of the rank."""
    exact = F.lit(None).cast(EXACT) if exact is None else exact
    types = F.element_at(F.array(*(F.lit(f'"^^<{XSD}{n}>') for n in ("integer", "decimal", "float", "double"))), rank + 1)
    return let(F.struct(value.alias("v"), rank.alias("r"), exact.alias("e"), types.alias("t")), lambda x: F.concat(F.lit('"'), number_text(x.v, x.r, x.e), x.t))


def date_seconds(t: Column) -> Column:
    """Seconds since 1970 of a dateTime with a zone; null of others."""
    text = lexical(t)
    return F.when(is_datatype(t, "dateTime") & text.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.unix_seconds(F.try_to_timestamp(F.ltrim(text, F.lit("+")))))


def date_key(t: Column) -> Column:
    """A number in the order of dateTimes, months and days of 0 and second 60 included; another zone than UTC is reckoned to UTC."""

    def key(x: Column) -> Column:
        out = F.regexp_extract(x, _DATE, 1).try_cast("bigint")
        for i, radix in enumerate(_RADIX):
            out = out * radix + F.regexp_extract(x, _DATE, i + 2).try_cast("bigint")
        return out

    text = lexical(t)
    abroad = text.rlike(r"[+-]\d\d:\d\d$") & ~text.rlike(r"[+-]00:00$")
    return F.when(is_datatype(t, "dateTime"), let(F.when(abroad, F.coalesce(lexical(date_literal(date_seconds(t))), text)).otherwise(text), key))


def date_part(t: Column, part: int) -> Column:
    return F.when(is_datatype(t, "dateTime"), F.regexp_extract(lexical(t), _DATE, part).try_cast("bigint"))


def snapshot_kind(t: Column) -> Column:
    """N, G, A or D of a revision IRI, else null."""
    out = F.lit(None).cast("string")
    for kind in "NDAG":
        out = F.when(t.rlike(f"^<{SNAPSHOTS[kind]}-?[0-9]+>$"), kind).otherwise(out)
    return out


def snapshot_revision(t: Column) -> Column:
    return F.regexp_extract(t, f"^<{SNAPSHOTS['N']}(?:global/|additions/|deletions/)?(-?[0-9]+)>$", 1).try_cast("bigint")


def order_keys(t: Column, descending: bool = False) -> list[Column]:
    """Sort columns for the order unbound, blank nodes, IRIs, literals."""
    rank = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).otherwise(3)
    keys = [rank, number(t), exact(t), date_key(t), F.coalesce(text_of(t), t), t]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]
