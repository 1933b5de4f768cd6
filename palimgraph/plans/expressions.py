"""SPARQL expressions as columns.  An error is null, as an unbound value is;
logic is three-valued either way."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms as T
from ..vocabulary import XSD
from .algebra import Var


@dataclass
class Val:
    """A value: 'term' (N-Triples), 'bool', 'text' (a string without language) or 'num' (a double, with the rank of its
    datatype and, where all that it comes from are integers or decimals, its exact value)."""

    kind: str
    col: Column
    rank: Any = None
    const: str | None = None
    exact: Any = None
    whole: Any = None  # a small integer as such
    simple: bool = False  # a variable or a constant, which may be looked at often
    held: Any = None  # string() where that is a column already
    decoded: Any = None  # number(), exactly() and number_rank() where these are columns already

    def _of(self, f: Callable[[Column], Column]) -> Column:
        """A function of a term, which is computed once."""
        return f(self.col) if self.simple else T.let(self.col, f)

    def term(self) -> Column:
        if self.kind == "bool":
            return F.when(self.col, f'"true"^^<{XSD}boolean>').when(~self.col, f'"false"^^<{XSD}boolean>')
        if self.kind == "text":
            return T.text_literal(self.col)
        if self.whole is not None:
            return T.integer_literal(self.whole)
        return T.number_term(self.col, self.rank, self.exact) if self.kind == "num" else self.col

    def exactly(self) -> Column:
        if self.whole is not None:
            return self.whole.cast(T.EXACT)
        if self.kind == "num" and self.exact is not None:
            return self.exact
        if self.decoded is not None:
            return self.decoded[1]
        return self._of(T.exact) if self.kind == "term" else F.lit(None).cast(T.EXACT)

    def small(self) -> bool:
        """Whether it is a constant that a double holds exactly, and that no rounding of another number passes."""
        if not self.const or not self.const.startswith('"'):
            return False
        text = self.const[1 : self.const.rindex('"')]
        return text.lstrip("+-").isdigit() and abs(int(text)) < 1 << 53

    def number(self) -> Column:
        if self.kind == "num":
            return self.col
        if self.decoded is not None:
            return self.decoded[0]
        return self._of(T.number) if self.kind == "term" else F.lit(None).cast("double")

    def number_rank(self) -> Column:
        if self.kind == "num":
            return self.rank
        if self.decoded is not None:
            return self.decoded[2]
        return self._of(T.number_rank) if self.kind == "term" else F.lit(None).cast("int")

    def text(self) -> Column:
        """The text of STR."""
        if self.kind == "text":
            return self.col
        if self.kind == "bool":
            return F.when(self.col, "true").when(~self.col, "false")
        if self.whole is not None:
            return self.whole.cast("string")
        if self.kind == "num":
            exact = F.lit(None).cast(T.EXACT) if self.exact is None else self.exact
            return T.let(F.struct(self.col.alias("v"), self.rank.alias("r"), exact.alias("e")), lambda x: T.number_text(x.v, x.r, x.e))
        return self._of(T.text_of) if self.held is None else F.coalesce(self.held, T.text_of(self.col))

    def string(self) -> Column:
        """The text of a string literal, with or without language; null of others."""
        if self.kind == "text":
            return self.col
        if self.kind != "term":
            return F.lit(None).cast("string")
        return self._of(T.string_of) if self.held is None else self.held

    def bool(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "num":
            return (self.col != 0) & ~F.isnan(self.col)
        if self.kind == "text":
            return F.length(self.col) > 0

        def truth(t: Column) -> Column:
            n = T.number(t)
            return (
                F.when(T.is_datatype(t, "boolean"), T.lexical(t).isin("true", "1"))
                .when(n.isNotNull(), (n != 0) & ~F.isnan(n))
                .when(t.endswith('"') | T.suffix(t).startswith("@"), F.length(T.lexical(t)) > 0)
            )

        return self._of(truth)


def _rank(n: int) -> Column:
    return F.lit(n)


def _num(c: Column, rank: int = 0) -> Val:
    return Val("num", c.cast("double"), _rank(rank), whole=c.cast("bigint") if rank == 0 else None)


def _const(text: str) -> Val:
    return Val("term", F.lit(text), const=text, simple=True)


def _ordering(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _numbers(op: str, a: Val, b: Val) -> Column:
    near = _ordering(op, a.number(), b.number())
    return near if a.small() or b.small() else F.coalesce(_ordering(op, a.exactly(), b.exactly()), near)


def _compare(op: str, a: Val, b: Val) -> Column:
    if a.kind == "num" or b.kind == "num":
        return _numbers(op, a, b)
    if a.kind == b.kind and a.kind in ("bool", "text"):
        return _ordering(op, a.col, b.col)
    equality = op in ("=", "!=")
    if not (a.kind == "term" and a.simple and b.kind == "term" and b.simple):  # what is computed is computed once
        a, b = (x if x.const else Val("term", x.term()) for x in (a, b))
        if equality and any(x.const and x.const[0] in "<_" for x in (a, b)):
            return _ordering(op, a.col, b.col)
        known = lambda x, c: x if x.const else Val("term", c, simple=True)
        return T.let(F.struct(a.col.alias("a"), b.col.alias("b")), lambda x: _compare(op, known(a, x.a), known(b, x.b)))
    for x, y in ((a, b), (b, a)):
        if x.const and x.const[0] in "<_" and equality:  # stays an equality of columns
            return _ordering(op, y.term(), x.term())
    s, t = a.term(), b.term()
    kind = _kind_of(a) or _kind_of(b)
    number = _numbers(op, a, b)
    date = _ordering(op, T.date_key(s), T.date_key(t))
    text = _ordering(op, T.lexical(s), T.lexical(t))
    both_text, both_bool = T.is_text(s) & T.is_text(t), T.is_datatype(s, "boolean") & T.is_datatype(t, "boolean")
    same = F.when(s == t, op == "=").when(~(T.is_literal(s) & T.is_literal(t)), op != "=")
    # Literals of one kind that differ are unequal; of unknown datatypes that's an error.
    unlike = F.when(both_text | T.suffix(s).startswith("@") | T.suffix(t).startswith("@"), op != "=")
    rest = F.coalesce(same, unlike) if equality else F.lit(None).cast("boolean")
    if kind == "number":
        return F.coalesce(number, rest) if equality else number
    if kind == "date":
        return F.coalesce(date, rest) if equality else date
    if kind == "text":
        return F.when(both_text, text).otherwise(rest)
    out = F.coalesce(number, date, F.when(both_text | both_bool, text))
    return F.coalesce(out, rest) if equality else out


def _kind_of(x: Val) -> str | None:
    if x.kind == "text":
        return "text"
    if x.const is None:
        return None
    if x.const.endswith('"'):
        return "text"
    if x.const.endswith(f"^^<{XSD}dateTime>"):
        return "date"
    return "number" if any(x.const.endswith(f"^^<{XSD}{n}>") for n in T.NUMERIC) else None


def _arithmetic(op: str, a: Val, b: Val) -> Val:
    x, y = a.number(), b.number()
    rank = F.greatest(a.number_rank(), b.number_rank())
    if op == "/":
        return Val("num", F.when((y == 0) & (rank < 2), None).otherwise(F.try_divide(x, y)), F.greatest(rank, _rank(1)))
    m, n = a.exactly(), b.exactly()
    if op == "*":
        exact = T.let(F.struct(m.alias("m"), n.alias("n")), lambda v: _product(v.m, v.n))
    else:
        exact = (m + n if op == "+" else m - n).try_cast(T.EXACT)
    return Val("num", x + y if op == "+" else x - y if op == "-" else x * y, rank, exact=exact)


def _product(m: Column, n: Column) -> Column:
    """Of whole numbers, or of such of up to 10 digits before and 9 after the point; null of others."""
    short, brief = m.try_cast("decimal(19,9)"), n.try_cast("decimal(19,9)")
    whole, full = m.try_cast("decimal(20,0)"), n.try_cast("decimal(20,0)")
    return F.when((whole == m) & (full == n), F.try_multiply(whole, full).try_cast(T.EXACT)).when((short == m) & (brief == n), F.try_multiply(short, brief).try_cast(T.EXACT))


def _like_first(first: Val, made: Column) -> Val:
    """A string of the language that the first argument has."""
    if first.kind == "text" or (first.const and first.const.endswith('"')):
        return Val("text", made)
    if first.kind != "term":
        return Val("term", F.lit(None).cast("string"))
    return Val("term", F.concat(F.lit('"'), T.escape_column(made), F.lit('"'), first._of(T.suffix)))


def _pattern(pattern: Val, flags: Val | None) -> Column:
    found = pattern.string()
    if flags is not None:
        f = flags.string()
        marks = F.concat(*[F.when(f.contains(x), x).otherwise("") for x in "ismx"])
        found = F.concat(F.when(f.contains("q"), F.lit("\\Q")).otherwise(""), found)
        found = F.when(marks == "", found).otherwise(F.concat(F.lit("(?"), marks, F.lit(")"), found))
    return found


_CASTS = {"boolean", "double", "float", "decimal", "integer", "dateTime", "string", "int", "long"}


def _cast(name: str, a: Val) -> Val:
    text = F.trim(a.text())
    from_bool = F.when(T.is_datatype(a.term(), "boolean"), T.lexical(a.term()).isin("true", "1").cast("double"))
    number = F.coalesce(a.number(), from_bool, F.when(T.is_text(a.term()), text.try_cast("double")))
    exact = F.coalesce(a.exactly(), F.when(T.is_text(a.term()) & text.rlike(r"^[+-]?\d*\.?\d{0,18}$"), text.try_cast(T.EXACT)))
    if name == "string":
        return Val("text", a.text())
    if name == "boolean":
        return Val("bool", F.coalesce(F.when(T.is_datatype(a.term(), "boolean") | T.is_text(a.term()), F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)), a.number() != 0))
    if name == "dateTime":
        ok = text.rlike(r"^-?\+?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$")
        return Val("term", F.when(ok, T.typed_literal(F.regexp_replace(text, r"^\+", ""), XSD + "dateTime")))
    if name in ("integer", "int", "long"):
        whole = F.when(F.isnan(number) | (F.abs(number) > 9e18), None).otherwise(number)
        ok = T.is_text(a.term()) & ~text.rlike(r"^[+-]?\d+$")
        part = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact)).try_cast(T.EXACT)
        return Val("num", F.when(ok, None).otherwise(F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole))).cast("double"), _rank(0), exact=F.when(~F.coalesce(ok, F.lit(False)), part))
    return Val("num", number, _rank({"decimal": 1, "float": 2, "double": 3}[name]), exact=exact if name == "decimal" else None)


_OF_TEXTS = set("STRLEN SUBSTR UCASE LCASE STRSTARTS STRENDS CONTAINS STRBEFORE STRAFTER ENCODE_FOR_URI CONCAT REPLACE REGEX MD5 SHA1 SHA256 SHA384 SHA512 LANGMATCHES STR".split())


_OF_NUMBERS = set("+ - * / NEG ABS ROUND CEIL FLOOR".split())


def read_texts(e: Any, by: set[str] = _OF_TEXTS) -> Counter:
    """How often an expression reads the text of each variable."""
    if not isinstance(e, tuple) or not e or e[0] == "EXISTS":
        return Counter()
    out = Counter(x.name for x in e[1:] if isinstance(x, Var)) if e[0] in by else Counter()
    for x in e[1:]:
        out += read_texts(x, by)
    return out


def read_numbers(e: Any) -> Counter:
    """The same of numbers."""
    return read_texts(e, _OF_NUMBERS)


class Expressions:
    """Compiles expressions over the columns of variables; held: columns of texts that are decoded already."""

    def __init__(self, column: Callable[[str], Column | None], exists: Callable[[Any], Column] | None = None, aggregates: dict | None = None, held: dict[str, str] | None = None):
        self.column, self.exists, self.aggregates, self.held = column, exists, aggregates or {}, held or {}

    def __call__(self, e: Any) -> Val:
        if isinstance(e, Var):
            c = self.column(e.name)
            number = self.held.get(f"#{e.name}")
            return Val(
                "term", F.lit(None).cast("string") if c is None else c, simple=True, held=F.col(self.held[e.name]) if e.name in self.held else None,
                decoded=tuple(F.col(f"{number}_{x}") for x in "ner") if number else None,
            )
        if isinstance(e, str):
            return _const(e)
        op, *args = e
        if op == "AGG":
            return self.aggregates[repr(e)]
        if op == "EXISTS":
            return Val("bool", self.exists(args[0]))
        if op == "CALL":
            name, *args = args
            local = name[1:-1].removeprefix(XSD)
            if name.startswith("<" + XSD) and local in _CASTS and len(args) == 1:
                return _cast(local, self(args[0]))
            raise ValueError(f"unknown function {name}")
        if op == "BOUND":
            c = self.column(args[0].name)
            return Val("bool", F.lit(False) if c is None else c.isNotNull())
        return self.apply(op, [self(a) for a in args])

    def apply(self, op: str, v: list[Val]) -> Val:
        if op in ("&&", "||"):
            a, b = v[0].bool(), v[1].bool()
            return Val("bool", a & b if op == "&&" else a | b)
        if op == "!":
            return Val("bool", ~v[0].bool())
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return Val("bool", _compare(op, v[0], v[1]))
        if op == "IN":
            out = F.lit(False)
            for x in v[1:]:
                out = out | _compare("=", v[0], x)
            return Val("bool", out)
        if op in ("+", "-", "*", "/"):
            return _arithmetic(op, v[0], v[1])
        if op == "NEG":
            return Val("num", -v[0].number(), v[0].number_rank(), exact=-v[0].exactly())
        if op in ("COALESCE", "IF"):
            sides = v if op == "COALESCE" else v[1:]
            kind = sides[0].kind if len({s.kind for s in sides}) == 1 else "term"
            get = (lambda s: s.term()) if kind in ("term", "num") else (lambda s: s.col)
            kind = "term" if kind == "num" else kind
            if op == "COALESCE":
                return Val(kind, F.coalesce(*map(get, sides)))
            return Val(kind, F.when(v[0].bool(), get(sides[0])).when(~v[0].bool(), get(sides[1])))
        return getattr(self, "fn_" + op.lower())(*v)

    # -- terms

    def fn_sameterm(self, a: Val, b: Val) -> Val:
        return Val("bool", a.term() == b.term())

    def fn_isiri(self, a: Val) -> Val:
        return Val("bool", T.is_iri(a.term()))

    fn_isuri = fn_isiri

    def fn_isblank(self, a: Val) -> Val:
        return Val("bool", T.is_blank(a.term()))

    def fn_isliteral(self, a: Val) -> Val:
        return Val("bool", T.is_literal(a.term()))

    def fn_isnumeric(self, a: Val) -> Val:
        return Val("bool", F.when(a.term().isNotNull(), a.number().isNotNull()))

    def fn_str(self, a: Val) -> Val:
        return Val("text", a.text())

    def fn_lang(self, a: Val) -> Val:
        return Val("text", T.lang_of(a.term()))

    def fn_datatype(self, a: Val) -> Val:
        return Val("term", T.datatype_of(a.term()))

    def fn_langmatches(self, a: Val, b: Val) -> Val:
        x, y = F.lower(a.string()), F.lower(b.string())
        return Val("bool", F.when(y == "*", x != "").otherwise((x == y) | x.startswith(F.concat(y, F.lit("-")))))

    def fn_iri(self, a: Val) -> Val:
        if a.kind == "text":
            return Val("term", F.concat(F.lit("<"), a.col, F.lit(">")))
        return Val("term", a._of(lambda t: F.when(T.is_iri(t), t).when(t.endswith('"'), F.concat(F.lit("<"), T.lexical(t), F.lit(">"))))) if a.kind == "term" else Val("term", F.lit(None).cast("string"))

    fn_uri = fn_iri

    def fn_bnode(self, *a: Val) -> Val:
        return Val("term", F.concat(F.lit("_:b"), F.md5(a[0].string()) if a else F.replace(F.uuid(), F.lit("-"), F.lit(""))))

    def fn_strdt(self, a: Val, b: Val) -> Val:
        made = F.concat(F.lit('"'), T.escape_column(a.string()), F.lit('"^^'), b.term())
        return Val("term", F.when(T.is_text(a.term()) & T.is_iri(b.term()), F.when(b.term() == f"<{XSD}string>", a.term()).otherwise(T.canonical_column(made))))

    def fn_strlang(self, a: Val, b: Val) -> Val:
        return Val("term", F.when(T.is_text(a.term()), T.lang_literal(a.string(), b.string())))

    # -- strings

    def fn_strlen(self, a: Val) -> Val:
        return _num(F.length(a.string()))

    def fn_substr(self, a: Val, start: Val, length: Val | None = None) -> Val:
        begin = F.floor(start.number() + 0.5)
        end = F.lit(float(1 << 30)) if length is None else begin + F.floor(length.number() + 0.5)
        low = F.greatest(begin, F.lit(1)).cast("int")
        return _like_first(a, F.substr(a.string(), low, F.greatest(end - low, F.lit(0)).cast("int")))

    def fn_ucase(self, a: Val) -> Val:
        return _like_first(a, F.upper(a.string()))

    def fn_lcase(self, a: Val) -> Val:
        return _like_first(a, F.lower(a.string()))

    def fn_strstarts(self, a: Val, b: Val) -> Val:
        return Val("bool", a.string().startswith(b.string()))

    def fn_strends(self, a: Val, b: Val) -> Val:
        return Val("bool", a.string().endswith(b.string()))

    def fn_contains(self, a: Val, b: Val) -> Val:
        return Val("bool", a.string().contains(b.string()))

    def fn_strbefore(self, a: Val, b: Val) -> Val:
        at = F.position(b.string(), a.string())
        made = F.when(at > 1, F.substr(a.string(), F.lit(1), at - 1)).otherwise("")
        return _like_first(a, F.when(a.string().isNotNull() & b.string().isNotNull(), made))

    def fn_strafter(self, a: Val, b: Val) -> Val:
        at = F.position(b.string(), a.string())
        made = F.when(at > 0, F.substr(a.string(), at + F.length(b.string()))).otherwise("")
        return _like_first(a, F.when(a.string().isNotNull() & b.string().isNotNull(), made))

    def fn_encode_for_uri(self, a: Val) -> Val:
        coded = F.url_encode(a.string())
        for x, y in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            coded = F.replace(coded, F.lit(x), F.lit(y))
        return Val("text", coded)

    def fn_concat(self, *a: Val) -> Val:
        return Val("text", F.concat(*[x.string() for x in a])) if a else Val("text", F.lit(""))

    def fn_replace(self, a: Val, pattern: Val, by: Val, flags: Val | None = None) -> Val:
        return _like_first(a, F.regexp_replace(a.string(), _pattern(pattern, flags), by.string()))

    def fn_regex(self, a: Val, pattern: Val, flags: Val | None = None) -> Val:
        return Val("bool", F.regexp_like(a.string(), _pattern(pattern, flags)))

    # -- numbers

    def fn_abs(self, a: Val) -> Val:
        return Val("num", F.abs(a.number()), a.number_rank(), exact=F.abs(a.exactly()))

    def fn_round(self, a: Val) -> Val:
        return Val("num", F.floor(a.number() + 0.5).cast("double"), a.number_rank(), exact=F.floor(a.exactly() + F.lit("0.5").cast("decimal(2,1)")).try_cast(T.EXACT))

    def fn_ceil(self, a: Val) -> Val:
        return Val("num", F.ceil(a.number()).cast("double"), a.number_rank(), exact=F.ceil(a.exactly()).try_cast(T.EXACT))

    def fn_floor(self, a: Val) -> Val:
        return Val("num", F.floor(a.number()).cast("double"), a.number_rank(), exact=F.floor(a.exactly()).try_cast(T.EXACT))

    def fn_rand(self) -> Val:
        return Val("num", F.rand(), _rank(3))

    # -- dates, by their text: month 0, day 0 and second 60 are legal

    def _part(self, a: Val, part: int) -> Val:
        return _num(T.date_part(a.term(), part))

    def fn_year(self, a: Val) -> Val:
        return self._part(a, 1)

    def fn_month(self, a: Val) -> Val:
        return self._part(a, 2)

    def fn_day(self, a: Val) -> Val:
        return self._part(a, 3)

    def fn_hours(self, a: Val) -> Val:
        return self._part(a, 4)

    def fn_minutes(self, a: Val) -> Val:
        return self._part(a, 5)

    def fn_seconds(self, a: Val) -> Val:
        seconds = F.regexp_extract(T.lexical(a.term()), r":(\d\d(?:\.\d+)?)(?:Z|[+-]\d\d:\d\d)?$", 1).try_cast("double")
        return Val("num", F.when(T.is_datatype(a.term(), "dateTime"), seconds), _rank(1))

    def fn_tz(self, a: Val) -> Val:
        zone = F.regexp_extract(T.lexical(a.term()), r"(Z|[+-]\d\d:\d\d)?$", 1)
        return Val("text", F.when(T.is_datatype(a.term(), "dateTime"), zone))

    def fn_timezone(self, a: Val) -> Val:
        zone = self.fn_tz(a).col
        hours, minutes = F.substr(zone, F.lit(2), F.lit(2)).try_cast("int"), F.substr(zone, F.lit(5), F.lit(2)).try_cast("int")
        parts = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
        made = F.when((zone == "Z") | (hours + minutes == 0), "PT0S").when(zone != "", parts)
        return Val("term", T.typed_literal(made, XSD + "dayTimeDuration"))

    def fn_now(self) -> Val:
        return Val("term", T.date_literal(F.unix_seconds(F.current_timestamp())))

    # -- hashes and ids

    def fn_md5(self, a: Val) -> Val:
        return Val("text", F.md5(a.string()))

    def fn_sha1(self, a: Val) -> Val:
        return Val("text", F.sha1(a.string()))

    def fn_sha256(self, a: Val) -> Val:
        return Val("text", F.sha2(a.string(), 256))

    def fn_sha384(self, a: Val) -> Val:
        return Val("text", F.sha2(a.string(), 384))

    def fn_sha512(self, a: Val) -> Val:
        return Val("text", F.sha2(a.string(), 512))

    def fn_uuid(self) -> Val:
        return Val("term", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))

    def fn_struuid(self) -> Val:
        return Val("text", F.uuid())
