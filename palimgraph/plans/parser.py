"""SPARQL 1.1 query syntax: a tokenizer and a recursive-descent parser."""

from __future__ import annotations

import re
from typing import Any

from ..functions import terms as T
from ..vocabulary import PREFIXES, TYPE, XSD, iri
from .algebra import Bind, Graph, Group, Minus, Optional_, Pattern, Query, Service, Union, Values, Var


class SyntaxError_(ValueError):
    """The query isn't SPARQL 1.1."""


class UnsupportedQuery(ValueError):
    """SPARQL that this read-only store has no answer for."""


_TOKENS = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\s]*>)
  | (?P<var>[?$]\w+)
  | (?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  | (?P<blank>_:[\w.-]*\w)
  | (?P<name>(?:[A-Za-z][\w.-]*)?:(?:(?:[\w:%-]|\\.)(?:[\w.:%-]|\\.)*(?<!\.))?)
  | (?P<word>[A-Za-z_]\w*)
  | (?P<op>\^\^|\|\||&&|!=|<=|>=|[{}()\[\];,.|/^?*+!=<>-])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
BUILTINS = set(
    """STR LANG LANGMATCHES DATATYPE BOUND IRI URI BNODE RAND ABS CEIL FLOOR ROUND CONCAT STRLEN UCASE LCASE ENCODE_FOR_URI
CONTAINS STRSTARTS STRENDS STRBEFORE STRAFTER YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ NOW UUID STRUUID MD5 SHA1 SHA256
SHA384 SHA512 COALESCE IF STRLANG STRDT SAMETERM ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC REGEX SUBSTR REPLACE""".split()
)


def _unquote(text: str) -> str:
    n = 3 if text[:3] in ('"""', "'''") else 1

    def one(m: re.Match) -> str:
        if m.group(1):
            return chr(int(m.group(1), 16))
        if m.group(3) not in _ESCAPES:
            raise SyntaxError_(f"unknown escape \\{m.group(3)}")
        return _ESCAPES[m.group(3)]

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m.group(2), 16)) if m.group(2) else one(m), text[n:-n], flags=re.S)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise SyntaxError_(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at = 0
        self.prefixes = dict(PREFIXES if prefixes is None else prefixes)
        self.base = ""
        self.fresh = 0

    # -- tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def has(self, *texts: str) -> bool:
        kind, text = self.peek()
        return kind in ("op", "word") and text.upper() in texts

    def take(self, *texts: str) -> bool:
        if self.has(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SyntaxError_(f"expected {text}, found {self.peek()[1] or 'the end'}")

    def unnamed(self) -> Var:
        """A variable for a blank node; its name can't be written in a query."""
        self.fresh += 1
        return Var(f".b{self.fresh}")

    # -- query forms

    def parse(self) -> Query:
        self.prologue()
        kind = self.peek()[1].upper()
        if kind in ("INSERT", "DELETE", "LOAD", "CLEAR", "CREATE", "DROP", "COPY", "MOVE", "ADD", "WITH"):
            raise UnsupportedQuery("updates are not supported: the store is read-only")
        if kind not in ("SELECT", "CONSTRUCT", "ASK", "DESCRIBE"):
            raise SyntaxError_("expected SELECT, CONSTRUCT, ASK or DESCRIBE")
        query = self.select() if kind == "SELECT" else self.other(kind)
        if self.has("VALUES"):
            query.values = self.values()
        if self.peek()[0] != "end":
            raise SyntaxError_(f"unexpected {self.peek()[1]}")
        return query

    def prologue(self) -> None:
        while self.has("PREFIX", "BASE"):
            if self.take("BASE"):
                self.base = self.next()[1][1:-1]
            else:
                self.next()
                kind, name = self.next()
                if kind != "name" or not name.endswith(":"):
                    raise SyntaxError_(f"no prefix: {name}")
                self.prefixes[name[:-1]] = self.iri_text(self.next()[1])

    def iri_text(self, token: str) -> str:
        inner = token[1:-1]
        if self.base and not re.match(r"[A-Za-z][\w+.-]*:", inner):
            from urllib.parse import urljoin

            return urljoin(self.base, inner)
        return inner

    def select(self) -> Query:
        self.need("SELECT")
        q = Query("SELECT", distinct=self.take("DISTINCT"))
        q.reduced = not q.distinct and self.take("REDUCED")
        if not self.take("*"):
            while True:
                if self.peek()[0] == "var":
                    q.projection.append((self.next()[1][1:], None))
                elif self.take("("):
                    e = self.expression()
                    self.need("AS")
                    q.projection.append((self.next()[1][1:], e))
                    self.need(")")
                else:
                    break
            if not q.projection:
                raise SyntaxError_("nothing is selected")
        self.dataset(q)
        self.take("WHERE")
        q.where = self.group()
        self.modifiers(q)
        return q

    def other(self, kind: str) -> Query:
        self.next()
        q = Query(kind)
        if kind == "DESCRIBE":
            if not self.take("*"):
                while self.peek()[0] in ("var", "iri", "name"):
                    q.describe.append(self.term())
        short = kind == "CONSTRUCT" and not self.has("{")
        if kind == "CONSTRUCT" and not short:
            self.need("{")
            q.template = self.template()
        self.dataset(q)
        if kind == "DESCRIBE" and not self.has("WHERE", "{"):
            q.where = Group()
        else:
            self.take("WHERE")
            q.where = self.group()
        if short:
            q.template = [i for i in q.where.items if isinstance(i, Pattern)]
        self.modifiers(q)
        return q

    def template(self) -> list[Pattern]:
        holder = Group()
        while not self.take("}"):
            self.triples(holder, None)
            self.take(".")
        return holder.items

    def dataset(self, q: Query) -> None:
        while self.take("FROM"):
            (q.named if self.take("NAMED") else q.graphs).append(self.term())

    def modifiers(self, q: Query) -> None:
        if self.take("GROUP"):
            self.need("BY")
            q.grouped = True
            while self.peek()[0] in ("var", "iri", "name") or self.has("(") or self.peek()[1].upper() in BUILTINS:
                if self.take("("):
                    e, name = self.expression(), None
                    if self.take("AS"):
                        name = self.next()[1][1:]
                    self.need(")")
                else:
                    e = self.primary()
                    name = e.name if isinstance(e, Var) else None
                q.group_by.append((name, e))
        if self.take("HAVING"):
            q.having.append(self.primary())
            while self.has("(") or self.peek()[1].upper() in BUILTINS | AGGREGATES:
                q.having.append(self.primary())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if self.has("ASC", "DESC"):
                    down = self.next()[1].upper() == "DESC"
                    q.order_by.append((self.primary(), down))
                elif self.peek()[0] == "var" or self.has("(") or self.peek()[1].upper() in BUILTINS | AGGREGATES:
                    q.order_by.append((self.primary(), False))
                else:
                    break
            if not q.order_by:
                raise SyntaxError_("ORDER BY what?")
        while self.has("LIMIT", "OFFSET"):
            word, number = self.next()[1].upper(), self.next()[1]
            if not number.isdigit():
                raise SyntaxError_(f"{word} needs a number")
            if word == "LIMIT":
                q.limit = int(number)
            else:
                q.offset = int(number)

    # -- patterns

    def group(self, g: Any = None) -> Group:
        self.need("{")
        out = Group(g=g)
        if self.has("SELECT"):
            out.items.append(self.select())
            if self.has("VALUES"):
                out.items[-1].values = self.values()
            self.need("}")
            return out
        while not self.take("}"):
            if self.take("OPTIONAL"):
                out.items.append(Optional_(self.group(g)))
            elif self.take("MINUS"):
                out.items.append(Minus(self.group(g)))
            elif self.take("FILTER"):
                out.filters.append(self.constraint(g))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                out.items.append(Bind(e, self.next()[1][1:]))
                self.need(")")
            elif self.has("VALUES"):
                out.items.append(self.values())
            elif self.take("GRAPH"):
                name = self.term()
                out.items.append(Graph(self.group(name), name))
            elif self.take("SERVICE"):
                self.take("SILENT")
                out.items.append(Service(self.term(), self.group(g)))
            elif self.has("{"):
                sides = [self.group(g)]
                while self.take("UNION"):
                    sides.append(self.group(g))
                out.items.append(Union(sides) if len(sides) > 1 else sides[0])
            elif self.peek()[0] == "end":
                raise SyntaxError_("a group isn't closed")
            else:
                self.triples(out, g)
            self.take(".")
        return out

    def constraint(self, g: Any) -> Any:
        self.context = g
        return self.primary()

    def values(self) -> Values:
        self.need("VALUES")
        single = self.peek()[0] == "var"
        if single:
            names = [self.next()[1][1:]]
        else:
            self.need("(")
            names = []
            while not self.take(")"):
                names.append(self.next()[1][1:])
        self.need("{")
        rows: list[list[str | None]] = []

        def value() -> str | None:
            return None if self.take("UNDEF") else self.term()

        while not self.take("}"):
            if single:
                rows.append([value()])
            else:
                self.need("(")
                row = []
                while not self.take(")"):
                    row.append(value())
                if len(row) != len(names):
                    raise SyntaxError_("a row of VALUES has another length")
                rows.append(row)
        return Values(names, rows)

    def triples(self, out: Group, g: Any) -> None:
        if self.has("["):
            s = self.node(out, g)
            if not self.has(".", "}"):
                self.properties(s, out, g)
        else:
            self.properties(self.node(out, g), out, g)

    def properties(self, s: Any, out: Group, g: Any) -> None:
        while True:
            if self.peek()[0] == "var":
                p = Var(self.next()[1][1:])
            else:
                p = self.path()
            while True:
                out.items.append(Pattern(s, p, self.node(out, g), g))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.has(".", "}", "]") or self.peek()[0] == "end":
                return

    def node(self, out: Group, g: Any) -> Any:
        if self.take("["):
            made = self.unnamed()
            if not self.take("]"):
                self.properties(made, out, g)
                self.need("]")
            return made
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out, g))
            at: Any = iri("rdf:nil")
            for item in reversed(items):
                cell = self.unnamed()
                out.items += [Pattern(cell, iri("rdf:first"), item, g), Pattern(cell, iri("rdf:rest"), at, g)]
                at = cell
            return at
        return self.term()

    def term(self) -> Any:
        kind, text = self.next()
        if kind == "var":
            return Var(text[1:])
        if kind == "iri":
            return f"<{self.iri_text(text)}>"
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SyntaxError_(f"unknown prefix {prefix}:")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"
        if kind == "blank":
            return Var("." + text)
        if kind == "string":
            value = _unquote(text)
            if self.peek()[0] == "lang":
                return T.literal(value, lang=self.next()[1][1:])
            if self.take("^^"):
                return T.literal(value, datatype=self.term()[1:-1])
            return T.literal(value)
        if kind == "op" and text in "+-" and self.peek()[0] == "number":
            return self.number(text + self.next()[1])
        if kind == "number":
            return self.number(text)
        if kind == "word" and text in ("true", "false"):
            return f'"{text}"^^<{XSD}boolean>'
        raise SyntaxError_(f"unexpected {text or 'end'}")

    @staticmethod
    def number(text: str) -> str:
        name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
        return T.canonical(f'"{text}"^^<{XSD}{name}>')

    # -- paths: a term, ('^', p), ('/', p...), ('|', p...), ('*+?', p), ('!', forward, backward)

    def path(self) -> Any:
        sides = [self.sequence()]
        while self.take("|"):
            sides.append(self.sequence())
        return sides[0] if len(sides) == 1 else ("|", *sides)

    def sequence(self) -> Any:
        steps = [self.step()]
        while self.take("/"):
            steps.append(self.step())
        return steps[0] if len(steps) == 1 else ("/", *steps)

    def step(self) -> Any:
        back = self.take("^")
        if self.take("!"):
            made = self.negated()
        elif self.take("("):
            made = self.path()
            self.need(")")
        else:
            made = self.predicate()
        if self.has("*", "+", "?"):
            made = (self.next()[1], made)
        return ("^", made) if back else made

    def predicate(self) -> str:
        if self.peek() == ("word", "a"):
            self.next()
            return TYPE
        kind, text = self.peek()
        if kind not in ("iri", "name"):
            raise SyntaxError_(f"no predicate: {text or 'end'}")
        return self.term()

    def negated(self) -> Any:
        forward, backward = [], []

        def one() -> None:
            (backward if self.take("^") else forward).append(self.predicate())

        if self.take("("):
            if not self.take(")"):
                one()
                while self.take("|"):
                    one()
                self.need(")")
        else:
            one()
        return ("!", tuple(forward), tuple(backward))

    # -- expressions: Var, term, (operator, arguments...)

    def expression(self) -> Any:
        left = self.conjunction()
        while self.take("||"):
            left = ("||", left, self.conjunction())
        return left

    def conjunction(self) -> Any:
        left = self.relation()
        while self.take("&&"):
            left = ("&&", left, self.relation())
        return left

    def relation(self) -> Any:
        left = self.sum()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return (op, left, self.sum())
        if self.take("IN"):
            return ("IN", left, *self.arguments())
        if self.has("NOT") and self.peek(1)[1].upper() == "IN":
            self.at += 2
            return ("!", ("IN", left, *self.arguments()))
        return left

    def sum(self) -> Any:
        left = self.product()
        while self.has("+", "-"):
            left = (self.next()[1], left, self.product())
        return left

    def product(self) -> Any:
        left = self.unary()
        while self.has("*", "/"):
            left = (self.next()[1], left, self.unary())
        return left

    def unary(self) -> Any:
        if self.take("!"):
            return ("!", self.unary())
        if self.take("-"):
            return ("NEG", self.unary())
        self.take("+")
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def primary(self) -> Any:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        kind, text = self.peek()
        word = text.upper()
        if kind == "word" and word in ("EXISTS", "NOT"):
            no = self.take("NOT")
            self.need("EXISTS")
            inner = ("EXISTS", self.group(getattr(self, "context", None)))
            return ("!", inner) if no else inner
        if kind == "word" and word in AGGREGATES and self.peek(1)[1] == "(":
            self.at += 2
            distinct = self.take("DISTINCT")
            star = self.take("*")
            e = None if star else self.expression()
            separator = " "
            if self.take(";"):
                self.need("SEPARATOR")
                self.need("=")
                separator = _unquote(self.next()[1])
            self.need(")")
            return ("AGG", word, distinct, e, separator)
        if kind == "word" and word in BUILTINS:
            self.next()
            return (word, *self.arguments())
        if kind in ("iri", "name"):
            name = self.term()
            return ("CALL", name, *self.arguments()) if self.has("(") else name
        return self.term()


def parse(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, prefixes).parse()
