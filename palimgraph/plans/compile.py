"""From the algebra to DataFrames.

A Rel is a DataFrame with a column for each variable.  Which variables may be
unbound is tracked, so that joins are equality joins wherever the query allows;
which kind of revision graph a variable holds is tracked too, so that GRAPH ?g
after hist:additions is an equality join and after hist:globalState a temporal
one."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import magic, scan, temporal_join
from ..operators.closure import closure, sources
from ..vocabulary import MAX, SNAPSHOTS
from .algebra import Bind, Graph, Group, Minus, Optional_, Pattern, Query, Service, Union, Values, Var, names_in
from .expressions import Expressions, Val, read_numbers, read_texts
from .optimize import pick, simplify_path
from .parser import UnsupportedQuery


@dataclass
class Rel:
    df: DataFrame
    cols: dict[str, str]
    maybe: set[str] = field(default_factory=set)  # variables that may be unbound
    kinds: dict[str, set[str]] = field(default_factory=dict)  # of variables known to be revision IRIs
    held: dict[str, str] = field(default_factory=dict)  # columns of texts that several functions read
    most: int | None = None  # rows at most, where that is known beforehand
    numbers: dict[str, tuple[str, str]] = field(default_factory=dict)  # of variables known to be revision IRIs: the column of their number, their kind

    def column(self, name: str) -> Column | None:
        return F.col(self.cols[name]) if name in self.cols else None

    def revision(self, name: str) -> Column:
        """The number of a revision IRI; it is read from the term only where it isn't known."""
        return F.col(self.numbers[name][0]) if name in self.numbers else T.snapshot_revision(F.col(self.cols[name]))


#: Between a graph and a node that carries it; no IRI has it.
_TAG = "\x01"


@dataclass
class Tagged:
    """Edges (x, p, y) of several graphs (g), whose nodes carry their graph."""

    edges: DataFrame
    graphs: DataFrame


class Compiler:
    def __init__(self, store: Any, services: dict[str, Any] | None = None):
        self.store, self.services = store, services or {}
        self.spark = store.spark
        self.numbers = count()
        self.default: list[str] = []
        self.named: list[str] = []

    def fresh(self, name: str) -> str:
        return f"v{next(self.numbers)}_{''.join(c if c.isalnum() else '_' for c in name)}".lower()

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(), {})

    # -- whole queries

    def query(self, q: Query) -> tuple[Rel, list[str]]:
        """Of a SELECT: its rows and the names of its columns."""
        self.default, self.named = list(q.graphs), list(q.named)
        return self.select(q)

    def select(self, q: Query, seed: Rel | None = None) -> tuple[Rel, list[str]]:
        aggregated = q.grouped or q.having or any(self._aggregates(e) for _, e in q.projection if e is not None) or any(self._aggregates(e) for e, _ in q.order_by)
        made: dict[str, Val] = {}
        counted = self.counted(q, seed) if aggregated else None
        if counted:
            rel, made = counted
        else:
            rel = self.group(q.where, seed)
            if q.values:
                rel = self.join(rel, self.values(q.values))
            if aggregated:
                rel, made = self.aggregate(rel, q)
        if aggregated:
            for e in q.having:
                rel = self.filter(rel, e, made)
        rel = self.decoded(rel, [e for _, e in q.projection if e is not None])
        for name, e in q.projection:
            if e is not None:
                rel = self.extend(rel, e, name, made)
        names = [n for n, _ in q.projection] or sorted(n for n in rel.cols if not n.startswith("."))
        df = rel.df
        order = []
        for e, down in q.order_by:
            df, exists = self.flags(Rel(df, rel.cols, rel.maybe, rel.kinds), e)
            order += T.order_keys(Expressions(rel.column, exists, made)(e).term(), down)
        if order:
            df = df.orderBy(*order)
        aliases = [self.fresh(n) for n in names]
        df = df.select(*[(F.col(rel.cols[n]) if n in rel.cols else F.lit(None).cast("string")).alias(a) for n, a in zip(names, aliases)])
        cols = dict(zip(names, aliases))
        if q.distinct:
            df = df.dropDuplicates()
            if order:  # duplicates have equal sort columns where those are projected
                after = Rel(df, cols)
                df = df.orderBy(*[k for e, down in q.order_by for k in T.order_keys(self.expressions(after)(e).term(), down)])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        maybe = {n for n in names if n in rel.maybe or n not in rel.cols}
        return Rel(df, cols, maybe, {n: k for n, k in rel.kinds.items() if n in names}), names

    def _aggregates(self, e: Any) -> list[tuple]:
        if isinstance(e, tuple):
            return [e] if e and e[0] == "AGG" else [a for x in e for a in self._aggregates(x)]
        return []

    def aggregate(self, rel: Rel, q: Query) -> tuple[Rel, dict[str, Val]]:
        expr = self.expressions(rel)
        keys, cols, maybe = [], {}, set()
        for i, (name, e) in enumerate(q.group_by):
            alias = self.fresh(name or f"key{i}")
            keys.append(expr(e).term().alias(alias))
            if name:
                cols[name] = alias
                if not isinstance(e, Var) or e.name in rel.maybe:
                    maybe.add(name)
        wanted: dict[str, tuple] = {}
        for e in [e for _, e in q.projection if e is not None] + q.having + [e for e, _ in q.order_by]:
            for a in self._aggregates(e):
                wanted[repr(a)] = a
        columns, made = [], {}
        for text, (_, name, distinct, e, separator) in wanted.items():
            column, value = self._aggregate(rel, name, distinct, expr(e) if e is not None else None, separator)
            alias = self.fresh("agg")
            columns.append(column.alias(alias))
            made[text] = value(F.col(alias))
        if not columns:
            columns = [F.count(F.lit(1)).alias(self.fresh("rows"))]
        df = rel.df.groupBy(*keys).agg(*columns)
        return Rel(df, cols, maybe, {n: k for n, k in rel.kinds.items() if n in cols}), made

    def counted(self, q: Query, seed: Rel | None) -> tuple[Rel, dict[str, Val]] | None:
        """Where solutions are only counted: their number without the solutions, by sums over the states that a graph variable
        names or over the edges of p+; None of other queries."""
        used = [e for _, e in q.projection if e is not None] + q.having + [e for e, _ in q.order_by]
        wanted = {repr(a): a for e in used for a in self._aggregates(e)}
        keys = [n for n, e in q.group_by if isinstance(e, Var) and n == e.name]
        free = names_in(used) | {n for n, e in q.projection if e is None}
        if q.values or q.where.filters or len(keys) < len(q.group_by) or list(self._exists(tuple(used))) or not all(a[1] == "COUNT" for a in wanted.values()):
            return None
        found = self._counted_paths(q, seed, keys, list(wanted.values())) or (self._counted_states(q, seed, keys, free) if all(a[3] is None and not a[2] for a in wanted.values()) else None)
        if found is None:
            return None
        rel, n = found
        df = rel.df.groupBy(*[F.col(rel.cols[k]) for k in keys]).agg(F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(total := self.fresh("agg")))
        cols = {k: rel.cols[k] for k in keys}
        value = lambda: Val("num", F.col(total).cast("double"), F.lit(0), whole=F.col(total))
        return Rel(df, cols, rel.maybe & set(keys), {k: v for k, v in rel.kinds.items() if k in cols}), {text: value() for text in wanted}

    def _counted_paths(self, q: Query, seed: Rel | None, keys: list[str], wanted: list[tuple]) -> tuple[Rel, Column] | None:
        """Of { ?x p+ ?y } GROUP BY ?y: pairs of a closure are distinct, so all ways of counting ?x agree."""
        items = q.where.items
        p = items[0] if len(items) == 1 and isinstance(items[0], Pattern) else None
        if p is None or seed is not None or p.g is not None or not isinstance(p.p, tuple) or p.p[0] != "+" or not isinstance(p.p[1], str):
            return None
        if not (isinstance(p.s, Var) and isinstance(p.o, Var)) or p.s == p.o or keys != [p.o.name]:
            return None
        if not all(a[3] == p.s or (not a[2] and (a[3] is None or a[3] == p.o)) for a in wanted):
            return None
        if p.p[1] == magic.PARENT and not self.default:  # numbers are shorter than terms
            reached = sources(self.store.revisions.select(F.col("revision_id").alias("x"), F.col("parent_id").alias("y")))
            reached = reached.select(T.iri_column(SNAPSHOTS["N"], F.col("y")).alias("y"), "n")
        else:
            reached = sources(self.pairs(p.p[1], None))
        alias = self.fresh(p.o.name)
        return Rel(reached.select(F.col("y").alias(alias), "n"), {p.o.name: alias}), F.col("n")

    def _counted_states(self, q: Query, seed: Rel | None, keys: list[str], free: set[str]) -> tuple[Rel, Column] | None:
        """Of a pattern in GRAPH ?g, g being states, whose own variables are not used otherwise: how often it holds in each state."""
        states = [i for i in q.where.items if isinstance(i, Graph) and isinstance(i.g, Var) and not i.group.filters and len(i.group.items) == 1 and isinstance(i.group.items[0], Pattern)]
        rest = [i for i in q.where.items if all(i is not x for x in states)]
        if len(states) != 1 or self.named or not rest or not all(isinstance(i, (Pattern, Query, Group, Union, Values)) for i in rest):
            return None
        p, g = states[0].group.items[0], states[0].g.name
        own = names_in([p.s, p.p, p.o])
        if isinstance(p.p, tuple) or own & (names_in(rest) | free | {g} | set(keys) | set(seed.cols if seed else ())):
            return None
        rel = self.joined(seed, rest)
        if rel is None or g not in rel.cols or g in rel.maybe or rel.kinds.get(g) != {"G"} or not set(keys) <= set(rel.cols):
            return None
        given = [x if isinstance(x, str) else None for x in (p.s, p.p, p.o)]
        triples = scan.where_terms(self.store.tables.of(*given), *given)
        inner = self.bind(triples, [(p.s, "s"), (p.p, "p"), (p.o, "o"), (Var(".start"), "rev_start"), (Var(".end"), "rev_end")])
        r, cols = rel.revision(g), list(dict.fromkeys(rel.cols[k] for k in keys))
        asked = rel.df.groupBy(r.alias("_r"), *cols).agg(F.count(F.lit(1)).alias("_times"))
        held = temporal_join.counts(asked, inner.df, "_r", inner.cols[".start"], inner.cols[".end"])
        return Rel(asked.join(held, "_r"), {k: rel.cols[k] for k in keys}, rel.maybe, rel.kinds), F.col("_times") * F.col("n")

    def _aggregate(self, rel: Rel, name: str, distinct: bool, v: Val | None, separator: str) -> tuple[Column, Any]:
        number = lambda c: Val("num", c.cast("double"), F.lit(0), whole=c)
        if name == "COUNT":
            if v is None:
                if distinct:
                    return F.count_distinct(F.struct(*[F.col(c) for c in rel.cols.values()])), number
                return F.count(F.lit(1)), number
            return (F.count_distinct(v.term()) if distinct else F.count(v.term())), number
        if name in ("SUM", "AVG"):
            n, t, exact = v.number(), v.term(), v.exactly()
            if distinct:  # equal terms count once
                pairs = F.collect_set(F.struct(t.alias("t"), n.alias("n"), v.number_rank().alias("r"), exact.alias("e")))
                whole = F.aggregate(pairs, F.lit(0).cast(T.EXACT), lambda a, x: (a + F.when(x.t.isNull(), F.lit(0).cast(T.EXACT)).otherwise(x.e)).try_cast(T.EXACT))
                total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.coalesce(x.n, F.lit(0.0)))
                bad, size, rank = F.exists(pairs, lambda x: x.t.isNotNull() & x.n.isNull()), F.size(F.filter(pairs, lambda x: x.t.isNotNull())), F.array_max(F.transform(pairs, lambda x: x.r))
            else:
                whole = F.when(F.count(exact) == F.count(t), F.coalesce(F.try_sum(exact).try_cast(T.EXACT), F.when(F.count(t) == 0, F.lit(0).cast(T.EXACT))))
                total, bad, size, rank = F.coalesce(F.sum(n), F.lit(0.0)), F.count(F.when(t.isNotNull() & n.isNull(), 1)) > 0, F.count(t), F.max(v.number_rank())
            rank = F.coalesce(rank, F.lit(0))
            if name == "AVG":
                total, rank = F.when(size == 0, 0.0).otherwise(F.try_divide(total, size)), F.when(size == 0, 0).otherwise(F.greatest(rank, F.lit(1)))
                whole = F.lit(None).cast(T.EXACT)
            return F.when(~bad, F.struct(total.alias("n"), rank.alias("r"), whole.alias("e"))), lambda c: Val("num", c.n, c.r, exact=c.e)
        t = v.term()
        if name in ("MIN", "MAX"):
            kind = F.when(T.is_blank(t), 1).when(T.is_iri(t), 2).otherwise(3)
            keyed = F.when(t.isNotNull(), F.struct(kind.alias("k"), T.number(t).alias("n"), T.exact(t).alias("e"), T.date_key(t).alias("d"), F.coalesce(T.text_of(t), t).alias("x"), t.alias("t")))
            return (F.min(keyed) if name == "MIN" else F.max(keyed)), lambda c: Val("term", c.t, simple=True)
        if name == "SAMPLE":  # the least term, so that a query gives the same each time
            return F.min(t), lambda c: Val("term", c, simple=True)
        texts = v.text()
        items = F.collect_set(F.struct(t.alias("t"), texts.alias("x"))) if distinct else F.collect_list(F.struct(t.alias("t"), texts.alias("x")))
        held = F.sort_array(F.filter(items, lambda x: x.t.isNotNull()))
        return F.array_join(F.transform(held, lambda x: x.x), separator), lambda c: Val("text", c)

    # -- groups

    def group(self, g: Group, seed: Rel | None = None) -> Rel:
        rel = seed
        waiting: list[Any] = []

        def flush() -> None:
            nonlocal rel, waiting
            rel, waiting = self.joined(rel, waiting), []

        for item in g.items:
            if isinstance(item, (Pattern, Values)):
                waiting.append(item)
            elif isinstance(item, Graph) and not item.group.filters and all(isinstance(i, Pattern) for i in item.group.items):
                waiting += item.group.items
            elif isinstance(item, (Group, Union, Graph, Query, Service)):
                waiting.append(item)
            else:
                flush()
                rel = rel or self.unit()
                if isinstance(item, Bind):
                    rel = self.extend(rel, item.expression, item.name)
                elif isinstance(item, Optional_):
                    rel = self.optional(rel, item.group)
                elif isinstance(item, Minus):
                    rel = self.minus(rel, self.group(item.group, self.seed_for(rel, item.group, near=True)))
                else:
                    raise TypeError(item)
        flush()
        rel = rel or self.unit()
        for e in g.filters:
            rel = self.filter(self.decoded(rel, g.filters), e)
        return rel

    def joined(self, rel: Rel | None, items: list[Any]) -> Rel | None:
        patterns = [Pattern(i.s, simplify_path(i.p), i.o, i.g) for i in items if isinstance(i, Pattern)]
        rest = [i for i in items if not isinstance(i, Pattern)]
        for item in [i for i in rest if isinstance(i, Values)] + [i for i in rest if not isinstance(i, Values)]:
            late = isinstance(item, Graph) and isinstance(item.g, Var)
            if not late:
                made = self.item(item, rel)
                rel = made if rel is None else self.join(rel, made)
        # Patterns in a graph that another pattern names come after it.
        while patterns:
            bound = set(rel.cols) if rel else set()
            sources = {x.name for p in patterns for x in (p.s, p.p, p.o) if isinstance(x, Var)}
            ready = [p for p in patterns if not isinstance(p.g, Var) or p.g.name in bound or p.g.name not in sources] or patterns
            # A date that others may give comes first.
            dated = [p for p in ready if not (self._of_revisions(p) and p.p == magic.STATE_AT and isinstance(p.o, Var) and p.o.name not in bound)]
            ready = dated or ready
            p = ready[pick(ready, bound)]
            star = [x for x in ready if x.s == p.s and self._of_revisions(x) and x.p in magic.STORED] if self._of_revisions(p) and p.p in magic.STORED and isinstance(p.s, Var) else [p]
            patterns = [x for x in patterns if all(x is not y for y in star)]
            if isinstance(p.g, Var) and rel and p.g.name in rel.cols:
                rel = self.correlate(rel, p)
            elif self._of_revisions(p) and p.p in magic.STORED and isinstance(p.s, Var):
                rel = self.star(rel, p.s.name, star)
            elif rel and self._of_revisions(p) and (made := self.step(rel, p)):
                rel = made
            else:
                made = self.pattern(p)
                rel = made if rel is None else self.join(rel, made)
        for item in rest:
            if isinstance(item, Graph) and isinstance(item.g, Var):
                made = self.group(item.group, self.distinct(rel, {item.g.name}) if rel and item.g.name in rel.cols else None)
                rel = made if rel is None else self.join(rel, made)
        return rel

    # -- attributes of revisions

    def _of_revisions(self, p: Pattern) -> bool:
        return p.g is None and not self.default and p.p in magic.PREDICATES if isinstance(p.p, str) else False

    def _sure(self, rel: Rel | None, x: Any) -> Column | None:
        """The column of a variable that every row binds."""
        return rel.column(x.name) if rel and isinstance(x, Var) and x.name not in rel.maybe else None

    def step(self, rel: Rel, p: Pattern) -> Rel | None:
        """An attribute that follows from a side that rel binds, whether or not the revision exists; None if neither does."""
        s, o = self._sure(rel, p.s), self._sure(rel, p.o)
        if p.p == magic.STATE_AT:
            if o is None:
                return None
            found = magic.states_at_dates(self.store.revisions, rel.df, rel.cols[p.o.name])
            found = found if isinstance(p.s, Var) else found.where(F.col("s") == p.s)
            made = self.bind(found, [(p.s, "s"), (p.o, "o")])
            made.kinds = {p.s.name: {"G"}} if isinstance(p.s, Var) else {}
            return self.join(rel, made)
        if s is None and o is None:
            return None
        numbered = rel.numbers.get(p.s.name) if s is not None else None
        if numbered:
            made = self.fresh("number")
            rel = replace(rel, df=rel.df.withColumn(made, F.col(numbered[0]) + {magic.PREVIOUS: -1, magic.NEXT: 1}.get(p.p, 0)))
            kind = magic._GRAPHS.get(p.p, numbered[1])
            value = T.integer_literal(F.col(made)) if p.p == magic.REVISION_ID else T.iri_column(SNAPSHOTS[kind], F.col(made))
        other = p.o if s is not None else p.s
        if not numbered:
            value = magic.object_of(p.p, s) if s is not None else magic.subject_of(p.p, o)
        if isinstance(other, Var) and other.name in rel.maybe:
            return None
        alias = self.fresh(other.name if isinstance(other, Var) else "given")
        df = rel.df.withColumn(alias, value).where(F.col(alias).isNotNull())
        if not isinstance(other, Var) or other.name in rel.cols:
            df = df.where(F.col(alias) == (F.lit(other) if isinstance(other, str) else F.col(rel.cols[other.name])))
            return Rel(df, rel.cols, rel.maybe, rel.kinds, most=rel.most, numbers=rel.numbers)
        numbers = {other.name: (made, kind)} if numbered and p.p != magic.REVISION_ID else {}
        kinds = {p.o.name: {magic.OBJECT_KIND[p.p]}} if isinstance(p.o, Var) and p.p in magic.OBJECT_KIND and p.p not in (magic.PREVIOUS, magic.NEXT) else {}
        return Rel(df, rel.cols | {other.name: alias}, rel.maybe, rel.kinds | kinds, most=rel.most, numbers=rel.numbers | numbers)

    def star(self, rel: Rel | None, subject: str, patterns: list[Pattern]) -> Rel:
        """Stored attributes of one subject: one scan of the revisions, joined on what rel binds."""
        df = self.store.revisions
        for p in patterns:
            if isinstance(p.o, str):
                df = magic.with_object(df, p.p, p.o)
        cols: dict[str, str] = {}
        on, picked = [], [F.col("revision_id").alias(rid := self.fresh("rid"))]
        at = self._sure(rel, Var(subject))
        if at is not None:
            on.append(rel.revision(subject) == F.col(rid))
        else:
            cols[subject] = self.fresh(subject)
            picked.append(T.iri_column(SNAPSHOTS["N"], F.col("revision_id")).alias(cols[subject]))
        for p in patterns:
            value = magic.attribute(p.p)
            df = df.where(F.col(magic.COLUMN[p.p]).isNotNull())
            given = self._sure(rel, p.o)
            if given is not None and p.p == magic.DATE:  # an instant, however it is spelled
                picked.append(F.col("ts_sec").alias(sec := self.fresh("sec")))
                on.append(T.date_seconds(given) == F.col(sec))
            elif isinstance(p.o, Var) and p.o.name not in cols and p.o.name != subject:
                cols[p.o.name] = self.fresh(p.o.name)
                picked.append(value.alias(cols[p.o.name]))
            elif isinstance(p.o, Var):
                df = df.where(value == (T.iri_column(SNAPSHOTS["N"], F.col("revision_id")) if p.o.name == subject else magic.attribute(next(x.p for x in patterns if x.o == p.o))))
        kinds = {p.o.name: {"N"} for p in patterns if isinstance(p.o, Var) and p.p == magic.PARENT}
        made = Rel(df.select(*picked), cols, set(), kinds, numbers={subject: (rid, "N")} if subject in cols else {})
        return made if rel is None else self.join(rel, made, on=on)

    def item(self, item: Any, rel: Rel | None) -> Rel:
        if isinstance(item, Values):
            return self.values(item)
        if isinstance(item, (Group, Graph)):
            group = item if isinstance(item, Group) else item.group
            return self.group(group, self.seed_for(rel, group))
        if isinstance(item, Union):
            return self.union([self.group(s, self.seed_for(rel, s)) for s in item.sides])
        if isinstance(item, Query):
            return self.select(item)[0]
        if isinstance(item, Service):
            if not isinstance(item.name, str) or item.name not in self.services:
                raise UnsupportedQuery(f"no table is registered for the service {item.name}")
            return Compiler(self.services[item.name], self.services).group(item.group)
        raise TypeError(item)

    def _graph_names(self, x: Any) -> set[str]:
        """Variables that name graphs inside."""
        if isinstance(x, Pattern):
            return {x.g.name} if isinstance(x.g, Var) else set()
        if isinstance(x, (list, tuple)):
            return set().union(*map(self._graph_names, x)) if x else set()
        if hasattr(x, "__dataclass_fields__"):
            return set().union(*(self._graph_names(getattr(x, f)) for f in x.__dataclass_fields__))
        return set()

    def seed_for(self, rel: Rel | None, group: Any, near: bool = False) -> Rel | None:
        """Outside values of the variables that name graphs inside: a state can only be read for given revisions.

        near: only what agrees with a row of rel is wanted, so where the group is patterns, of a state only what agrees in all that both bind."""
        names = self._graph_names(group) & set(rel.cols if rel else ())
        if names and near and not group.filters and all(isinstance(x, Pattern) or (isinstance(x, Graph) and not x.group.filters and all(isinstance(y, Pattern) for y in x.group.items)) for x in group.items):
            names |= (self._bound_names(group) & set(rel.cols)) - rel.maybe
        return self.distinct(rel, names) if names else None

    def distinct(self, rel: Rel, names: set[str]) -> Rel:
        cols = {n: self.fresh(n) for n in sorted(names)}
        numbers = {n: (self.fresh("number"), rel.numbers[n][1]) for n in sorted(names) if n in rel.numbers}
        df = rel.df.select(*[F.col(rel.cols[n]).alias(c) for n, c in cols.items()], *[F.col(rel.numbers[n][0]).alias(c) for n, (c, _) in numbers.items()]).distinct()
        return Rel(df, cols, rel.maybe & names, {n: k for n, k in rel.kinds.items() if n in names}, most=rel.most, numbers=numbers)

    # -- leaves

    def data(self, g: Any, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Quads (s, p, o, g) of a pattern's constants in its context."""
        tables = self.store.tables
        if isinstance(g, str):
            return scan.in_context(tables, "" if self.named and g not in self.named else g, s, p, o)
        graphs = self.named if isinstance(g, Var) else self.default
        if graphs:
            return reduce(DataFrame.unionByName, [scan.in_context(tables, n, s, p, o) for n in graphs])
        return scan.boundary_quads(scan.where_terms(tables.of(s, p, o), s, p, o))

    def pattern(self, p: Pattern) -> Rel:
        if isinstance(p.p, tuple):
            return self.path(p)
        given = [x if isinstance(x, str) else None for x in (p.s, p.p, p.o)]
        if p.g is None and not self.default and p.p in magic.ARITHMETIC and isinstance(p.s, Var) and isinstance(p.o, Var) and p.s != p.o:
            return self.step(self.star(None, p.s.name, []), p)
        if p.g is None and not self.default:
            quads = scan.quads(self.store.tables, self.store.revisions, *given)
        else:
            quads = self.data(p.g, *given)
        rel = self.bind(quads, [(p.s, "s"), (p.p, "p"), (p.o, "o"), (p.g, "g")])
        if p.g is None and not self.default:
            rel.most = 1 if p.p == magic.STATE_AT else None
            if isinstance(p.o, Var) and p.p in magic.OBJECT_KIND:
                rel.kinds[p.o.name] = {magic.OBJECT_KIND[p.p]}
            if isinstance(p.s, Var) and p.p == magic.STATE_AT:
                rel.kinds[p.s.name] = {"G"}
        if isinstance(p.g, Var):
            rel.kinds[p.g.name] = {"A", "D", "G"} if self.named else {"A", "D"}
        return rel

    def bind(self, df: DataFrame, sides: list[tuple[Any, str]]) -> Rel:
        cols: dict[str, str] = {}
        picked = []
        for x, column in sides:
            if not isinstance(x, Var):
                continue
            if x.name in cols:
                df = df.where(F.col(column) == F.col(next(c for v, c in sides if v == x)))
            else:
                cols[x.name] = self.fresh(x.name)
                picked.append(F.col(column).alias(cols[x.name]))
        return Rel(df.select(*picked), cols)

    def values(self, v: Values) -> Rel:
        cols = {n: self.fresh(n) for n in v.names}
        schema = ", ".join(f"{c} string" for c in cols.values())
        maybe = {n for i, n in enumerate(v.names) if any(r[i] is None for r in v.rows)}
        if not cols:
            return Rel(self.spark.range(len(v.rows)).select(), {}, most=len(v.rows))
        return Rel(self.spark.createDataFrame([tuple(r) for r in v.rows], schema), cols, maybe, most=len(v.rows))

    def correlate(self, rel: Rel, p: Pattern) -> Rel:
        """Joins a pattern in the graph that a column of rel names."""
        g = F.col(rel.cols[p.g.name])
        if isinstance(p.p, tuple):  # paths are read graph by graph
            return self.path_in(rel, p)
        loose = [x.name for x in (p.s, p.p, p.o) if isinstance(x, Var) and x.name in rel.maybe and x.name in rel.cols and x != p.g]
        if loose:  # apart by what is bound, so that every part joins by equality
            sides = [(df, set(loose) - set(bound)) for df, bound in self._sides(rel, list(dict.fromkeys(loose)))]
            return self.union([self.correlate(Rel(df, {n: c for n, c in rel.cols.items() if n not in gone}, rel.maybe - set(loose), rel.kinds), p) for df, gone in sides])
        given = [x if isinstance(x, str) else None for x in (p.s, p.p, p.o)]
        triples = scan.where_terms(self.store.tables.of(*given), *given)
        sides = [(p.s, "s"), (p.p, "p"), (p.o, "o")]
        parts = []
        for kind in sorted(rel.kinds.get(p.g.name, {"A", "D", "G"}) & {"A", "D", "G"}):
            if p.g.name in rel.numbers:
                left = rel.df.withColumn("_r", rel.revision(p.g.name)) if rel.numbers[p.g.name][1] == kind else rel.df.withColumn("_r", F.lit(None).cast("bigint"))
            else:
                left = rel.df.withColumn("_r", F.when(g.startswith("<" + SNAPSHOTS[kind]), T.snapshot_revision(g)))
            left = left.where("_r is not null")
            inner = self.bind(triples.select("s", "p", "o", "rev_start", "rev_end"), [*sides, (Var(".start"), "rev_start"), (Var(".end"), "rev_end")])
            start, end = inner.cols.pop(".start"), inner.cols.pop(".end")
            shared = [n for n in inner.cols if n in rel.cols and n != p.g.name]
            r = F.col("_r")
            keys = [F.col(rel.cols[n]) == F.col(inner.cols[n]) for n in shared]
            if kind in "AD":
                bound = F.col(start) == r if kind == "A" else (F.col(end) == r) & (F.col(end) < MAX)
                both = left.join(inner.df, reduce(Column.__and__, [*keys, bound]))
            elif keys:
                both = left.join(inner.df, reduce(Column.__and__, [*keys, F.col(start) <= r, r < F.col(end)]))
            elif rel.most is not None and rel.most <= temporal_join.FEW:
                both = temporal_join.contains_few(left, inner.df, "_r", start, end)
            else:
                both = temporal_join.contains(left, inner.df, "_r", start, end, levels=self.store.revision_bits())
            out = {n: c for n, c in rel.cols.items()} | {n: c for n, c in inner.cols.items() if n not in rel.cols}
            picked = [*out.values(), *dict.fromkeys(c for c, _ in rel.numbers.values())]
            made = both.select(*picked)
            if isinstance(p.g, Var) and p.g.name in inner.cols:
                made = both.where(F.col(inner.cols[p.g.name]) == g).select(*picked)
            parts.append(Rel(made, out, rel.maybe - set(shared), dict(rel.kinds), numbers=rel.numbers))
        return self.union(parts) if len(parts) > 1 else parts[0] if parts else Rel(rel.df.where(F.lit(False)), rel.cols)

    # -- paths

    def path(self, p: Pattern) -> Rel:
        starts = [x for x in (p.s, p.o) if isinstance(x, str)]
        pairs = self.pairs(p.p, p.g, p.s if isinstance(p.s, str) else None, p.o if isinstance(p.o, str) else None, starts)
        if isinstance(p.s, str):
            pairs = pairs.where(F.col("x") == p.s)
        if isinstance(p.o, str):
            pairs = pairs.where(F.col("y") == p.o)
        return self.bind(pairs, [(p.s, "x"), (p.o, "y")])

    def path_in(self, rel: Rel, p: Pattern) -> Rel:
        """A path in each graph that a column of rel names: nodes carry their graph, so no step leaves it."""
        graphs = self.distinct(rel, {p.g.name})
        name = graphs.cols[p.g.name]
        found = self.correlate(graphs, Pattern(Var(".x"), Var(".p"), Var(".y"), p.g))
        g = F.col(found.cols[p.g.name])
        tag = lambda c: F.concat(g, F.lit(_TAG), F.col(found.cols[c]))
        edges = found.df.select(tag(".x").alias("x"), F.col(found.cols[".p"]).alias("p"), tag(".y").alias("y"))
        starts = [x for x in (p.s, p.o) if isinstance(x, str)]
        pairs = self.pairs(p.p, Tagged(edges, graphs.df.select(F.col(name).alias("g"))), terms=starts)
        x, y = (F.split(c, _TAG, 2) for c in ("x", "y"))
        pairs = pairs.select(x[0].alias("g"), x[1].alias("x"), y[1].alias("y"))
        for side, c in ((p.s, "x"), (p.o, "y")):
            if isinstance(side, str):
                pairs = pairs.where(F.col(c) == side)
        return self.join(rel, self.bind(pairs, [(p.g, "g"), (p.s, "x"), (p.o, "y")]))

    def nodes(self, terms: list[str], g: Any) -> DataFrame:
        """(x) of terms that a path of no step may stay at; in each graph, where nodes carry it."""
        rows = self.spark.createDataFrame([(t,) for t in terms], "x string")
        return rows.crossJoin(g.graphs).select(F.concat("g", F.lit(_TAG), "x").alias("x")) if isinstance(g, Tagged) else rows

    def edges(self, g: Any) -> DataFrame:
        if isinstance(g, Tagged):
            return g.edges
        return self.data(g).select(F.col("s").alias("x"), "p", F.col("o").alias("y"))

    def pairs(self, path: Any, g: Any, start: str | None = None, end: str | None = None, terms: list[str] = ()) -> DataFrame:
        """(x, y) of a path."""
        if isinstance(path, str):
            if g is None and not self.default:
                return scan.quads(self.store.tables, self.store.revisions, None, path, None).select(F.col("s").alias("x"), F.col("o").alias("y"))
            return self.edges(g).where(F.col("p") == path).select("x", "y")
        op, *rest = path
        if op == "^":
            return self.pairs(rest[0], g, end, start, terms).select(F.col("y").alias("x"), F.col("x").alias("y"))
        if op == "/":
            out = self.pairs(rest[0], g, start, None, terms)
            for i, step in enumerate(rest[1:], 2):
                after = self.pairs(step, g, None, end if i == len(rest) else None, terms)
                out = out.withColumnRenamed("y", "m").join(after.withColumnRenamed("x", "m"), "m").select("x", "y")
            return out
        if op == "|":
            return reduce(DataFrame.unionByName, [self.pairs(x, g, start, end, terms) for x in rest])
        if op == "!":
            forward, backward = rest
            e = self.edges(g)
            out = e.where(~F.col("p").isin(list(forward))).select("x", "y") if forward or not backward else None
            back = e.where(~F.col("p").isin(list(backward))).select(F.col("y").alias("x"), F.col("x").alias("y")) if backward else None
            return out.unionByName(back) if out is not None and back is not None else out if out is not None else back
        inner = self.pairs(rest[0], g)
        if op == "?":
            out = inner
        elif start is not None:
            out = closure(inner, self.spark.createDataFrame([(start,)], "x string"))
        elif end is not None:
            turned = closure(inner.select(F.col("y").alias("x"), F.col("x").alias("y")), self.spark.createDataFrame([(end,)], "x string"))
            out = turned.select(F.col("y").alias("x"), F.col("x").alias("y"))
        else:
            out = closure(inner)
        if op in "*?":
            e = self.edges(g)
            nodes = e.select("x").unionByName(e.select(F.col("y").alias("x")))
            if start is not None or end is not None:
                nodes = self.spark.createDataFrame([(t,) for t in (start, end) if t is not None], "x string")
            elif terms:
                nodes = nodes.unionByName(self.nodes(list(terms), g))
            out = out.unionByName(nodes.select("x", F.col("x").alias("y")))
        return out.distinct()

    # -- operators

    def expressions(self, rel: Rel, aggregates: dict | None = None) -> Expressions:
        return Expressions(rel.column, None, aggregates)

    def extend(self, rel: Rel, e: Any, name: str, aggregates: dict | None = None) -> Rel:
        flagged, exists = self.flags(rel, e)
        value = Expressions(rel.column, exists, aggregates, rel.held)(e).term()
        alias = self.fresh(name)
        kinds = {name: rel.kinds[e.name]} if isinstance(e, Var) and e.name in rel.kinds else {}
        maybe = set() if isinstance(e, str) or (isinstance(e, Var) and e.name in rel.cols and e.name not in rel.maybe) or (isinstance(e, tuple) and e[0] in ("BOUND", "EXISTS")) else {name}
        return Rel(flagged.withColumn(alias, value), rel.cols | {name: alias}, rel.maybe | maybe, rel.kinds | kinds, rel.held)

    def decoded(self, rel: Rel, expressions: list[Any]) -> Rel:
        """A text or a number that is read several times is decoded once, in columns of its own."""
        times = sum(map(read_texts, expressions), Counter())
        df, held = rel.df, dict(rel.held)
        for name in sorted(n for n, k in times.items() if k > 1 and n in rel.cols and n not in held):
            held[name] = self.fresh("text")
            df = df.withColumn(held[name], T.string_of(F.col(rel.cols[name])))
        times = sum(map(read_numbers, expressions), Counter())
        for name in sorted(n for n, k in times.items() if k > 1 and n in rel.cols and f"#{n}" not in held):
            held[f"#{name}"] = at = self.fresh("number")
            df = T.with_numbers(df, rel.cols[name], at)
        return Rel(df, rel.cols, rel.maybe, rel.kinds, held)

    def _exists(self, e: Any):
        if isinstance(e, tuple):
            if e and e[0] == "EXISTS":
                yield e
            else:
                for x in e:
                    yield from self._exists(x)

    def flags(self, rel: Rel, e: Any) -> tuple[DataFrame, Any]:
        """The rows with a flag for each EXISTS inside an expression, and a function from its group to the flag.

        Whether a pattern exists depends on the variables that it shares with the row: each combination of these is looked up once."""
        df, of = rel.df, {}
        for x in self._exists(e):
            names = names_in(x[1]) & set(rel.cols)
            flag = self.fresh("flag")
            if names:
                keys = self.distinct(rel, names)
                hit = self.semi(keys, x[1], "left_semi").df.withColumn(flag, F.lit(True))
                df = df.join(hit, reduce(Column.__and__, [F.col(rel.cols[n]).eqNullSafe(F.col(keys.cols[n])) for n in names]), "left").drop(*keys.cols.values())
            else:
                df = df.join(self.group(x[1]).df.limit(1).select(F.lit(True).alias(flag)), F.lit(True), "left")
            of[id(x[1])] = F.coalesce(F.col(flag), F.lit(False))
        return df, (lambda group: of[id(group)])

    def filter(self, rel: Rel, e: Any, aggregates: dict | None = None) -> Rel:
        if isinstance(e, tuple) and e[0] == "&&":
            return self.filter(self.filter(rel, e[1], aggregates), e[2], aggregates)
        if isinstance(e, tuple) and e[0] == "EXISTS":
            return self.semi(rel, e[1], "left_semi")
        if isinstance(e, tuple) and e[0] == "!" and isinstance(e[1], tuple) and e[1][0] == "EXISTS":
            return self.semi(rel, e[1][1], "left_anti")
        rel = self.decoded(rel, [e])
        flagged, exists = self.flags(rel, e)
        kept = flagged.where(F.coalesce(Expressions(rel.column, exists, aggregates, rel.held)(e).bool(), F.lit(False)))
        bound = {e[1].name} if isinstance(e, tuple) and e[0] == "BOUND" else set()
        return Rel(kept, rel.cols, rel.maybe - bound, rel.kinds, rel.held)

    def semi(self, rel: Rel, group: Group, how: str) -> Rel:
        outside = self._filter_names(group) - self._bound_names(group)
        names = (outside | self._graph_names(group)) & set(rel.cols)
        inner = self.group(group, self.distinct(rel, names) if names else None)
        shared = [n for n in inner.cols if n in rel.cols]
        return self.split(rel, inner, shared, "semi" if how == "left_semi" else "anti")

    def _filter_names(self, x: Any) -> set[str]:
        if isinstance(x, Group):
            return names_in(x.filters) | self._filter_names(x.items)
        if isinstance(x, Bind):
            return names_in(x.expression)
        if isinstance(x, list):
            return set().union(*map(self._filter_names, x)) if x else set()
        if isinstance(x, (Optional_, Minus, Graph)):
            return self._filter_names(x.group)
        return self._filter_names(x.sides) if isinstance(x, Union) else set()

    def _bound_names(self, group: Group) -> set[str]:
        """Variables that every solution of the group binds by patterns of its own."""
        return set().union(*(names_in(i) for i in group.items if isinstance(i, (Pattern, Graph, Group)))) if group.items else set()

    @staticmethod
    def _sides(rel: Rel, shared: list[str]) -> list[tuple[DataFrame, list[str]]]:
        """The rows apart by which of the shared variables they bind: each part joins by equality on these."""
        parts = [(rel.df, [])]
        for n in shared:
            if n in rel.maybe:
                c = F.col(rel.cols[n])
                parts = [x for df, bound in parts for x in ((df.where(c.isNotNull()), [*bound, n]), (df.where(c.isNull()), bound))]
            else:
                parts = [(df, [*bound, n]) for df, bound in parts]
        return parts

    def split(self, a: Rel, b: Rel, shared: list[str], how: str, condition: Column | None = None, on: list[Column] | None = None, common: bool = False) -> Rel:
        """a with the rows of b that agree in all variables that both bind: 'inner', 'left', 'semi' or 'anti'.

        Rows are taken apart by the variables that they bind, so every part is an equality join.
        common: only rows that both bind some shared variable agree (MINUS)."""
        extra = [*(on or []), *([] if condition is None else [condition])]
        cols = a.cols | {n: c for n, c in b.cols.items() if n not in a.cols}

        def both(x: DataFrame, y: DataFrame, keys: list[str], kind: str) -> DataFrame | None:
            match = [F.col(a.cols[n]) == F.col(b.cols[n]) for n in keys] + extra
            if common and not keys:
                return None
            if not match:
                return x.crossJoin(y) if kind == "inner" else x.join(y.limit(1).select(F.lit(True).alias("_some")), F.lit(True), kind)
            return x.join(y, reduce(Column.__and__, match), kind)

        made = []
        for x, mine in self._sides(a, shared):
            sides = [(y, [n for n in theirs if n in mine]) for y, theirs in self._sides(b, shared)]
            if how == "left" and len(sides) == 1 and (sides[0][1] or extra):
                made.append(both(x, *sides[0], "left"))
                continue
            if how in ("inner", "left"):
                made += [both(x, y, keys, "inner") for y, keys in sides]
            rest = x
            if how != "inner":
                for y, keys in sides:
                    if how == "semi" and (found := both(rest, y, keys, "left_semi")) is not None:
                        made.append(found)
                    if how != "semi" or len(sides) > 1:
                        left = both(rest, y, keys, "left_anti")
                        rest = rest if left is None else left
                if how == "anti":
                    made.append(rest)
                elif how == "left":
                    made.append(rest.select("*", *[F.lit(None).cast("string").alias(c) for c in b.df.columns]))
        if how in ("semi", "anti"):
            return Rel(reduce(DataFrame.unionByName, made), a.cols, a.maybe, a.kinds)
        picked = [(F.coalesce(F.col(c), F.col(b.cols[n])) if n in shared and n in a.maybe else F.col(c)).alias(c) for n, c in cols.items()]
        left = how == "left"
        maybe = {n for n in cols if (n in a.maybe and (left or n not in b.cols or n in b.maybe)) or (n in b.maybe and n not in a.cols)}
        if left:
            maybe |= {n for n in b.cols if n not in a.cols}
        kinds = dict(b.kinds)
        for n, k in a.kinds.items():
            kinds[n] = k & kinds[n] if n in kinds else k
        numbers = {n: x for n, x in a.numbers.items() if n not in a.maybe} | ({} if left else {n: x for n, x in b.numbers.items() if n not in a.cols and n not in b.maybe})
        picked += [F.col(c) for c in dict.fromkeys(c for c, _ in numbers.values())]
        return Rel(reduce(DataFrame.unionByName, [m.select(*picked) for m in made]), cols, maybe, kinds, numbers=numbers)

    def join(self, a: Rel, b: Rel, how: str = "inner", condition: Any = None, on: list[Column] | None = None) -> Rel:
        """on: equalities beside those of the shared variables."""
        shared = [n for n in b.cols if n in a.cols]
        found = None
        if condition is not None:
            look = lambda n: F.coalesce(F.col(a.cols[n]), F.col(b.cols[n])) if n in shared else F.col((a.cols | b.cols)[n]) if n in a.cols or n in b.cols else None
            found = F.coalesce(Expressions(look)(condition).bool(), F.lit(False))
        return self.split(a, b, shared, how, found, on)

    def optional(self, rel: Rel, group: Group) -> Rel:
        """The group's own filters are conditions of the join, where they may use outside variables."""
        bare = Group(group.items, [], group.g)
        plain = [e for e in group.filters if not list(self._exists(e))]
        inner = self.group(Group(group.items, [e for e in group.filters if list(self._exists(e))], group.g) if len(plain) < len(group.filters) else bare, self.seed_for(rel, group))
        return self.join(rel, inner, "left", reduce(lambda x, y: ("&&", x, y), plain) if plain else None)

    def minus(self, a: Rel, b: Rel) -> Rel:
        shared = [n for n in b.cols if n in a.cols]
        if not shared:
            return a
        return self.split(a, b, shared, "anti", common=True)

    def union(self, sides: list[Rel]) -> Rel:
        names = sorted(set().union(*(s.cols for s in sides)))
        cols = {n: self.fresh(n) for n in names}
        parts = [s.df.select(*[(F.col(s.cols[n]) if n in s.cols else F.lit(None).cast("string")).alias(c) for n, c in cols.items()]) for s in sides]
        maybe = {n for n in names if any(n not in s.cols or n in s.maybe for s in sides)}
        kinds = {n: set().union(*(s.kinds[n] for s in sides)) for n in names if all(n in s.kinds for s in sides)}
        return Rel(reduce(DataFrame.union, parts), cols, maybe, kinds)
