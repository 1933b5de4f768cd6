"""Nodes of a parsed query.  Variables are Var, constants are term strings."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass
class Pattern:
    s: Any
    p: Any  # term, Var or a path tuple
    o: Any
    g: Any = None


@dataclass
class Group:
    """Elements in the order written; filters apply to the whole group."""

    items: list = field(default_factory=list)
    filters: list = field(default_factory=list)
    g: Any = None


@dataclass
class Optional_:
    group: Group


@dataclass
class Minus:
    group: Group


@dataclass
class Union:
    sides: list


@dataclass
class Graph:
    group: Group
    g: Any


@dataclass
class Bind:
    expression: Any
    name: str


@dataclass
class Values:
    names: list[str]
    rows: list[list[str | None]]


@dataclass
class Service:
    name: Any
    group: Group


@dataclass
class Query:
    form: str = "SELECT"
    projection: list = field(default_factory=list)  # (name, expression or None); empty for *
    distinct: bool = False
    reduced: bool = False
    where: Group = field(default_factory=Group)
    template: list = field(default_factory=list)
    describe: list = field(default_factory=list)
    graphs: list = field(default_factory=list)
    named: list = field(default_factory=list)
    group_by: list = field(default_factory=list)  # (name or None, expression)
    grouped: bool = False
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0
    values: Values | None = None


def names_in(x: Any) -> set[str]:
    """Variables mentioned anywhere in a node or expression."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, Bind):
        return names_in(x.expression) | {x.name}
    if isinstance(x, Values):
        return set(x.names)
    if isinstance(x, Query):
        if x.projection:
            return {n for n, _ in x.projection}
        return names_in(x.where)
    if isinstance(x, (list, tuple)):
        return set().union(*map(names_in, x)) if x else set()
    if hasattr(x, "__dataclass_fields__"):
        return set().union(*(names_in(getattr(x, f)) for f in x.__dataclass_fields__))
    return set()
