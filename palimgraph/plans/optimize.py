"""What is decided before Catalyst: the order of patterns and path rewrites."""

from __future__ import annotations

from typing import Any

from ..operators import magic
from ..vocabulary import snapshot
from .algebra import Pattern, Var

MANY, ALL = 1e9, float(1 << 31)


def simplify_path(p: Any) -> Any:
    """p/p* and p*/p are p+."""
    if not isinstance(p, tuple) or p[0] == "!":
        return p
    op, *steps = p
    steps = [simplify_path(x) for x in steps]
    if op == "/":
        out: list = []
        for x in steps:
            if out and (x == ("*", out[-1]) or out[-1] == ("*", x)):
                base = out[-1] if x == ("*", out[-1]) else x
                out[-1] = ("+", base)
            else:
                out.append(x)
        return out[0] if len(out) == 1 else ("/", *out)
    return (op, *steps)


def estimate(p: Pattern, bound: set[str]) -> float:
    """Rows that a pattern is expected to give once these variables are bound."""

    def known(x: Any) -> bool:
        return x is not None and (not isinstance(x, Var) or x.name in bound)

    s, o = known(p.s), known(p.o)
    if isinstance(p.g, str):
        at = snapshot(p.g)
        if not at or at[0] == "N":
            return 0
        if at[0] in "AD":
            return 1
    elif p.g is None and isinstance(p.p, str) and p.p in magic.PREDICATES:
        if p.p == magic.STATE_AT:
            return 1 if o else ALL
        if s:
            return 1
        per_value = {magic.ABOUT: 100, magic.AUTHOR: 10_000}
        return per_value.get(p.p, 1) if o else ALL
    if any(isinstance(x, str) and (at := snapshot(x)) and at[0] == "N" for x in (p.s, p.o)):
        return 10
    pk = isinstance(p.p, str) or (isinstance(p.p, Var) and p.p.name in bound)
    if s:
        return 1 if pk or o else 100
    return 100_000 if o else MANY


def pick(patterns: list[Pattern], bound: set[str]) -> int:
    """The next pattern to join: one that shares a variable, of the least estimate."""

    def rank(i: int) -> tuple:
        p = patterns[i]
        names = {x.name for x in (p.s, p.p, p.o, p.g) if isinstance(x, Var)}
        return bool(bound) and not (names & bound), estimate(p, bound), i

    return min(range(len(patterns)), key=rank)
