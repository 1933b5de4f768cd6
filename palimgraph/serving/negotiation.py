"""Which media type answers an Accept header."""

from __future__ import annotations

from collections.abc import Sequence


class NotAcceptable(ValueError):
    """No available type is accepted (HTTP 406)."""


def _range(text: str) -> tuple[float, str, str]:
    mime, *parameters = text.split(";")
    kinds = [x.strip() for x in mime.split("/")]
    if len(kinds) != 2 or not all(kinds):
        raise ValueError(f"no media type: {mime!r}")
    weight = 1.0
    for p in parameters:
        name, sep, value = (x.strip() for x in p.partition("="))
        if not sep or "=" in value:
            raise ValueError(f"no parameter: {p!r}")
        if name == "q":
            weight = float(value)
            if not 0 <= weight <= 1:
                raise ValueError(f"q is from 0 to 1, not {value}")
    return weight, *kinds


def negotiate(accept: str | None, available: Sequence[str]) -> str | None:
    """The first available type that the header's ranges match, by falling q,
    then by their order; None if there is none.  ValueError if malformed."""
    ranges = [_range(x) for x in (accept if accept is not None else "*/*").split(",")]
    for _, kind, sub in sorted(ranges, key=lambda r: -r[0]):
        for mime in available:
            main, _, rest = mime.partition("/")
            if kind == "*" or (kind == main and sub in ("*", rest)):
                return mime
    return None
