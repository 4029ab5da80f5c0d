"""Addresses of the official site and their coordinates, titles as published."""

from __future__ import annotations

import re

from citeloom.functions import coords as C
from citeloom.functions.grammar import PREFIX, instrument_length

SITE = "https://www.legislation.gov.uk/"
# View names that an address may end in, how designators and sub-divisions are written.
VIEWS = frozenset("contents enacted made created adopted data.xml england wales scotland ni england+wales".split())
DESIGNATOR = re.compile(r"[0-9A-Z][0-9A-Za-z]{0,11}(?:\.[0-9A-Za-z]{1,6}){0,2}")
LOWER_DESIGNATOR = re.compile(r"[a-z]{1,2}[0-9]{0,2}")
LOWER_UNITS = ("sch", "para")
SUBDIVISION = re.compile(r"[0-9]{1,4}[A-Z]{0,3}[0-9]{0,2}|[A-Z]{1,3}[0-9]{0,3}|[ivxlc]{1,7}[a-z]?|[a-z]{1,3}")
NO_SUBDIVISION = frozenset({"and", "the", "for", "of", "to", "sch"})
REPEALED = re.compile(r"\s*\((?:repealed|revoked)\b[^()]*\)\s*$", re.I)
# End of the fixed values.

_ADDRESS = re.compile(r"^https?://www\.legislation\.gov\.uk/(?:id/)?(?P<path>[^?#]+?)/?$")
_WORDS = {v: k for k, v in PREFIX.items()}


def address_path(uri: str | None) -> str | None:
    m = _ADDRESS.match((uri or "").strip())
    return m["path"] if m else None


def _designates(prefix: str, token: str) -> bool:
    return bool(DESIGNATOR.fullmatch(token) or prefix in LOWER_UNITS and LOWER_DESIGNATOR.fullmatch(token))


def tail_of(tokens: list[str]) -> list[str] | None:
    """Coordinate tail of id or address tokens: section, 124, 1ZA gives s124, 1ZA; None if they name no provision."""
    out: list[str] = []
    todo = tokens[::-1]
    while todo:
        t = todo.pop()
        prefix = PREFIX.get(t)
        if prefix and todo and todo[-1] not in PREFIX and _designates(prefix, todo[-1]):
            out.append(prefix + todo.pop())
        elif prefix == "sch":
            out.append(prefix)
        elif prefix or not out or t in NO_SUBDIVISION or not SUBDIVISION.fullmatch(t):
            return None
        else:
            out.append(t)
    return out or None


def path_of(tail: list[str]) -> str:
    """The inverse: s124, 1ZA gives section/124/1ZA."""
    out: list[str] = []
    for s in tail:
        prefix = next((p for p in sorted(_WORDS, key=len, reverse=True) if s.startswith(p) and (s == "sch" if s == p else _designates(p, s[len(p) :]))), None)
        out += [s] if prefix is None else [_WORDS[prefix], *([s[len(prefix) :]] if s != prefix else [])]
    return "/".join(out)


def valid(coordinate: str) -> bool:
    """Whether text is a UK coordinate, in plain Python; ``coords.parse`` says the same of a column."""
    seg = coordinate.split("/")
    n = None if len(seg) < 4 or seg[0] != "uk" else 3 if re.fullmatch(C.YEAR_SEGMENT, seg[2]) else 4 if re.fullmatch(C.REGNAL_SEGMENT, seg[2]) else None
    if n is None or len(seg) <= n or len(coordinate) > C.MAX_LENGTH or len(seg) - n - 1 > C.MAX_DEPTH:
        return False
    tail = seg[n + 1 :]
    good = re.fullmatch(C.SCHEMES["uk"].instrument.strip("^$"), "/".join(seg[1 : n + 1])) and all(re.match(C.SEGMENT, s) for s in tail)
    return bool(good and (not tail or re.match(C.FIRST, tail[0])))


def coordinate_of(uri: str | None) -> str | None:
    """The coordinate of an address, without the view or date it may end in; None if it names none."""
    path = address_path(uri)
    parts = [p for p in (path or "").split("/") if p]
    n = instrument_length([p.lower() for p in parts])
    if n is None:
        return None
    rest = parts[n:]
    while rest and (rest[-1] in VIEWS or re.fullmatch(r"\d{4}-\d{2}-\d{2}", rest[-1])):
        rest.pop()
    tail = tail_of(rest) if rest else []
    made = None if tail is None else "/".join(["uk", *parts[:n], *tail])
    return made if made and valid(made) else None


def clean_title(published: str) -> tuple[str, bool]:
    """A title without "(repealed ...)" or "(revoked ...)" at its end, and whether that was there."""
    title = REPEALED.sub("", published).strip()
    return title or published.strip(), REPEALED.search(published) is not None
