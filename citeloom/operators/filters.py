"""The retrieval filter of a bound decision, as a Column and as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _split(coordinate: str) -> tuple[str, str | None]:
    parts = coordinate.split("/")
    n = 4 if parts[2][:1].isdigit() else 5
    return "_".join(parts[:n]), coordinate if len(parts) > n else None


def _allowed(coordinate: str) -> str:
    if not all(c.isascii() and (c.isalnum() or c in "/.-") for c in coordinate):
        raise ValueError(f"{coordinate!r} is no coordinate")
    return coordinate


def _plan(bound: list[str], excluded: list[str]):
    pairs = [_split(_allowed(c)) for c in bound]
    ids = list(dict.fromkeys(i for i, _ in pairs))
    whole = {i for i, p in pairs if p is None}
    provisions = [p for i, p in pairs if p is not None and i not in whole]
    return ids, [i for i in ids if i in whole], provisions, [_allowed(x) for x in excluded]


def partition_filter(bound: list[str], excluded: list[str] = ()) -> Column:
    """instrument_id among the bound ones, and a bound provision or beneath one, and nothing excluded.

    A whole instrument takes in its provisions. Nothing bound: false.
    """
    if not bound:
        return F.lit(False)
    ids, whole, provisions, out = _plan(list(bound), list(excluded))
    c = F.col("coordinate")
    keep = F.col("instrument_id").isin(*ids)
    if provisions:
        parts = [(c == p) | c.startswith(p + "/") for p in provisions]
        if whole:
            parts.append(F.col("instrument_id").isin(*whole))
        keep = keep & reduce(Column.__or__, parts)
    for x in out:
        keep = keep & ~((c == x) | c.startswith(x + "/"))
    return keep


def filter_text(bound: list[str], excluded: list[str] = ()) -> str | None:
    if not bound:
        return None
    ids, whole, provisions, out = _plan(list(bound), list(excluded))
    text = "instrument_id in [" + ", ".join(f'"{i}"' for i in ids) + "]"
    one = lambda p: f'(coordinate == "{p}" or coordinate like "{p}/%")'
    if provisions:
        parts = [one(p) for p in provisions] + [f'instrument_id == "{w}"' for w in whole]
        text += " and (" + " or ".join(parts) + ")"
    for x in out:
        text += f" and not {one(x)}"
    return text
