"""Secret scan with multipart credential linking.

Base spans (assign, access, hex) are found over the whole text. The method adds weak candidates, parts that
mean nothing alone: identifiers (``user=``, ``client_id:`` ...), opaque values (long mixed tokens) and endpoints
(``scheme://host``, ``host:port``). A scope is a paragraph or key-value block (blank lines end it) and at most
``REACH`` code points around a part. Parts and base spans of a scope are joined as intervals; a weak candidate is reported only when complementary parts co-occur: an identifier needs
a secret (base or opaque value), an opaque value needs an identifier, an access key or an assignment and an endpoint,
an endpoint needs both an identifier and a secret.

A scope is asked for a part of a role by two binary searches over running ends, so nothing inside it is overlooked and
a text of any length and any number of parts costs n log n; a document is one row and no shuffle takes place.

Defined results: null and empty texts give zero counts, the hash of the empty string and an empty ``spans``;
repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import pick

REACH = 400
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
IDENT = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?(?:key_?)?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(
    r"(?<![A-Za-z0-9])(?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~%@:-]+|(?:[a-z0-9-]{1,63}\.){1,10}[a-z]{2,24}:[0-9]{2,5}(?![0-9]))", re.ASCII
)
_BLANK = re.compile(r"\n[ \t\r]*\n")


def _mixed(token: str) -> bool:
    """Upper, lower and digit, and at least 3.5 bits a character: not a word."""
    if not (any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)):
        return False
    n = len(token)
    return -sum(v / n * math.log2(v / n) for v in Counter(token).values()) >= 3.5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), per kind leftmost and non-overlapping."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class _Within:
    """Spans of some roles by start, with running ends, so that any stretch is asked in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _, _ in spans]
        self.furthest = list(accumulate((e for *_, e in spans), max))  # of this span and all before
        self.nearest = list(accumulate((e for *_, e in reversed(spans)), min))[::-1]  # of this span and all after

    def meets(self, start: int, end: int) -> bool:
        """Does any span overlap the stretch?"""
        i = bisect_left(self.starts, end)
        return i > 0 and self.furthest[i - 1] > start

    def holds(self, low: int, high: int) -> bool:
        """Does any span lie inside the stretch?"""
        i = bisect_left(self.starts, low)
        return i < len(self.starts) and self.nearest[i] <= high


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found, known = [], _Within(base)
    if ":" in text or "=" in text:
        found += [(m.start(1), 3, m.end(1)) for m in IDENT.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if _mixed(m[0]) and not known.meets(m.start(), m.end())]
    if ":" in text:
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return sorted(found)


def linked(text: str, base: list, weak: list, reach: int = REACH) -> list[tuple[int, int, int]]:
    """The weak parts that co-occur in a scope with their complements."""
    if not weak or len(weak) + len(base) < 2:
        return []
    cuts = [m.start() for m in _BLANK.finditer(text)]
    roles = {k: _Within([s for s in base + weak if s[1] in k]) for k in ((3, 1), (0, 2, 4), (0, 2), (5,))}

    def near(span, kinds) -> bool:
        start, _, end = span
        at = bisect_left(cuts, start)
        low = max(cuts[at - 1] if at else 0, start - reach)
        high = min(cuts[at] if at < len(cuts) else len(text), end + reach)
        return roles[kinds].holds(low, high)

    out = []
    for w in weak:
        if w[1] == 3:
            ok = near(w, (0, 2, 4))
        elif w[1] == 4:
            ok = near(w, (3, 1)) or near(w, (0, 2)) and near(w, (5,))
        else:
            ok = near(w, (3, 1)) and near(w, (0, 2, 4))
        if ok:
            out.append(w)
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_weak, base string, spans string) for each row of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = linked(text, base, weak_parts(text, base), reach) if text else []
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                for c, v in zip(cols, [*counts, len(more), render(base), render(base + more)], strict=True):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_weak", "base", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_weak long, base string, spans string"
    return pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_weak")
