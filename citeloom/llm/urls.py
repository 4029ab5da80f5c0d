"""URL filter: host and path rules first, then a weighted vocabulary found with Aho-Corasick.

The automaton finds every term of a table of weights in the url from its host to its end, query and fragment included; a hit counts only
between boundaries (the characters beside it are not letters or digits; a term that ends in ``*`` needs only the left one). The weights
of different terms found add up and block at ``limit``: one strict term weighs that much, several soft ones do. A rule (host part + path prefix) that fits
decides before the vocabulary; of several the longest does.

Defined results: null or a url without ``://`` has empty host and path, fits no rule and is allowed; an
empty table gives no rows; repeated rows stay repeated; other columns are ignored; urls of any length are
scanned whole, in linear time.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import pick

STRICT = (
    "porn*", "xxx", "sex", "hardcore", "escorts", "casino*", "viagra", "cialis", "pills", "warez", "phishing",
    "malware", "torrents", "camgirls",
)
SOFT = (
    "adult", "bet", "betting", "bonus", "cheap", "crack", "dating", "drugs", "free", "gambling", "hot", "jackpot", "loan",
    "loans", "lottery", "nude", "pharmacy", "poker", "replica", "slots", "spam", "win", "ads", "track", "tracker", "click",
    "bets", "farm", "farms", "x",
)
#: Weights of different terms that block a url together.
LIMIT = 2.0
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    for end in "?#":
        at = rest.find(end)
        if at >= 0:
            rest = rest[:at]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return host.translate(_ASCII_LOWER), path


def find_rule(host: str, path: str, rules: tuple) -> tuple[str, str] | None:
    best = None
    for rule, verdict in rules:
        at = rule.find("/")
        h, p = rule[:at], rule[at:]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def vocabulary(strict: tuple = STRICT, soft: tuple = SOFT, limit: float = LIMIT) -> dict[str, float]:
    """The weight of each term: a strict one reaches the limit alone, soft ones only together."""
    return {t: 1.0 for t in soft} | {t: float(limit) for t in strict}


def automaton(weights: dict[str, float]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t, w in weights.items():
        if t.rstrip("*"):
            a.add_word(t.rstrip("*").lower(), (t.rstrip("*").lower(), w, t.endswith("*")))
    a.make_automaton()
    return a


def hits(a: ahocorasick.Automaton, text: str) -> dict[str, float]:
    """Different terms that stand between boundaries, with their weights."""
    found: dict[str, float] = {}
    if not len(a):
        return found
    for end, (term, weight, open_right) in a.iter(text):
        start = end - len(term) + 1
        left = start == 0 or not text[start - 1].isalnum()
        right = open_right or end + 1 == len(text) or not text[end + 1].isalnum()
        if left and right:
            found[term] = weight
    return found


def judge(pages: DataFrame, weights: dict[str, float] | None = None, limit: float = LIMIT, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft) for each row of pages (page_id, url).

    The method blocks a url whose different terms weigh ``limit`` or more together; terms of that weight alone count as strict.
    """
    weights = vocabulary(limit=limit) if weights is None else weights

    def run(batches):
        a = automaton(weights)
        for b in batches:
            out: list[tuple] = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                found = hits(a, url[url.index("://") + 3 :].lower()) if url and "://" in url else {}
                strict = sum(w >= limit for w in found.values())
                rule = find_rule(host, path, rules)
                bad = sum(found.values()) >= limit
                out.append((host, path, rule and rule[0], rule[1] if rule else "block" if bad else "allow", strict, len(found) - strict))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"],
            )

    schema = "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long"
    return pick(pages, page_id="page_id", url="url").withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
