"""Quality rules: a decision list learned by sequential covering, applied as one Spark CASE expression.

Statistics are built-in expressions over whole texts. From labelled documents (a bounded, hash-chosen sample:
``sample_rows``) conjunctions of thresholds are grown by FOIL gain on two thirds of the rows and pruned on the
rest; a rule enters the list if it is right on at least ``precision`` of what it covers among the rows no
earlier rule covers, on both parts. The list is ordered; the first rule that holds rejects. Application has
no join, no shuffle and no Python: it is a projection of the scan.

Defined results: a null text counts as empty (no words: the base rule fails it); a rule's null never
rejects; repeated rows get equal verdicts; empty tables give no rows, and without usable labels only the base rule decides;
other columns are ignored by the query and passed through by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import carried, carrying

SAMPLE_ROWS = 20_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: What the learned conditions may test.
FEATURES = (
    "n_words", "mean_word", "symbol_share", "bang_share", "upper_share", "dup_line_share", "repeat_share",
    "distinct_share", "mean_line",
)


def let(value: Column, body) -> Column:
    """body(value), with value computed once even where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; hashes: one for each five-word window."""

    def covered(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(
            s,
            lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"])),
        )
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.coalesce(F.least(F.get(p, j + 1) - x, F.lit(5)), F.lit(5))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))


def _word_stats(words: Column) -> Column:
    n = F.size(words)
    ids = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(
        ids,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])
        ),
    )
    repeat = F.when(n < 5, F.lit(0)).otherwise(let(windows, _repeat_words))
    return F.struct(n.cast("long").alias("n"), repeat.cast("long").alias("repeat"), F.size(F.array_distinct(words)).alias("distinct"))


def _line_stats(lines: Column) -> Column:
    full = F.filter(lines, lambda x: F.translate(x, SPACES, "") != "")
    return let(
        full, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))
    )


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds column _q, a struct of the statistics of each text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    flat = F.translate(t, SPACES[1:], " " * 5)
    words = F.filter(F.split(flat, " "), lambda w: w != "")
    w, ln = let(words, _word_stats), let(F.split(t, "\n"), _line_stats)
    bare = F.length(F.translate(t, SPACES, ""))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    bangs = F.length(t) - F.length(F.translate(t, "!", ""))
    upper = F.regexp_count(t, F.lit(r"\p{Lu}"))
    base = F.struct(w.alias("w"), ln.alias("l"), bare.alias("c"), symbols.alias("s"), bangs.alias("b"), upper.alias("u"))

    def finish(x: Column) -> Column:
        n, chars = F.greatest(x["w"]["n"], F.lit(1)), F.greatest(x["c"], F.lit(1))
        lines = F.greatest(x["l"]["n"], F.lit(1))
        return F.struct(
            x["w"]["n"].alias("n_words"),
            x["c"].cast("long").alias("word_chars"),
            x["s"].cast("long").alias("n_symbols"),
            x["l"]["dup"].alias("n_dup_lines"),
            x["w"]["repeat"].alias("n_repeat_words"),
            (x["c"] / n).alias("mean_word"),
            (x["s"] / chars).alias("symbol_share"),
            (x["b"] / chars).alias("bang_share"),
            (x["u"] / chars).alias("upper_share"),
            (x["l"]["dup"] / lines).alias("dup_line_share"),
            (x["w"]["repeat"] / n).alias("repeat_share"),
            (x["w"]["distinct"] / n).alias("distinct_share"),
            (n / lines).alias("mean_line"),
        )

    return docs.withColumn("_q", let(base, finish))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 10) | (q["n_repeat_words"] * 100 > q["n_words"] * 20)


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.value if self.op == ">=" else v <= self.value

    def column(self, q: Column) -> Column:
        v = q[self.feature].cast("double")
        return v >= F.lit(self.value) if self.op == ">=" else v <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition] | None:
    """The threshold with the highest FOIL gain over the rows given."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    now, best = np.log2(p0 / (p0 + n0)), None
    for f, name in enumerate(FEATURES):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], bad[order]
        edge = np.flatnonzero(v[1:] > v[:-1])  # a cut after each
        if not len(edge):
            continue
        pos = np.cumsum(b)
        for op, p, n in (("<=", pos[edge], edge + 1 - pos[edge]), (">=", p0 - pos[edge], n0 - (edge + 1 - pos[edge]))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - now), -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                best = (float(gain[i]), Condition(name, op, float((v[edge[i]] + v[edge[i] + 1]) / 2)))
    return best


def learn(
    x: np.ndarray, bad: np.ndarray, precision: float = 0.97, max_rules: int = 12, max_conditions: int = 4, least: int = 5
) -> list[Rule]:
    """Sequential covering; rows of x are hash-ordered, so every third one can serve for pruning."""
    rules: list[Rule] = []
    prune = np.arange(len(x)) % 3 == 2
    open_rows = np.ones(len(x), bool)
    while len(rules) < max_rules and (open_rows & bad).any():
        gx, gb = x[open_rows & ~prune], bad[open_rows & ~prune]
        rule: Rule = ()
        inside = np.ones(len(gx), bool)
        while len(rule) < max_conditions and gb[inside].any() and not gb[inside].all():
            found = _best(gx[inside], gb[inside])
            if found is None:
                break
            rule += (found[1],)
            inside &= found[1].holds(gx)
        px, pb = x[open_rows & prune], bad[open_rows & prune]

        def worth(r: Rule, px=px, pb=pb) -> float:
            c = _covers(r, px)
            p, n = int(pb[c].sum()), int((~pb[c]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        if rule:
            rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = _covers(rule, x) & open_rows
        right = [bad[hit & part].mean() if (hit & part).any() else 0.0 for part in (prune, ~prune)]
        if not rule or hit.sum() < least or min(right) < precision:
            break
        rules.append(rule)
        open_rows &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = 0.97) -> list[Rule]:
    """Learns from at most sample_rows labels, the first by hash of doc_id, and as many different rows of statistics (repeated ids add no more)."""
    some = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("_id"), "quality")
    some = some.orderBy(F.xxhash64("_id"), "_id", "quality").limit(sample_rows)
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(some), "_id")  # at most sample_rows rows
    rows = with_stats(rows).select("_id", "quality", *[F.col("_q")[f].cast("double").alias(f) for f in FEATURES]).dropDuplicates().orderBy("_id", "quality", *FEATURES).limit(sample_rows)
    got = rows.collect()
    got.sort(key=lambda r: tuple(r))
    if not got:
        return []
    x = np.array([[r[f] for f in FEATURES] for r in got])
    bad = np.array([r["quality"] == 0 for r in got])
    mixed = np.random.default_rng(7).permutation(len(got))
    return learn(x[mixed], bad[mixed], precision)


def rejects(rules: list[Rule], q: Column) -> Column:
    """The ordered list as a CASE; false where no rule holds."""
    out = None
    for rule in rules:
        both = F.lit(True)
        for c in rule:
            both = both & c.column(q)
        out = F.when(both, F.lit(True)) if out is None else out.when(both, F.lit(True))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def keep(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that neither the base rule nor the learned list rejects, with their columns."""
    rules = fit(docs, labels, sample_rows)
    q = F.col("_q")
    return carried(with_stats(carrying(docs, "text")).where(~base_failed(q) & ~rejects(rules, q)), docs)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    q = F.col("_q")
    counts = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = base_failed(q)
    return with_stats(docs).select("doc_id", *counts, failed.alias("base_failed"), (~failed & ~rejects(rules, q)).alias("kept"))
