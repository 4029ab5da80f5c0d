"""Evaluation and log operators: splits, rates, percentiles, exact bounds, latest records, valid-time lookups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def hash_bucket(salt: str, key: Column) -> Column:
    """0 to 99 from the first 32 bits of SHA-256 of ``salt|key``."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "|"), key), 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """The element at 0-based place min(n - 1, int(q * n)) of each group.

    Places come from a count per distinct value and a running sum, so a hot group is counted in parts before it is ordered.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    upto = part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_hi", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(part))
    picks = []
    for name, q in quantiles.items():
        at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * q))
        picks.append(F.max(F.when((F.col("_hi") - F.col("_c") <= at) & (at < F.col("_hi")), F.col(value))).alias(name))
    return placed.groupBy(*keys).agg(F.max("_n").alias("n"), *picks, F.max(value).alias("max"))


def upper_bound(failures: int, trials: int, confidence: float = 0.95) -> float:
    """One-sided Clopper-Pearson upper bound of a failure rate."""
    if trials <= 0:
        return 1.0
    if failures <= 0:
        return 1.0 - (1.0 - confidence) ** (1.0 / trials)
    if failures >= trials:
        return 1.0

    def below(p: float) -> float:
        logs = [
            math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1) + i * math.log(p) + (trials - i) * math.log1p(-p)
            for i in range(failures + 1)
        ]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    lo, hi = failures / trials, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid < 1.0 and below(mid) > 1.0 - confidence else (lo, mid)
    return hi


@F.pandas_udf(DoubleType())
def upper_bound_udf(failures: pd.Series, trials: pd.Series) -> pd.Series:
    return pd.Series([upper_bound(int(k), int(n)) for k, n in zip(failures, trials, strict=True)])


def bootstrap(rows: DataFrame, key: str, value: str, q: float, draws: int = 500, seed: int = 7) -> DataFrame:
    """(key, estimate, low, high): 95 % interval of a nearest-rank quantile.

    A resample of n values is a multinomial draw over the distinct values' counts, so a group comes to a task as its
    histogram (rounded to three places), never as its rows.
    """
    hist = rows.groupBy(key, F.round(value, 3).alias("v")).agg(F.count("*").alias("c"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v, c = pdf["v"].to_numpy(), pdf["c"].to_numpy()
        n = int(c.sum())
        at = min(n - 1, int(q * n))
        rng = np.random.default_rng(seed)
        ends = np.cumsum(rng.multinomial(n, c / n, size=draws), axis=1)
        sampled = np.sort(v[(ends > at).argmax(axis=1)])
        own = v[(np.cumsum(c) > at).argmax()]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "estimate": [own], "low": [sampled[int(0.025 * draws)]], "high": [sampled[int(0.975 * draws)]]})

    return hist.groupBy(key).applyInPandas(one, f"{key} {rows.schema[key].dataType.simpleString()}, estimate double, low double, high double")


def latest_success(log: DataFrame, key: list[str], ok: Column, seq: list[str], keep: list[str]) -> DataFrame:
    """Per key the latest success, else the latest failure."""
    order = F.struct(ok.alias("ok"), *seq, *keep)
    best = log.groupBy(*key).agg(F.max(order).alias("b"), F.count_if(~ok).alias("failures"))
    return best.select(*key, F.col("b.ok").alias("ok"), *[F.col(f"b.{c}").alias(c) for c in [*seq, *keep]], "failures")


def valid_periods(versions: DataFrame, key: str, start: str, tie: str) -> DataFrame:
    """Adds valid_from and valid_to: each version holds until the next begins; versions of one day follow each other empty."""
    w = Window.partitionBy(key).orderBy(start, tie)
    return versions.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.lead(start).over(w))


def valid_at(questions: DataFrame, versions: DataFrame, key: str, on: str) -> DataFrame:
    """questions with status NO_ROW, FOUND or AMBIGUOUS and, where found, the version's amount.

    An equi-join on the key with the period as its condition, then an aggregate per question.
    """
    v = versions.select(F.col(key).alias("_k"), "valid_from", "valid_to", "amount")
    hit = (F.col(key) == F.col("_k")) & (F.col("valid_from") <= F.col(on)) & (F.col("valid_to").isNull() | (F.col(on) < F.col("valid_to")))
    j = questions.join(v, hit, "left")
    out = j.groupBy(*questions.columns).agg(F.count("_k").alias("_n"), F.min("amount").alias("amount"), F.min("valid_from").alias("valid_from"))
    status = F.when(F.col("_n") == 0, "NO_ROW").when(F.col("_n") == 1, "FOUND").otherwise("AMBIGUOUS")
    return out.withColumn("status", status).withColumn("amount", F.when(F.col("_n") == 1, F.col("amount"))).withColumn(
        "valid_from", F.when(F.col("_n") == 1, F.col("valid_from"))
    ).drop("_n")


def chain_problems(versions: DataFrame, key: str, start: str, tie: str, old: str, new: str) -> DataFrame:
    """Versions whose old value is not the new value of the one before; must be empty."""
    w = Window.partitionBy(key).orderBy(start, tie)
    prior = F.lag(new).over(w)
    return versions.withColumn("_p", prior).where(F.col("_p").isNotNull() & ~F.col("_p").eqNullSafe(F.col(old))).drop("_p")


def merged_spans(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Gaps and islands: touching or overlapping spans of a key become one."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("_new", new).withColumn("_i", island).groupBy(key, "_i").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")
    ).drop("_i")


def carried(rows: DataFrame, key: str, order: list[str], value: Column) -> Column:
    """The last value set before a row of its key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(w)


def nearest_around(rows: DataFrame, key: str, order: list[str], value: Column) -> tuple[Column, Column]:
    """The nearest value before and after each row of its key."""
    w = Window.partitionBy(key).orderBy(*order)
    return (
        F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    )


#: Rows that one task brings together; more input makes more tasks, not larger ones.
AT_ONCE = 1_000_000


def divided(pairs: DataFrame, wanted: DataFrame, left: list[str], right: str) -> DataFrame:
    """Relational division: the left keys of pairs (left, right) that have every right value of wanted (query, right).

    A query's values are bits of longs, so repeats cost nothing and nothing is made distinct; pairs are dealt by their left keys over as many tasks as they need.
    """
    order = Window.partitionBy("query").orderBy(right)
    bits = wanted.where(F.col(right).isNotNull()).select("query", right).distinct().withColumn("n", F.row_number().over(order) - 1)
    need = bits.groupBy("query").agg(F.count("*").alias("need"))
    longs = (bits.agg(F.max("n")).first()[0] or 0) // 63 + 1
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs.count() / AT_ONCE))
    rows = pairs.join(bits, right).select("query", *left, "n").repartition(parts, *left)
    bit = F.expr("shiftleft(1L, n % 63)")
    masks = [F.bit_or(F.when(F.floor(F.col("n") / 63) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"_m{i}") for i in range(longs)]
    have = rows.groupBy("query", *left).agg(*masks)
    have = have.withColumn("have", sum((F.bit_count(f"_m{i}") for i in range(longs)), F.lit(0)))
    return have.join(need, "query").where("have = need").select("query", *left)


def rates(rows: DataFrame, named: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(measure, hits, of, rate): each measure counts its hits in its slice, in one pass."""
    aggs = [F.struct(F.lit(n).alias("measure"), F.count_if(s & h).alias("hits"), F.count_if(s).alias("of")) for n, (s, h) in named.items()]
    one = rows.agg(F.array(*aggs).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    return one.withColumn("rate", F.when(F.col("of") > 0, F.col("hits") / F.col("of")))
