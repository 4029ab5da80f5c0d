"""Concept retrieval: BM25F over field-counted postings, priors, confidence; all joins and aggregates.

Postings are a tall table (term, doc_id, one count per field), for ranking only of the queries' own terms. Query terms are the small side of the one
join that matters; common terms are cut by document frequency before it, so the largest posting lists never move.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators.tables import stored

FIELDS = ("heading", "crossheading", "structure", "title", "body")
FLAGS = ("repealed", "northern_ireland", "scotland", "amending", "commencement", "secondary")
BODY_TERMS, OPENING_CHARS, TF_CAP, LENGTH_CAP = 200, 300, 63, 65_535
#: Documents whose postings one task counts.
DOCS_AT_ONCE = 2_000


@dataclass(frozen=True)
class Policy:
    weights: tuple = (2.0, 1.0, 0.5, 0.5, 0.3)
    b: tuple = (0.6, 0.3, 0.9, 0.3, 0.3)
    k1: float = 0.6
    synonym_weight: float = 1.0
    max_df_share: float = 0.1
    penalties: tuple = (0.3, 0.4, 0.4, 0.5, 0.3, 0.6)
    in_degree_weight: float = 0.6
    pool: int = 300
    min_share: float = 0.5
    limit: int = 10


def postings(fields: DataFrame, only: DataFrame | None = None, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """(term, doc_id, heading .. body) counts, capped, of a frame with doc_id and an array of terms per field.

    only: a frame whose terms alone are wanted, as those of the queries; all others end before anything is counted or moved. stem: makes
    terms of the fields' words where they hold words, once for each different word; such words and their terms are a table, whose
    size the planner knows. Without only, documents are dealt over as many tasks as they need, which count their own documents whole.
    """
    if only is None:
        parts = max(int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(fields.count() / DOCS_AT_ONCE))
        fields = fields.repartition(parts, "doc_id")
    each = F.array(*[F.struct(F.lit(f).alias("f"), F.coalesce(F.col(f), F.array().cast("array<string>")).alias("t")) for f in FIELDS])
    rows = fields.select("doc_id", F.explode(each).alias("x")).select("doc_id", F.col("x.f").alias("f"), F.explode("x.t").alias("term"))
    if stem is not None:
        known = rows.select(F.col("term").alias("word")).distinct().withColumn("term", stem(F.col("word")))
        if only is not None:
            known = known.join(only.select("term").distinct(), "term", "left_semi")
        rows = rows.withColumnRenamed("term", "word").join(stored(known, "known-words"), "word")
    elif only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    counts = [F.least(F.count_if(F.col("f") == f), F.lit(TF_CAP)).cast("int").alias(f) for f in FIELDS]
    return rows.groupBy("term", "doc_id").agg(*counts)


def lengths(fields: DataFrame) -> DataFrame:
    """(doc_id, l_heading .. l_body): capped field lengths."""
    return fields.select("doc_id", *[F.coalesce(F.least(F.size(f), F.lit(LENGTH_CAP)), F.lit(0)).alias(f"l_{f}") for f in FIELDS])


def averages(lens: DataFrame) -> DataFrame:
    """One row: n documents, and each field's average length to four places."""
    return lens.agg(F.count("*").alias("n"), *[F.bround(F.avg(f"l_{f}"), 4).alias(f"a_{f}") for f in FIELDS])


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, thesaurus: DataFrame | None = None, synonym_weight: float = 1.0) -> DataFrame:
    """(query_id, term, origin, typed, qweight): typed terms in first-use order, then expansions no typed or earlier term has."""
    typed = queries.select("query_id", F.posexplode(F.array_distinct(T.terms(F.col("text")))).alias("origin", "term"))
    typed = typed.select("query_id", "term", "origin", F.lit(True).alias("typed"), F.lit(1.0).alias("qweight"), F.lit(0).alias("rank"))
    if thesaurus is None:
        return typed.drop("rank")
    more = typed.join(thesaurus.select(F.col("word").alias("term"), F.posexplode("synonyms").alias("place", "synonym")), "term")
    more = more.select(
        "query_id", F.col("synonym").alias("term"), "origin", F.lit(False).alias("typed"), F.lit(synonym_weight).alias("qweight"), F.col("place") + 1
    )
    w = Window.partitionBy("query_id", "term").orderBy(F.desc("typed"), "origin", "rank")
    return typed.union(more).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "rank")


def weighted(terms: DataFrame, df: DataFrame, avg: DataFrame, policy: Policy) -> DataFrame:
    """Query terms with df, idf and whether they are scored: at most the cut-off share, or the two rarest if all are above it."""
    t = terms.join(df, "term").crossJoin(F.broadcast(avg.select("n")))  # one row
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    cut = F.greatest(F.lit(1.0), F.lit(policy.max_df_share) * F.col("n"))
    own = Window.partitionBy("query_id")
    dfs = F.array_sort(F.collect_list(F.when(F.col("typed"), F.col("df"))).over(own))
    second = F.get(dfs, F.least(F.lit(1), F.size(dfs) - 1))
    limit = F.when((F.size(dfs) > 0) & (F.get(dfs, F.lit(0)) > cut), second.cast("double")).otherwise(cut)
    return t.withColumn("idf", idf).withColumn("scored", F.col("df") <= limit)


def score(terms: DataFrame, post: DataFrame, lens: DataFrame, avg: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(query_id, doc_id, score, matched): matched has a bit for each query word found."""
    q = weighted(terms, document_frequency(post), avg, policy).where("scored")
    hit = q.join(post, "term").join(lens, "doc_id").crossJoin(F.broadcast(avg.drop("n")))  # one row
    tf = F.lit(0.0)
    for f, w, b in zip(FIELDS, policy.weights, policy.b, strict=True):
        norm = F.when(F.col(f"a_{f}") > 0, 1.0 - b + b * F.col(f"l_{f}") / F.col(f"a_{f}")).otherwise(F.lit(1.0 - b))
        tf = tf + F.when(F.col(f) > 0, F.col(f) * w / norm).otherwise(F.lit(0.0))
    gain = F.col("qweight") * F.col("idf") * tf / (F.lit(policy.k1) + tf)
    bit = F.expr("shiftleft(1L, origin)")
    return hit.groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score"), F.bit_or(bit).alias("matched"))


def prior(flags: Column, degree: Column, policy: Policy = Policy(), lifted: Column | None = None) -> Column:
    """(1 + weight * degree / 255) times the penalty of each flag set and not lifted."""
    out = 1.0 + policy.in_degree_weight * degree / 255.0
    for i, p in enumerate(policy.penalties):
        on = F.shiftright(flags, i).bitwiseAND(F.lit(1)) == 1
        if lifted is not None:
            on = on & (F.shiftright(lifted, i).bitwiseAND(F.lit(1)) == 0)
        out = out * F.when(on, F.lit(p)).otherwise(F.lit(1.0))
    return out


def ranked(scores: DataFrame, by: Column, k: int, name: str = "rank") -> DataFrame:
    """The first k of each query by a score rounded against sum order, ties by doc_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "doc_id")
    return scores.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def discover(
    queries: DataFrame, fields: DataFrame, priors: DataFrame, thesaurus: DataFrame | None = None, policy: Policy = Policy(), stem: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(query_id, rank, doc_id, score, matched, confident) of each query's candidates.

    priors: (doc_id, flags, degree). The text score picks a pool, the priors re-rank it. fields is read twice, so it should be a table;
    stem makes terms of its words, if it holds words.
    """
    terms = query_terms(queries, thesaurus, policy.synonym_weight)
    post, lens = stored(postings(fields, terms, stem), "postings"), lengths(fields)
    avg = averages(lens)
    pool = ranked(score(terms, post, lens, avg, policy), F.round("score", 9), policy.pool, "text_rank").join(priors, "doc_id")
    names = F.array_distinct(T.terms(F.col("text")))
    lift = queries.select(
        "query_id",
        (
            F.when(F.array_contains(names, "northern") & F.array_contains(names, "ireland"), 2).otherwise(0)
            + F.when(F.arrays_overlap(names, F.array(F.lit("scotland"), F.lit("scottish"))), 4).otherwise(0)
        ).alias("lifted"),
    )
    pool = pool.join(lift, "query_id").withColumn("final", F.col("score") * prior(F.col("flags"), F.col("degree"), policy, F.col("lifted")))
    top = ranked(pool, F.round("final", 9), policy.limit).select("query_id", "rank", "doc_id", F.bround("final", 4).alias("score"), "matched")
    share = confidence(terms, document_frequency(post), avg, top.where("rank = 1"), policy)
    return top.join(share.select("query_id", (F.col("share") >= policy.min_share).alias("confident")), "query_id")


def confidence(terms: DataFrame, df: DataFrame, avg: DataFrame, first: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(query_id, share): the idf of typed words that the first candidate matched, over that of all typed words the index knows."""
    t = weighted(terms, df, avg, policy).where("typed").select("query_id", "origin", "idf")
    m = t.join(first.select("query_id", "matched"), "query_id")
    on = F.expr("shiftright(matched, origin) & 1") == 1
    return m.groupBy("query_id").agg((F.sum(F.when(on, F.col("idf")).otherwise(0.0)) / F.sum("idf")).alias("share"))


def opening_text(rows: DataFrame, unit: str, order: str, text: str, limit: int = OPENING_CHARS) -> DataFrame:
    """(unit, opening): a unit's texts in order, as long as fewer than limit characters came before."""
    before = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    some = rows.withColumn("_n", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))).where(F.col("_n") < limit)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return some.groupBy(unit).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("opening"))


def gold_rank(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rank): the first candidate equal to or beneath a gold coordinate; null if none."""
    j = gold.join(candidates, "query_id", "left")
    good = (F.col("coordinate") == F.col("gold")) | F.startswith(F.col("coordinate"), F.concat("gold", F.lit("/")))
    return j.groupBy("query_id").agg(F.min(F.when(good, F.col("rank"))).alias("rank"))


def retrieval_measures(by_rank: DataFrame, *slices: str) -> DataFrame:
    """hit@1/5/10 and MRR of (rank, slice columns); with slices, over all and by each slice (grouping sets)."""
    def aggs():
        hit = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in (1, 5, 10)]
        return [F.count("*").alias("queries"), *hit, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr")]

    if not slices:
        return by_rank.agg(*aggs())
    return by_rank.groupingSets([[F.col(s)] for s in slices] + [[]], *slices).agg(*aggs())
