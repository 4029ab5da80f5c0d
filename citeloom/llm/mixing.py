"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in hash-shuffled order, gone through again from the start if its target
exceeds it. A document's virtual finish time is its source's cumulative words divided by the source's
target; sorted by that time over all sources and cut at the total budget, every source has been served in
proportion. As the targets sum to the budget, the cut falls at virtual time one, so the document in service
there is taken in part.

Targets are weights filled up like water: a source stops at ``limit`` times its size and what it leaves is shared
by weight among the others. Cumulative words come from two levels of prefix sums: sums of hash-range
buckets of a source (about ``BUCKET_ROWS`` documents each, so a hot source is many buckets), then within a bucket.
Equal rows are counted first and stand as one unit, so that copies cannot fill a bucket.

Defined results: a null text has size 0; a null source is a source of its own, sorted last; rows equal in
doc_id, source and text are interchangeable and all come out; a source of size 0 has target 0; an empty
table gives no rows; other columns are ignored by the query. The order depends on ids and texts only, not on partitions.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import WORD, carried, carrying, pick, row_key, stored

LIMIT = 3
WEIGHTS = (1, 2, 3)
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, source, _k1, _k2) with size and the number n of equal rows."""
    rows = pick(docs, doc_id="doc_id", source="source", text="text")
    sized = rows.select("doc_id", "source", *row_key(), word_count(F.col("text")).alias("size"))
    return stored(sized.groupBy("doc_id", "source", "_k1", "_k2", "size").agg(F.count("*").alias("n")), "units")


def targets(unit: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, share: float = 1.0) -> DataFrame:
    """(sid, source, source_size, target) of each source; one row a source, so one task orders them.

    Sources by code point, null last, get the weights in turn; they share ``share`` of all words.
    """
    s = unit.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("sid", turn).withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")
    )
    every = Window.partitionBy()
    cap = F.col("source_size") * float(limit)
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(share)).withColumn("cap", cap)
    rise = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("below", F.coalesce(F.sum("cap").over(rise), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(rise), F.lit(0.0)))
    s = s.withColumn("full", F.col("cap") * F.col("open") <= F.col("w") * (F.col("budget") - F.col("below")))
    free = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    rest = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * free / rest)
    return s.select("sid", "source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def queued(unit: DataFrame, source: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Units with their source's numbers and before, the words of the source that come earlier in the shuffle."""
    bits = max(4, min(40, (unit.count() // bucket_rows).bit_length()))
    order = F.xxhash64("_k1", "_k2", F.lit(20_011))
    s = source.withColumnRenamed("source", "_s")
    u = unit.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    u = u.withColumn("at", order).withColumn("bucket", F.shiftrightunsigned("at", 64 - bits))
    words = F.col("size") * F.col("n")
    sums = u.groupBy("sid", "bucket").agg(F.sum(words).alias("words"))
    prior = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(prior), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("at", "_k1", "_k2", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("within", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    return u.join(sums, ["sid", "bucket"]).withColumn("before", F.col("base") + F.col("within"))


def copies(queue: DataFrame) -> DataFrame:
    """One row for each document row; before moves on from copy to copy."""
    each = queue.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.withColumn("before", F.col("before") + (F.col("copy") - 1) * F.col("size"))


def served(c: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The schedule: (doc_id, source, _k1, _k2, copy, size, round, words, finish) of each turn of a document that the budget reaches.

    A turn starts at its source's words so far (full rounds and what comes earlier in the shuffle) and takes the document's size;
    finish is its end over the source's target, its virtual finish time. As targets sum to the budget, the total budget
    is spent at time one: turns that start before it are served, the one in service there with the words left to it.
    """
    r = c.where("target > 0 and size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
    start = (F.col("round") * F.col("source_size") + F.col("before")).cast("double")
    r = r.withColumn("start", start).withColumn("finish", (start + F.col("size")) / F.col("target"))
    words = F.when(F.col("finish") <= 1, F.col("size")).otherwise(F.floor(F.least(F.col("size").cast("double"), F.col("target") - F.col("start"))))
    return r.withColumn("words", words.cast("long")).where("words > 0").select("doc_id", "source", "_k1", "_k2", "copy", "size", "round", "words", "finish")


def schedule(docs: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, share: float = 1.0) -> DataFrame:
    """The mix itself: (doc_id, source, _k1, _k2, copy, size, round, words, finish), globally range-sorted by virtual finish time."""
    unit = units(docs)
    return served(copies(queued(unit, targets(unit, weights, limit, share))), limit).orderBy("finish", "source", "_k1", "_k2", "copy")


def taken(c: DataFrame, limit: int = LIMIT) -> DataFrame:
    """c with taken, the words that the schedule serves of each document; 0 where it serves none. Sums need no order, so none is made."""
    key = ["doc_id", "source", "_k1", "_k2", "copy"]
    sums = served(c, limit).groupBy(*key).agg(F.sum("words").alias("taken"))
    s = sums.toDF(*[f"s_{k}" for k in key], "taken")
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in key]
    return c.join(s, reduce(and_, same), "left").withColumn("taken", F.coalesce("taken", F.lit(0))).drop(*[f"s_{k}" for k in key])


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, share: float = 1.0) -> DataFrame:
    """Rows of docs as often as the schedule serves them, as whole documents with all columns.

    The document at the cut counts if at least half of it is served. Equal rows share their takes
    evenly (the mean, rounded). A document without words is taken as often as its source has full rounds, and once if none.
    """
    unit = units(docs)
    c = stored(copies(queued(unit, targets(unit, weights, limit, share))), "queue")
    turns = served(c, limit).where("2 * words >= size").groupBy("source", "_k1", "_k2").agg(F.count("*").alias("turns"))
    empty = F.greatest(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(1))
    every = c.groupBy("source", "_k1", "_k2").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max(empty).alias("empty"))
    t = every.toDF("s0", "k1", "k2", "n", "size", "empty").join(
        turns, F.col("s0").eqNullSafe(F.col("source")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left"
    )
    times = F.when(F.col("size") == 0, F.col("empty")).otherwise(F.round(F.coalesce("turns", F.lit(0)) / F.col("n"))).cast("int")
    t = t.select("s0", "k1", "k2", times.alias("times")).where("times > 0")
    packed = carrying(docs, "doc_id", "text", "source").select("row", "source", *row_key())
    kept = packed.join(t, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("s0").eqNullSafe(F.col("source")))
    return carried(kept.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))), docs)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = units(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    c = stored(copies(queued(unit, targets(unit))), "queue")
    return taken(c).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")
