"""Splits, measures, percentiles, logs, valid time, spans and carried context, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.operators import evaluation as V
from citeloom.plans.book import instruments, provisions, table, with_book


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    b = V.hash_bucket("harvest", F.col("doc_id").cast("string"))
    return docs.select("doc_id", b.alias("bucket"), F.when(b < 20, "held_out").otherwise("kept").alias("split"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    amount = F.concat(F.lit("£"), F.col("o_totalprice").cast("decimal(14,2)").cast("string"))
    v = o.select(F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("made"), F.col("o_orderkey").alias("okey"), amount.alias("amount"))
    return V.valid_periods(v, "customer", "made", "okey")


def valid_to_chain(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).select("customer", "okey", "amount", "valid_from", "valid_to")


def valid_time_lookup(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("customer")).withColumn("day", F.explode(F.array(*[F.to_date(F.lit(x)) for x in ("1994-06-01", "1996-02-29", "1998-12-31")])))
    return V.valid_at(q, _versions(spark, d), "customer", "day")


def chain_check(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("new"), F.col("o_orderstatus").alias("s"))
    o = o.withColumn("old", F.when(F.col("s") == "P", F.lit("none")).otherwise(F.col("new")))
    return V.chain_problems(o, "o_custkey", "o_orderdate", "o_orderkey", "old", "new").select("o_custkey", "o_orderkey", "old", "new")


def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest_rank(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p99": 0.99})


def percentile_total(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest_rank(table(spark, d, "events"), [], "value", {"p50": 0.5, "p99": 0.99})


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return V.bootstrap(table(spark, d, "events"), "event_type", "value", 0.99)


def metrics_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.regexp_count("text", F.lit("[#*$%&|]")) * 20 > F.length("text")).alias("flagged"), "lang")
    x = docs.join(table(spark, d, "labels"), "doc_id")
    low, flag = F.col("quality") == 0, F.col("flagged")
    named = {
        "recall": (low, flag), "false_alarm": (~low, flag), "precision": (flag, low), "flagged": (F.lit(True), flag),
        "toxic_flagged": (F.col("toxic") == 1, flag), "english": (F.col("lang") == "en", flag), "agreement": (F.lit(True), flag == low),
    }
    return V.rates(x, named).withColumn("rate", F.round("rate", 6))


def upper_bound_zero(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", "n", F.round(1 - F.pow(F.lit(0.05), 1.0 / F.col("n")), 9).alias("bound"))


def upper_bound(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count("*").alias("n"))
    return e.withColumn("bound", V.upper_bound_udf("k", "n"))


def latest_success(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    out = V.latest_success(e, ["user_id"], F.col("event_type") != "error", ["ts", "event_id"], ["value"])
    return out.select("user_id", "ok", "event_id", "value", "failures")


def determinism_changed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    five = e.withColumn("r", F.row_number().over(w) - 1).withColumn("pass", F.floor(F.col("r") / 5))
    g = five.groupBy("user_id", "pass").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("answers")).where("n = 5")
    return g.groupBy("user_id").agg(F.count("*").alias("groups"), F.count_if(F.col("answers") > 1).alias("changed"))


def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    p = e.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.sum(F.col("value").cast("decimal(18,2)")))
    return p.select("user_id", (F.col("click") - F.col("view")).cast("double").alias("difference")).where("difference is not null")


def agreement(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("a"))
    b = e.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("b"))
    j = a.join(b, "user_id", "full_outer")
    return j.select("user_id", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), (~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))


def context_follow_up(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    bound = F.when(F.col("role") == "user", F.concat(F.lit("c"), F.length("text").cast("string")))
    return c.select("conv_id", "turn", V.carried(c, "conv_id", ["turn"], bound).alias("context"))


def nearest_link(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    target = F.when(F.col("event_type") == "view", F.col("event_id"))
    before, after = V.nearest_around(e, "user_id", ["ts", "event_id"], target)
    x = e.select("event_id", "event_type", before.alias("before"), after.alias("after")).where("event_type = 'click'")
    return x.select("event_id", "before", "after", F.coalesce("after", "before").alias("linked"))


def antecedent(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select("event_id", F.lag("event_id").over(w).alias("antecedent"))


def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    start = F.unix_seconds(F.date_trunc("second", F.col("ts")).cast("timestamp")).cast("long")
    s = e.select("user_id", start.alias("s"), (start + F.floor(F.col("value") * 3600).cast("long")).alias("e"))
    return V.merged_spans(s, "user_id", "s", "e")


def shape_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.regexp_replace(F.lower(F.trim("url")), "[0-9]+", "N").alias("shape"))
    return p.groupBy("shape").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(40)


def nearest_year_options(spark: SparkSession, d: str) -> DataFrame:
    b = instruments(spark, d).select("instrument_id", "year", "number", "status")
    q = b.select(F.col("instrument_id").alias("query"), F.col("year").alias("y"), F.col("status").alias("s"))
    md5 = F.md5(F.col("instrument_id").cast("binary"))
    few = Window.partitionBy("status", "year").orderBy(md5)  # four answers may come from one year, which may hold the query too
    pool = b.withColumn("r", F.row_number().over(few)).where("r <= 5").drop("r")
    w = Window.partitionBy("query").orderBy(F.abs(F.col("year") - F.col("y")), md5)
    j = q.join(pool, (F.col("s") == F.col("status")) & (F.col("instrument_id") != F.col("query")))
    return j.withColumn("r", F.row_number().over(w)).where("r <= 4").select("query", "instrument_id", F.col("r").cast("int").alias("r"))


def relational_division(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"))
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 5), ("b", 7)], "query string, line int")
    return V.divided(li, wanted, ["okey"], "line")


def partition_filter_apply(spark: SparkSession, d: str) -> DataFrame:
    from citeloom.operators.filters import partition_filter

    p = provisions(spark, d).withColumn("instrument_id", F.translate("instrument", "/", "_"))
    some = [r["instrument_id"] for r in instruments(spark, d).where("number in (2, 11, 57)").select("instrument_id").orderBy("number").collect()]
    bound = [some[0].replace("_", "/"), *[some[1].replace("_", "/") + s for s in ("/s1", "/s3", "/s5")]]
    return p.where(partition_filter(bound, [some[1].replace("_", "/") + "/s3"])).select("coordinate")


def fact_checks(spark: SparkSession, d: str) -> DataFrame:
    """Labels that do not hold: expected coordinates that are missing (must be rows only where planted)."""
    p = provisions(spark, d)
    expected = p.select("coordinate").where("line <= 2").union(p.where("line = 7 and okey % 100 = 0").select(F.concat("coordinate", F.lit("Z"))))
    return expected.join(p.select("coordinate"), "coordinate", "left_anti")


def rows_per_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 6).alias("status")).agg(F.count("*").alias("n"))


def remaining_cost(spark: SparkSession, d: str) -> DataFrame:
    """Planned jobs without a record, priced at the mean of the done ones of their system."""
    e = table(spark, d, "events")
    plan = e.select("event_type").distinct().join(e.select("user_id").distinct())
    done = e.where("value > 45").select("event_type", "user_id").distinct()
    cost = e.where("value > 45").groupBy("event_type").agg(F.avg("value").alias("mean"))
    left = plan.join(done, ["event_type", "user_id"], "left_anti").groupBy("event_type").agg(F.count("*").alias("left"))
    return left.join(cost, "event_type").select("event_type", "left", F.round(F.col("left") * F.col("mean"), 6).alias("cost"))


QUERIES = {
    f.__name__: f
    for f in (
        hash_split, valid_to_chain, valid_time_lookup, chain_check, percentile_nearest_rank, percentile_total, bootstrap_interval,
        metrics_rates, upper_bound_zero, upper_bound, latest_success, determinism_changed, paired_difference, agreement, context_follow_up,
        nearest_link, antecedent, merge_spans, shape_counts, nearest_year_options, relational_division, partition_filter_apply, fact_checks,
        rows_per_status, remaining_cost,
    )
}

_VERS = (
    "v AS (SELECT o_custkey AS customer, o_orderkey AS okey, '£' || CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) AS amount, CAST(o_orderdate AS DATE) AS valid_from,"
    " lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS valid_to FROM orders)"
)


def _rank_sql(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    sel = f"{keys}, " if keys else ""
    return (
        f"SELECT {sel}max(n) AS n, max(CASE WHEN i = least(n - 1, floor(0.5 * n)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, floor(0.99 * n)) THEN value END) AS p99,"
        f" max(value) AS max FROM (SELECT *, row_number() OVER ({part} ORDER BY value) - 1 AS i, count(*) OVER ({part}) AS n FROM events)" + (f" GROUP BY {keys}" if keys else "")
    )


ORACLE = {
    "hash_split": "SELECT doc_id, CAST(b AS INTEGER) AS bucket, CASE WHEN b < 20 THEN 'held_out' ELSE 'kept' END AS split FROM"
    " (SELECT doc_id, ('0x' || substr(sha256('harvest|' || doc_id), 1, 8))::UBIGINT % 100 AS b FROM documents)",
    "valid_to_chain": f"WITH {_VERS} SELECT customer, okey, amount, valid_from, valid_to FROM v",
    "valid_time_lookup": f"WITH {_VERS}, q AS (SELECT c_custkey AS customer, unnest([DATE '1994-06-01', DATE '1996-02-29', DATE '1998-12-31']) AS day FROM customer),"
    " j AS (SELECT q.customer, q.day, count(v.customer) AS n, min(amount) AS amount, min(valid_from) AS valid_from FROM q LEFT JOIN v ON q.customer = v.customer AND valid_from <= day"
    " AND (valid_to IS NULL OR day < valid_to) GROUP BY 1, 2) SELECT customer, day, CASE WHEN n = 1 THEN amount END AS amount, CASE WHEN n = 1 THEN valid_from END AS valid_from,"
    " CASE n WHEN 0 THEN 'NO_ROW' WHEN 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status FROM j",
    "chain_check": "SELECT o_custkey, o_orderkey, old, new FROM (SELECT *, lag(new) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM (SELECT o_custkey, o_orderkey, o_orderdate,"
    " o_orderpriority AS new, CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderpriority END AS old FROM orders)) WHERE p IS NOT NULL AND p IS DISTINCT FROM old",
    "percentile_nearest_rank": _rank_sql("event_type"),
    "percentile_total": _rank_sql(""),
    "metrics_rates": """WITH x AS (SELECT d.*, quality, toxic, len(regexp_extract_all(text, '[#*$%&|]')) * 20 > length(text) AS f, quality = 0 AS low FROM documents d JOIN labels USING (doc_id)),
m AS (SELECT 'recall' AS measure, count(*) FILTER (low AND f) AS hits, count(*) FILTER (low) AS of FROM x UNION ALL SELECT 'false_alarm', count(*) FILTER (NOT low AND f), count(*) FILTER (NOT low) FROM x
UNION ALL SELECT 'precision', count(*) FILTER (low AND f), count(*) FILTER (f) FROM x UNION ALL SELECT 'flagged', count(*) FILTER (f), count(*) FROM x
UNION ALL SELECT 'toxic_flagged', count(*) FILTER (toxic = 1 AND f), count(*) FILTER (toxic = 1) FROM x UNION ALL SELECT 'english', count(*) FILTER (lang = 'en' AND f), count(*) FILTER (lang = 'en') FROM x
UNION ALL SELECT 'agreement', count(*) FILTER (f = low), count(*) FROM x) SELECT measure, hits, of, CASE WHEN of > 0 THEN round(hits / of, 6) END AS rate FROM m""",
    "upper_bound_zero": "SELECT user_id, n, round(1 - pow(0.05, 1.0 / n), 9) AS bound FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)",
    "latest_success": "SELECT user_id, event_type <> 'error' AS ok, event_id, value, failures FROM (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS failures FROM events)"
    " QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'error' DESC, ts DESC, event_id DESC) = 1",
    "determinism_changed": "SELECT user_id, count(*) AS groups, count(*) FILTER (a > 1) AS changed FROM (SELECT user_id, r // 5 AS pass, count(*) AS n, count(DISTINCT event_type) AS a FROM"
    " (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events) GROUP BY 1, 2 HAVING count(*) = 5) GROUP BY 1",
    "paired_difference": "SELECT user_id, CAST(c - v AS DOUBLE) AS difference FROM (SELECT user_id, sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'click') AS c,"
    " sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'view') AS v FROM events GROUP BY 1) WHERE c - v IS NOT NULL",
    "agreement": "SELECT user_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, a IS DISTINCT FROM b AS differs FROM (SELECT user_id, count(*) AS a FROM events WHERE event_type = 'click' GROUP BY 1)"
    " FULL JOIN (SELECT user_id, count(*) AS b FROM events WHERE event_type = 'error' GROUP BY 1) USING (user_id)",
    "context_follow_up": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN 'c' || length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM conversations",
    "nearest_link": "SELECT event_id, before, after, coalesce(after, before) AS linked FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER"
    " (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER"
    " (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events) WHERE event_type = 'click'",
    "antecedent": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS antecedent FROM events",
    "merge_spans": """WITH s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 3600) AS BIGINT) AS e FROM events),
n AS (SELECT *, CASE WHEN s > max(e) OVER w THEN 1 WHEN max(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM n) GROUP BY user_id, i""",
    "shape_counts": "SELECT regexp_replace(lower(trim(url)), '[0-9]+', 'N', 'g') AS shape, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, shape LIMIT 40",
    "nearest_year_options": with_book(
        "SELECT query, instrument_id, CAST(r AS INTEGER) AS r FROM (SELECT q.instrument_id AS query, p.instrument_id, row_number() OVER (PARTITION BY q.instrument_id ORDER BY abs(p.year - q.year), md5(p.instrument_id)) AS r"
        " FROM book q JOIN (SELECT * FROM book QUALIFY row_number() OVER (PARTITION BY status, year ORDER BY number) <= 3) p ON p.status = q.status AND p.instrument_id <> q.instrument_id WHERE q.number % 500 = 0) WHERE r <= 4"
    ),
    "relational_division": "SELECT query, l_orderkey AS okey FROM (VALUES ('a', 1), ('a', 2), ('a', 3), ('b', 5), ('b', 7)) w(query, line) JOIN lineitem ON l_linenumber = line GROUP BY 1, 2"
    " HAVING count(DISTINCT line) = CASE query WHEN 'a' THEN 3 ELSE 2 END",
    "partition_filter_apply": with_book("SELECT p.coordinate FROM prov p JOIN book b USING (okey) WHERE number = 2 OR (number = 11 AND line IN (1, 5))"),
    "fact_checks": with_book("SELECT coordinate || 'Z' AS coordinate FROM prov WHERE line = 7 AND okey % 100 = 0"),
    "rows_per_status": "SELECT event_type, user_id % 6 AS status, count(*) AS n FROM events GROUP BY 1, 2",
    "remaining_cost": "WITH p AS (SELECT * FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT DISTINCT user_id FROM events)) SELECT event_type, count(*) AS \"left\", round(count(*) * any_value(mean), 6) AS cost FROM p"
    " JOIN (SELECT event_type, avg(value) AS mean FROM events WHERE value > 45 GROUP BY 1) USING (event_type) WHERE (event_type, user_id) NOT IN (SELECT (event_type, user_id) FROM events WHERE value > 45) GROUP BY 1",
}
