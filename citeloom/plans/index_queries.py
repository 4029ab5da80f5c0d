"""Index-build queries over the statute book: keys, inverted lists, counts, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import coords as C
from citeloom.functions import text as T
from citeloom.operators import indexing as X
from citeloom.plans.book import instruments, provisions, table, title_table, with_book


def title_keys(spark: SparkSession, d: str) -> DataFrame:
    b = instruments(spark, d).where("title is not null")
    p = T.split_year(F.col("title"))
    b = b.withColumn("p", p)
    return b.select(
        "instrument_id",
        F.array_join(T.title_words(F.col("p.title")), " ").alias("words"),
        F.col("p.year").alias("year"),
        T.title_key(T.title_words(F.col("p.title")), F.col("p.year")).alias("key"),
    )


def title_variants(spark: SparkSession, d: str) -> DataFrame:
    return title_table(spark, d)


def coverage_by_series(spark: SparkSession, d: str) -> DataFrame:
    return X.coverage(instruments(spark, d))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    return X.freshness(instruments(spark, d))


def words_inverted(spark: SparkSession, d: str) -> DataFrame:
    b = instruments(spark, d).where("title is not null")
    inv = X.inverted(b, T.title_words(T.split_year(F.col("title"))["title"]), "word")
    return inv.groupBy("word").agg(F.count("*").alias("n"), F.min("instrument_id").alias("first_id"), F.max("instrument_id").alias("last_id"))


def word_df(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("df"))


def wordsets_unique(spark: SparkSession, d: str) -> DataFrame:
    b = instruments(spark, d).where("title is not null").withColumn("p", T.split_year(F.col("title")))
    key = T.wordset_key(T.title_words(F.col("p.title")), F.col("p.year"))
    return X.unique_keys(b.select(key.alias("key"), "instrument_id").where("key is not null"))


def acronyms(spark: SparkSession, d: str) -> DataFrame:
    b = instruments(spark, d).where("title is not null")
    rows = b.select(F.explode(T.acronym_keys(F.col("title"))).alias("key"), "instrument_id")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("instrument_id").alias("first_id"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return X.vocabulary([p.select(F.col("p_name").alias("t")), p.select(F.col("p_type").alias("t"))])


def typo_deletes(spark: SparkSession, d: str) -> DataFrame:
    return X.delete_table(vocabulary(spark, d))


def coord_parse(spark: SparkSession, d: str) -> DataFrame:
    made = provisions(spark, d).select(
        F.when(F.col("line") % 3 == 0, F.concat("coordinate", F.lit("/"), F.lit("_x"))).otherwise(F.col("coordinate")).alias("coordinate")
    )
    p = made.select("coordinate", C.parse(F.col("coordinate")).alias("p"))
    return p.select("coordinate", "p.instrument_id", F.array_join("p.provision", "/").alias("provision"), F.col("p").isNotNull().alias("valid"))


def coord_parent(spark: SparkSession, d: str) -> DataFrame:
    p = provisions(spark, d)
    return p.select("coordinate", C.parent(F.col("coordinate")).alias("parent"), C.parent(F.col("instrument")).alias("grandparent"))


def coord_related(spark: SparkSession, d: str) -> DataFrame:
    p = provisions(spark, d)
    a = p.select("okey", F.col("coordinate").alias("a"), F.col("line").alias("la"))
    b = p.select("okey", F.col("coordinate").alias("b")).union(
        p.select("okey", F.concat("coordinate", F.lit("A")).alias("b"))
    ).union(p.select("okey", F.concat("coordinate", F.lit("/1")).alias("b")))
    j = a.where("la = 1").join(b, "okey")
    return j.select("a", "b", C.related(F.col("a"), F.col("b")).alias("related"), C.is_ancestor(F.col("a"), F.col("b")).alias("ancestor"))


def prefix_descendants(spark: SparkSession, d: str) -> DataFrame:
    p = provisions(spark, d).select("coordinate", "okey")
    return X.descendants(p, "uk/ukpga/1995/1").union(X.descendants(p, "uk/ukpga/1996"))


def children(spark: SparkSession, d: str) -> DataFrame:
    both = provisions(spark, d).select("coordinate").union(provisions(spark, d).select(F.concat("coordinate", F.lit("/1"))))
    kids = both.where(C.depth(F.col("coordinate")) == 5).select(C.parent(F.col("coordinate")).alias("parent"), "coordinate")
    return kids.groupBy("parent").agg(F.count("*").alias("n"), F.min("coordinate").alias("first_child"))


def number_keys(spark: SparkSession, d: str) -> DataFrame:
    b = instruments(spark, d)
    series = F.element_at(F.array(*[F.lit(x) for x in ("ukpga", "uksi", "ssi", "nisr", "wsi", "ukla")]), (F.col("okey") % 6 + 1).cast("int"))
    seg = F.array(series, F.col("year").cast("string"), F.col("number").cast("string"))
    return b.select("instrument_id", F.explode(C.number_keys(seg)).alias("key"))


def case_variants(spark: SparkSession, d: str) -> DataFrame:
    p = provisions(spark, d)
    twice = p.select("coordinate").union(p.where("line % 2 = 0").select(F.upper("coordinate")))
    return X.spellings(twice).select("key", F.size("spellings").alias("n"), F.get("spellings", F.lit(0)).alias("first_spelling"))


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return provisions(spark, d).where("copies > 1").select("coordinate", F.col("copies").cast("long").alias("copies"))


def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    b = instruments(spark, d)
    catalogue = b.select("coordinate", "year", "number", "status")
    index = b.where("status <> 'P' and structure = 'full'").select("coordinate")
    return X.missing(catalogue, index, ["coordinate"]).select("coordinate", "year", "number")


def semi_eligible(spark: SparkSession, d: str) -> DataFrame:
    p = provisions(spark, d)
    full = instruments(spark, d).where("structure = 'full' and status = 'O'").select(F.col("coordinate").alias("instrument"))
    return p.join(full, "instrument", "left_semi").select("coordinate", "line")


def part_groups(spark: SparkSession, d: str) -> DataFrame:
    p = provisions(spark, d)
    group = F.concat(F.lit("pt"), F.ceil(F.col("line") / 3).cast("string"))
    g = p.groupBy("instrument", group.alias("part")).agg(F.array_sort(F.collect_set("coordinate")).alias("members"))
    return g.select("instrument", "part", F.posexplode("members").alias("i", "coordinate")).select("instrument", "part", "coordinate", F.col("i").cast("long").alias("i"))


def first_per_series(spark: SparkSession, d: str) -> DataFrame:
    b = instruments(spark, d)
    w = Window.partitionBy("year", "status").orderBy("number")
    some = b.withColumn("r", F.row_number().over(w)).where("r <= 5").select("instrument_id")
    return some.union(b.where(F.col("number").isin(7, 77, 777)).select("instrument_id")).distinct()


def strata_sample(spark: SparkSession, d: str) -> DataFrame:
    b = instruments(spark, d).where("structure = 'full'")
    p = provisions(spark, d)
    inst = Window.partitionBy("status").orderBy(F.sha2(F.concat(F.lit("s|"), "instrument_id"), 256))
    chosen = b.withColumn("r", F.row_number().over(inst)).where("r <= 40").select("status", F.col("coordinate").alias("instrument"))
    each = Window.partitionBy("instrument").orderBy(F.sha2(F.concat(F.lit("p|"), "coordinate"), 256))
    return p.join(chosen, "instrument").withColumn("r", F.row_number().over(each)).where("r = 1").select("status", "instrument", "coordinate")


QUERIES = {
    f.__name__: f
    for f in (
        title_keys, title_variants, coverage_by_series, freshness, words_inverted, word_df, wordsets_unique, acronyms, typo_deletes,
        coord_parse, coord_parent, coord_related, prefix_descendants, children, number_keys, case_variants, duplicates, anti_missing,
        semi_eligible, part_groups, first_per_series, strata_sample,
    )
}

ORACLE = {
    "title_keys": with_book("SELECT instrument_id, name || ' act' AS words, year, name || ' act|' || year AS key FROM book WHERE name IS NOT NULL"),
    "title_variants": with_book("SELECT key, instrument_id FROM titles"),
    "coverage_by_series": with_book(
        "SELECT series, year, count(*) AS instruments, count(*) FILTER (structure = 'full') AS structured, count(DISTINCT title) AS titles FROM book GROUP BY 1, 2"
    ),
    "freshness": with_book("SELECT series, year, max(number) AS max_number FROM book GROUP BY 1, 2"),
    "words_inverted": with_book(
        "SELECT word, count(*) AS n, min(instrument_id) AS first_id, max(instrument_id) AS last_id FROM"
        " (SELECT DISTINCT unnest(string_split(name || ' act', ' ')) AS word, instrument_id FROM book WHERE name IS NOT NULL) GROUP BY 1"
    ),
    "word_df": "SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1",
    "wordsets_unique": with_book(
        "SELECT key, min(instrument_id) AS instrument_id FROM (SELECT array_to_string(list_sort(list_distinct(string_split(name || ' act', ' '))), ' ')"
        " || '|' || year AS key, instrument_id FROM book WHERE name IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT instrument_id) = 1"
    ),
    "acronyms": with_book(
        "SELECT key, count(*) AS n, min(instrument_id) AS first_id FROM (SELECT array_to_string(list_transform(string_split(name || ' act', ' '),"
        " lambda w: w[1]), '') || '|' || year AS key, instrument_id FROM book WHERE name IS NOT NULL) GROUP BY 1"
    ),
    "typo_deletes": """
WITH v AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part UNION ALL
  SELECT unnest(string_split(lower(p_type), ' ')) FROM part) WHERE regexp_full_match(w, '[a-z]{3,}')),
one AS (SELECT w, unnest(list_transform(range(1, length(w) + 1), lambda i: w[1:i - 1] || w[i + 1:])) AS d FROM v),
two AS (SELECT w, unnest(list_transform(range(1, length(d) + 1), lambda i: d[1:i - 1] || d[i + 1:])) AS d FROM one WHERE length(d) > 1)
SELECT DISTINCT d AS variant, w AS word FROM (SELECT * FROM one UNION ALL SELECT * FROM two)""",
    "coord_parse": with_book(
        "SELECT CASE WHEN line % 3 = 0 THEN p.coordinate || '/_x' ELSE p.coordinate END AS coordinate,"
        " CASE WHEN line % 3 <> 0 THEN instrument_id END AS instrument_id, CASE WHEN line % 3 <> 0 THEN 's' || line END AS provision,"
        " line % 3 <> 0 AS valid FROM prov p JOIN book b USING (okey)"
    ),
    "coord_parent": with_book("SELECT coordinate, instrument AS parent, CAST(NULL AS VARCHAR) AS grandparent FROM prov"),
    "coord_related": with_book(
        "SELECT a, b, (a = b OR starts_with(b, a || '/') OR starts_with(a, b || '/')) AS related, starts_with(b, a || '/') AS ancestor FROM"
        " (SELECT okey, coordinate AS a FROM prov WHERE line = 1) JOIN (SELECT okey, coordinate || x AS b FROM prov CROSS JOIN (VALUES (''), ('A'), ('/1')) t(x)) USING (okey)"
    ),
    "prefix_descendants": with_book(
        "SELECT coordinate, okey FROM prov WHERE starts_with(coordinate, 'uk/ukpga/1995/1/')"
        " UNION ALL SELECT coordinate, okey FROM prov WHERE okey < 2000 AND starts_with(coordinate, 'uk/ukpga/1996/')"
    ),
    "children": with_book("SELECT instrument AS parent, count(*) AS n, min(coordinate) AS first_child FROM prov GROUP BY 1"),
    "number_keys": with_book(
        "SELECT instrument_id, ['c', 'si', 'ssi', 'sr', 'si'][okey % 6 + 1] || '/' || year || '/' || number AS key FROM book WHERE okey % 6 < 5 AND NOT (okey % 6 = 4 AND year >= 2026)"
    ),
    "case_variants": with_book(
        "SELECT key, CAST(count(*) AS INTEGER) AS n, min(c) AS first_spelling FROM (SELECT lower(c) AS key, c FROM (SELECT coordinate AS c FROM prov UNION SELECT upper(coordinate) FROM prov WHERE line % 2 = 0)) GROUP BY 1"
    ),
    "duplicates": with_book("SELECT coordinate, copies FROM prov WHERE copies > 1"),
    "anti_missing": with_book("SELECT coordinate, year, number FROM book WHERE status = 'P' OR structure <> 'full'"),
    "semi_eligible": with_book("SELECT p.coordinate, line FROM prov p JOIN book b USING (okey) WHERE structure = 'full' AND status = 'O'"),
    "part_groups": with_book(
        "SELECT instrument, part, coordinate, row_number() OVER (PARTITION BY instrument, part ORDER BY coordinate) - 1 AS i FROM"
        " (SELECT instrument, 'pt' || CAST(ceil(line / 3.0) AS INTEGER) AS part, coordinate FROM prov)"
    ),
    "first_per_series": with_book(
        "SELECT instrument_id FROM book QUALIFY row_number() OVER (PARTITION BY year, status ORDER BY number) <= 5"
        " UNION SELECT instrument_id FROM book WHERE number IN (7, 77, 777)"
    ),
    "strata_sample": with_book(
        "SELECT status, instrument, coordinate FROM (SELECT b.status, p.instrument, p.coordinate, row_number() OVER (PARTITION BY p.instrument ORDER BY"
        " sha256('p|' || p.coordinate)) AS r FROM prov p JOIN (SELECT * FROM book WHERE structure = 'full' QUALIFY row_number() OVER"
        " (PARTITION BY status ORDER BY sha256('s|' || instrument_id)) <= 40) b USING (okey)) WHERE r = 1"
    ),
}
