"""Routing queries: citations composed from the driver's tables, with the decision that SQL comes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import coords as C
from citeloom.functions import dates
from citeloom.functions import reading as R
from citeloom.functions import text as T
from citeloom.operators import extraction, routing
from citeloom.operators.tables import stored
from citeloom.plans.book import instruments, provisions, table, title_sets, with_book


def _held(spark: SparkSession, d: str) -> DataFrame:
    p = provisions(spark, d)
    return p.select(
        F.translate("instrument", "/", "_").alias("instrument_id"), "instrument", F.concat(F.lit("s"), F.col("line").cast("string")).alias("tail"), "coordinate", "copies"
    )


def _split(texts: DataFrame) -> DataFrame:
    """(text, key, tail) of "section N of the <title>"; no other words are taken."""
    n = F.regexp_extract("text", r"^section ([0-9]+[a-z]*) of the (.+)$", 1)
    title = F.regexp_extract("text", r"^section ([0-9]+[a-z]*) of the (.+)$", 2)
    p = T.split_year(title)
    return texts.select("text", T.title_key(T.title_words(p["title"]), p["year"]).alias("key"), F.concat(F.lit("s"), n).alias("tail"))


def route_exact_title(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct "section N of the <title> <year>" of the book, decided by joins on keys alone."""
    p = provisions(spark, d).select("okey", "line")
    b = instruments(spark, d).where("title is not null").select("okey", "title")
    texts = p.join(b, "okey").select(F.concat(F.lit("section "), F.col("line").cast("string"), F.lit(" of the "), "title").alias("text")).distinct()
    return routing.exact_titles(_split(texts), title_sets(spark, d), _held(spark, d)).select("text", "status", "coordinate", "bearers", "fit")


def route_ambiguous_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles cited without a year: bound only if one bearer alone has the provision."""
    p = provisions(spark, d).select("okey", "line")
    b = instruments(spark, d).where("title is not null").select("okey", F.regexp_replace("title", " [0-9]+$", "").alias("title"))
    texts = p.join(b, "okey").select(F.concat(F.lit("section "), F.col("line").cast("string"), F.lit(" of the "), "title").alias("text")).distinct()
    more = texts.select(F.regexp_replace("text", "^section [0-9]+", "section 99").alias("text")).distinct()
    return routing.exact_titles(_split(texts.union(more)), title_sets(spark, d), _held(spark, d)).select("text", "status", "coordinate", "bearers", "fit")


def _titles(spark: SparkSession, d: str, offers: int | None = None) -> DataFrame:
    b = instruments(spark, d).where("title is not null").select("instrument_id", "title", "year")
    b = b if offers is None else routing.first_bearers(b, offers)
    return b.select("instrument_id", F.array_join(T.title_words(T.split_year(F.col("title"))["title"]), " ").alias("words"), "year", "title")


def route_wrong_year(spark: SparkSession, d: str) -> DataFrame:
    t = _titles(spark, d)
    cited = t.select(F.concat("words", F.lit(" "), (F.col("year") + 50).cast("string")).alias("query_id"), "words", (F.col("year") + 50).alias("year")).distinct()
    return routing.wrong_year(cited, t)


def route_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Titles with an invented word in the middle: the nearest real ones are offered."""
    t = _titles(spark, d, offers=3)
    core = F.filter(F.split("words", " "), lambda w: ~w.isin(*T.TYPE_WORDS))
    cited = t.select(F.array(F.get(core, F.lit(0)), F.lit("crown"), F.get(core, F.lit(1))).alias("content")).distinct()
    cited = cited.select(F.array_join("content", " ").alias("query_id"), "content", F.lit(1998).alias("year"))
    words = t.select(F.explode(F.array_distinct(F.split("words", " "))).alias("word"), "instrument_id")
    return routing.suggestions(cited, words, t, most_titles=1 << 40)


def route_range(spark: SparkSession, d: str) -> DataFrame:
    b = instruments(spark, d)
    cited = b.select(F.col("okey").alias("query_id"), F.col("coordinate").alias("instrument"), F.lit("s").alias("unit"), F.lit("1").alias("low"), F.lit("3").alias("high"))
    got = routing.ranges(cited, _held(spark, d))
    return got.select("query_id", "status", F.array_join("coordinates", ",").alias("coordinates"))


def route_first_path(spark: SparkSession, d: str) -> DataFrame:
    """A section of an instrument that may have articles, regulations or rules instead."""
    p = provisions(spark, d)
    unit = F.element_at(F.array(*[F.lit(x) for x in ("s", "art", "reg", "rule")]), (F.col("okey") % 4 + 1).cast("int"))
    have = p.select(F.concat("instrument", F.lit("/"), unit, F.col("line").cast("string")).alias("coordinate"))
    from citeloom.functions.grammar import UNIT_ORDER

    paths = [F.concat("instrument", F.lit(f"/{u}"), F.lit("2")) for u in UNIT_ORDER[False]["section"]]
    b = instruments(spark, d).select(F.col("okey").alias("query_id"), F.col("coordinate").alias("instrument"))
    return routing.first_paths(b.select("query_id", F.array(*paths).alias("paths")), have).select("query_id", "coordinate", F.col("place").cast("int").alias("place"))


def route_status_priority(spark: SparkSession, d: str) -> DataFrame:
    """Queries of two citations: an instrument and the one after it."""
    b = instruments(spark, d).select("okey", "coordinate", "structure", "status")
    state = F.when(F.col("structure") != "full", R.OUTSIDE).when(F.col("status") == "P", R.NO_INSTRUMENT).when(F.col("okey") % 11 == 0, R.AMBIGUOUS).otherwise(R.BOUNDED)
    one = b.select("okey", state.alias("status"), F.when(state == R.BOUNDED, F.col("coordinate")).alias("coordinate"))
    both = one.select(F.col("okey").alias("query_id"), "status", "coordinate").union(one.where("okey > 0").select(F.col("okey") - 1, "status", "coordinate"))
    got = routing.decided(both)
    return got.select("query_id", "status", "next_action", F.array_join("coordinates", ",").alias("coordinates"))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word")).distinct()


def _mutated(spark: SparkSession, d: str) -> DataFrame:
    v = _vocabulary(spark, d)
    swap = F.concat(F.substring("word", 2, 1), F.substring("word", 1, 1), F.expr("substring(word, 3)"))
    return v.select(F.expr("substring(word, 2)").alias("word")).union(v.select(swap)).union(v.select(F.concat("word", F.lit("s")))).distinct()


def typo_near_join(spark: SparkSession, d: str) -> DataFrame:
    return routing.near_words(_mutated(spark, d), _vocabulary(spark, d))


def typo_near_osa(spark: SparkSession, d: str) -> DataFrame:
    return routing.near_words(_mutated(spark, d), _vocabulary(spark, d), osa=True)


def book_facts(spark: SparkSession, d: str) -> DataFrame:
    """The whole book as facts; what the general route asks."""
    b, p = instruments(spark, d), provisions(spark, d)
    twice = p.where("copies > 1").groupBy("instrument").agg(F.array_sort(F.collect_set("coordinate")).alias("duplicated"))
    b = b.join(twice, b.coordinate == twice.instrument, "left").drop("instrument")
    return routing.facts_table(b.select("coordinate", "title", "year", "number", "structure", "duplicated"), p.select("coordinate"))


def facts_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return book_facts(spark, d).groupBy("kind").agg(F.count("*").alias("keys"), F.sum(F.size("values")).cast("long").alias("entries")).where("kind not in ('typo', 'word')")


def route_full(spark: SparkSession, d: str) -> DataFrame:
    """The general route over numbers, identifiers, provisions, wrong numbers and prose, one query of some form per instrument."""
    b = instruments(spark, d).select("okey", "coordinate", "year", "number")
    y, n = F.col("year").cast("string"), F.col("number").cast("string")
    forms = [
        F.concat(F.lit("see section 2 of "), F.col("coordinate")), F.concat(F.lit("https://www.legislation.gov.uk/"), F.expr("substring(coordinate, 4)"), F.lit("/section/1")),
        F.concat(F.lit("what does SI "), y, F.lit("/"), F.pmod("number", F.lit(9999)).cast("string"), F.lit(" say?")),
        F.concat(F.lit("how large is order "), F.lit("forty")), F.concat(F.col("coordinate"), F.lit(" except section 1")),
        F.concat(F.translate("coordinate", "/", "_"), F.lit(" ss. 1, 2")),
    ]
    text = F.get(F.array(*forms), (F.col("okey") % len(forms)).cast("int"))
    got = routing.route(b.select("okey", text.alias("text")), stored(book_facts(spark, d), "facts"))
    return got.select("okey", "status", "reason", F.array_join("coordinates", ",").alias("coordinates"), F.array_join("excluded", ",").alias("excluded"))


def url_identifiers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("at http://legislation.gov.uk/id/ukpga/1996/"), (F.col("page_id") + 1).cast("string"), F.lit("/section/"), (F.col("page_id") % 40).cast("string"), F.lit("A/contents")).alias("text")
    )
    return extraction.mentions(p, "page_id", "text").where("kind = 'identifier'").select("page_id", F.col("key_of").alias("key"), F.col("detail").alias("typed"))


def extract_provisions(spark: SparkSession, d: str) -> DataFrame:
    p = provisions(spark, d).select(F.col("coordinate").alias("id"), F.concat(F.lit("see ss. "), "line", F.lit(", "), F.col("line") + 1, F.lit(" and Sch. "), "line", F.lit(" para. 4(b)")).alias("text"))
    m = extraction.mentions(p, "id", "text").where("kind = 'provision'")
    return m.select("id", "start", F.col("end").alias("stop"), F.col("key_of").alias("label"))


def fold_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    f = T.fold_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    return f.select("doc_id", F.length("folded").alias("n"), F.size("origin").alias("places"), F.sha2("folded", 256).alias("folded"))


def cue_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day, m = F.to_date("o_orderdate"), F.month("o_orderdate")
    names = F.array(*[F.lit(x.title()) for x in dates.MONTHS])
    forms = [
        F.concat(F.lit("as at "), F.dayofmonth(day).cast("string"), F.lit("th "), F.element_at(names, m), F.lit(" "), F.year(day).cast("string")),
        F.concat(F.lit("in force on "), day.cast("string")), F.concat(F.lit("as of "), F.year(day).cast("string")), F.lit("as it stood"),
        F.concat(F.element_at(names, m), F.lit(" "), F.dayofmonth(day).cast("string"), F.lit(", "), F.year(day).cast("string"), F.lit(" or 1/2/2003")),
    ]
    rows = o.select("o_orderkey", F.get(F.array(*forms), (F.col("o_orderkey") % 5).cast("int")).alias("hint"))
    h = dates.hint_date(F.col("hint"))
    return rows.select("o_orderkey", h.alias("h")).select("o_orderkey", F.col("h.day").alias("day"), F.col("h.status").alias("status"))


def order_keys(spark: SparkSession, d: str) -> DataFrame:
    """Designators in statutory order within each instrument."""
    from pyspark.sql import Window

    p = provisions(spark, d)
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", "ZA", "A", "B")]), (F.col("line") % 4 + 1).cast("int"))
    made = p.select("okey", F.concat((F.col("line") % 3).cast("string"), suffix, F.lit("")).alias("d")).distinct()
    w = Window.partitionBy("okey").orderBy(C.statutory_order(F.col("d")))
    return made.withColumn("place", F.row_number().over(w)).select("okey", "d", F.col("place").cast("int").alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        route_exact_title, route_ambiguous_title, route_wrong_year, route_suggestions, route_range, route_first_path, route_status_priority,
        typo_near_join, typo_near_osa, facts_by_kind, route_full, url_identifiers, extract_provisions, fold_text, cue_dates, order_keys,
    )
}

_HOLD = """
bearers AS (SELECT key, count(*) AS bearers FROM titles GROUP BY 1),
held AS (SELECT key, 's' || line AS tail, count(*) FILTER (copies = 1) AS fit, min(p.coordinate) FILTER (copies = 1) AS coordinate,
         count(*) FILTER (copies > 1) AS twice FROM titles JOIN book USING (instrument_id) JOIN prov p USING (okey) GROUP BY 1, 2),
"""
_DECIDE = f"""
SELECT text, status, CASE WHEN status = '{R.BOUNDED}' THEN coordinate END AS coordinate, bearers, fit FROM (
  SELECT text, coordinate, CAST(coalesce(bearers, 0) AS BIGINT) AS bearers, CAST(coalesce(fit, 0) AS BIGINT) AS fit,
    CASE WHEN bearers IS NULL THEN '{R.NO_INSTRUMENT}' WHEN fit = 1 THEN '{R.BOUNDED}' WHEN bearers > 1 OR twice = 1 THEN '{R.AMBIGUOUS}' ELSE '{R.NO_PROVISION}' END AS status
  FROM cited LEFT JOIN bearers USING (key) LEFT JOIN held USING (key, tail))
"""
_CAUTION = "[" + ", ".join(f"'{s}'" for s in R.ACTIONS) + "]"
_ACTION = "[" + ", ".join(f"'{s}'" for s in R.ACTIONS.values()) + "]"
_MONTHS = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"


def _book(ctes: str, sql: str) -> str:
    return with_book("").rstrip().removesuffix(",") + ", " + ctes + sql


_TYPO = """
WITH v AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS near FROM part),
m AS (SELECT word FROM (SELECT near[2:] AS word FROM v UNION SELECT near[2] || near[1] || near[3:] FROM v UNION SELECT near || 's' FROM v))
SELECT word, near, CAST(levenshtein(word, near) AS INTEGER) AS distance FROM m, v WHERE word <> near AND levenshtein(word, near) <= 2
"""

ORACLE = {
    "route_exact_title": _book(
        _HOLD + "cited AS (SELECT DISTINCT 'section ' || line || ' of the ' || title AS text, name || ' act|' || year AS key, 's' || line AS tail FROM prov JOIN book USING (okey) WHERE name IS NOT NULL)", _DECIDE
    ),
    "route_ambiguous_title": _book(
        _HOLD
        + "one AS (SELECT DISTINCT line, name FROM prov JOIN book USING (okey) WHERE name IS NOT NULL UNION ALL SELECT DISTINCT 99, name FROM book WHERE name IS NOT NULL),"
        " cited AS (SELECT 'section ' || line || ' of the ' || name || ' act' AS text, name || ' act' AS key, 's' || line AS tail FROM one)",
        _DECIDE,
    ),
    "route_wrong_year": _book(
        "cited AS (SELECT DISTINCT name || ' act ' || (year + 50) AS query_id, name, year + 50 AS y FROM book WHERE name IS NOT NULL)",
        " SELECT query_id, instrument_id, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, instrument_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(year - y), instrument_id) AS r"
        " FROM cited JOIN book USING (name) WHERE year <> y) WHERE r <= 3",
    ),
    "route_suggestions": _book(
        "t AS (SELECT instrument_id, year, title, string_split(name, ' ') AS w FROM book WHERE name IS NOT NULL),"
        " cited AS (SELECT DISTINCT w[1] || ' crown ' || w[2] AS query_id, [w[1], 'crown', w[2]] AS content FROM t)",
        " SELECT query_id, instrument_id, shared, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, instrument_id, CAST(len(list_intersect(content, w)) AS INTEGER) AS shared,"
        " row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(content, w)) DESC, abs(year - 1998), levenshtein(query_id, lower(title)), instrument_id) AS r"
        " FROM cited, t WHERE len(list_intersect(content, w)) >= 1.5) WHERE r <= 3",
    ),
    "route_range": _book(
        "r AS (SELECT b.okey AS query_id, count(*) FILTER (line IN (1, 3)) AS ends, count(*) FILTER (line IN (1, 3) AND copies > 1) AS twice,"
        " coalesce(string_agg(p.coordinate, ',' ORDER BY line), '') AS coordinates FROM book b LEFT JOIN prov p ON b.okey = p.okey AND line BETWEEN 1 AND 3 WHERE b.okey % 5 = 0 GROUP BY 1)",
        f" SELECT query_id, status, CASE WHEN status = '{R.BOUNDED}' THEN coordinates ELSE '' END AS coordinates FROM (SELECT *, CASE WHEN ends < 2 THEN '{R.NO_PROVISION}'"
        f" WHEN twice > 0 THEN '{R.AMBIGUOUS}' ELSE '{R.BOUNDED}' END AS status FROM r)",
    ),
    "route_first_path": _book(
        "have AS (SELECT DISTINCT instrument || '/' || ['s', 'art', 'reg', 'rule'][okey % 4 + 1] || line AS coordinate FROM prov),"
        " paths AS (SELECT okey AS query_id, unnest([0, 1, 2, 3]) AS place, coordinate || '/' || unnest(['art', 'reg', 'rule', 's']) || '2' AS coordinate FROM book)",
        " SELECT b.okey AS query_id, min_by(p.coordinate, place) AS coordinate, CAST(min(place) AS INTEGER) AS place FROM book b LEFT JOIN"
        " (SELECT paths.* FROM paths JOIN have USING (coordinate)) p ON b.okey = p.query_id GROUP BY 1",
    ),
    "route_status_priority": _book(
        f"one AS (SELECT okey, coordinate, CASE WHEN structure <> 'full' THEN '{R.OUTSIDE}' WHEN status = 'P' THEN '{R.NO_INSTRUMENT}' WHEN okey % 11 = 0 THEN '{R.AMBIGUOUS}' ELSE '{R.BOUNDED}' END AS s FROM book),"
        f" g AS (SELECT query_id, min(list_position({_CAUTION}, s)) AS r, string_agg(DISTINCT CASE WHEN s = '{R.BOUNDED}' THEN coordinate END, ',' ORDER BY CASE WHEN s = '{R.BOUNDED}' THEN coordinate END) AS c"
        " FROM (SELECT okey AS query_id, * FROM one UNION ALL SELECT okey - 1, * FROM one WHERE okey > 0) GROUP BY 1)",
        f" SELECT query_id, {_CAUTION}[r] AS status, {_ACTION}[r] AS next_action, CASE WHEN {_CAUTION}[r] = '{R.BOUNDED}' THEN c ELSE '' END AS coordinates FROM g",
    ),
    "typo_near_join": _TYPO,
    "facts_by_kind": _book(
        "acr AS (SELECT DISTINCT array_to_string(list_transform(string_split(name || ' act', ' '), lambda w: w[1]), '') || '|' || year AS k, instrument_id FROM book WHERE name IS NOT NULL),"
        " ws AS (SELECT array_to_string(list_sort(list_distinct(string_split(name || ' act', ' '))), ' ') || '|' || year AS k FROM book WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT instrument_id) = 1)",
        " SELECT 'title' AS kind, count(DISTINCT key) AS keys, count(*) AS entries FROM titles UNION ALL SELECT 'acronym', count(DISTINCT k), count(*) FROM acr"
        " UNION ALL SELECT 'wordset', count(*), count(*) FROM ws HAVING count(*) > 0 UNION ALL SELECT 'info', count(*), count(*) FROM book UNION ALL SELECT 'number', count(*), count(*) FROM book"
        " UNION ALL SELECT 'acts', count(DISTINCT year), count(*) FROM book UNION ALL SELECT 'coordinate', sum(n), sum(n) FROM (SELECT count(*) AS n FROM book UNION ALL SELECT count(*) FROM prov)"
        " UNION ALL SELECT 'top', count(*), count(*) FROM prov UNION ALL SELECT 'newest', count(DISTINCT year) + 1, count(DISTINCT year) + 1 FROM book",
    ),
    "route_full": _book(
        "s AS (SELECT okey, max(copies) FILTER (line = 1) AS c1, max(copies) FILTER (line = 2) AS c2 FROM prov GROUP BY 1),"
        " q AS (SELECT b.okey, okey % 6 AS form, b.coordinate AS c, structure <> 'full' AS bare, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2 FROM book b LEFT JOIN s USING (okey)),"
        " n AS (SELECT *, CASE form WHEN 0 THEN CASE WHEN c2 = 0 THEN 0 WHEN c2 > 1 THEN 2 ELSE 1 END WHEN 1 THEN CASE WHEN c1 = 0 THEN 0 WHEN c1 > 1 THEN 2 ELSE 1 END"
        " WHEN 5 THEN CASE WHEN c1 = 0 THEN 0 WHEN c1 > 1 THEN 2 WHEN c2 = 0 THEN 0 WHEN c2 > 1 THEN 2 ELSE 1 END END AS v FROM q)",
        f" SELECT okey, CASE WHEN form = 2 THEN '{R.NO_INSTRUMENT}' WHEN form = 3 THEN '{R.UNRESOLVED}' WHEN form = 4 THEN '{R.BOUNDED}' WHEN bare THEN '{R.OUTSIDE}'"
        f" ELSE ['{R.NO_PROVISION}', '{R.BOUNDED}', '{R.AMBIGUOUS}'][v + 1] END AS status,"
        " CASE WHEN form = 2 THEN 'number_not_in_index' WHEN form IN (3, 4) THEN NULL WHEN bare THEN 'provision_structure_unavailable' ELSE ['provision_not_in_instrument', NULL, 'duplicated_in_source'][v + 1] END AS reason,"
        " CASE WHEN form = 4 THEN c WHEN form IN (2, 3) OR bare OR v <> 1 THEN '' WHEN form = 0 THEN c || '/s2' WHEN form = 1 THEN c || '/s1' ELSE c || '/s1,' || c || '/s2' END AS coordinates,"
        " CASE WHEN form = 4 AND c1 = 1 THEN c || '/s1' ELSE '' END AS excluded FROM n",
    ),
    "url_identifiers": "SELECT page_id, 'uk/ukpga/1996/' || (page_id + 1) || '/s' || (page_id % 40) || 'a' AS key, 'uk/ukpga/1996/' || (page_id + 1) || '/s' || (page_id % 40) || 'A' AS typed FROM pages",
    "extract_provisions": with_book(
        "SELECT p.coordinate AS id, CAST(4 AS INTEGER) AS start, CAST(4 + length('ss. ' || line || ', ' || (line + 1)) AS INTEGER) AS stop, 's.' || line || '; s.' || (line + 1) AS label FROM prov p WHERE okey < 5000"
        " UNION ALL SELECT p.coordinate, CAST(9 + length('ss. ' || line || ', ' || (line + 1)) AS INTEGER), CAST(length('see ss. ' || line || ', ' || (line + 1) || ' and Sch. ' || line || ' para. 4(b)') AS INTEGER),"
        " 'Sch. ' || line || ' para. 4(b)' FROM prov p WHERE okey < 5000"
    ),
    "cue_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) OR (o_orderkey % 5 = 4 AND CAST(o_orderdate AS DATE) = DATE '2003-02-01') THEN CAST(o_orderdate AS DATE) END AS day,"
    " CASE o_orderkey % 5 WHEN 2 THEN 'IMPRECISE_DATE' WHEN 3 THEN 'NO_DATE' WHEN 4 THEN 'AMBIGUOUS' END AS status FROM orders",
    "order_keys": with_book(
        "SELECT okey, d, CAST(row_number() OVER (PARTITION BY okey ORDER BY n, CASE WHEN x = '' THEN 0 WHEN x[1] = 'Z' THEN 1 ELSE 2 END, x) AS INTEGER) AS place FROM"
        " (SELECT DISTINCT okey, line % 3 AS n, ['', 'ZA', 'A', 'B'][line % 4 + 1] AS x, (line % 3) || ['', 'ZA', 'A', 'B'][line % 4 + 1] AS d FROM prov WHERE okey < 4000)"
    ),
}
