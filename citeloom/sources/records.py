"""Record files, catalogues, listings, feeds and logs: reading with fixed schemas, sealing, checking, writing."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import coords as C
from citeloom.functions import grammar as G
from citeloom.functions import text as T
from citeloom.operators import indexing as X
from citeloom.sources.clml import CITATION, INSTRUMENT, PROVISION

CATALOGUE = "coordinate string, series string, year int, number int, title string, title_as_published string, repealed boolean, source string"
BATTERY = (
    "id string, query string, context array<string>, lang string, domain string, expected_status string, expected_coordinates array<string>,"
    " source string, notes string, surface_form_ids array<string>, absence_verified_via struct<catalogue:string,search_url:string,searched:date>, split string"
)
CONCEPTS = "id string, query string, lang string, domain string, area string, route_status string, gold array<string>, source string, split string, notes string"
CALLS = "key string, system string, battery string, row_id string, count int, rep int, started_utc string, attempts int, ok boolean, error string, result string"
# Statuses without coordinates, what a published title may end in.
UNBOUND = (
    "EPISTEMIC_ABSTENTION_INSTRUMENT_NOT_FOUND", "EPISTEMIC_ABSTENTION_PROVISION_NOT_FOUND", "ROUTE_OUT_OF_COVERAGE", "ROUTE_UNRESOLVED",
)
REPEALED = r"(?i)\s*\((?:repealed|revoked)\b[^()]*\)\s*$"
RETRYABLE = r"(?i)\b(429|500|502|503|504|529|timeout|timed out|connection|overloaded|rate.?limit|unavailable)\b"
# End of the fixed values.


def canonical(*columns: str) -> Column:
    """JSON of the columns in name order without nulls: equal content, equal text."""
    return F.to_json(F.struct(*sorted(columns)))


def sealed(rows: DataFrame, name: str = "checksum_sha256") -> DataFrame:
    return rows.withColumn(name, F.sha2(canonical(*[c for c in rows.columns if c != name]), 256))


def broken_seals(rows: DataFrame, name: str = "checksum_sha256") -> DataFrame:
    """Rows whose content does not have its checksum; must be empty."""
    return rows.where(~F.col(name).eqNullSafe(F.sha2(canonical(*[c for c in rows.columns if c != name]), 256)))


def json_rows(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines under a fixed schema. Strict: a bad line fails; else bad and torn lines are left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def instrument_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Instruments and provisions of record files: one line each, told apart by record_type; with the file as _file."""
    kinds = "record_type string, checksum_sha256 string, "
    read = lambda schema: spark.read.schema(kinds + schema).option("recursiveFileLookup", "true").json(path).withColumn("_file", F.input_file_name())
    return read(INSTRUMENT).where("record_type = 'instrument'"), read(PROVISION).where("record_type = 'provision'")


def coordinates_only(spark: SparkSession, path: str) -> DataFrame:
    """Just what an index of coordinates needs; the other fields are never parsed."""
    return spark.read.schema("coordinate string, instrument_id string").option("recursiveFileLookup", "true").json(path)


def harvest(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, CITATION)


def file_problems(rows: DataFrame) -> DataFrame:
    """(_file, problem): files that hold two instruments, or whose names are another instrument's; must be empty."""
    per = rows.groupBy("_file").agg(F.min("instrument_id").alias("a"), F.max("instrument_id").alias("b"))
    name = F.regexp_extract("_file", r"([^/]+)\.jsonl", 1)
    return per.select("_file", F.when(F.col("a") != F.col("b"), "two_instruments").when(name != F.col("a"), "other_name").alias("problem")).where("problem is not null")


def cleaned(rows: DataFrame, published: str = "title_as_published") -> DataFrame:
    """Adds title and repealed, read off the published title."""
    bare = F.trim(F.regexp_replace(published, REPEALED, ""))
    title = F.when(F.trim(F.coalesce(F.col(published), F.lit(""))) == "", F.lit(None)).otherwise(F.coalesce(F.nullif(bare, F.lit("")), F.trim(published)))
    return rows.withColumn("title", title).withColumn("repealed", F.coalesce(F.col(published).rlike(REPEALED), F.lit(False)))


def listing(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A JSON listing as catalogue rows: rows without a title stay, rows whose coordinate is none go."""
    raw = json_rows(spark, path, "coordinate string, series string, year int, number int, title string", strict=False)
    good = raw.withColumn("p", C.parse(F.col("coordinate"))).where("p is not null and size(p.provision) = 0").withColumnRenamed("title", "title_as_published")
    rows = cleaned(good).withColumn("series", F.get("p.instrument", F.lit(0))).withColumn("source", F.lit(source))
    return rows.select(*[c.split()[0] for c in CATALOGUE.split(", ")])


def queue(rows: DataFrame, source: str) -> DataFrame:
    """Download-queue rows (series, year, number, title; strings), from a database read by spark.read.jdbc, as catalogue rows.

    SIs, and Acts from 1963 on, when chapters began to be numbered by calendar year.
    """
    digits = F.col("year").rlike("^[0-9]+$") & F.col("number").rlike("^[0-9]+$")
    ok = rows.where(F.col("series").isin("uksi", "ukpga") & digits).withColumn("year", F.col("year").try_cast("int")).withColumn("number", F.col("number").try_cast("int"))
    ok = ok.where("series = 'uksi' or year >= 1963").withColumnRenamed("title", "title_as_published")
    made = F.concat_ws("/", F.lit("uk"), "series", F.col("year").cast("string"), F.col("number").cast("string"))
    rows = cleaned(ok.withColumn("coordinate", made)).withColumn("source", F.lit(source)).where(C.parse(F.col("coordinate")).isNotNull())
    return rows.select(*[c.split()[0] for c in CATALOGUE.split(", ")])


def feed_entries(pages: DataFrame, source: str = "atom-feed") -> DataFrame:
    """Catalogue rows of Atom pages (body, series hint): entries without a usable coordinate are left out."""
    entries = pages.select("series", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))).alias("e"))
    pick = lambda pattern: F.nullif(F.trim(F.regexp_extract("e", pattern, 1)), F.lit(""))
    year, number = pick(r'<(?:\w+:)?Year\b[^>]*Value="([0-9]+)"'), pick(r'<(?:\w+:)?Number\b[^>]*Value="([0-9]+)"')
    path = pick(r"(?s)<id>\s*https?://www\.legislation\.gov\.uk/(?:id/)?([^<\s]+?)/?\s*</id>")
    own = F.concat(F.lit("uk/"), path)
    hinted = F.concat_ws("/", F.lit("uk"), "series", year, number)
    rows = entries.withColumn("coordinate", F.when(C.parse(own).isNotNull(), own).when(year.isNotNull() & number.isNotNull() & F.col("series").isNotNull(), hinted))
    rows = rows.withColumn("p", C.parse(F.col("coordinate"))).where("p is not null and size(p.provision) = 0")
    seg = F.col("p.instrument")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(pick(r"(?s)<title[^>]*>(.*?)</title>"), "&lt;", "<"), "&gt;", ">"), "&amp;", "&")
    rows = rows.withColumn("title_as_published", text).withColumn("series", F.get(seg, F.lit(0)))
    rows = rows.withColumn("year", F.coalesce(year, F.get(seg, F.lit(1))).try_cast("int")).withColumn("number", F.coalesce(number, F.element_at(seg, -1)).try_cast("int"))
    return cleaned(rows.where("year is not null and number is not null")).withColumn("source", F.lit(source)).select(*[c.split()[0] for c in CATALOGUE.split(", ")])


def next_page(pages: DataFrame) -> DataFrame:
    """(page, url): the address of the page that follows each page."""
    link = F.regexp_extract("body", r'<link\b[^>]*rel="next"[^>]*>', 0)
    return pages.select("page", F.nullif(F.regexp_extract(link, 'href="([^"]+)"', 1), F.lit("")).alias("url"))


def merged_catalogue(sources: Iterable[DataFrame]) -> DataFrame:
    """One row a coordinate: the first source that has it wins, and within a source the least row."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("_place", F.lit(i))
        rows = s if rows is None else rows.unionByName(s)
    return X.first_wins(rows, ["coordinate"], [F.col("_place"), F.col("title").isNull()]).drop("_place")


def not_indexed(catalogue: DataFrame, book: DataFrame) -> DataFrame:
    """Catalogue entries that the book has neither by coordinate nor by any official number."""
    keyed = lambda df: df.select("coordinate", F.explode_outer(C.number_keys(F.slice(F.split("coordinate", "/"), F.lit(2), F.lit(4)))).alias("k"))
    have = keyed(book).where("k is not null").select("k").distinct()
    rest = catalogue.join(book.select("coordinate"), "coordinate", "left_anti")
    named = keyed(rest).join(have, "k", "left_semi").select("coordinate").distinct()
    return rest.join(named, "coordinate", "left_anti")


def aliases(path: str) -> list[tuple[str, str, bool]]:
    """(words, target coordinate, salient) of a hand-written TOML file of [[alias]] tables with target, forms and salient."""
    with open(path, "rb") as f:
        entries = tomllib.load(f).get("alias", [])
    return [(" ".join(G.title_words(G.Query(form).folded)), e["target"], bool(e.get("salient"))) for e in entries for form in e["forms"]]


def thesaurus(path: str) -> list[tuple[str, list[str]]]:
    """(word, synonyms) of a TOML file of [[entry]] tables with word and synonyms; a curated list."""
    with open(path, "rb") as f:
        return [(e["word"], list(e["synonyms"])) for e in tomllib.load(f).get("entry", [])]


def battery_problems(rows: DataFrame, name: str) -> DataFrame:
    """(id, problem) of battery rows; must be empty."""
    none = F.size(F.coalesce("expected_coordinates", F.array().cast("array<string>"))) == 0
    bound, empty = F.col("expected_status") == "ROUTE_BOUNDED", F.col("expected_status").isin(*UNBOUND)
    problem = (
        F.when(~F.col("id").rlike(f"^uk-{name}-[0-9]{{4}}$"), "id").when(F.length("query").between(1, 8192) == F.lit(False), "query")
        .when(bound & none, "bound_without_coordinates").when(empty & ~none, "coordinates_without_bound")
        .when(F.col("split").isNotNull() != F.lit(name == "typo"), "split")
    )
    one = rows.select("id", problem.alias("problem")).where("problem is not null")
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated_id").alias("problem"))
    same = rows.groupBy(F.lower(F.trim("query")).alias("q")).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    return one.union(twice).union(same.select("id", F.lit("repeated_query")))


def numbered(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows with ids uk-name-0001 and on, in order. Batteries are small; one task numbers them."""
    place = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("id", F.format_string(f"uk-{name}-%04d", place))


def calls(spark: SparkSession, path: str) -> DataFrame:
    """Call-log records; a torn last line is left out."""
    return json_rows(spark, path, CALLS, strict=False).where("key is not null")


def retryable(error: Column) -> Column:
    return F.coalesce(error.rlike(RETRYABLE), F.lit(False))


def to_do(plan: DataFrame, log: DataFrame) -> DataFrame:
    """Jobs of a plan that have no success yet, and no failure that retrying cannot mend."""
    settled = log.where(F.col("ok") | ~retryable(F.col("error"))).select("key").distinct()
    return plan.join(settled, "key", "left_anti")


def job_plan(rows: DataFrame, systems: list[str], counts: list[int], repeats: int, sample: int | None, seed: int) -> DataFrame:
    """Rows by systems, option counts and repeats, in a seeded order; sample bounds the rows by hash (a sampling operator)."""
    some = rows.select("row_id") if sample is None else rows.select("row_id").orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id").limit(sample)
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    jobs = some.withColumn("system", F.explode(arr(systems))).withColumn("count", F.explode(arr(counts))).withColumn("rep", F.explode(arr(range(1, repeats + 1))))
    jobs = jobs.withColumn("key", F.concat_ws("|", "system", "row_id", F.col("count").cast("string"), F.col("rep").cast("string")))
    return jobs.withColumn("turn", F.xxhash64(F.lit(seed), "key"))


def queries_of(spark: SparkSession, path: str) -> DataFrame:
    """(text) of a plain file, blank lines left out."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("text"))


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of each file beneath path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def seal_differences(sealed_: DataFrame, now: DataFrame) -> DataFrame:
    """(name, change): what was added, removed or changed since a seal (name, sha256)."""
    j = sealed_.select("name", F.col("sha256").alias("a")).join(now.select("name", F.col("sha256").alias("b")), "name", "full_outer")
    return j.select("name", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").alias("change")).where("change is not null")


def undeclared(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path) beneath no declared prefix (prefix, licence)."""
    return files.join(manifest, F.col("path").startswith(F.col("prefix")), "left_anti")


def searches(lines: DataFrame, first: int = 1, last: int = 50) -> DataFrame:
    """(number, query) of numbered lines (value) of an appendix; fails if any number is missing or repeated."""
    m = lines.select(F.regexp_extract("value", r"^\s*([0-9]+)\.\s+(.+?)\s*$", 1).try_cast("int").alias("number"), F.regexp_extract("value", r"^\s*([0-9]+)\.\s+(.+?)\s*$", 2).alias("query"))
    m = m.where(F.col("number").between(first, last))
    n = m.agg(F.count("*").alias("n"), F.countDistinct("number").alias("d")).first()
    if (n["n"], n["d"]) != (last - first + 1, last - first + 1):
        raise ValueError(f"{n['n']} searches, {n['d']} numbers; wanted {first} to {last} once each")
    return m


NOISE = ("digits", "words", "years", "sections", "brackets", "acts", "roman", "commas", "slashes", "accents", "capitals", "numbers", "mixed")


def noise(spark: SparkSession, per_class: int, chars: int = T.MAX_QUERY, seed: int = 7) -> DataFrame:
    """(class, sample, text): generated queries of chars characters that cite nothing real, to time worst cases."""
    stock = {
        "digits": "8271", "words": "lorem", "years": "1996", "sections": "s. 12", "brackets": "(a)(1)", "acts": "act", "roman": "xiv", "commas": ", ,",
        "slashes": "uk/x/1", "accents": "é ü", "capitals": "ACT", "numbers": "SI 2011/12", "mixed": "Sch. 2 order 1999",
    }
    rows = spark.range(len(NOISE) * per_class).select((F.col("id") % len(NOISE)).cast("int").alias("k"), F.floor(F.col("id") / len(NOISE)).cast("int").alias("sample"))
    kind = F.get(F.array(*map(F.lit, NOISE)), F.col("k"))
    word = F.get(F.array(*[F.lit(stock[n]) for n in NOISE]), F.col("k"))
    parts = F.transform(F.sequence(F.lit(1), F.lit(chars // 4)), lambda i: F.concat(word, F.pmod(F.xxhash64(F.lit(seed), "k", "sample", i), F.lit(97)).cast("string"), F.lit(" ")))
    return rows.select(kind.alias("class"), "sample", F.substring(F.array_join(parts, ""), 1, chars).alias("text"))
