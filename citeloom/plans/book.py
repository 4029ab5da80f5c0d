"""The synthetic statute book: instruments from orders, provisions from their lines; its tables are an index that is built once and kept.

Every function gives a DataFrame; ``SQL`` holds the same book as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators.tables import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kept(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    inputs = tuple(f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "part"))
    return kept(spark, build.__name__.strip("_"), inputs, lambda: build(spark, sf_dir))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, name): the least part name of each order that has lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("okey")).agg(F.min("p_name").alias("name"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, _instruments)


def _instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(okey, coordinate, instrument_id, title, year, number, series, structure, status, customer, enacted)."""
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    num = F.col("o_orderkey") + 1
    rows = o.join(titled(spark, sf_dir), F.col("o_orderkey") == F.col("okey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("okey"),
        F.concat(F.lit("uk/ukpga/"), year.cast("string"), F.lit("/"), num.cast("string")).alias("coordinate"),
        F.concat(F.lit("uk_ukpga_"), year.cast("string"), F.lit("_"), num.cast("string")).alias("instrument_id"),
        F.concat(F.col("name"), F.lit(" act "), year.cast("string")).alias("title"),
        year.cast("int").alias("year"),
        num.alias("number"),
        F.lit("ukpga").alias("series"),
        F.when(F.col("name").isNull(), "metadata_only").otherwise("full").alias("structure"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("customer"),
        F.to_date("o_orderdate").alias("enacted"),
    )


def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, _provisions)


def _provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(okey, line, coordinate, seq, copies): one row a line; copies counts rows with the same coordinate."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    o = instruments(spark, sf_dir).select("okey", F.col("coordinate").alias("instrument"))
    rows = lines.groupBy(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line")).agg(F.count("*").alias("copies"))
    return rows.join(o, "okey").select(
        "okey", "line", "instrument", F.concat("instrument", F.lit("/s"), F.col("line").cast("string")).alias("coordinate"), "copies"
    )


def title_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, _title_sets)


def _title_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keys, instrument_id): the lookup keys of every titled instrument."""
    book = instruments(spark, sf_dir).where("title is not null").select("instrument_id", "title")
    return book.select(T.title_variants(F.col("title")).alias("keys"), "instrument_id")


def title_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, instrument_id): every lookup key of every titled instrument."""
    return title_sets(spark, sf_dir).select(F.explode("keys").alias("key"), "instrument_id")


SQL = """
titled AS (SELECT l_orderkey AS okey, min(p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
book AS (
  SELECT o_orderkey AS okey,
         'uk/ukpga/' || year(o_orderdate) || '/' || (o_orderkey + 1) AS coordinate,
         'uk_ukpga_' || year(o_orderdate) || '_' || (o_orderkey + 1) AS instrument_id,
         name || ' act ' || year(o_orderdate) AS title, name,
         CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey + 1 AS number, 'ukpga' AS series,
         CASE WHEN name IS NULL THEN 'metadata_only' ELSE 'full' END AS structure,
         o_orderstatus AS status, o_custkey AS customer, CAST(o_orderdate AS DATE) AS enacted
  FROM orders LEFT JOIN titled ON o_orderkey = titled.okey),
prov AS (
  SELECT l.okey, line, b.coordinate AS instrument, b.coordinate || '/s' || line AS coordinate, copies
  FROM (SELECT l_orderkey AS okey, l_linenumber AS line, count(*) AS copies FROM lineitem GROUP BY 1, 2) l JOIN book b USING (okey)),
titles AS (
  SELECT DISTINCT unnest([name || ' act|' || year, name || ' act', name || '|' || year, name]) AS key, instrument_id
  FROM book WHERE name IS NOT NULL)
"""


def with_book(sql: str) -> str:
    return f"WITH {SQL} {sql}"
