"""Sinks: partitioned records, lists, logs, reports and seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.tables import digest, write_sorted
from citeloom.sources.records import canonical


def write_records(rows: DataFrame, path: str, *partitions: str) -> None:
    """Replaces records under path; the commit makes all files visible at once."""
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_index(tables: dict[str, DataFrame], path: str, version: int = 1, key: str = "key") -> list[dict]:
    """Each table sorted by its key under path/name; the manifest is written last, so a broken write is never loaded."""
    manifest = [write_sorted(t, f"{path}/{name}", key) | {"name": name, "format_version": version} for name, t in sorted(tables.items())]
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(manifest).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_harvest(rows: DataFrame, path: str) -> None:
    """The citations of all instruments in the order of id and place."""
    rows.orderBy("instrument_id", "seq").write.mode("overwrite").json(path)


def write_missing(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_lines(rows: DataFrame, path: str, *columns: str) -> None:
    """JSON lines with fields in the order given; null fields are left out."""
    rows.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


def write_queries(rows: DataFrame, path: str, text: str = "text") -> None:
    rows.select(F.regexp_replace(text, r"\s+", " ").alias("value")).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def markdown(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row (text): a Markdown table of a report. Reports are small; one task lays them out."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("–")) for c in rows.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    return rows.agg(F.concat(F.lit(head + "\n"), body).alias("text"))


def seal(tables: dict[str, DataFrame]) -> list[dict]:
    """Name, rows and digest of each table."""
    return [{"name": n} | digest(t) for n, t in sorted(tables.items())]


def misses(results: DataFrame, text: str = "query_text", redact: Column | None = None) -> DataFrame:
    """Unresolved queries with a citation signal, told by hash and length only, unless redact says what may be shown."""
    shown = F.lit(None).cast("string") if redact is None else redact
    some = results.where("status = 'ROUTE_UNRESOLVED' and citation_signal")
    return some.select(
        F.lit("unresolved_with_signal").alias("event"), F.sha2(F.col(text), 256).alias("query_sha256"), F.length(text).alias("query_length"),
        shown.alias("query"), "reason", "index_snapshot",
    )


__all__ = ["append_log", "canonical", "markdown", "misses", "seal", "write_harvest", "write_index", "write_lines", "write_missing", "write_queries", "write_records"]
