"""Tables in the session's shared folder: cut lineage, exact membership, sorted index tables with a manifest."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is named, a local master gets one of its own (tests); a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    own = getattr(spark.sparkContext, "_citeloom_tables", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.sparkContext._citeloom_tables = own
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: later steps outlive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/book-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_state(spark: SparkSession, path: str) -> tuple:
    """(name, length, time of change) of a file or of the files of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found))


def kept(spark: SparkSession, name: str, inputs: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """A table of the index: built once a session and read again as long as its input files are the same."""
    held = spark.sparkContext.__dict__.setdefault("_citeloom_kept", {})
    key = (name, tuple((path, file_state(spark, path)) for path in inputs))
    if key not in held:
        made = stored(build(), name)
        held[key] = (made.schema, made.inputFiles())
    schema, files = held[key]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def key_problems(table: DataFrame, key: str = "key", values: tuple[str, ...] = ()) -> DataFrame:
    """(key, problem): empty or repeated keys and control characters; must be empty before a table is written."""
    bad = F.when(F.coalesce(F.col(key), F.lit("")) == "", "empty_key").when(F.col(key).rlike(r"[\t\n\r]"), "control_character")
    for v in values:
        bad = bad.when(F.col(v).rlike(r"[\n\r]"), "newline_in_value")
    one = table.select(F.col(key).alias("key"), bad.alias("problem")).where("problem is not null")
    twice = table.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return one.union(twice.select("key", F.lit("repeated_key"))).distinct()


def write_sorted(table: DataFrame, path: str, key: str = "key") -> dict:
    """Writes a table range-partitioned and sorted by key, so a lookup or prefix reads few row groups; gives its manifest row.

    The write replaces the table as a whole. The digest does not depend on the order of rows or files.
    """
    bad = key_problems(table, key).take(1)
    if bad:
        raise ValueError(f"{bad[0]['problem']}: {bad[0]['key']!r}")
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table.repartitionByRange(parts, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return digest(table.sparkSession.read.parquet(path)) | {"path": path}


def digest(table: DataFrame) -> dict:
    """(rows, sha256) of a table's content: SHA-256 over each row's JSON, combined without regard to order."""
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    lanes = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    got = table.agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(lanes)]).first()
    import hashlib

    text = "|".join(str(got[f"s{i}"] or 0) for i in range(5))
    return {"rows": got["n"], "sha256": hashlib.sha256(f"{got['n']}|{text}".encode()).hexdigest()}


def verify(spark: SparkSession, manifest: list[dict], format_version: int, found_version: int) -> list[str]:
    """What differs from the manifest: a wrong version, tables that are gone or changed."""
    out = [] if format_version == found_version else [f"format version {found_version}, wanted {format_version}"]
    for m in manifest:
        try:
            now = digest(spark.read.parquet(m["path"]))
        except Exception as e:  # a table that cannot be read is a finding, told with its cause
            out.append(f"{m['path']}: {type(e).__name__}")
            continue
        out += [f"{m['path']}: {k} {now[k]} is not {m[k]}" for k in ("rows", "sha256") if now[k] != m[k]]
    return out


def prefix(table: DataFrame, start: str, key: str = "key") -> DataFrame:
    """The rows whose key begins with start; Parquet prunes row groups by it."""
    return table.where(F.col(key).startswith(start))
