"""What the corpus operators share: shared-folder tables, row keys, Arrow row maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 words are runs of bytes other than space and \\t \\n \\v \\f \\r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Spark removes a step's shuffle files at its end where this holds.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is named, a local master gets one of its own (tests); a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    own = getattr(spark.sparkContext, "_citeloom_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.sparkContext._citeloom_dir = own
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it again.

    The files outlive lost executors; they are compressed and column-pruned when read. The shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._citeloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._citeloom_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """96 bits that name a document row; rows equal in id and text share them."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.col(doc_id), t).alias("_k1"), F.hash(t).alias("_k2")]


def carrying(df: DataFrame, *cols: str) -> DataFrame:
    """row, a struct of all columns, and the named ones beside it, so that an operator's own names clash with no user's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`") for c in cols])


def carried(rows: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    """The columns of like out of row again, with new values for some."""
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in like.columns])


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns under internal names, so that no other column can clash."""
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in cols.items()])


def arrow_map(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    return df.mapInArrow(fn, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batch_of(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
