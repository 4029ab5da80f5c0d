"""Citation readers as table functions: mentions of texts as rows, in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import grammar as G

SCHEMA = "kind string, start int, end int, key string, detail string"


def mentions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, start, end, key_of, detail) of every citation part in texts; a null text has none.

    Kinds: identifier, provision, number, negation, context_ref, bare_chapter, unsupported_part, temporal, date, out_of_coverage.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                found = list(G.each_mention(t.as_py())) if t.is_valid else []
                rows += found
                at += [i] * len(found)
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=[key, "kind", "start", "end", "key_of", "detail"],
            )

    rows = texts.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, kind string, start int, end int, key_of string, detail string")
