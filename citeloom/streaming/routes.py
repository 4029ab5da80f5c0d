"""Routing of streams: stateless routes per micro-batch, conversations that carry what was bound, logs written once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeloom.functions import reading as R
from citeloom.operators import routing


def route_stream(queries: DataFrame, facts: DataFrame, path: str, checkpoint: str, setting: R.Setting = R.Setting(), **trigger) -> StreamingQuery:
    """Routes each micro-batch of queries and writes it under path, in the folder of its batch.

    A batch that is run again after a failure replaces its own folder, so every query is decided once.
    """

    def write(batch: DataFrame, number: int) -> None:
        routing.route(batch, facts, setting).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


TURNS = "conv_id long, turn long, coordinates array<string>"


def carried_context(turns: DataFrame, timeout: str = "30 minutes") -> DataFrame:
    """Stream of bound turns (conv_id, turn, coordinates array) as (conv_id, turn, context): what the nearest earlier turn bound.

    State is one conversation's last turn with coordinates, dropped when the conversation is idle for the timeout.
    Turns that come in one batch are taken in order; a turn that comes after a later one keeps the context of its time of arrival.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get[0]) if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values("turn", kind="stable").itertuples():
            out.append((key[0], r.turn, last))
            if r.coordinates is not None and len(r.coordinates):
                last = list(r.coordinates)
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(int(pd.Timedelta(timeout).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "context"])

    return (
        turns.select("conv_id", "turn", "coordinates")
        .groupBy("conv_id")
        .applyInPandasWithState(
            run, "conv_id long, turn long, context array<string>", "coordinates array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout
        )
    )


def log_once(records: DataFrame, path: str, checkpoint: str, key: str = "key", late: str = "1 hour", **trigger) -> StreamingQuery:
    """Appends records (key, ts ...) to a log, each key once within the watermark."""
    once = records.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    out = once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return out.trigger(**(trigger or {"availableNow": True})).start()


def new_files(stream: DataFrame, checkpoint: str, parse, path: str, **trigger) -> StreamingQuery:
    """Parses files (path, content) as they come; the source's checkpoint remembers which are done."""

    def write(batch: DataFrame, number: int) -> None:
        parse(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
