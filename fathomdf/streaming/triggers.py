"""Streams: windows, deduplication, rate-limited triggers with keyed state, sinks by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(df: DataFrame, ts: str, size: str, late: str, keys: list[str], *aggs: Column) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(*aggs)


def sliding(df: DataFrame, ts: str, size: str, step: str, late: str, keys: list[str], *aggs: Column) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, size, step), *keys).agg(*aggs)


def sessions(df: DataFrame, ts: str, gap: str, late: str, keys: list[str], *aggs: Column) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*aggs)


def distinct(df: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def rate_limit(df: DataFrame, key: str, ts: str, id_col: str, per: int, seconds: int, idle: int = 86_400) -> DataFrame:
    """Events within the first `per` of their key and fixed window of `seconds`, by keyed state: the open window and its
    count. Events of a batch are taken in order of time, ties by id; those of a window already left are late and dropped. The
    state of a key that was idle for `idle` seconds of processing time expires.
    """
    out = f"{key} {df.schema[key].dataType.simpleString()}, {id_col} {df.schema[id_col].dataType.simpleString()}, {ts} timestamp"

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window, count = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(pdfs)).sort_values([ts, id_col])
        keep = []
        for t in rows[ts]:
            w = int(t.timestamp() // seconds)
            if w > window:
                window, count = w, 0
            ok = w == window and count < per
            count += w == window
            keep.append(ok)
        state.update((window, count))
        state.setTimeoutDuration(idle * 1000)
        got = rows[keep]
        yield pd.DataFrame({key: [k[0]] * len(got), id_col: got[id_col].to_numpy(), ts: got[ts].to_numpy()})

    return df.select(key, id_col, ts).groupBy(key).applyInPandasWithState(step, out, "win long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hands every micro-batch to fn (before/after hooks, upserts), with all that is there now, then stops."""
    return df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
