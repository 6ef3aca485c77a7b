"""Moving statistics of a stream: state per series, and a timer that ends a series which falls silent."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

SIZE = 20
IDLE_MS = 24 * 3600 * 1000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "name string, seq long, value double, median double, mean double, most double, ended boolean"


def moving(values: np.ndarray, new: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the last `new` of some values, each with up to size - 1 before it: lower median, mean and maximum."""
    wide = np.concatenate((np.full(max(0, size - 1 - (len(values) - new)), np.nan), values[max(0, len(values) - new - size + 1) :]))
    window = np.sort(np.lib.stride_tricks.sliding_window_view(wide, size), axis=1)  # what is not there sorts last
    n = size - np.isnan(window).sum(1)
    at = np.arange(len(window))
    return window[at, (n + 1) // 2 - 1], np.nansum(window, 1) / n, window[at, n - 1]


class MovingMeter(StatefulProcessor):
    """For each row (name, seq, at, value) the statistics of the last `size` of its series. Rows of a batch come in order
    of seq, batches in the order they are. A series of which the watermark has passed the last row by idle_ms gives one
    more row, marked as ended, of its last values, and starts anew."""

    def __init__(self, size: int = SIZE, idle_ms: int = IDLE_MS) -> None:
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "seq long, at long, values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        seq, last, before = self.held.get() if self.held.exists() else (0, 0, [])
        so_far = None
        for new in rows:  # some thousand at a time, and what is held of those before
            if not new["seq"].is_monotonic_increasing or (so_far is not None and new["seq"].iloc[0] < so_far):
                raise ValueError(f"rows of {key[0]} do not come in order")
            values = np.array([*before, *new["value"]], np.float64)
            median, mean, most = moving(values, len(new), self.size)
            seq = so_far = int(new["seq"].iloc[-1])
            last, before = max(last, int(new["at"].max())), [float(v) for v in values[-self.size :]]
            yield pd.DataFrame({"name": key[0], "seq": new["seq"], "value": new["value"], "median": median, "mean": mean, "most": most, "ended": False})
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        self.held.update((seq, last, before))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, _, values = self.held.get()
        median, mean, most = moving(np.array(values, np.float64), 1, self.size)
        self.held.clear()
        yield pd.DataFrame({"name": [key[0]], "seq": [seq], "value": [values[-1]], "median": median, "mean": mean, "most": most, "ended": [True]})

    def close(self) -> None:
        pass


def moving_meters(series: DataFrame, size: int = SIZE, idle_ms: int = IDLE_MS, late: str = "1 hour") -> DataFrame:
    """OUT rows of a stream (name, seq, ts, value); rows more than `late` behind the latest ts are out, as are those with
    a null. Its state is `size` values a series, and needs the RocksDB store. The rows of a batch are sorted before they
    meet their series, so that no task's Python holds a series whole; run_keyed lets that be. Timers are of event time: with such of processing time
    a run that takes what is there would not end."""
    rows = series.selectExpr("cast(name as string) as name", "cast(seq as long) as seq", "cast(ts as timestamp) as ts", "unix_millis(cast(ts as timestamp)) as at", "cast(value as double) as value")
    rows = rows.where("name is not null and value is not null and at is not null").withWatermark("ts", late).repartition("name").sortWithinPartitions("name", "seq")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's own worker for state has not the driver's path
    return rows.groupBy("name").transformWithStateInPandas(MovingMeter(size, idle_ms), OUT, "append", "eventTime")


def run_keyed(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files: int | None = None, glob: str = "*") -> None:
    """Puts the Parquet files that are new in the folder `source`, of names that `glob` allows, through `step`, which keeps state by key, into `sink`, `files` a
    batch. State outlives the run: the next one, after a failure too, goes on where this one stopped. Rows may be sorted
    within the partitions of a batch, which Spark's check of streams takes for a sort of the whole stream."""
    needed = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.unsupportedOperationCheck": "false"}
    before = {k: spark.conf.get(k) for k in needed}
    for k, v in needed.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
        rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
        step(rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
