"""Keyed state: batches and restarts give what the whole series gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curatrix.operators import relational as rel
from curatrix.streaming import meters


def test_moving_over_batches():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 9, 70).astype(float)
    want = [(np.sort(w)[(len(w) + 1) // 2 - 1], w.mean(), w.max()) for i in range(70) for w in [values[max(0, i - 19) : i + 1]]]
    for cut in (1, 5, 19, 20, 40, 69):
        a, b = meters.moving(values[:cut], cut), meters.moving(values[max(0, cut - 19) :], 70 - cut)
        got = list(zip(*(np.concatenate(x) for x in zip(a, b, strict=True)), strict=True))
        assert np.allclose(got, want)


def test_three_batches_and_a_restart(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), "ts", "value")
    source, sink, mark = (str(tmp_path / x) for x in ("source", "sink", "mark"))
    low, high = (r[0] for r in [events.agg(F.percentile("seq", F.lit(p)).cast("long")).first() for p in (0.3, 0.6)])
    step = lambda d: meters.moving_meters(d, idle_ms=1 << 40, late="36500 days")
    for k, some in enumerate((f"seq <= {low}", f"seq > {low} and seq <= {high}", f"seq > {high}")):
        events.where(some).coalesce(1).write.mode("append").parquet(source)
        if k != 1:  # two batches in the second run, after a restart
            meters.run_keyed(spark, source, events.schema, step, sink, mark, files=1)
    got = {(r.name, r.seq): (r.value, r.median, round(r["mean"], 9), r.most) for r in spark.read.parquet(sink).collect()}
    want = {(r.name, r.seq): (r.value, r.median, round(r["mean"], 9), r.most) for r in rel.moving_meter(events, "name", "seq", "value").collect()}
    assert got == want and spark.read.parquet(sink).where("ended").isEmpty()


def test_a_silent_series_ends(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("source", "sink", "mark"))
    schema = "name string, seq long, ts timestamp, value double"
    for k, names in enumerate((["a", "b"], ["b"], ["a"])):
        rows = spark.createDataFrame([(n, 10 * k + i, 100 * k + i, float(i + k)) for n in names for i in range(4)], "name string, seq long, s long, value double")
        rows.select("name", "seq", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(source)
        meters.run_keyed(spark, source, schema, lambda d: meters.moving_meters(d, 3, idle_ms=50_000, late="1 second"), sink, mark)
    rows = spark.read.parquet(sink)
    assert {(r.name, r.seq): (r.median, r.most) for r in rows.where("ended").collect()}[("a", 3)] == (2.0, 3.0)  # in the second run, in which it has no rows
    again = rows.where("name = 'a' and seq = 20").first()
    assert again["median"] == again["mean"] == again.most == 2.0  # nothing of before


class Handle:
    """What a series keeps, without a stream."""

    state, timers = None, ()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.state is not None

    def get(self):
        return self.state

    def update(self, state):
        self.state = state

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, t):
        self.timers = [t]

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_series_is_never_held_whole():
    meter, handle, taken = meters.MovingMeter(3), Handle(), []
    meter.init(handle)

    def pieces(*starts):
        for k in starts:
            taken.append(k)
            yield pd.DataFrame({"seq": range(k, k + 10), "at": range(k, k + 10), "value": np.arange(k, k + 10.0)})

    out = meter.handleInputRows(("a",), pieces(0, 10, 20), handle)
    first = next(out)
    assert taken == [0] and len(first) == 10
    assert pd.concat([first, *out])["median"].tolist() == [0, 0, *range(1, 29)] and handle.state == (29, 29, [27.0, 28.0, 29.0])
    with pytest.raises(ValueError):
        list(meter.handleInputRows(("a",), pieces(50, 40), handle))


def test_a_long_batch_is_sorted(spark, tmp_path):
    rows = spark.range(24_000).select(F.lit("a").alias("name"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") + 1).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(99)).cast("double").alias("value"))
    source, sink, mark = (str(tmp_path / x) for x in ("source", "sink", "mark"))
    rows.repartition(3, F.xxhash64("seq")).sortWithinPartitions(F.desc("seq")).write.parquet(source)
    meters.run_keyed(spark, source, rows.schema, lambda d: meters.moving_meters(d, idle_ms=1 << 40, late="36500 days"), sink, mark)
    got = spark.read.parquet(sink).select("name", "seq", "value", "median", F.round("mean", 9).alias("mean"), "most")
    want = rel.moving_meter(rows, "name", "seq", "value").select("name", "seq", "value", "median", F.round("mean", 9).alias("mean"), "most")
    assert got.count() == 24_000 and got.exceptAll(want).isEmpty()
    assert spark.conf.get("spark.sql.streaming.unsupportedOperationCheck") == "true"
