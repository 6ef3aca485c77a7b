"""Binary record files: ranges, columns, commits and aborts."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from curatrix.sources import record_files as rf

N = 500


def frame(spark, kind):
    rows = spark.range(N).withColumn("n", (F.col("id") % 7).cast("int"))
    track = F.expr("transform(sequence(1, n + 1), i -> cast(i * id as int))")
    if kind == "cameras":
        return rows.select(F.col("id").cast("int").alias("camera_id"), F.when(F.col("n") > 3, "OPENCV").otherwise("FOV").alias("model"), F.lit(640).cast("long").alias("width"), (F.col("id") * 2).alias("height"), F.expr("transform(sequence(1, if(n > 3, 8, 5)), i -> i * 0.5D)").alias("params"))
    if kind == "images":
        pose = lambda k: F.array(*[(F.col("id") + i) * 0.25 for i in range(k)])
        xys = F.expr("filter(transform(sequence(1, n + 1), i -> named_struct('x', i * 1D, 'y', id * 1D)), p -> p.x <= n)")
        return rows.select(F.col("id").cast("int").alias("image_id"), pose(4).alias("qvec"), pose(3).alias("tvec"), F.lit(1).alias("camera_id"), F.concat(F.repeat(F.lit("é"), F.col("n") * 40), F.lit(".jpg")).alias("name"), xys.alias("xys"), F.expr("filter(sequence(1L, n + 1L), i -> i <= n)").alias("point3d_ids"))
    return rows.select(F.col("id").alias("point_id"), F.expr("array(id * 1D, 2D, 3D)").alias("xyz"), F.expr("array(n, 20, 255)").alias("rgb"), F.lit(0.5).alias("error"), track.alias("image_ids"), track.alias("point2d_idxs"))


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("kind", list(rf.KINDS))
def test_round_trip_in_ranges(spark, tmp_path, kind):
    rows, path = frame(spark, kind), str(tmp_path / "out")
    rf.write_records(rows.coalesce(1), path, kind)
    (name,) = os.listdir(path)
    for limit in (1, 2000, 1 << 30):
        ranges = list(rf.ranges_of(f"{path}/{name}", kind, limit))
        size = os.path.getsize(f"{path}/{name}")
        assert [r.start for r in ranges] == [8, *[r.end for r in ranges[:-1]]] and ranges[-1].end == size
        assert len(ranges) == (N if limit == 1 else 1 if limit > size else len(ranges))
    got = rf.read_records(spark, path, kind, range_bytes=2000)
    assert same(got, rows) and got.rdd.getNumPartitions() > 5  # one file, many tasks
    first = rows.columns[0]
    few = rf.read_records(spark, path, kind, [rows.columns[-1], first])
    assert few.columns == [rows.columns[-1], first] and same(few, rows.select(few.columns))
    assert same(spark.read.format(rf.FORMAT).option("kind", kind).load(path), rows)


def test_columns_that_are_not_asked_for_are_not_parsed(monkeypatch):
    data = rf._camera_bytes({"camera_id": 1, "model": "FOV", "width": 2, "height": 3, "params": [1.0] * 5})
    end, fields = rf._camera(data, 0)
    assert end == len(data)
    monkeypatch.setattr(rf.np, "frombuffer", None)
    assert [fields[c]() for c in ("camera_id", "model", "width", "height")] == [1, "FOV", 2, 3]


def test_modes(spark, tmp_path):
    rows, path = frame(spark, "cameras"), str(tmp_path / "out")
    rf.write_records(rows.repartition(3), path, "cameras")
    with pytest.raises(FileExistsError):
        rf.write_records(rows, path, "cameras")
    rf.write_records(rows.limit(5), path, "cameras", "append")
    assert rf.read_records(spark, path, "cameras").count() == N + 5
    rf.write_records(rows.limit(7), path, "cameras", "overwrite")
    assert rf.read_records(spark, path, "cameras").count() == 7
    rf.write_records(rows.limit(0), path, "cameras", "overwrite")
    assert rf.read_records(spark, path, "cameras").count() == 0
    assert [os.path.getsize(f"{path}/{f}") for f in os.listdir(path)] == [8]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = frame(spark, "cameras").repartition(4).withColumn("model", F.when(F.col("camera_id") == 77, "NO_SUCH").otherwise(F.col("model")))
    with pytest.raises(Exception, match="NO_SUCH"):
        rf.write_records(bad, path, "cameras")
    assert not os.path.exists(path) or os.listdir(path) == []
    rf.write_records(frame(spark, "cameras"), path, "cameras", "append")
    assert rf.read_records(spark, path, "cameras").count() == N


def test_broken_files(spark, tmp_path):
    good = struct.pack("<Q", 2) + b"".join(rf._camera_bytes({"camera_id": k, "model": "FOV", "width": 2, "height": 3, "params": [1.0] * 5}) for k in range(2))
    (tmp_path / "a.bin").write_bytes(good[:-1])
    for cut in (good[:-1], good[:-50], good[:20], good[:5]):
        (tmp_path / "a.bin").write_bytes(cut)
        with pytest.raises(ValueError, match="ends"):
            list(rf.ranges_of(str(tmp_path / "a.bin"), "cameras"))
    (tmp_path / "a.bin").write_bytes(good + b"\n")  # what stands behind the last record is not read
    assert rf.read_records(spark, f"file://{tmp_path}/a.bin", "cameras").count() == 2


def test_ranges_share_tasks():
    ranges = [rf.Range("f", 10 * i, 10 * i + 10) for i in range(5000)]
    packs = rf.packed(ranges, 64)
    assert len(packs) == 64 and [r for p in packs for r in p.ranges] == ranges
    assert max(len(p.ranges) for p in packs) <= 80
    assert [p.ranges for p in rf.packed(ranges[:64], 64)] == [[r] for r in ranges[:64]] and rf.packed([], 64) == []
