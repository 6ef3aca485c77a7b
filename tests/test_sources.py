"""Scans and sinks over small files, and incremental runs."""

import json
import struct

import pytest

from curatrix.operators import relational as rel
from curatrix.sources import cameras, records
from curatrix.streaming import incremental

ROWS = [{"edit": "turn the cat to red", "edited object": "cat", "edit_type": "color_alter", "visual_input": "None"}, {"edit": "add a hat", "edit object": "hat", "edit_type": "add", "input": None}]


@pytest.mark.parametrize("array", [True, False])
def test_records(spark, tmp_path, array):
    path = tmp_path / "r.json"
    path.write_text(("\n " + json.dumps(ROWS)) if array else "\n".join(map(json.dumps, ROWS)))
    got = records.read_records(spark, str(path)).orderBy("edit").collect()
    assert [r.edited_object for r in got] == ["hat", "cat"] and [r.visual_input for r in got] == [None, None] and got[0].new_object is None


def test_captions_and_lists(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"a": {"image_file": "1.jpg", "captions": ["One", "TWO"]}, "b": {"image_file": "2.jpg", "captions": []}}))
    got = {r.key: r.caption for r in records.read_keyed_captions(spark, str(tmp_path / "k.json")).collect()}
    assert got["a"] in ("one", "two") and got["b"] is None
    ocr = {"data_list": [{"img_name": "1", "caption": "c", "annotations": [{"language": "Latin", "text": "x"}, {"language": "Thai", "text": "y"}]}, {"img_name": "2", "caption": "c"}, {"img_name": "3", "caption": "c", "annotations": [{"language": "Thai", "text": "y"}]}]}
    (tmp_path / "o.json").write_text(json.dumps(ocr))
    assert [tuple(r) for r in records.read_ocr_captions(spark, str(tmp_path / "o.json")).collect()] == [("1", "c", "x")]
    (tmp_path / "c.json").write_text(json.dumps({"concepts": ["x", "y", "x"], "backgrounds": ["b"]}))
    concepts, backgrounds = records.read_concept_lists(spark, str(tmp_path / "c.json"))
    assert concepts.count() == 3 and backgrounds.first().background == "b"
    (tmp_path / "m.json").write_text(json.dumps({"x": ["1", "2"], "y": []}))
    assert {r.key: r["values"] for r in records.read_multimap(spark, str(tmp_path / "m.json")).collect()} == {"x": ["1", "2"], "y": []}
    (tmp_path / "t.tsv").write_text("concept,caption\ncat,a, b\ndog\n")
    assert [tuple(r) for r in records.read_split_column(spark, str(tmp_path / "t.tsv")).collect()] == [("cat", "a, b"), ("dog", None)]
    (tmp_path / "l.txt").write_text("a 1\nb 2 3\na 4\n")
    assert [r.item for r in records.read_list(spark, str(tmp_path / "l.txt"), "p/", 1, 1).collect()] == ["p/b 2 3"]
    assert {r.key: r["values"] for r in records.read_dict(spark, str(tmp_path / "l.txt")).collect()} == {"a": ["4"], "b": ["2", "3"]}


def test_listings(spark, tmp_path):
    for name in ("b.jpg", "a.jpg", "c.png"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "a.txt").write_text("first\nsecond")
    assert sorted(r.stem for r in records.list_files(spark, str(tmp_path), "*.jpg").collect()) == ["a", "b"]
    assert [r.caption for r in records.read_sidecars(spark, str(tmp_path), str(tmp_path / "txt")).collect()] == ["first"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "add", "success"), (2, "add", "failure"), (3, "remove", "skipped")], "id int, edit_type string, verdict string")
    records.write_routed(rows, str(tmp_path / "out"))
    assert (tmp_path / "out" / "edit_type=add" / "verdict=success").is_dir()
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    records.write_lines(rows, str(tmp_path / "l"))
    records.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    records.append_new(rows, str(tmp_path / "p"), "id")
    again = rows.union(spark.createDataFrame([(4, "add", "success")], rows.schema))
    done = spark.createDataFrame(spark.read.parquet(str(tmp_path / "p")).collect(), rows.schema)
    assert records.append_new(again, str(tmp_path / "p"), "id", done).count() == 1
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_cameras(spark, tmp_path):
    text = tmp_path / "text"
    text.mkdir()
    (text / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 1.5 2.5 3.5 4.5\n2 SIMPLE_PINHOLE 10 20 1 2 3\n")
    (text / "images.txt").write_text("# i\n7 1 0 0 0 0.5 1 2 1 a.jpg\n1.0 2.0 -1 3.0 4.0 9\n8 0 1 0 0 0 0 0 2 b.jpg\n\n")
    (text / "points3D.txt").write_text("9 1 2 3 10 20 30 0.25 7 1\n10 0 0 0 1 2 3 0.5\n")
    data = tmp_path / "bin"
    data.mkdir()
    (data / "cameras.bin").write_bytes(struct.pack("<Q", 2) + struct.pack("<iiQQ4d", 1, 1, 640, 480, 1.5, 2.5, 3.5, 4.5) + struct.pack("<iiQQ3d", 2, 0, 10, 20, 1, 2, 3))
    image = struct.pack("<i7di", 7, 1, 0, 0, 0, 0.5, 1, 2, 1) + b"a.jpg\0" + struct.pack("<Qddqddq", 2, 1, 2, -1, 3, 4, 9) + struct.pack("<i7di", 8, 0, 1, 0, 0, 0, 0, 0, 2) + b"b.jpg\0" + struct.pack("<Q", 0)
    (data / "images.bin").write_bytes(struct.pack("<Q", 2) + image)
    (data / "points3D.bin").write_bytes(struct.pack("<Q", 2) + struct.pack("<Q3d3BdQ2i", 9, 1, 2, 3, 10, 20, 30, 0.25, 1, 7, 1) + struct.pack("<Q3d3BdQ", 10, 0, 0, 0, 1, 2, 3, 0.5, 0))
    both = [cameras.read_model(spark, str(p), e) for p, e in ((text, ".txt"), (data, ".bin"))]
    for a, b in zip(*both, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 2
    assert [tuple(r) for r in cameras.observations(both[0][1], both[0][2]).collect()] == [(7, 9, 3.0, 4.0)]
    cameras.write_cameras_text(both[1][0], str(tmp_path / "again"))
    assert sorted(map(str, cameras.read_cameras_text(spark, str(tmp_path / "again")).collect())) == sorted(map(str, both[0][0].collect()))
    (tmp_path / "poses.txt").write_text("# p\n1 0.1 0.2 0.3 0.4 1 2 3 5 x.jpg\nshort line\n")
    assert cameras.read_poses(spark, str(tmp_path / "poses.txt")).first().quat == [0.2, 0.3, 0.4, 0.1]


def test_incremental(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source, sink, mark = (str(tmp_path / x) for x in ("source", "sink", "mark"))
    for part in (0, 1):
        events.where(f"event_id % 2 = {part}").coalesce(1).write.mode("append").parquet(source)
        incremental.run_once(spark, source, events.schema, lambda d: d.select("event_id", "user_id"), sink, mark)
    assert spark.read.parquet(sink).count() == events.count()
    for step in (incremental.tumbling, incremental.sessions, lambda d: incremental.first_seen(d, ["user_id"])):
        out = str(tmp_path / f"s{id(step)}")
        incremental.run_once(spark, source, events.schema, step, out, out + "-mark")
        assert spark.read.parquet(out).count() > 0
    assert incremental.tumbling(events).agg({"n": "sum"}).first()[0] == events.count()


def test_positions(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1009 as k", "id")
    got = rel.numbered(rows, ["k", "id"], 10).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1000)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    for ranges in (1, 2, 7, 64):
        some = rel.in_ranges(rows, ["k", "id"], ranges).orderBy("k", "id").collect()
        parts = [r.range for r in some]
        assert parts == sorted(parts) and len(set(parts)) == ranges and max(parts) < ranges
        assert max(map(parts.count, set(parts))) <= max(40, 3 * 1000 / ranges)
    assert rel.numbered(rows.limit(0), ["k", "id"], 10).isEmpty() and rel.numbered(rows.limit(1), ["k", "id"], 10).first().position == 0


def test_windows_over_stretches(spark):
    """A group cut into stretches gives what the whole group gives."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.range(500).selectExpr("if(id < 400, 'hot', concat('k', id % 7)) as name", "id * 7919 % 1009 as seq", "id * 31 % 97 as value")
    w = Window.partitionBy("name").orderBy("seq")
    want = rows.select("name", "seq", F.max("value").over(w.rowsBetween(-19, 0)).alias("most"), F.sum("value").over(w).alias("s"), (F.row_number().over(w) - 1).alias("place"))
    most = {(r.name, r.seq): r.most for r in rel.moving_meter(rows, "name", "seq", "value", stretch=25).collect()}
    for stretch in (25, 1000):
        sums = {(r.name, r.seq): (r.s, r.place) for r in rel.running_sum(rel.placed(rows, ["name"], "seq", stretch), ["name"], F.col("value"), "s").collect()}
        assert all(most[r.name, r.seq] == r.most and sums[r.name, r.seq] == (r.s, r.place) for r in want.collect())


def test_tables_and_datasets(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,n\nx,1\ny,2\n")
    assert [tuple(r) for r in records.read_csv(spark, str(tmp_path / "t.csv"), "a string, n int").collect()] == [("x", 1), ("y", 2)]
    images = tmp_path / "set" / "img"
    (images / "sub").mkdir(parents=True)
    for name in ("a.jpg", "sub/b.jpg", "c.PNG", "d.txt"):
        (images / name).write_bytes(b"x")
    assert sorted(r.name for r in records.list_images(spark, str(images)).collect()) == ["a.jpg", "b.jpg", "c.PNG"]
    rows = spark.createDataFrame([(str(images / "a.jpg"), 1), (str(images / "gone.jpg"), 2)], "file string, k int")
    assert [r.k for r in records.existing(rows, "file", records.list_files(spark, str(images))).collect()] == [1]
    found = {tuple(r) for r in records.read_dataset(spark, str(images), "ann").collect()}
    assert found == {("a.jpg", "a.png"), ("sub/b.jpg", "sub/b.png")}
    (tmp_path / "split.txt").write_text("a\n\nzz \n")
    assert {tuple(r) for r in records.read_dataset(spark, str(images), split=str(tmp_path / "split.txt")).collect()} == {("a.jpg", None), ("zz.jpg", None)}


def test_models_are_written_and_told_apart(spark, tmp_path):
    cams = spark.createDataFrame([(1, "PINHOLE", 640, 480, [1.5, 2.5, 3.5, 4.5]), (2, "SIMPLE_PINHOLE", 10, 20, [1.0, 2.0, 3.0])], cameras.CAMERA)
    images = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0], [0.5, 1.0, 2.0], 1, "a.jpg", [(1.0, 2.0), (3.0, 4.0)], [-1, 9]), (8, [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0], 2, "b.jpg", [], [])], cameras.IMAGE)
    points = spark.createDataFrame([(9, [1.0, 2.0, 3.0], [10, 20, 30], 0.25, [7], [1]), (10, [0.0, 0.0, 0.0], [1, 2, 3], 0.5, [], [])], cameras.POINT)
    both = str(tmp_path / "both")
    cameras.write_model_text(cams, images, points, both)
    assert cameras.model_format(spark, both) == ".txt"
    assert "mean observations per image: 1.0" in "".join(r.value for r in spark.read.text(f"{both}/images.txt").collect())
    cameras.write_model_binary(cams, images, points, both)
    assert cameras.model_format(spark, both) == ".bin"
    for ext in ("", ".txt", ".bin"):
        for got, want in zip(cameras.read_model(spark, both, ext), (cams, images, points), strict=True):
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    (tmp_path / "part").mkdir()
    (tmp_path / "part" / "cameras.bin").write_bytes(b"")
    with pytest.raises(FileNotFoundError):
        cameras.read_model(spark, str(tmp_path / "part"))


def test_routed_by_selection_and_masks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "add", True), (2, "add", None), (3, "remove", False)], "id int, edit_type string, selected boolean")
    records.write_selected(rows, str(tmp_path / "out"))
    assert {(r.id, r.verdict) for r in spark.read.json(str(tmp_path / "out")).collect()} == {(1, "selected"), (2, "failed"), (3, "failed")}
    masks = spark.createDataFrame([("i", 0, 5, [1, 2, 3, 4], [0.5, 0.5], 0.9, 0.95, [0, 0, 8, 8], 8, 8, [59, 5])], "image string, id int, area int, bbox array<int>, point array<double>, predicted_iou double, stability_score double, crop_box array<int>, h int, w int, counts array<int>")
    records.write_mask_metadata(masks, str(tmp_path / "meta"))
    head = next((tmp_path / "meta" / "image=i").glob("*.csv")).read_text().split("\n")[0]
    assert head.split(",") == records.MASK_COLUMNS
    records.write_mask_runs(masks, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).first().segmentation.counts == [59, 5]
