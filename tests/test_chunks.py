"""Records that span lines, in splits of any size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from curatrix.sources import cameras, chunks, records

SCHEMA = "k int, s string, n struct<a: array<struct<x: int>>, t: string>"


def objects(n, seed):
    rng = random.Random(seed)
    odd = ['}', '{', '"', "\\", "[", "]", "a", "é", "\n", '\\"', "}{", "\\\\", " ", ","]
    text = lambda: "".join(rng.choices(odd, k=rng.randint(0, 12)))
    return [{"k": k, "s": text(), "n": {"a": [{"x": i} for i in range(rng.randint(0, 3))], "t": text()}} for k in range(n)]


@pytest.fixture
def splits(spark):
    """Sets the size of splits, and takes it back."""
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def listed(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("indent", [None, 2])
def test_an_array_in_splits_is_what_it_is_whole(spark, tmp_path, splits, indent):
    path = str(tmp_path / "a.json")
    for n, size in ((0, 10), (1, 7), (20, 61), (40, 200), (40, 1 << 20)):
        (tmp_path / "a.json").write_text("\n " + json.dumps(objects(n, n + size), indent=indent, ensure_ascii=False) + "\n")
        splits(size)
        whole = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
        got = records.read_json(spark, path, SCHEMA)
        assert listed(got) == listed(whole) and got.count() == n
        if (n, size) == (40, 200):
            assert chunks.pieces(spark, path, "}").select("block").distinct().count() > 10


def test_a_record_longer_than_many_splits(spark, tmp_path, splits):
    long = [{"k": 1, "s": "x" * 3000 + "}" * 50}, {"k": 2, "s": "{" * 2000, "n": {"a": [{"x": i} for i in range(300)], "t": "\\" * 99}}, {"k": 3}]
    (tmp_path / "a.json").write_text(json.dumps(long))
    splits(150)
    assert listed(records.read_json(spark, str(tmp_path / "a.json"), SCHEMA)) == listed(spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path / "a.json")))


def test_each_file_is_told_for_itself(spark, tmp_path, splits):
    rows = objects(30, 1)
    (tmp_path / "a.json").write_text(json.dumps(rows[:10], indent=1))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, rows[10:20])))
    (tmp_path / "c.json").write_text(" \n\t" + json.dumps(rows[20:]))
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text("no record\nat all\n")
    (tmp_path / "f.json").write_text('[{"k": 100}, {"k": , "s": 3}, 7, null, {"k": 101}]')
    splits(300)
    got = records.read_json(spark, str(tmp_path), SCHEMA, mode="DROPMALFORMED")
    assert sorted(r.k for r in got.collect()) == [*range(30), 100, 101]
    lenient = records.read_json(spark, str(tmp_path), SCHEMA)
    assert lenient.where("k is not null").count() == 32 and lenient.where("k is null").count() == 3  # two lines and an object
    assert records.read_json(spark, str(tmp_path / "a.json"), SCHEMA, array=True).count() == 10
    assert records.read_json(spark, str(tmp_path / "b.json"), SCHEMA, array=False).count() == 10


def test_truncated_arrays_do_not_fail(spark, tmp_path, splits):
    whole = json.dumps(objects(12, 3))
    splits(50)
    for cut in range(0, len(whole), 397):
        (tmp_path / "a.json").write_text(whole[:cut])
        spark.catalog.clearCache()
        assert records.read_json(spark, str(tmp_path / "a.json"), SCHEMA).count() <= 13


def test_two_line_records_in_splits(spark, tmp_path, splits):
    def image(k):
        head = f"{k} 1 0 0 0 0.5 {k} 2 {k % 3} img{k}.jpg"
        return head + "\n" + " ".join(f"{i}.5 {k}.0 {i - 1}" for i in range(k % 4))

    text = "# a comment\n" + "\n".join(image(k) + ("\n# between" if k % 5 == 0 else "") for k in range(60)) + "\n"
    (tmp_path / "images.txt").write_text(text)
    (tmp_path / "crlf.txt").write_text(text.replace("\n", "\r\n"))
    want = None
    for size in (90, 700):
        splits(size)
        for name in ("images.txt", "crlf.txt"):
            got = cameras.read_images_text(spark, str(tmp_path / name)).collect()
            want = want or sorted(map(str, got))
            assert sorted(map(str, got)) == want and len(got) == 60
    assert {r.image_id: len(r.xys) for r in got} == {k: k % 4 for k in range(60)}
    splits(30)
    assert chunks.line_pairs(spark, str(tmp_path / "images.txt"), F.startswith("value", F.lit("#"))).count() >= 60


def test_lines_are_numbered_across_splits(spark, tmp_path, splits):
    for name, n in (("a.txt", 50), ("b.txt", 3)):
        (tmp_path / name).write_bytes("".join(f"{name} é{i}" + "\r\n" * (i % 3) + "\n" for i in range(n)).encode())
    splits(60)
    got = {(r.file.rsplit("/", 1)[1], r.pos): r.line for r in chunks.numbered_lines(spark, str(tmp_path)).collect()}
    want = {(name, k): line for name in ("a.txt", "b.txt") for k, line in enumerate((tmp_path / name).read_bytes().decode().replace("\r\n", "\n").split("\n")[:-1])}
    assert got == want
    assert [r.item for r in records.read_list(spark, str(tmp_path / "b.txt"), "p/", 1, 2).orderBy("pos").collect()] == ["p/" + want["b.txt", 1], "p/" + want["b.txt", 2]]
