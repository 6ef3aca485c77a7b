"""Camera models: cameras, posed images and points, as text or binary files. Binary ones are read and written by
record_files, in ranges of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.sources.chunks import line_pairs
from curatrix.sources.record_files import CAMERA, IMAGE, POINT, read_records, write_records  # noqa: F401  the schemas are for callers


def _words(lines: DataFrame) -> DataFrame:
    line = F.trim("value")
    return lines.where((line != "") & ~line.startswith("#")).select(F.split(line, r"\s+").alias("w"))


def cameras_of(lines: DataFrame) -> DataFrame:
    """Cameras from text lines (value): number, model, width, height, parameters."""
    w = F.col("w")
    return _words(lines).select(w[0].cast("int").alias("camera_id"), w[1].alias("model"), w[2].cast("long").alias("width"), w[3].cast("long").alias("height"), F.slice(w, F.lit(5), F.size(w) - 4).cast("array<double>").alias("params"))


def points_of(lines: DataFrame) -> DataFrame:
    """Points from text lines (value): number, place, colour, error, then pairs of image and position."""
    w = F.col("w")
    track = F.slice(w, F.lit(9), F.size(w) - 8)
    every = lambda at: F.filter(track, lambda x, i: i % 2 == at).cast("array<int>")
    return _words(lines).select(w[0].cast("long").alias("point_id"), F.slice(w, 2, 3).cast("array<double>").alias("xyz"), F.slice(w, 5, 3).cast("array<int>").alias("rgb"), w[7].cast("double").alias("error"), every(0).alias("image_ids"), every(1).alias("point2d_idxs"))


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    return images_of(line_pairs(spark, path, F.startswith("value", F.lit("#"))))


def images_of(pairs: DataFrame) -> DataFrame:
    """Images from texts of two lines: the pose and name, then x, y and point of what it sees. A blank first line is no
    record."""
    both = F.split("text", "\n", 2)
    pairs = pairs.select(F.struct(both[0].alias("head"), F.coalesce(F.get(both, F.lit(1)), F.lit("")).alias("rest")).alias("p")).where(F.trim("p.head") != "")
    h = F.split(F.trim("p.head"), r"\s+")
    r = F.filter(F.split(F.trim("p.rest"), r"\s+"), lambda x: x != "")
    every = lambda at: F.filter(r, lambda x, i: i % 3 == at)
    xys = F.zip_with(every(0), every(1), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return pairs.select(h[0].cast("int").alias("image_id"), F.slice(h, 2, 4).cast("array<double>").alias("qvec"), F.slice(h, 6, 3).cast("array<double>").alias("tvec"), h[8].cast("int").alias("camera_id"), h[9].alias("name"), xys.alias("xys"), every(2).cast("array<long>").alias("point3d_ids"))


def poses_of(lines: DataFrame) -> DataFrame:
    """(image_id, quat, tvec, camera_id, name) of the lines of ten words; the quaternion as x, y, z, w."""
    w = F.col("w")
    rows = _words(lines).where(F.size("w") == 10)
    return rows.select(w[0].cast("int").alias("image_id"), F.array(w[2], w[3], w[4], w[1]).cast("array<double>").alias("quat"), F.slice(w, 6, 3).cast("array<double>").alias("tvec"), w[8].cast("int").alias("camera_id"), w[9].alias("name"))


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    return cameras_of(spark.read.text(path))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    return points_of(spark.read.text(path))


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    return poses_of(spark.read.text(path))


def read_cameras_binary(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, "cameras")


def read_images_binary(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, "images")


def read_points_binary(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, "points3D")


FILES = ("cameras", "images", "points3D")


def model_format(spark: SparkSession, path: str) -> str | None:
    """.bin or .txt, whichever the folder has all three files of, .bin first; None if neither."""
    name = F.regexp_extract("path", r"/((?:cameras|images|points3D)\.(?:bin|txt))(?:/|$)", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(name.alias("name")).where("name <> ''")
    names = {r["name"] for r in files.distinct().collect()}  # six at most
    return next((ext for ext in (".bin", ".txt") if all(f + ext in names for f in FILES)), None)


def read_model(spark: SparkSession, path: str, ext: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cameras, images and points of the model in folder `path`; ext is .bin, .txt or, by what is there, empty."""
    ext = ext or model_format(spark, path)
    if ext is None:
        raise FileNotFoundError(f"{path} has no whole model, as .bin or .txt")
    kinds = (read_cameras_binary, read_images_binary, read_points_binary) if ext == ".bin" else (read_cameras_text, read_images_text, read_points_text)
    return tuple(f(spark, f"{path}/{name}{ext}") for f, name in zip(kinds, FILES, strict=True))


def camera_lines(cameras: DataFrame) -> DataFrame:
    return cameras.select(F.concat_ws(" ", F.col("camera_id").cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"), F.col("params").cast("array<string>")).alias("value"))


def _numbers(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), " ")


def image_line() -> Column:
    """Two lines of an image, in one value: the pose and name, then x, y and point of what it sees."""
    head = F.concat_ws(" ", F.col("image_id").cast("string"), _numbers("qvec"), _numbers("tvec"), F.col("camera_id").cast("string"), "name")
    seen = F.zip_with("xys", "point3d_ids", lambda p, i: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), i.cast("string")))
    return F.concat(head, F.lit("\n"), F.array_join(seen, " "))


def image_lines(images: DataFrame) -> DataFrame:
    return images.select(image_line().alias("value"))


def point_lines(points: DataFrame) -> DataFrame:
    track = F.zip_with("image_ids", "point2d_idxs", lambda i, k: F.concat_ws(" ", i.cast("string"), k.cast("string")))
    return points.select(F.concat_ws(" ", F.col("point_id").cast("string"), _numbers("xyz"), _numbers("rgb"), F.col("error").cast("string"), F.array_join(track, " ")).alias("value"))


def mean_size(rows: DataFrame, column: str) -> Column:
    """How long the arrays of a column are on average, 0 without rows: an aggregate."""
    return F.coalesce(F.avg(F.size(column)), F.lit(0.0))


def _headed(lines: DataFrame, header: DataFrame, path: str) -> None:
    """A model is small: its lines are one file, behind comments that tell how many there are."""
    order = header.select(F.lit(0).alias("part"), "value").union(lines.select(F.lit(1), "value"))
    order.coalesce(1).sortWithinPartitions("part").select("value").write.text(path)


def write_model_text(cameras: DataFrame, images: DataFrame, points: DataFrame, path: str) -> None:
    """The model as text in folder `path`, with the comments that tell numbers and means."""
    n = F.count("*").cast("string")
    _headed(camera_lines(cameras), cameras.agg(F.concat(F.lit("# Number of cameras: "), n).alias("value")), f"{path}/cameras.txt")
    seen = mean_size(images, "point3d_ids").cast("string")
    _headed(image_lines(images), images.agg(F.concat(F.lit("# Number of images: "), n, F.lit(", mean observations per image: "), seen).alias("value")), f"{path}/images.txt")
    track = mean_size(points, "image_ids").cast("string")
    _headed(point_lines(points), points.agg(F.concat(F.lit("# Number of points: "), n, F.lit(", mean track length: "), track).alias("value")), f"{path}/points3D.txt")


def write_cameras_text(cameras: DataFrame, path: str) -> None:
    """One line a camera, as read_cameras_text takes them."""
    camera_lines(cameras).write.text(path)


def write_model_binary(cameras: DataFrame, images: DataFrame, points: DataFrame, path: str) -> None:
    """The model as binary files in folder `path`: each a folder of files of whole records."""
    for rows, kind in zip((cameras, images, points), FILES, strict=True):
        write_records(rows, f"{path}/{kind}.bin", kind)


def observations(images: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, point_id, x, y) of the points that are seen; -1 stands for none."""
    seen = images.select("image_id", F.explode(F.arrays_zip("xys", "point3d_ids")).alias("o")).select("image_id", F.col("o.point3d_ids").alias("point_id"), "o.xys.x", "o.xys.y")
    return seen.where("point_id <> -1").join(points.select("point_id"), "point_id", "left_semi").select("image_id", "point_id", "x", "y")
