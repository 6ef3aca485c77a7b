"""Scans and sinks of instruction records, captions, concepts and listings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.sampling import pick
from curatrix.sources.chunks import numbered_lines, read_json
from curatrix.sources.record_files import file_system

#: The superset of the fields that producers write; a field that a row lacks reads as null.
RECORD = (
    "edit string, `edited object` string, `edit object` string, `new object` string, `new background` string, `new state` string, input string, output string, edit_type string, "
    "visual_input string, image_file string, edited_file string, foreground array<string>, original_background string, remove_number int, `target object` string, direction string, ref_object string, "
    "material string, edited_path string"
)


# How the names of images end.
IMAGE_ENDS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff"]
# End of fixed values.
# Columns of the metadata of masks.
MASK_COLUMNS = ["id", "area", "bbox_x0", "bbox_y0", "bbox_w", "bbox_h", "point_input_x", "point_input_y", "predicted_iou", "stability_score", "crop_box_x0", "crop_box_y0", "crop_box_w", "crop_box_h"]
# End of fixed values.


def parsed(texts: DataFrame, schema: str) -> DataFrame:
    """The records in texts (value), each a JSON array of them or one alone. What is neither gives
    no record."""
    many = F.when(F.json_array_length("value").isNotNull(), F.from_json("value", f"array<struct<{schema}>>"))
    many = many.when(F.json_object_keys("value").isNotNull(), F.array(F.from_json("value", f"struct<{schema}>")))
    return texts.select(F.explode(many).alias("r")).where("r is not null").select("r.*")


def read_records(spark: SparkSession, path: str, array: bool | None = None) -> DataFrame:
    """Instruction records with names in snake case. The two names of the edited object are one column, and the text
    "None" in visual_input is null."""
    return named_records(read_json(spark, path, RECORD, array))


def named_records(rows: DataFrame) -> DataFrame:
    """Records as they are written, under the names of read_records()."""
    named = [F.coalesce("edited object", "edit object").alias("edited_object") if c == "edited object" else F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in rows.columns if c != "edit object"]
    return rows.select(*named).withColumn("visual_input", F.when(F.col("visual_input") != "None", F.col("visual_input")))


def read_csv(spark: SparkSession, path: str, schema: str, delimiter: str = ",") -> DataFrame:
    """Delimited text with a header line; rows that don't fit the schema are errors."""
    return spark.read.schema(schema).option("header", True).option("delimiter", delimiter).option("mode", "FAILFAST").csv(path)


def read_keyed_captions(spark: SparkSession, path: str, seed: str = "caption") -> DataFrame:
    """(key, image_file, caption) from one object of key to {image_file, captions}: one caption each, by draw, in
    lower case."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<image_file: string, captions: array<string>>>")).alias("key", "v"))
    return rows.select("key", "v.image_file", F.lower(pick(F.col("v.captions"), F.col("key"), seed)).alias("caption"))


def read_ocr_captions(spark: SparkSession, path: str) -> DataFrame:
    """(image_file, caption, text) of the rows whose first annotation is in Latin script."""
    schema = "data_list array<struct<img_name: string, caption: string, annotations: array<struct<language: string, text: string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data_list").alias("d"))
    first = F.get("d.annotations", F.lit(0))
    return rows.where(first["language"] == "Latin").select(F.col("d.img_name").alias("image_file"), "d.caption", first["text"].alias("text"))


def read_concept_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(concept, pos) and (background, pos), in the order of the file."""
    rows = spark.read.schema("concepts array<string>, backgrounds array<string>").option("multiLine", True).json(path)
    return tuple(rows.select(F.posexplode(many).alias("pos", one)).select(one, "pos") for many, one in (("concepts", "concept"), ("backgrounds", "background")))


def read_multimap(spark: SparkSession, path: str) -> DataFrame:
    """(key, values) of one object of key to list."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("key", "values"))


def read_split_column(spark: SparkSession, path: str) -> DataFrame:
    """(concept, caption) of a tab-delimited file whose one column holds both, split at its first comma."""
    line = spark.read.option("delimiter", "\t").option("header", True).option("quote", "").csv(path)
    both = F.split(F.col(f"`{line.columns[0]}`"), ",", 2)
    return line.select(both[0].alias("concept"), F.get(both, F.lit(1)).alias("caption"))


def read_list(spark: SparkSession, path: str, prefix: str = "", offset: int = 0, most: int | None = None) -> DataFrame:
    """(pos, item) of text files of one item a line, from line `offset` of each on, and at most so many."""
    rows = numbered_lines(spark, path).where(F.col("pos") >= offset)
    rows = rows if most is None else rows.where(F.col("pos") < offset + most)
    return rows.select("pos", F.concat(F.lit(prefix), "line").alias("item"))


def read_dict(spark: SparkSession, path: str) -> DataFrame:
    """dict_of() the lines of a text file."""
    return dict_of(read_list(spark, path))


def dict_of(lines: DataFrame) -> DataFrame:
    """(key, value, values) of lines (pos, item) "key value ..."; the last line of a key counts. value is that of a line
    with one; values are those of every line."""
    words = lines.select("pos", F.split("item", " ").alias("w"))
    rest = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    last = words.groupBy(F.col("w")[0].alias("key")).agg(F.max_by(rest, "pos").alias("values"))
    return last.select("key", F.when(F.size("values") == 1, F.get("values", F.lit(0))).alias("value"), "values")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, stem) of the files under `path`; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """list_files() of which the name ends as an image's does, in whatever case."""
    return list_files(spark, path).where(F.lower(F.regexp_extract("name", r"\.[^.]*$", 0)).isin(IMAGE_ENDS))


def plain_path(path: Column) -> Column:
    """A path without the scheme of the local file system."""
    return F.regexp_replace(path, "^file:/*", "/")


def existing(rows: DataFrame, column: str, files: DataFrame) -> DataFrame:
    """The rows whose path in `column` is one of `files` (path)."""
    there = files.select(plain_path(F.col("path")).alias("there")).distinct()
    return rows.join(there, plain_path(F.col(column)) == F.col("there"), "left_semi")


def read_dataset(spark: SparkSession, images: str, annotations: str | None = None, split: str | None = None, image_end: str = ".jpg", annotation_end: str = ".png") -> DataFrame:
    """(filename, seg_map) of a dataset of images: those that the lines of `split` name, or all files under `images`
    that end in image_end, by their path from there. seg_map: the annotation of the same name, null without a folder
    of such."""
    if split is not None:
        stem = spark.read.text(split).select(F.trim("value").alias("stem")).where("stem <> ''")
    else:
        folder = images.rstrip("/").rsplit("/", 1)[-1]  # file names come with a scheme, and whole
        inner = F.element_at(F.split("path", f"/{re.escape(folder)}/", 2), -1)
        stem = list_files(spark, images, f"*{image_end}").select(F.left(inner, F.length(inner) - len(image_end)).alias("stem"))
    seg_map = F.lit(None).cast("string") if annotations is None else F.concat("stem", F.lit(annotation_end))
    return stem.select(F.concat("stem", F.lit(image_end)).alias("filename"), seg_map.alias("seg_map"))


def read_sidecars(spark: SparkSession, images: str, texts: str) -> DataFrame:
    """(path, caption): each image with the first line of the text file of the same stem, not of the same position."""
    lines = spark.read.text(texts, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split_part("value", F.lit("\n"), F.lit(1)).alias("caption"))
    lines = lines.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), "caption")
    return list_files(spark, images, "*.jpg").join(lines, "stem").select("path", "caption")


def frame_positions(n: Column, k: int) -> Column:
    """k whole positions from 0 to n - 2, evenly spaced; of fewer than k frames all, after -1 for each that is missing;
    of one frame or none only such."""
    n = n.cast("long")
    even = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 2) / max(1, k - 1)))
    none = lambda m: F.array_repeat(F.lit(-1).cast("long"), m.cast("int"))
    return F.when(n <= 1, none(F.lit(k))).when(n < k, F.concat(none(k - n), F.sequence(F.lit(0).cast("long"), n - 1))).otherwise(even)


# --------------------------------------------------------------------------- sinks


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_routed(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per edit type and verdict; rows without a verdict would be lost, so there must be none."""
    checked = rows.withColumn("verdict", F.when(F.col("verdict").isNull(), F.raise_error(F.lit("a row has no verdict"))).otherwise(F.col("verdict")))
    checked.write.mode(mode).partitionBy("edit_type", "verdict").json(path)


def output_paths(root: Column, edit_type: Column, name: Column) -> Column:
    """Where the pictures of an edit go: a struct (input_img, edited_img, mask) of paths under root and type."""
    return F.struct(*[F.concat_ws("/", root, edit_type, F.lit(kind), name).alias(kind) for kind in ("input_img", "edited_img", "mask")])


def write_selected(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per edit type for the rows that are selected, one for those that are not; a null is not."""
    verdict = F.when(F.coalesce("selected", F.lit(False)), "selected").otherwise("failed")
    rows.withColumn("verdict", verdict).drop("selected").write.mode(mode).partitionBy("edit_type", "verdict").json(path)


def mask_metadata(masks: DataFrame) -> DataFrame:
    """(image, and MASK_COLUMNS) of masks (image, id, area, bbox, point, predicted_iou, stability_score, crop_box): boxes
    are arrays x, y, width, height."""
    flat = [F.col(c) for c in ("id", "area")] + [F.col("bbox")[i] for i in range(4)] + [F.col("point")[i] for i in range(2)] + [F.col("predicted_iou"), F.col("stability_score")] + [F.col("crop_box")[i] for i in range(4)]
    return masks.select("image", *[c.alias(n) for c, n in zip(flat, MASK_COLUMNS, strict=True)])


def write_mask_metadata(masks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """mask_metadata() as CSV with a header, one folder per image."""
    mask_metadata(masks).write.mode(mode).partitionBy("image").option("header", True).csv(path)


def write_mask_runs(masks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Masks (image, id, h, w, counts) with their run lengths as JSON lines, one folder per image."""
    size = F.struct(F.array("h", "w").alias("size"), "counts")
    masks.select("image", "id", size.alias("segmentation")).write.mode(mode).partitionBy("image").json(path)


def write_named(files: DataFrame, path: str) -> int:
    """Each row of files (name, text) as a file of that name in the folder `path`; how many there are. A task that runs
    again writes the same."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        for x in batches:
            for name, text in zip(x.column("name").to_pylist(), x.column("text").to_pylist(), strict=True):
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write((text or "").encode())
            yield x.select(["name"])

    return files.select("name", "text").mapInArrow(put, "name string").count()


def write_csv(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def append_new(rows: DataFrame, path: str, key: str, done: DataFrame | None = None) -> DataFrame:
    """Appends the rows whose key isn't in `done` (or in `path`, if that is a table already) and returns them: a job
    that stopped half-way can simply run again."""
    from curatrix.operators.relational import unfinished

    rest = rows if done is None else unfinished(rows, done, key)
    rest.write.mode("append").parquet(path)
    return rest
