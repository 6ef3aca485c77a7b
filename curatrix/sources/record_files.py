"""Binary files of cameras, images and points as a data source of their own, "camera_records".

A file is a count and then that many records of various lengths, so where records start is known only to who has walked
over those before. A first job does that, a task per file: it reads the heads of records, skips their bodies and notes a
range about every RANGE_BYTES. The reader has a partition per range, so a large file is read by many tasks, and parses
only the columns of the schema that it is given. The writer's tasks each put a file under a temporary name; the commit
moves those of the attempts that count and removes all else, so no failed task leaves a file behind.
"""

from __future__ import annotations

import contextlib
import itertools
import re
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from curatrix.sources.shared import shared_path

# Model number, name and number of parameters, as the binary format numbers them.
MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8), 6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12)}
# End of fixed values.

CAMERA = "camera_id int, model string, width long, height long, params array<double>"
IMAGE = "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, xys array<struct<x: double, y: double>>, point3d_ids array<long>"
POINT = "point_id long, xyz array<double>, rgb array<int>, error double, image_ids array<int>, point2d_idxs array<int>"
SCHEMAS = {"cameras": CAMERA, "images": IMAGE, "points3D": POINT}

FORMAT = "camera_records"
RANGE_BYTES = 16 << 20
HEAD = 8  # bytes of the count
ROWS = 4096
MOST_TASKS = 1024
CHUNK = 1 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Of a path as Spark writes it: the file system, and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)


# --------------------------------------------------------------------------- records


class _Bytes:
    """A file read forward in chunks: memory is that of a chunk, or of one piece asked for."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.base, self.data = file, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.base <= at and at + n <= self.base + len(self.data)):
            self.base, self.data = at, self.file.read_at(max(n, CHUNK), at)
        got = self.data[at - self.base : at - self.base + n]
        if len(got) < n:
            raise ValueError(f"the file ends within the record at byte {at}")
        return got

    def zero(self, at: int) -> int:
        """Where the next zero byte is."""
        while True:
            n = max(1, min(256, self.base + len(self.data) - at)) if self.base <= at else 1
            end = self.get(at, n).find(b"\0")
            if end >= 0:
                return at + end
            at += n


def _camera_end(b: _Bytes, at: int) -> int:
    return at + 24 + 8 * MODELS[struct.unpack("<i", b.get(at + 4, 4))[0]][1]


def _image_end(b: _Bytes, at: int) -> int:
    name = b.zero(at + 64)
    return name + 9 + 24 * struct.unpack("<Q", b.get(name + 1, 8))[0]


def _point_end(b: _Bytes, at: int) -> int:
    return at + 51 + 8 * struct.unpack("<Q", b.get(at + 43, 8))[0]


Read = Callable[[], object]


def _camera(data: bytes, at: int) -> tuple[int, dict[str, Read]]:
    number, model, width, height = struct.unpack_from("<iiQQ", data, at)
    name, n = MODELS[model]
    return at + 24 + 8 * n, {"camera_id": lambda: number, "model": lambda: name, "width": lambda: width, "height": lambda: height, "params": lambda: np.frombuffer(data, "<f8", n, at + 24).tolist()}


def _image(data: bytes, at: int) -> tuple[int, dict[str, Read]]:
    number, *pose, camera = struct.unpack_from("<i7di", data, at)
    end = data.index(b"\0", at + 64)
    (n,) = struct.unpack_from("<Q", data, end + 1)
    seen = lambda: np.frombuffer(data, [("x", "<f8"), ("y", "<f8"), ("i", "<i8")], n, end + 9)
    return end + 9 + 24 * n, {
        "image_id": lambda: number, "qvec": lambda: pose[:4], "tvec": lambda: pose[4:], "camera_id": lambda: camera, "name": lambda: data[at + 64 : end].decode(),
        "xys": lambda: [{"x": x, "y": y} for x, y in seen()[["x", "y"]].tolist()], "point3d_ids": lambda: seen()["i"].tolist(),
    }


def _point(data: bytes, at: int) -> tuple[int, dict[str, Read]]:
    number, x, y, z, r, g, b, error, n = struct.unpack_from("<Q3d3BdQ", data, at)
    track = lambda k: np.frombuffer(data, "<i4", 2 * n, at + 51)[k::2].tolist()
    return at + 51 + 8 * n, {"point_id": lambda: number, "xyz": lambda: [x, y, z], "rgb": lambda: [r, g, b], "error": lambda: error, "image_ids": lambda: track(0), "point2d_idxs": lambda: track(1)}


_NUMBER_OF = {name: (number, n) for number, (name, n) in MODELS.items()}


def _camera_bytes(r: dict) -> bytes:
    number, n = _NUMBER_OF[r["model"]]
    return struct.pack(f"<iiQQ{n}d", r["camera_id"], number, r["width"], r["height"], *r["params"])


def _image_bytes(r: dict) -> bytes:
    seen = b"".join(struct.pack("<ddq", p["x"], p["y"], i) for p, i in zip(r["xys"], r["point3d_ids"], strict=True))
    return struct.pack("<i7di", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q", len(r["xys"])) + seen


def _point_bytes(r: dict) -> bytes:
    track = [x for pair in zip(r["image_ids"], r["point2d_idxs"], strict=True) for x in pair]
    return struct.pack("<Q3d3BdQ", r["point_id"], *r["xyz"], *r["rgb"], r["error"], len(r["image_ids"])) + struct.pack(f"<{len(track)}i", *track)


KINDS = {"cameras": (_camera_end, _camera, _camera_bytes), "images": (_image_end, _image, _image_bytes), "points3D": (_point_end, _point, _point_bytes)}


# --------------------------------------------------------------------------- ranges


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Pack(InputPartition):
    ranges: list[Range]


def packed(ranges: list[Range], most: int) -> list[Pack]:
    """The ranges in their order, a task each; of more than `most`, neighbours share a task, by bytes."""
    if len(ranges) <= most:
        return [Pack([r]) for r in ranges]
    ends = list(itertools.accumulate(r.end - r.start for r in ranges))
    share = ends[-1] / most
    return [Pack([r for _, r in g]) for _, g in itertools.groupby(zip(ends, ranges, strict=True), lambda x: min(most - 1, int(x[0] / share)))]


def ranges_of(path: str, kind: str, range_bytes: int = RANGE_BYTES) -> Iterator[Range]:
    """The ranges of whole records of a file, each of about range_bytes or of one longer record."""
    fs, name = file_system(path)
    with fs.open_input_file(name) as file:
        b = _Bytes(file)
        (n,) = struct.unpack("<Q", b.get(0, HEAD))
        start = at = HEAD
        for _ in range(n):
            end = KINDS[kind][0](b, at)
            if at > start and end - start > range_bytes:
                yield Range(path, start, at)
                start = at
            at = end
        if at > file.size():
            raise ValueError(f"{path} ends within its last record")
        if at > start:
            yield Range(path, start, at)


def record_ranges(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, end) of the ranges of the files at `path`, a file or folder: a task walks over each file."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for file in x.column("path").to_pylist():
                found = list(ranges_of(file, kind, range_bytes))
                if found:
                    yield pa.RecordBatch.from_pylist([vars(r) for r in found], pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")  # contents are not read
    return files.repartition("path").mapInArrow(walk, "path string, start long, end long")


# --------------------------------------------------------------------------- data source


class RangeReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.kind, self.path, self.index = options["kind"], options.get("path"), options.get("index")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.names = schema.names

    def partitions(self) -> list[Pack]:
        return packed(self._ranges(), MOST_TASKS)

    def _ranges(self) -> list[Range]:
        if self.index is None:
            fs, name = file_system(self.path)
            info = fs.get_file_info(name)
            files = [f.path for f in fs.get_file_info(pafs.FileSelector(name)) if f.is_file and f.size and not f.base_name.startswith(("_", "."))] if info.type == pafs.FileType.Directory else [name]
            root = self.path.split(name.strip("/"), 1)[0] if "://" in self.path else ""
            return [r for f in sorted(files) for r in ranges_of(f"{root}{f}", self.kind, self.range_bytes)]
        fs, name = file_system(self.index)
        return [Range(**r) for r in ds.dataset(name, filesystem=fs, format="parquet").to_table(["path", "start", "end"]).to_pylist()]

    def read(self, partition: Pack | None) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges if partition else ():  # Spark asks for None where there are none
            yield from self._read(r)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, name = file_system(partition.path)
        with fs.open_input_file(name) as file:
            data = file.read_at(partition.end - partition.start, partition.start)
        parse, at = KINDS[self.kind][1], 0
        kinds = arrow_schema(self.kind, self.names)
        while at < len(data):
            columns: dict[str, list] = {c: [] for c in self.names}
            n = 0
            while at < len(data) and n < ROWS:
                at, fields = parse(data, at)
                n += 1
                for c, values in columns.items():
                    values.append(fields[c]())
            yield pa.RecordBatch.from_pydict(columns, kinds)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.kind, self.path, self.overwrite = options["kind"], options["path"].rstrip("/"), overwrite
        self.folder = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        pack, n = KINDS[self.kind][2], 0
        with tempfile.TemporaryFile() as body:
            for batch in iterator:
                for at in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(at, ROWS).to_pylist()
                    body.writelines(map(pack, rows))
                    n += len(rows)
            if not n:
                return Written(None)
            body.seek(0)
            return Written(self._put(f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin", n, body))

    def _put(self, name: str, n: int, body) -> str:
        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/{self.folder}", recursive=True)
        try:
            with fs.open_output_stream(f"{root}/{self.folder}/{name}") as out:
                out.write(struct.pack("<Q", n))
                shutil.copyfileobj(body, out, CHUNK)
        except BaseException:
            with contextlib.suppress(OSError):
                fs.delete_file(f"{root}/{self.folder}/{name}")
            raise
        return name

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        names = [m.name for m in messages if m is not None and m.name is not None]
        if not names:
            with tempfile.TemporaryFile() as body:
                names = [self._put(f"part-empty-{uuid.uuid4().hex}.bin", 0, body)]
        before = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file] if self.overwrite else []
        for name in names:
            fs.move(f"{root}/{self.folder}/{name}", f"{root}/{name}")
        for old in before:
            fs.delete_file(old)
        fs.delete_dir(f"{root}/{self.folder}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        with contextlib.suppress(OSError):
            fs.delete_dir(f"{root}/{self.folder}")


class CameraRecords(DataSource):
    """Options: path, a file or folder, or index, a Parquet table of ranges; kind: cameras, images or points3D. A schema
    of some of the columns reads those alone."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)


_TYPES = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
    "array<struct<x: double, y: double>>": pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])),
}


def _fields(kind: str) -> dict[str, str]:
    return dict(f.split(" ", 1) for f in re.split(r", (?![^<]*>)", SCHEMAS[kind]))


def arrow_schema(kind: str, names: list[str]) -> pa.Schema:
    return pa.schema([(c, _TYPES[_fields(kind)[c]]) for c in names])


def read_records(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the files at `path`, a file or folder; of some columns only, these alone are parsed. Empty files have no
    records; one that ends within a record is an error."""
    spark.dataSource.register(CameraRecords)
    index = shared_path(spark, "ranges")
    record_ranges(spark, path, kind, range_bytes).write.parquet(index)
    fields = _fields(kind)
    schema = ", ".join(f"{c} {fields[c]}" for c in columns or fields)
    return spark.read.format(FORMAT).schema(schema).option("kind", kind).option("index", index).load()


def write_records(rows: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """rows as files in the folder `path`, one a task with rows, or one without records. mode: append, overwrite or
    errorifexists. Rows without a value in some column are an error."""
    rows.sparkSession.dataSource.register(CameraRecords)
    if mode == "errorifexists":
        fs, root = file_system(path)
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            raise FileExistsError(path)
    rows.select(*_fields(kind)).write.format(FORMAT).mode("overwrite" if mode == "overwrite" else "append").option("kind", kind).option("path", path).save()
