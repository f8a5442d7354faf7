"""Coded files read by byte ranges: samples of files that no single row can hold, several tasks a file.

`spark.read.format("ivf_frames")` is a data source whose partitions are stretches of whole frames, found by walking the
frame headers alone; files of MP4 are walked box by box, only the sample tables are read, and read_ranges() fetches the
samples that the table query found. Paths may lie in any store that Arrow opens (local, hdfs://, s3://).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .media import BOXES, box_walk

#: Bytes of one stretch, about, and of a batch of rows that is handed on.
SPLIT, BATCH = 64 << 20, 16 << 20
FRAMES = "path string, sample_index long, pts long, offset long, size long, data binary, error string"
#: Headers are read ahead in windows of this size.
AHEAD = 1 << 16


class Ranged:
    """A file of any size: its length, and any range of its bytes."""

    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path) if ":" in path else (fs.LocalFileSystem(), path)
        self._file = store.open_input_file(inner)
        self.length = self._file.size()
        self._at, self._ahead = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """At most n bytes from place at on; short ranges come from a window that was read ahead."""
        if n > AHEAD:
            return self._file.read_at(n, at)
        if not (self._at <= at and at + n <= self._at + len(self._ahead)):
            self._at, self._ahead = at, self._file.read_at(AHEAD, at) if at < self.length else b""
        return self._ahead[at - self._at : at - self._at + n]

    def close(self) -> None:
        self._file.close()


def ivf_index(file: Ranged) -> Iterator[tuple[int, int | None, int, int | None, str | None]]:
    """(frame, pts, where its data begin, their size, error) by the frame headers; a cut end gives one row with an error."""
    if file.read(0, 4) != b"DKIF" or file.length < 32:
        yield 0, None, 0, None, "no header of 32 bytes that begins with DKIF"
        return
    at, i = 32, 0
    while at < file.length:
        head = file.read(at, 12)
        size, pts = struct.unpack("<IQ", head) if len(head) == 12 else (None, None)
        if size is None or at + 12 + size > file.length:
            yield i, None, at, None, f"the file ends at {file.length} within frame {i}"
            return
        yield i, pts, at + 12, size, None
        at, i = at + 12 + size, i + 1


class Stretch(InputPartition):
    """Frames first to last of a file, the first one's header at place begin; or an error instead."""

    def __init__(self, path: str, first: int, last: int, begin: int, error: str | None = None):
        self.path, self.first, self.last, self.begin, self.error = path, first, last, begin, error


def stretches(path: str, first: int, last: int | None, split: int, report: bool) -> list[Stretch]:
    """A file's frames from first to last (None: all there are), in stretches of about split bytes.

    With report, a cut end and frames asked for beyond the last one are stretches with an error.
    """
    file, found, at, held = Ranged(path), [], None, 0
    n, damage = 0, None
    try:
        for i, _, offset, size, error in ivf_index(file):
            if error:
                damage = Stretch(path, i, i, offset, error)
                break
            n = i + 1
            if last is not None and i > last:
                break
            if i >= first:
                if at is None or held + size > split:
                    at, held = offset - 12, 0
                    found.append(Stretch(path, i, i, at))
                found[-1].last, held = i, held + size
    finally:
        file.close()
    if report and damage:
        found.append(damage)
    elif report and last is not None and n <= last:
        found.append(Stretch(path, n, last, 0, f"frames {max(first, n)} to {last} of a file of {n}"))
    return found


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= BATCH or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class IvfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for part in options.get("paths", options.get("path", "")).split(",") for p in expand(part.strip())]
        self.split = int(options.get("splitbytes", SPLIT))
        self.report = options.get("ontruncated", "drop") == "error"
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None
        self.asked = "last" in options

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of sample_index become the first and last frame to read; Spark still applies every filter."""
        for f in filters:
            if getattr(f, "attribute", None) == ("sample_index",):
                low = {EqualTo: 0, GreaterThanOrEqual: 0, GreaterThan: 1}.get(type(f))
                high = {EqualTo: 0, LessThanOrEqual: 0, LessThan: -1}.get(type(f))
                if low is not None:
                    self.first = max(self.first, f.value + low)
                if high is not None:
                    self.last = f.value + high if self.last is None else min(self.last, f.value + high)
                if isinstance(f, In) and f.value:
                    self.first, self.last = max(self.first, min(f.value)), max(f.value) if self.last is None else min(self.last, max(f.value))
            yield f

    def partitions(self) -> list[Stretch]:
        found = [s for p in self.paths for s in stretches(p, self.first, self.last, self.split, self.report or self.asked)]
        return found or [Stretch("", 0, -1, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("sample_index", pa.int64()), ("pts", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("data", pa.binary()), ("error", pa.string())])

        def rows() -> Iterator[tuple]:
            if partition.error:
                yield partition.path, partition.first, None, partition.begin, None, None, partition.error
                return
            if partition.last < partition.first:
                return
            file, at = Ranged(partition.path), partition.begin
            try:
                for i in range(partition.first, partition.last + 1):
                    size, pts = struct.unpack("<IQ", file.read(at, 12))
                    yield partition.path, i, pts, at + 12, size, file.read(at + 12, size), None
                    at += 12 + size
            finally:
                file.close()

        yield from _batches(rows(), schema, lambda r: len(r[5] or b""))


class IvfFrames(DataSource):
    """Frames of IVF files: path (or comma-separated paths, each a file, a folder or a pattern of local files).

    Options: splitBytes; first, last (frames asked for; frames that a file lacks give a row with an error);
    onTruncated: drop (a cut last frame gives no row) or error (it gives a row with an error).
    """

    @classmethod
    def name(cls) -> str:
        return "ivf_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> IvfReader:
        return IvfReader({k.lower(): v for k, v in self.options.items()})


def expand(path: str) -> list[str]:
    """The files that a path stands for: itself, the files of a folder, or what a pattern of local names matches."""
    import glob
    import os

    if not path:
        return []
    if ":" not in path:
        return sorted(glob.glob(path)) if any(c in path for c in "*?[") else [os.path.join(path, x) for x in sorted(os.listdir(path))] if os.path.isdir(path) else [path]
    return [path]


def register(spark: SparkSession) -> None:
    """Make the formats ivf_frames and placed_bytes known to a session, and let it hand filters to Python data sources."""
    from .placed import PlacedBytes

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IvfFrames)
    spark.dataSource.register(PlacedBytes)


def index_frames(files: DataFrame) -> DataFrame:
    """(path, sample_index, pts, offset, size, error): the frames of IVF files (path), one task walking a file's headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("sample_index", pa.int64()), ("pts", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("error", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                file = Ranged(path)
                try:
                    yield from _batches(((path, *row) for row in ivf_index(file)), schema, lambda r: 0)
                finally:
                    file.close()

    return files.select("path").mapInArrow(run, "path string, sample_index long, pts long, offset long, size long, error string")


def ranged_boxes(files: DataFrame) -> DataFrame:
    """media.boxes() of MP4 files (path) of any size: box headers are read one by one, payloads only of leaves below moov."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("box", pa.string()), ("track", pa.int32()), ("at", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                file = Ranged(path)
                try:
                    yield from _batches(((path, *row) for row in box_walk(file.read, file.length)), schema, lambda r: len(r[4] or b""))
                finally:
                    file.close()

    return files.select("path").mapInArrow(run, BOXES)


def read_ranges(ranges: DataFrame, split: int = SPLIT, tasks: int | None = None) -> DataFrame:
    """ranges with data (their bytes) and error; ranges have path, offset, size, and whatever else.

    A file's ranges are dealt to tasks (as many as shuffle partitions, unless said) by stretches of split bytes and read
    in order of place; the number is fixed, since the rows say nothing about how much they will read. A range that reaches
    beyond the end of its file has no data but an error; so has one without place or size.
    """
    columns = ranges.columns
    if {"data", "error"} & set(columns):
        raise ValueError("ranges have columns data or error already")
    stretch = F.floor(F.col("offset") / split)
    rows = ranges.repartition(tasks or int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", stretch).sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            begin, held, data, errors = 0, 0, [], []
            places = zip(*(batch.column(columns.index(c)).to_pylist() for c in ("path", "offset", "size")))
            for k, (where, at, n) in enumerate(places):
                if where != path:
                    if file:
                        file.close()
                    path, file = where, Ranged(where) if where is not None else None
                if file is None or at is None or n is None or at < 0 or n < 0:
                    found, error = None, "no range"
                elif at + n > file.length:
                    found, error = None, f"bytes {at} to {at + n} of a file of {file.length}"
                else:
                    found, error = file.read(at, n), None
                data.append(found)
                errors.append(error)
                held += n or 0
                if held >= BATCH or k == batch.num_rows - 1:
                    part = batch.slice(begin, k + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary()), pa.array(errors, pa.string())], [*columns, "data", "error"])
                    begin, held, data, errors = k + 1, 0, [], []
        if file:
            file.close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema)
    return rows.mapInArrow(run, f"{kinds}, data binary, error string")
