"""Sinks that many tasks write at once: every row holds bytes and their place in a file.

Places are exclusive sums of sizes (exclusive_sums), so that no task needs another's bytes. Rows are written into
hidden files beside the target; commit checks that they have no gaps and renames them, abort deletes them. A task that
runs twice writes the same bytes to the same places. The target is a folder that all executors share and that allows
writes at a place (a POSIX file system); object stores do not.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .writers import ivf_frame, ivf_header

#: Rows of a key whose sizes one task adds up.
BLOCK = 4096


@dataclass
class Written(WriterCommitMessage):
    """By file: bytes written, and where the last of them ends."""

    files: dict[str, tuple[int, int]] = field(default_factory=dict)


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.hidden = os.path.join(folder, f".writing-{uuid.uuid4().hex}")
        os.makedirs(self.hidden)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, handles = Written(), {}
        try:
            for batch in iterator:
                for name, offset, data in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("name", "offset", "data"))):
                    name, offset, data = name.as_py(), offset.as_py(), memoryview(data.as_buffer() or b"") if data.is_valid else memoryview(b"")
                    if not name or os.path.basename(name) != name or name.startswith("."):
                        raise ValueError(f"not a file name: {name!r}")
                    if name not in handles:
                        handles[name] = os.open(os.path.join(self.hidden, name), os.O_CREAT | os.O_WRONLY, 0o644)
                    size, at = len(data), offset
                    while data:
                        n = os.pwrite(handles[name], data, at)
                        data, at = data[n:], at + n
                    before = done.files.get(name, (0, 0))
                    done.files[name] = (before[0] + size, max(before[1], offset + size))
            for handle in handles.values():
                os.fsync(handle)
        finally:
            for handle in handles.values():
                os.close(handle)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        total: dict[str, tuple[int, int]] = {}
        for m in messages:
            for name, (size, end) in (m.files if m else {}).items():
                before = total.get(name, (0, 0))
                total[name] = (before[0] + size, max(before[1], end))
        try:
            for name, (size, end) in total.items():
                if size != end:
                    raise ValueError(f"{name}: {size} bytes were placed up to {end}")
                if not self.overwrite and os.path.exists(os.path.join(self.folder, name)):
                    raise FileExistsError(name)
            for name in total:
                os.replace(os.path.join(self.hidden, name), os.path.join(self.folder, name))
        finally:
            shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class PlacedBytes(DataSource):
    """Format placed_bytes: rows (name, offset, data) as files of a shared folder. Mode overwrite replaces files of the same names."""

    @classmethod
    def name(cls) -> str:
        return "placed_bytes"

    def schema(self) -> str:
        return "name string, offset long, data binary"

    def writer(self, schema, overwrite: bool) -> PlacedWriter:
        return PlacedWriter(self.options["path"].removeprefix("file:"), overwrite)


def exclusive_sums(rows: DataFrame, key: str, order: str, size: Column, name: str, block: int = BLOCK) -> DataFrame:
    """rows with name: the sum of size over the rows of the same key that come before by order, a number from about 0 on.

    Sums within blocks of order and sums of blocks: a key's rows lie in as many tasks as it has blocks, and only one
    row a block meets in one place. Rows shuffle once.
    """
    of = F.floor(F.col(order) / block)
    placed = rows.withColumn("__size", size).withColumn("__block", of)
    before = W.partitionBy(key, "__block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.select(F.col(key), of.alias("__block"), size.alias("__size")).groupBy(key, "__block").agg(F.sum("__size").alias("__n"))
    earlier = W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(key, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__carry"))
    summed = placed.withColumn("__within", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    return summed.join(blocks, [key, "__block"]).withColumn(name, F.col("__within") + F.col("__carry")).select(*rows.columns, name)


def _placed(parts: DataFrame, suffix: str) -> DataFrame:
    """(name, offset, data) of parts (path, part, data); names are the last parts of paths with another suffix."""
    found = exclusive_sums(parts, "path", "part", F.octet_length("data").cast("long"), "offset")
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return found.select(F.concat(base, F.lit(suffix)).alias("name"), "offset", "data")


def y4m_parts(frames: DataFrame, rate: str = "30:1") -> DataFrame:
    """Frames (columns of media.y4m_frames) as rows to be placed in Y4M files, one for each frame and each header."""
    head = F.format_string(f"YUV4MPEG2 W%d H%d F{rate} Ip A1:1 C420jpeg\n", F.first("width"), F.first("height")).cast("binary")
    heads = frames.groupBy("path").agg(head.alias("data")).select("path", F.lit(-1).cast("long").alias("part"), "data")
    return _placed(heads.unionByName(frames.select("path", F.col("frame").cast("long").alias("part"), F.concat(F.lit(b"FRAME\n"), "y", "u", "v").alias("data"))), ".y4m")


def yuv_parts(frames: DataFrame) -> DataFrame:
    """The planes of frames as rows to be placed in files without headers."""
    return _placed(frames.select("path", F.col("frame").cast("long").alias("part"), F.concat("y", "u", "v").alias("data")), ".yuv")


def stream_parts(samples: DataFrame) -> DataFrame:
    """Samples (path, sample_index, data) as rows to be placed in streams of record units."""
    return _placed(samples.select("path", F.col("sample_index").cast("long").alias("part"), "data"), ".obu")


def ivf_parts(samples: DataFrame, **header) -> DataFrame:
    """Samples (path, sample_index, pts, data) as rows to be placed in IVF files, the frame counts in their headers."""
    heads = samples.groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit(-1).cast("long").alias("part"), ivf_header(F.col("n"), **header).alias("data"))
    frames = samples.select("path", F.col("sample_index").cast("long").alias("part"), ivf_frame(F.col("pts"), F.col("data")).alias("data"))
    return _placed(heads.unionByName(frames), ".ivf")


def write_placed(parts: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write rows (name, offset, data) as files of a shared folder; all of them appear, or none."""
    from .ranged import register

    register(parts.sparkSession)
    parts.write.format("placed_bytes").mode("overwrite" if overwrite else "append").save(folder)
