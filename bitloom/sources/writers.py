"""Writers as column expressions: record units, record streams and video files, as binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import leb128_encode


def _byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


def unit_bytes(obu_type: Column, payload: Column, temporal_id: Column | None = None, spatial_id: Column | None = None, sized: bool = True) -> Column:
    """A record unit: its header (with an extension where both ids are given and not null), its size, its payload.

    Null payload counts as empty; a null type gives null.
    """
    payload = F.coalesce(payload, F.lit(b""))
    extended = F.lit(False) if temporal_id is None or spatial_id is None else temporal_id.isNotNull() & spatial_id.isNotNull()
    head = _byte(obu_type * 8 + F.when(extended, 4).otherwise(0) + (2 if sized else 0))
    extension = F.lit(b"") if temporal_id is None or spatial_id is None else F.when(extended, _byte(temporal_id * 32 + spatial_id * 8)).otherwise(F.lit(b""))
    return F.concat(head, extension, leb128_encode(F.octet_length(payload).cast("long")) if sized else F.lit(b""), payload)


def sample_bytes(units: DataFrame) -> DataFrame:
    """(path, sample_index, data): the units of each sample (columns of media.units), written one after another.

    Rows with an error are left out. One sample's units meet in one row.
    """
    extended = (F.col("temporal_id") > 0) | (F.col("spatial_id") > 0)
    data = unit_bytes(F.col("obu_type"), F.col("payload"), F.when(extended, F.col("temporal_id")), F.when(extended, F.col("spatial_id")))
    rows = units.where("error is null").select("path", "sample_index", F.struct("obu_index", data.alias("data")).alias("u"))
    joined = F.aggregate(F.array_sort(F.collect_list("u")), F.lit(b""), lambda a, u: F.concat(a, u["data"]))
    return rows.groupBy("path", "sample_index").agg(joined.alias("data"))


def little_endian(value: Column, n: int) -> Column:
    """A whole number in n bytes, the least significant first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)]))


def ivf_header(frames: Column, codec: str = "AV01", width: int = 0, height: int = 0, rate: tuple[int, int] = (30, 1)) -> Column:
    """The 32 bytes that open an IVF file of so many frames."""
    fixed = b"DKIF" + (0).to_bytes(2, "little") + (32).to_bytes(2, "little") + codec.encode() + width.to_bytes(2, "little") + height.to_bytes(2, "little") + rate[0].to_bytes(4, "little") + rate[1].to_bytes(4, "little")
    return F.concat(F.lit(fixed), little_endian(frames, 4), F.lit(b"\0\0\0\0"))


def ivf_frame(pts: Column, data: Column) -> Column:
    """A frame of an IVF file: its size, its time, its data."""
    return F.concat(little_endian(F.octet_length(data), 4), little_endian(pts, 8), data)


def ivf_bytes(samples: DataFrame, **header) -> DataFrame:
    """(path, content): samples (path, sample_index, pts, data) as IVF files. One file's frames meet in one row."""
    rows = samples.select("path", F.struct("sample_index", ivf_frame(F.col("pts"), F.col("data")).alias("data")).alias("f"))
    joined = F.aggregate(F.array_sort(F.collect_list("f")), F.lit(b""), lambda a, f: F.concat(a, f["data"]))
    return rows.groupBy("path").agg(F.concat(ivf_header(F.count("*"), **header), joined).alias("content"))


def _frames(frames: DataFrame, start: Column, head: Column) -> DataFrame:
    rows = frames.select("path", "width", "height", F.struct("frame", F.concat(head, "y", "u", "v").alias("data")).alias("f"))
    joined = F.aggregate(F.array_sort(F.collect_list("f")), F.first(start), lambda a, f: F.concat(a, f["data"]))
    return rows.groupBy("path").agg(joined.alias("content"))


def y4m_bytes(frames: DataFrame, rate: str = "30:1") -> DataFrame:
    """(path, content): frames (columns of media.y4m_frames) as Y4M files. One file's frames meet in one row."""
    start = F.format_string(f"YUV4MPEG2 W%d H%d F{rate} Ip A1:1 C420jpeg\n", "width", "height").cast("binary")
    return _frames(frames, start, F.lit(b"FRAME\n"))


def yuv_bytes(frames: DataFrame) -> DataFrame:
    """(path, content): the planes of frames, one after another, without headers."""
    return _frames(frames, F.lit(b""), F.lit(b""))


def ppm_bytes(frames: DataFrame) -> DataFrame:
    """frames with ppm: each frame as a binary PPM picture, by the fixed-point conversion of full-range samples."""
    at = lambda c, i: F.conv(F.hex(F.substring(F.col(c), i.cast("int"), F.lit(1))), 16, 10).cast("int")
    half = lambda i, w: F.floor(F.floor(i / w) / 2) * F.floor((w + 1) / 2) + F.floor(F.pmod(i, w) / 2) + 1
    two = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("long")), 2, "0")
    fixed = lambda x: F.shiftright(x + 32768, 16)

    def pixel(i: Column) -> Column:
        y, u, v = at("y", i + 1), at("u", half(i, F.col("width"))) - 128, at("v", half(i, F.col("width"))) - 128
        return F.concat(two(y + fixed(91881 * v)), two(y - fixed(22554 * u + 46802 * v)), two(y + fixed(116130 * u)))

    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), pixel), ""))
    return frames.withColumn("ppm", F.concat(F.format_string("P6\n%d %d\n255\n", "width", "height").cast("binary"), pixels))
