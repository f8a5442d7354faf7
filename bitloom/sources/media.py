"""Coded-video files as tables: formats, container frames, record units, box trees and sample tables.

Files are rows (path, content) of Spark's binaryFile source. Where a record's place depends on the one before it, a
small generator walks the bytes of one row inside mapInPandas; what follows (offsets, sync flags, composition
offsets, histograms) is joins and windows. Damage gives the rows before it and one row with an error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.bits import byte_at

#: Box types that may open an MP4 file, and boxes that hold boxes.
FIRST_BOXES = ("ftyp", "moov", "mdat", "free", "skip", "wide", "pnot")
#: Bytes of a visual sample entry before its boxes, its own header left out, and where width and height stand.
ENTRY, WIDTH, HEIGHT = 78, 24, 26
#: Types of record units, from the sequence header to padding.
KNOWN_UNITS = (1, 2, 3, 4, 5, 6, 7, 8, 15)
HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex"}
BOXES = "path string, box string, track int, at long, payload binary"
UNITS = "path string, sample_index int, obu_index int, obu_type int, temporal_id int, spatial_id int, has_size boolean, size long, payload binary, error_offset long, error string"


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _probed(head: bytes, length: int) -> str | None:
    """obu or annexb, by the first bytes of data of this length; None where they are neither.

    obu: a whole record unit of a known type that states its size. annexb: sizes of a temporal unit, a frame unit and a
    record unit, each above 0 and within the one before, and a unit that does not state its size.
    """
    try:
        first, kind = head[0], head[0] >> 3 & 15
        if first & 0x82 == 2 and kind in KNOWN_UNITS:
            size, at = _leb128(head, 2 if first & 4 else 1, len(head))
            if at + size <= length:
                return "obu"
    except (ValueError, IndexError):
        pass
    try:
        at, end = 0, length
        for _ in range(3):
            size, at = _leb128(head, at, len(head))
            if not size or at + size > end:
                return None
            end = at + size
        return "annexb" if head[at] & 0x82 == 0 else None
    except (ValueError, IndexError):
        return None


@F.pandas_udf(StringType())
def _probe(head: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([_probed(bytes(h), int(n)) for h, n in zip(head, length)], dtype=object)


def sniff(rows: DataFrame, column: str = "content") -> DataFrame:
    """rows with format: ivf, mp4, obu, annexb or unknown, by the first bytes; record units are walked, not only looked at.

    Null and anything below four bytes is unknown. Only 32 bytes and the length of a file go to the probe.
    """
    c = F.col(column)
    word = lambda at: F.decode(F.substring(c, F.lit(at + 1), F.lit(4)), "iso-8859-1")
    probed = _probe(F.coalesce(F.substring(c, F.lit(1), F.lit(32)), F.lit(b"\0\0\0\0")), F.coalesce(F.octet_length(c), F.lit(0)))
    known = F.when(c.isNull() | (F.octet_length(c) < 4), "unknown").when(word(0) == "DKIF", "ivf").when(word(4).isin(*FIRST_BOXES), "mp4")
    return rows.withColumn("format", F.coalesce(known, probed, F.lit("unknown")))


def ivf_headers(rows: DataFrame) -> DataFrame:
    """The 32-byte header of each IVF file, cut out by column expressions alone."""
    number = lambda at, n: F.conv(F.concat(*[F.hex(F.substring("content", at + i + 1, 1)) for i in reversed(range(n))]), 16, 10).cast("long")
    ok = rows.where((F.octet_length("content") >= 32) & (F.substring("content", 1, 4) == F.lit(b"DKIF")))
    return ok.select("path", number(4, 2).alias("version"), F.decode(F.substring("content", 9, 4), "iso-8859-1").alias("codec"), number(12, 2).alias("width"), number(14, 2).alias("height"), number(16, 4).alias("timebase_den"), number(20, 4).alias("timebase_num"), number(24, 4).alias("frame_count"))


def _walk(walk: Callable[[bytes], Iterator[tuple]], columns: list[str], column: str = "content", keep: tuple[str, ...] = ("path",)):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*head, *row) for *head, data in part[[*keep, column]].itertuples(index=False) for row in walk(bytes(data or b""))]
            yield pd.DataFrame(rows, columns=[*keep, *columns])

    return run


def ivf_samples(rows: DataFrame) -> DataFrame:
    """(path, sample_index, pts, data, offset): the frames of IVF files and where their data begin; a cut last frame is dropped."""

    def walk(data: bytes) -> Iterator[tuple]:
        at, i = 32, 0
        while data[:4] == b"DKIF" and at + 12 <= len(data):
            size, pts = struct.unpack_from("<IQ", data, at)
            if at + 12 + size > len(data):
                return
            yield i, pts, data[at + 12 : at + 12 + size], at + 12
            at, i = at + 12 + size, i + 1

    return rows.mapInPandas(_walk(walk, ["sample_index", "pts", "data", "offset"]), "path string, sample_index int, pts long, data binary, offset long")


def _leb128(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = 0
    for k in range(8):
        if at + k >= end:
            raise ValueError("size: out of data")
        value |= (data[at + k] & 127) << (7 * k)
        if data[at + k] < 128:
            return value, at + k + 1
    raise ValueError("size: more than 8 bytes")


def _unit(data: bytes, at: int, end: int) -> tuple[tuple, int]:
    """The unit at a place and where it ends; without a size of its own it reaches to end."""
    head = data[at]
    if head & 0x80:
        raise ValueError("forbidden bit is set")
    here, temporal, spatial = at + 1, 0, 0
    if head & 4:
        if here >= end:
            raise ValueError("extension: out of data")
        temporal, spatial, here = data[here] >> 5, data[here] >> 3 & 3, here + 1
    size = end - here
    if head & 2:
        size, here = _leb128(data, here, end)
        if here + size > end:
            raise ValueError(f"payload of {size} bytes exceeds the {end - here} there are")
    return (head >> 3 & 15, temporal, spatial, bool(head & 2), size, data[here : here + size]), here + size


def _units(data: bytes, at: int, end: int) -> Iterator[tuple]:
    i = 0
    while at < end:
        try:
            row, nxt = _unit(data, at, end)
        except ValueError as e:
            yield i, None, None, None, None, None, None, at, str(e)
            return
        yield i, *row, None, None
        at, i = nxt, i + 1


def units(samples: DataFrame) -> DataFrame:
    """The record units of samples (path, sample_index, data), in order."""
    columns = ["obu_index", "obu_type", "temporal_id", "spatial_id", "has_size", "size", "payload", "error_offset", "error"]
    run = _walk(lambda data: _units(data, 0, len(data)), columns, "data", ("path", "sample_index"))
    return samples.mapInPandas(_ints(run), UNITS)


def _ints(run):
    """Nullable integers stay integers on the way through pandas."""

    def typed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in run(parts):
            yield part.astype({c: "Int64" for c in ("obu_type", "temporal_id", "spatial_id", "size", "error_offset") if c in part} | ({"has_size": "boolean"} if "has_size" in part else {}))

    return typed


def annexb_units(rows: DataFrame) -> DataFrame:
    """The units of length-delimited streams: temporal units (sample_index) of frame units of units."""

    def walk(data: bytes) -> Iterator[tuple]:
        at, tu = 0, 0
        while at < len(data):
            try:
                size, here = _leb128(data, at, len(data))
                end = here + size
                if end > len(data):
                    raise ValueError("temporal unit exceeds the data")
                i, found = 0, []
                while here < end:
                    size, here = _leb128(data, here, end)
                    frame = here + size
                    if frame > end:
                        raise ValueError("frame unit exceeds its temporal unit")
                    while here < frame:
                        size, here = _leb128(data, here, frame)
                        if here + size > frame or not size:
                            raise ValueError("unit exceeds its frame unit")
                        found.append((tu, i, *_unit(data, here, here + size)[0], None, None))
                        here, i = here + size, i + 1
                yield from found
            except ValueError as e:
                yield tu, 0, None, None, None, None, None, None, at, str(e)
                return
            at, tu = end, tu + 1

    columns = ["sample_index", "obu_index", "obu_type", "temporal_id", "spatial_id", "has_size", "size", "payload", "error_offset", "error"]
    return rows.mapInPandas(_ints(_walk(walk, columns)), UNITS)


def box_walk(read: Callable[[int, int], bytes], length: int) -> Iterator[tuple]:
    """(box, track, at, payload) of the boxes of an MP4 file, of which read(at, n) gives n bytes, fewer at its end.

    Sample entries are boxes within stsd, as many as it says, and what follows the fields of an av01 entry are boxes in it.
    """
    todo, track = [(0, length, "", 0, length)], 0
    while todo:
        at, end, above, of, left = todo.pop()
        if at + 8 > end or not left:
            continue
        size, kind = struct.unpack(">I4s", read(at, 8))
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack(">Q", read(at + 8, 8))[0], 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            continue
        todo.append((at + size, end, above, of, left - 1))
        name = f"{above}/{kind.decode('iso-8859-1')}"
        if kind == b"trak":
            track += 1
            of = track
        holds = kind in HOLDERS
        yield name, of, at, None if holds or not name.startswith("/moov") else read(at + head, size - head)
        if holds:
            todo.append((at + head, at + size, name, of, length))
        elif name.endswith("/stbl/stsd") and size >= head + 8:
            todo.append((at + head + 8, at + size, name, of, int.from_bytes(read(at + head + 4, 4), "big")))
        elif name.endswith("/stsd/av01"):
            todo.append((at + head + ENTRY, at + size, name, of, length))


def boxes(rows: DataFrame) -> DataFrame:
    """(path, box, track, at, payload): the boxes of MP4 files; only leaves below moov carry their payload."""
    walk = lambda data: box_walk(lambda at, n: data[at : at + n], len(data))
    return rows.mapInPandas(_walk(walk, ["box", "track", "at", "payload"]), BOXES)


def _be(at: int | str, n: int) -> Column:
    """The big-endian number in n bytes of a payload from place at on."""
    return F.conv(F.hex(F.expr(f"substring(payload, cast({at} as int) + 1, {n})")), 16, 10).cast("long")


def _numbers(found: DataFrame, box: str, first: int, width: int, per_row: int) -> DataFrame:
    """Rows of per_row numbers of width bytes each from byte first of a box's payload, numbered from 1.

    The entry count stands in the four bytes before; what lies beyond that many entries, or is missing, gives no row.
    A sample-size box that names one size for all has no entries: each of its samples has that size.
    """
    data = found.where(F.col("box").endswith(f"/stbl/{box}") & (F.octet_length("payload") >= first))
    there = F.floor((F.octet_length("payload") - first) / (width * per_row))
    number = lambda i, k: F.conv(F.hex(F.substring("payload", (first + width * (per_row * (i - 1) + k) + 1).cast("int"), F.lit(width))), 16, 10).cast("long")
    entry = lambda i: F.struct(i.alias("i"), *[number(i, k).alias(f"v{k}") for k in range(per_row)])
    one = _be(4, 4) if box == "stsz" else F.lit(0)
    n = F.when(one > 0, _be(first - 4, 4)).otherwise(F.least(_be(first - 4, 4), there)).cast("int")
    same = lambda i: F.struct(i.alias("i"), *[one.alias(f"v{k}") for k in range(per_row)])
    listed = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.when(one > 0, same(i)).otherwise(entry(i))))
    return data.select("path", "track", F.explode(listed).alias("e")).select("path", "track", "e.*")


def tracks(found: DataFrame) -> DataFrame:
    """(path, track, track_id, handler, timescale, codec, width, height, av1_config, config_obus) of every track of MP4 files.

    Fields of boxes that are missing or too short are null. Of several boxes of one kind in a track the first counts; of
    several sample entries the last gives codec and size, and the last av1C box of an av01 entry the configuration.
    """
    leaf = lambda name, value: F.min_by(value, F.when(F.col("box").endswith(name), F.col("at")))
    text = lambda at: F.decode(F.expr(f"substring(payload, {at} + 1, 4)"), "iso-8859-1")
    long = F.substring("payload", 1, 1) == F.lit(b"\1")
    rows = found.where((F.col("track") > 0) & F.col("payload").isNotNull())
    entry, config = F.col("box").rlike("/stsd/[^/]*$"), F.col("box").endswith("/stsd/av01/av1C")
    last = lambda which, value: F.max_by(value, F.when(which, F.col("at")))
    named = rows.groupBy("path", "track").agg(
        leaf("/tkhd", F.when(long, _be(20, 4)).otherwise(_be(12, 4))).alias("track_id"),
        leaf("/mdia/hdlr", text(8)).alias("handler"),
        leaf("/mdia/mdhd", F.when(long, _be(20, 4)).otherwise(_be(12, 4))).alias("timescale"),
        last(entry, F.element_at(F.split("box", "/"), -1)).alias("codec"),
        last(entry, _be(WIDTH, 2)).alias("width"),
        last(entry, _be(HEIGHT, 2)).alias("height"),
        last(config, F.col("payload")).alias("av1_config"),
    )
    return named.withColumn("config_obus", F.expr("case when octet_length(av1_config) > 4 then substring(av1_config, 5) end"))


def first_av1_track(rows: DataFrame) -> DataFrame:
    """Of the tracks of each file the first video track of AV1; files without one give no row."""
    of = rows.where("handler = 'vide' and codec = 'av01'")
    return of.join(of.groupBy("path").agg(F.min("track").alias("track")), ["path", "track"], "left_semi")


def mp4_sample_data(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """(path, track, sample_index, data): the bytes of samples (of mp4_samples), cut out of files (path, content).

    A file's samples are cut out of its one row; those that reach beyond its end give no row.
    """
    of = samples.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("track", "sample_index", "offset", "size"))).alias("samples"))
    inside = F.filter("samples", lambda s: s["offset"] + s["size"] <= F.octet_length("content"))
    cut = F.transform(inside, lambda s: F.struct(s["track"].alias("track"), s["sample_index"].alias("sample_index"), F.substring("content", (s["offset"] + 1).cast("int"), s["size"].cast("int")).alias("data")))
    return rows.join(of, "path").select("path", F.explode(cut).alias("s")).select("path", "s.*")


def mp4_samples(found: DataFrame) -> DataFrame:
    """(path, track, sample_index, size, offset, is_sync, cts_offset) from the boxes of MP4 files.

    Sizes of stsz, chunks of stco or co64, runs of stsc (each run holds until the next), sync samples of stss (none:
    all are), runs of ctts (the last one holds on). Offsets are exclusive sums of sizes within a chunk.
    """
    by = ["path", "track"]
    sizes = _numbers(found, "stsz", 12, 4, 1).select(*by, F.col("i").alias("n"), F.col("v0").alias("size"))
    chunks = _numbers(found, "stco", 8, 4, 1).unionByName(_numbers(found, "co64", 8, 8, 1)).select(*by, F.col("i").alias("chunk"), F.col("v0").alias("begins"))
    runs = _numbers(found, "stsc", 8, 4, 3).select(*by, F.col("v0").alias("chunk"), F.col("v1").alias("per_chunk"))
    order = W.partitionBy(*by).orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    filled = chunks.join(runs, [*by, "chunk"], "left").withColumn("per_chunk", F.last("per_chunk", ignorenulls=True).over(order))
    filled = filled.withColumn("upto", F.sum("per_chunk").over(order))
    placed = filled.select(*by, "begins", F.col("chunk"), F.explode(F.sequence(F.col("upto") - F.col("per_chunk") + 1, F.col("upto"))).alias("n"))
    within = W.partitionBy(*by, "chunk").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    samples = sizes.join(placed, [*by, "n"]).withColumn("offset", F.col("begins") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    sync = _numbers(found, "stss", 8, 4, 1).select(*by, F.col("v0").alias("n"), F.lit(True).alias("listed"))
    listing = found.where(F.col("box").endswith("/stbl/stss")).select(*by, F.lit(True).alias("has_stss")).distinct()
    samples = samples.join(sync, [*by, "n"], "left").join(listing, by, "left")
    every = W.partitionBy(*by).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    ctts = _numbers(found, "ctts", 8, 4, 2).withColumn("n", F.sum("v0").over(every) - F.col("v0") + 1)
    ctts = ctts.select(*by, "n", F.when(F.col("v1") >= 1 << 31, F.col("v1") - (1 << 32)).otherwise(F.col("v1")).alias("cts"))
    upto = W.partitionBy(*by).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    samples = samples.join(ctts, [*by, "n"], "left").withColumn("cts", F.coalesce(F.last("cts", ignorenulls=True).over(upto), F.lit(0)))
    return samples.select(*by, (F.col("n") - 1).alias("sample_index"), "size", "offset", F.coalesce("listed", F.col("has_stss").isNull()).alias("is_sync"), F.col("cts").alias("cts_offset"))


def unit_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").groupBy("obu_type").count().orderBy("obu_type")


def y4m_frames(rows: DataFrame) -> DataFrame:
    """(path, frame, width, height, y, u, v): the 4:2:0 frames of Y4M files; a cut last frame is dropped."""

    def walk(data: bytes) -> Iterator[tuple]:
        head, _, rest = data.partition(b"\n")
        fields = {f[:1]: f[1:] for f in head.split(b" ")[1:]}
        if not head.startswith(b"YUV4MPEG2") or not (fields.get(b"W", b"").isdigit() and fields.get(b"H", b"").isdigit()):
            return
        w, h = int(fields[b"W"]), int(fields[b"H"])
        luma, chroma, at, n = w * h, (w + 1) // 2 * ((h + 1) // 2), 0, 0
        while rest[at : at + 5] == b"FRAME" and (begin := rest.find(b"\n", at) + 1) and begin + luma + 2 * chroma <= len(rest):
            y, u = begin + luma, begin + luma + chroma
            yield n, w, h, rest[begin:y], rest[y:u], rest[u : u + chroma]
            at, n = u + chroma, n + 1

    return rows.mapInPandas(_walk(walk, ["frame", "width", "height", "y", "u", "v"]), "path string, frame int, width int, height int, y binary, u binary, v binary")


def compare_frames(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per path, frame and plane: samples, how many differ, the largest difference, and the first place that differs.

    Both sides have the columns of y4m_frames; frames that one side lacks are left out, as are samples beyond the
    shorter plane. Planes are compared byte by byte where they lie, joined by path and frame.
    """
    planes = lambda side: side.select("path", "frame", "width", F.explode(F.create_map(*[x for c in "yuv" for x in (F.lit(c), F.col(c))])).alias("plane", side_name(side)))
    side_name = lambda side: "a" if side is ours else "b"
    both = planes(ours).join(planes(theirs).drop("width"), ["path", "frame", "plane"])
    byte = lambda c, i: F.conv(F.hex(F.substring(F.col(c), i, F.lit(1))), 16, 10).cast("int")
    n = F.least(F.octet_length("a"), F.octet_length("b"))
    diff = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.abs(byte("a", i) - byte("b", i)))).otherwise(F.array().cast("array<int>"))
    both = both.select("path", "frame", "plane", "width", diff.alias("d"))
    first = F.array_position(F.transform("d", lambda x: x > 0), True) - 1
    wide = F.when(F.col("plane") == "y", F.col("width")).otherwise(F.floor((F.col("width") + 1) / 2))
    return both.select(
        "path", "frame", "plane", F.size("d").alias("samples"), F.size(F.filter("d", lambda x: x > 0)).alias("differing"), F.coalesce(F.array_max("d"), F.lit(0)).alias("largest"),
        F.when(first >= 0, F.pmod(first, wide)).alias("first_x"), F.when(first >= 0, F.floor(first / wide)).alias("first_y"),
    )


def inspect(rows: DataFrame) -> DataFrame:
    """(path, format, obu_type, n): the report on files of every format: how many record units of each type they hold."""
    known = sniff(rows)
    of = lambda name: known.where(F.col("format") == name).drop("format")
    found = boxes(of("mp4"))
    chosen = mp4_samples(found).join(first_av1_track(tracks(found)).select("path", "track"), ["path", "track"], "left_semi")
    samples = ivf_samples(of("ivf")).select("path", "sample_index", "data").unionByName(mp4_sample_data(of("mp4"), chosen).select("path", "sample_index", "data"))
    samples = samples.unionByName(of("obu").select("path", F.lit(0).alias("sample_index"), F.col("content").alias("data")))
    counted = units(samples).unionByName(annexb_units(of("annexb"))).where("error is null").groupBy("path", "obu_type").agg(F.count("*").alias("n"))
    return known.select("path", "format").join(counted, "path", "left")
