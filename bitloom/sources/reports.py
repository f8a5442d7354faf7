"""The inspection report on files of any format, as rows: what they are, what their headers say, their samples, units and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.headers import frame_headers, sequence_headers
from . import media

#: Names of the types of record units.
UNIT_NAMES = {1: "SEQUENCE_HEADER", 2: "TEMPORAL_DELIMITER", 3: "FRAME_HEADER", 4: "TILE_GROUP", 5: "METADATA", 6: "FRAME", 7: "REDUNDANT_FRAME_HEADER", 8: "TILE_LIST", 15: "PADDING"}
#: Samples and units whose details are listed.
DETAILED = 10


def all_samples(rows: DataFrame) -> DataFrame:
    """(path, format, sample_index, is_sync, data): the samples of files (path, content) of every format but nested streams.

    Of MP4 files the first video track of AV1. is_sync is null where a format does not say. A plain stream is one sample.
    """
    known = media.sniff(rows)
    of = lambda name: known.where(F.col("format") == name).drop("format")
    found = media.boxes(of("mp4"))
    chosen = media.mp4_samples(found).join(media.first_av1_track(media.tracks(found)).select("path", "track"), ["path", "track"], "left_semi")
    cut = media.mp4_sample_data(of("mp4"), chosen).join(chosen.select("path", "track", "sample_index", "is_sync"), ["path", "track", "sample_index"])
    unsaid = F.lit(None).cast("boolean")
    parts = [
        cut.select("path", F.lit("mp4").alias("format"), "sample_index", "is_sync", "data"),
        media.ivf_samples(of("ivf")).select("path", F.lit("ivf").alias("format"), "sample_index", unsaid.alias("is_sync"), "data"),
        of("obu").select("path", F.lit("obu").alias("format"), F.lit(0).alias("sample_index"), unsaid.alias("is_sync"), F.col("content").alias("data")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def file_units(rows: DataFrame) -> DataFrame:
    """The record units (columns of media.units) of files of every format. Units of an MP4 track's configuration come first, as sample -1."""
    known = media.sniff(rows)
    of = lambda name: known.where(F.col("format") == name).drop("format")
    setup = media.first_av1_track(media.tracks(media.boxes(of("mp4")))).where("config_obus is not null").select("path", F.lit(-1).alias("sample_index"), F.col("config_obus").alias("data"))
    samples = all_samples(rows).select("path", "sample_index", "data").unionByName(setup)
    return media.units(samples).unionByName(media.annexb_units(of("annexb")))


def summary(rows: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """One row a file: path, format, samples, sync_samples, broken, units and frames (maps of type to count), shown, profile, width, height, bit_depth.

    A sample that breaks is neither counted as sync nor are its units before the damage left out. sync_samples is null
    where the format does not say. Frames are counted from where the first sequence header is known; the last one gives
    profile to bit_depth. Files of an unknown format have a row without counts. units: what file_units(rows) gave, where
    it was written or cached; else files are walked once for each kind of count.
    """
    units = file_units(rows) if units is None else units
    known = media.sniff(rows)
    broken = units.where("error is not null and sample_index >= 0").select("path", "sample_index", F.lit(True).alias("bad")).distinct()
    nested = media.annexb_units(known.where("format = 'annexb'").drop("format")).select("path", "sample_index").distinct()
    samples = all_samples(rows).select("path", "sample_index", "is_sync").unionByName(nested.withColumn("is_sync", F.lit(None).cast("boolean")))
    samples = samples.join(broken, ["path", "sample_index"], "left")
    whole = units.where("error is null")
    frames = frame_headers(whole)
    names = F.create_map(*[F.lit(x) for pair in UNIT_NAMES.items() for x in pair])
    # Everything that is counted, as one table of facts: what kind it is, and its name.
    fact = lambda df, kind, name="": df.select("path", F.lit(kind).alias("kind"), (F.lit(name) if isinstance(name, str) else name).alias("name"))
    facts = fact(whole, "unit", F.coalesce(names[F.col("obu_type")], F.lit("UNKNOWN")))
    kind = F.array_compact(F.array(F.lit("sample"), F.when(F.col("bad"), "broken"), F.when(F.col("is_sync").isNotNull(), "told"), F.when(F.col("is_sync") & F.col("bad").isNull(), "sync")))
    facts = facts.unionByName(samples.select("path", F.explode(kind).alias("kind"), F.lit("").alias("name")))
    shown = F.array_compact(F.array(F.when(F.col("frame_type_name").isNotNull(), F.struct(F.lit("frame").alias("kind"), F.col("frame_type_name").alias("name"))), F.when(F.col("show_frame"), F.struct(F.lit("shown").alias("kind"), F.lit("").alias("name")))))
    facts = facts.unionByName(frames.select("path", F.explode(shown).alias("f")).select("path", "f.*"))
    counted = facts.groupBy("path", "kind", "name").agg(F.count("*").alias("n"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "n"))))
    as_map = lambda kind: F.when(F.size(listed(kind)) > 0, F.map_from_entries(listed(kind)))
    total = counted.groupBy("path").agg(
        of("sample").alias("samples"), F.when(of("told") > 0, F.coalesce(of("sync"), F.lit(0))).alias("sync_samples"), F.when(of("sample") > 0, F.coalesce(of("broken"), F.lit(0))).alias("broken"),
        as_map("unit").alias("units"), as_map("frame").alias("frames"), of("shown").alias("shown"),
    )
    last = sequence_headers(whole).groupBy("path").agg(F.max_by(F.struct("profile", "width", "height", "bit_depth"), F.struct("sample_index", "obu_index")).alias("s"))
    return known.select("path", "format").join(total, "path", "left").join(last.select("path", "s.*"), "path", "left")


def lines(rows: DataFrame, detailed: int = DETAILED, units: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """(path, place, line): the report as text, by place: the file, its headers, its first samples with their units, its damage.

    units and told: what file_units(rows) and summary(rows) gave, where they are at hand.
    """
    units = file_units(rows) if units is None else units
    told = summary(rows, units) if told is None else told
    counts = lambda name: F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))), ", ")
    place = lambda *of: F.struct(*[(F.lit(x) if isinstance(x, int) else F.col(x)).cast("int").alias(n) for x, n in zip(of, "abc")])
    said = [
        told.select("path", place(0, 0, 0).alias("place"), F.concat(F.lit("format "), "format").alias("line")),
        told.where("profile is not null").select("path", place(1, 0, 0).alias("place"), F.format_string("sequence: profile %d, %d x %d, %d bits", "profile", "width", "height", "bit_depth").alias("line")),
        told.where("samples is not null").select("path", place(2, 0, 0).alias("place"), F.concat(F.format_string("samples %d", "samples"), F.when(F.col("sync_samples").isNotNull(), F.format_string(", sync %d", "sync_samples")).otherwise("")).alias("line")),
        told.where("units is not null").select("path", place(3, 0, 0).alias("place"), F.concat(F.lit("units: "), counts("units")).alias("line")),
        told.where("frames is not null").select("path", place(4, 0, 0).alias("place"), F.concat(F.lit("frames: "), counts("frames")).alias("line")),
    ]
    names = F.create_map(*[F.lit(x) for pair in UNIT_NAMES.items() for x in pair])
    extended = F.when((F.col("temporal_id") > 0) | (F.col("spatial_id") > 0), F.format_string(" (temporal %d, spatial %d)", "temporal_id", "spatial_id")).otherwise("")
    listed = units.where(f"error is null and sample_index between 0 and {detailed - 1}")
    said.append(listed.select("path", place(5, "sample_index", "obu_index").alias("place"), F.concat(F.format_string("sample %d: ", "sample_index"), F.coalesce(names[F.col("obu_type")], F.lit("UNKNOWN")), F.format_string(", %d bytes", "size"), extended).alias("line")))
    said.append(units.where("error is not null").select("path", place(6, "sample_index", "obu_index").alias("place"), F.concat(F.format_string("sample %d is broken at %d: ", "sample_index", "error_offset"), "error").alias("line")))
    out = said[0]
    for part in said[1:]:
        out = out.unionByName(part)
    return out


def first_frames(frames: DataFrame, n: int) -> DataFrame:
    """The first n frames that are shown (frame_headers) of each file, hidden ones left out, numbered from 0 as shown_index."""
    order = W.partitionBy("path").orderBy("sample_index", "obu_index")
    return frames.where("show_frame").withColumn("shown_index", F.row_number().over(order) - 1).where(F.col("shown_index") < n)
