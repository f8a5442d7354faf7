"""Rules over rows: the first one that a row breaks, and counters of all of them in the pass that writes the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: name -> what holds of a valid row, in the order in which they are asked; a null answer counts as broken.
Rules = dict[str, Column]

#: Types of record units, bit depths, and the numbers of profiles and pixel formats.
UNIT_TYPES, DEPTHS = (1, 2, 3, 4, 5, 6, 7, 8, 15), (8, 10, 12)
MAIN, HIGH, PROFESSIONAL = range(3)
YUV420, YUV422, YUV444, MONOCHROME = range(4)
CONSTANT_QUALITY = 0

#: What a session starts from, where its settings say nothing.
DEFAULTS = {
    "profile": MAIN, "bit_depth": 8, "rate_num": 30, "rate_den": 1, "pixel_format": YUV420, "rate_control": CONSTANT_QUALITY, "qp": 32, "bitrate": 0, "speed": 4,
    "key_interval": 240, "tile_columns": 0, "tile_rows": 0, "lag": 19, "cdef": True, "restoration": True, "super_res": False, "large_blocks": True,
    "primaries": 1, "transfer": 1, "matrix": 1, "full_range": False, "still": False, "grain": False,
}


def first_violation(rules: Rules) -> Column:
    """The name of the first rule that a row breaks; null if it breaks none."""
    said = F.array(*[F.struct(F.coalesce(~holds, F.lit(True)).alias("broken"), F.lit(name).alias("name")) for name, holds in rules.items()])
    return F.get(F.filter(said, lambda r: r["broken"]), F.lit(0))["name"]


def audited(rows: DataFrame, rules: Rules, name: str) -> tuple[DataFrame, Observation]:
    """rows as they are, and what counts, while they pass, all of them (rows) and those that break each rule (by its name).

    The counters are there after the first action on the rows that are returned; they cost no pass of their own.
    """
    seen = Observation(name)
    broken = [F.count_if(F.coalesce(~holds, F.lit(True))).alias(rule) for rule, holds in rules.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *broken), seen


def unit_rules() -> Rules:
    """Rules of record units: obu_type, temporal_id, spatial_id, extended, size, payload."""
    c = F.col
    return {
        "type is known": c("obu_type").isin(*UNIT_TYPES),
        "extension is there": ~c("extended") | (c("temporal_id").isNotNull() & c("spatial_id").isNotNull()),
        "temporal id has three bits": ~c("extended") | c("temporal_id").between(0, 7),
        "spatial id has two bits": ~c("extended") | c("spatial_id").between(0, 3),
        "size is the payload's": c("size") == F.octet_length("payload"),
    }


def sequence_rules() -> Rules:
    """Rules of sequence headers: profile, still, reduced, points, stated_points, timing_present, timing, model_present, model, and width and height with the bits they are written in."""
    c = F.col
    fits = lambda value, bits: F.length(F.bin(c(value))) - F.when(c(value) == 0, 1).otherwise(0) <= c(bits)
    return {
        "profile is 0 to 2": c("profile").between(0, 2),
        "reduced headers are of still pictures": ~c("reduced") | c("still"),
        "there is an operating point": c("points") >= 1,
        "reduced headers have no timing": ~c("reduced") | ~c("timing_present"),
        "all operating points are there": c("reduced") | (c("points") >= c("stated_points")),
        "timing is there": ~c("timing_present") | c("timing").isNotNull(),
        "decoder model is there": ~c("model_present") | c("model").isNotNull(),
        "width fits its bits": fits("max_width_minus_1", "width_bits"),
        "height fits its bits": fits("max_height_minus_1", "height_bits"),
    }


def settings_rules() -> Rules:
    """Rules of a session's settings (columns of DEFAULTS, width and height)."""
    c = F.col
    return {
        "width and height are above 0": (c("width") > 0) & (c("height") > 0),
        "width and height are at most 65536": (c("width") <= 65536) & (c("height") <= 65536),
        "bit depth is 8, 10 or 12": c("bit_depth").isin(*DEPTHS),
        "profile is 0 to 2": c("profile").between(0, 2),
        "main and high have no 12 bits": (c("profile") == PROFESSIONAL) | (c("bit_depth") != 12),
        "main is 4:2:0 or monochrome": (c("profile") != MAIN) | c("pixel_format").isin(YUV420, MONOCHROME),
        "high is 4:4:4": (c("profile") != HIGH) | (c("pixel_format") == YUV444),
        "rate is above 0": (c("rate_num") > 0) & (c("rate_den") > 0),
        "quantizer is 0 to 63": c("qp").between(0, 63),
        "speed is 0 to 6": c("speed").between(0, 6),
        "tile columns are 0 to 6": c("tile_columns").between(0, 6),
        "tile rows are 0 to 6": c("tile_rows").between(0, 6),
        "lag is 0 or more": c("lag") >= 0,
        "bitrate is 0 or more": c("bitrate") >= 0,
        "constant and variable rates have a bitrate": (c("rate_control") == CONSTANT_QUALITY) | (c("bitrate") > 0),
    }


def with_defaults(settings: DataFrame) -> DataFrame:
    """settings (width, height and any columns of DEFAULTS) with every column of DEFAULTS; missing and null ones are filled."""
    there = set(settings.columns)
    return settings.select(*[c for c in settings.columns if c not in DEFAULTS], *[(F.coalesce(F.col(k), F.lit(v)) if k in there else F.lit(v)).alias(k) for k, v in DEFAULTS.items()])


def sequence_of(settings: DataFrame) -> DataFrame:
    """settings (see with_defaults) with sequence: a struct of what their sequence header says."""
    c = F.col
    sub = lambda *formats: F.when(c("pixel_format").isin(*formats), 1).otherwise(0)
    timing = F.when(~c("still"), F.struct(c("rate_den").alias("units_in_tick"), c("rate_num").alias("time_scale"), F.lit(True).alias("equal_intervals"), F.lit(1).alias("ticks_per_picture")))
    bits = lambda x: F.greatest(F.lit(1), F.length(F.bin(c(x) - 1)))
    said = F.struct(
        c("profile"), c("still"), c("still").alias("reduced"), (c("width") - 1).alias("max_width_minus_1"), (c("height") - 1).alias("max_height_minus_1"), bits("width").alias("width_bits"), bits("height").alias("height_bits"),
        c("large_blocks"), c("cdef"), c("restoration"), c("super_res"), c("grain"), (c("bit_depth") >= 10).alias("high_bit_depth"), (c("bit_depth") == 12).alias("twelve_bit"),
        (c("pixel_format") == MONOCHROME).alias("mono_chrome"), sub(YUV420, YUV422, MONOCHROME).alias("subsampling_x"), sub(YUV420, MONOCHROME).alias("subsampling_y"),
        c("primaries"), c("transfer"), c("matrix"), c("full_range"), timing.alias("timing"),
    )
    return settings.withColumn("sequence", said)


def wedge_allowed(w: Column, h: Column) -> Column:
    """Blocks of 8 to 32 samples a side may be joined along a wedge."""
    return w.isin(8, 16, 32) & h.isin(8, 16, 32)


def inter_intra_allowed(w: Column, h: Column) -> Column:
    """The same but for sides of one to four."""
    return wedge_allowed(w, h) & (F.greatest(w, h) <= 2 * F.least(w, h))


def coded_lossless(base: Column, deltas: Column) -> Column:
    """A quantizer of 0 without any offset."""
    return (base == 0) & ~F.exists(deltas, lambda d: d != 0)
