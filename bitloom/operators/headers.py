"""Sequence headers and the first fields of frame headers; syntax.py has whole frame headers and writers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bits import byte_at
from .syntax import Reader, sequence

SEQUENCE, FRAME_HEADER, FRAME = 1, 3, 6
#: Names of the frame types, by number.
FRAME_TYPES = ("KEY_FRAME", "INTER_FRAME", "INTRA_ONLY_FRAME", "SWITCH_FRAME")
SEQUENCE_FIELDS = (
    "profile int, still_picture boolean, reduced_still boolean, operating_points int, level int, width int, height int, superblock_128 boolean, "
    "filter_intra boolean, intra_edge_filter boolean, order_hint_bits int, superres boolean, cdef boolean, restoration boolean, bit_depth int, "
    "mono_chrome boolean, color_primaries int, transfer int, matrix int, full_range boolean, subsampling_x int, subsampling_y int, film_grain boolean, "
    "display_tick long, time_scale long, ticks_per_picture long, decoding_tick long, point_idcs array<int>, point_levels array<int>, point_tiers array<int>"
)


def _sequence(data: bytes) -> tuple:
    s = sequence(Reader(data))
    flags = lambda *names: [bool(s.get(x, 0)) for x in names]
    return (
        s["profile"], *flags("still_picture", "reduced_still"), len(s["levels"]), s["levels"][0], s["width"], s["height"],
        *flags("superblock_128", "filter_intra", "intra_edge_filter"), s["hint_bits"], *flags("superres", "cdef", "restoration"), s["depth"], *flags("mono"), *s["colors"],
        *flags("full"), s["x"], s["y"], *flags("film_grain"), s["tick"], s["scale"], s["per_picture"], s["decoding"], s["idcs"], s["levels"], s["tiers"],
    )


def sequence_headers(units: DataFrame) -> DataFrame:
    """The sequence headers among units, one row each; a header that ends too early gives no row."""
    names = ["path", "sample_index", "obu_index", *[x.split()[0] for x in SEQUENCE_FIELDS.split(", ")]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, sample, unit, data in part.itertuples(index=False):
                try:
                    rows.append((path, sample, unit, *_sequence(bytes(data))))
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("display_tick", "time_scale", "ticks_per_picture", "decoding_tick")})

    return units.where(F.col("obu_type") == SEQUENCE).select("path", "sample_index", "obu_index", "payload").mapInPandas(run, f"path string, sample_index int, obu_index int, {SEQUENCE_FIELDS}")


def frame_headers(units: DataFrame) -> DataFrame:
    """The first fields of frame headers, cut from the first byte by column expressions.

    A repeated frame has no type of its own. Units before the first sequence header of their file, and empty ones, are
    left out, as they cannot be read. Under a sequence header of the reduced form a frame header has none of these
    fields: it is a key frame that is shown.
    """
    order = W.partitionBy("path").orderBy("sample_index", "obu_index")
    head = F.when(F.col("obu_type") == SEQUENCE, byte_at(F.col("payload"), 0))
    active = F.last(head, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = units.where(F.col("obu_type").isin(SEQUENCE, FRAME_HEADER, FRAME)).withColumn("__active", active)
    rows = rows.where((F.col("obu_type") != SEQUENCE) & F.col("__active").isNotNull() & (F.octet_length("payload") > 0))
    # A reduced header stands for a byte that says: not repeated, key frame, shown.
    b = F.when(F.shiftright("__active", 3).bitwiseAND(1) == 1, F.lit(0x10)).otherwise(byte_at(F.col("payload"), 0))
    bit = lambda n: F.shiftright(b, n).bitwiseAND(1) == 1
    again, kind, shown = bit(7), F.shiftright(b, 5).bitwiseAND(3), bit(4)
    always: Column = (kind == 3) | ((kind == 0) & shown)
    return rows.select(
        "path",
        "sample_index",
        "obu_index",
        again.alias("show_existing"),
        F.when(again, F.shiftright(b, 4).bitwiseAND(7)).alias("shown_slot"),
        F.when(~again, kind).alias("frame_type"),
        F.when(~again, F.element_at(F.array(*map(F.lit, FRAME_TYPES)), kind + 1)).alias("frame_type_name"),
        (again | shown).alias("show_frame"),
        F.when(~again, F.when(shown, kind != 0).otherwise(bit(3))).alias("showable"),
        F.when(~again, always | F.when(shown, bit(3)).otherwise(bit(2))).alias("error_resilient"),
    )


def frame_histogram(frames: DataFrame) -> DataFrame:
    """Frames of each type in each file; repeated frames are a row of their own (null type)."""
    return frames.groupBy("path", "frame_type_name").count().orderBy("path", "frame_type_name")
