"""Whole sequence and frame headers: one walk through the fields serves for reading and for writing.

A walk asks its codec for one field after another. A Reader takes them from bytes, a Writer from a map of values; both
remember every field by name, so that what one has read the other can write. Frame headers depend on the eight slots
that earlier frames filled, so the frames from one shown key frame (which fills all slots) to the next are read in order
in one group; groups are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEQUENCE, FRAME_HEADER, FRAME = 1, 3, 6
KEY, INTER, INTRA_ONLY, SWITCH = range(4)
#: No header is longer than that: tiles, features, motion and delays together are below 5,000 bits.
HEADER_BYTES = 1024
NO_PRIMARY, SLOTS, REFS = 7, 8, 7
#: Fixed values of the format: a motion model that moves nothing, and the loop filter's first deltas.
IDENTITY = [0, 0, 1 << 16, 0, 0, 1 << 16]
FIRST_DELTAS = [1, 0, 0, 0, -1, 0, -1, -1, 0, 0]
#: Fixed values of the format: bits, sign and limit of each segment feature.
FEATURES = [(8, True, 255), (6, True, 63), (6, True, 63), (6, True, 63), (6, True, 63), (3, False, 7), (0, False, 0), (0, False, 0)]
#: Fixed values of the format: restoration by its two bits.
RESTORATIONS = ["NONE", "SWITCHABLE", "WIENER", "SGRPROJ"]


class Codec:
    """Codes of single fields, for both directions: raw(n, v) reads n bits or writes v in them."""

    values: dict[str, int]

    def raw(self, n: int, value: int) -> int:
        raise NotImplementedError

    def wanted(self, name: str) -> int:
        return 0

    def _keep(self, name: str, value: int) -> int:
        self.values[name] = value
        return value

    def f(self, name: str, n: int = 1) -> int:
        return self._keep(name, self.raw(n, self.wanted(name)))

    def su(self, name: str, n: int) -> int:
        v = self.raw(n, self.wanted(name) & ((1 << n) - 1))
        return self._keep(name, v - (1 << n) if v >> (n - 1) else v)

    def uvlc(self, name: str) -> int:
        x = self.wanted(name) + 1
        top, zeros = x.bit_length() - 1, 0
        while not self.raw(1, int(zeros == top)):
            zeros += 1
            if zeros == 32:
                raise ValueError(f"{name}: 32 zeros")
        return self._keep(name, (1 << zeros) - 1 + self.raw(zeros, x - (1 << top)))

    def _below(self, n: int, x: int) -> int:
        w = n.bit_length()
        m = (1 << w) - n
        v = self.raw(w - 1, x if x < m else (x + m) >> 1)
        return v if v < m else 2 * v - m + self.raw(1, (x + m) & 1)

    def ns(self, name: str, n: int) -> int:
        return self._keep(name, self._below(n, self.wanted(name)))

    def _exponential(self, n: int, x: int) -> int:
        low, bits = 0, 3
        while n > low + 3 * (1 << bits):
            if not self.raw(1, int(x >= low + (1 << bits))):
                return low + self.raw(bits, x - low)
            low, bits = low + (1 << bits), max(3, bits + (low > 0))
        return low + self._below(n - low, x - low)

    def near(self, name: str, limit: int, reference: int) -> int:
        """A number from -limit to limit that is likely near the reference."""
        r, x, n = reference + limit, self.wanted(name) + limit, 2 * limit + 1
        if turned := 2 * r > n:
            r, x = n - 1 - r, n - 1 - x
        v = self._exponential(n, x if x > 2 * r else 2 * (x - r) if x >= r else 2 * (r - x) - 1)
        x = v if v > 2 * r else r - (v + 1) // 2 if v & 1 else r + v // 2
        return self._keep(name, (n - 1 - x if turned else x) - limit)


class Reader(Codec):
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.values = data, 0, {}

    def raw(self, n: int, value: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise ValueError("out of data")
        word = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big") >> (-end % 8)
        self.at = end
        return word & ((1 << n) - 1)


class Writer(Codec):
    """Fields that the given map lacks are written as 0."""

    def __init__(self, given: dict[str, int]) -> None:
        self.given, self.values, self.number, self.at = given, {}, 0, 0

    def wanted(self, name: str) -> int:
        return self.given.get(name, 0)

    def raw(self, n: int, value: int) -> int:
        if not 0 <= value < 1 << n:
            raise ValueError(f"{value} does not fit in {n} bits")
        self.number, self.at = self.number << n | value, self.at + n
        return value

    def bytes(self, trailing: bool) -> bytes:
        """What was written, filled up with zeros; trailing: after a one."""
        number, n = (self.number << 1 | 1, self.at + 1) if trailing else (self.number, self.at)
        return (number << -n % 8).to_bytes((n + 7) // 8, "big")


def sequence(io: Codec) -> dict:
    """The fields of a sequence header and what follows from them."""
    f = io.f
    profile, _, reduced = f("profile", 3), f("still_picture"), f("reduced_still")
    s: dict = {"model": 0, "equal": 0, "time_bits": 0, "removal_bits": 0, "modelled": [], "idcs": [0], "levels": [], "tiers": [0], "hint_bits": 0, "id_bits": 0, "delta_bits": 0, "screen": 2, "integer": 2, "warped": 0, "ref_mvs": 0}
    s |= {"tick": None, "scale": None, "per_picture": None, "decoding": None}
    if reduced:
        s["levels"] = [f("level.0", 5)]
    else:
        delay_bits = 0
        if f("timing_present"):
            s["tick"], s["scale"] = f("display_tick", 32), f("time_scale", 32)
            if equal := f("equal_interval"):
                s["per_picture"] = io.uvlc("ticks_per_picture_less_1") + 1
            s["equal"], s["model"] = equal, f("model_present")
            if s["model"]:
                delay_bits, s["decoding"] = f("delay_bits_less_1", 5) + 1, f("decoding_tick", 32)
                s["removal_bits"], s["time_bits"] = f("removal_bits_less_1", 5) + 1, f("time_bits_less_1", 5) + 1
        display_delay, points = f("display_delay_present"), f("points_less_1", 5) + 1
        s["idcs"], s["tiers"] = [], []
        for i in range(points):
            s["idcs"].append(f(f"idc.{i}", 12))
            s["levels"].append(f(f"level.{i}", 5))
            s["tiers"].append(f(f"tier.{i}") if s["levels"][-1] > 7 else 0)
            s["modelled"].append(f(f"modelled.{i}") if s["model"] else 0)
            if s["modelled"][-1]:
                f(f"decoder_delay.{i}", delay_bits), f(f"encoder_delay.{i}", delay_bits), f(f"low_delay.{i}")
            if display_delay and f(f"display_delay_here.{i}"):
                f(f"display_delay_less_1.{i}", 4)
    s["width_bits"], s["height_bits"] = f("width_bits_less_1", 4) + 1, f("height_bits_less_1", 4) + 1
    s["width"], s["height"] = f("width_less_1", s["width_bits"]) + 1, f("height_less_1", s["height_bits"]) + 1
    if not reduced and f("ids_present"):
        s["delta_bits"] = f("delta_id_bits_less_2", 4) + 2
        s["id_bits"] = s["delta_bits"] + f("more_id_bits_less_1", 3) + 1
    f("superblock_128"), f("filter_intra"), f("intra_edge_filter")
    if not reduced:
        f("interintra"), f("masked")
        s["warped"] = f("warped")
        f("dual_filter")
        if hints := f("hints"):
            f("joint")
            s["ref_mvs"] = f("ref_mvs")
        s["screen"] = 2 if f("choose_screen") else f("force_screen")
        if s["screen"] and not f("choose_integer"):
            s["integer"] = f("force_integer")
        if hints:
            s["hint_bits"] = f("hint_bits_less_1", 3) + 1
    f("superres"), f("cdef"), f("restoration")
    s["depth"] = 8
    if f("high_depth"):
        s["depth"] = 12 if profile == 2 and f("twelve") else 10
    mono = s["mono"] = 0 if profile == 1 else f("mono_chrome")
    s["colors"] = (f("primaries", 8), f("transfer", 8), f("matrix", 8)) if f("colors_present") else (2, 2, 2)
    s["x"], s["y"], s["full"], s["separate"] = 1, 1, 1, 0
    if mono:
        s["full"] = f("full_range")
    elif s["colors"] == (1, 13, 0):
        s["x"], s["y"], s["separate"] = 0, 0, f("separate_uv")
    else:
        s["full"] = f("full_range")
        if profile == 1:
            s["x"], s["y"] = 0, 0
        elif profile == 2:
            s["x"] = f("subsampling_x") if s["depth"] == 12 else 1
            s["y"] = f("subsampling_y") if s["depth"] == 12 and s["x"] else 0
        if s["x"] and s["y"]:
            f("chroma_position", 2)
        s["separate"] = f("separate_uv")
    f("film_grain")
    return io.values | s


def distance(a: int, b: int, bits: int) -> int:
    """a - b on a clock of 2**bits ticks; 0 without a clock."""
    half = 1 << bits >> 1
    return ((a - b) & (half - 1)) - ((a - b) & half) if bits else 0


def assign_references(hints: list[int], hint: int, bits: int, last: int, golden: int) -> list[int]:
    """The slot of each of the seven references, from the slots of the first and the fourth.

    Frames ahead go to the last references (the latest, then the two earliest), frames behind to the others, latest
    first; what is left open gets the earliest of all. Each slot is given once; among equals the last slot is the
    latest and the first one the earliest.
    """
    far = [distance(x, hint, bits) for x in hints]
    given: dict[int, int] = {0: last, 3: golden}
    latest = lambda slots: max(slots, key=lambda i: (far[i], i))
    earliest = lambda slots: min(slots, key=lambda i: (far[i], i))
    ahead = [(6, latest), (4, earliest), (5, earliest)]
    behind = [(r, latest) for r in (1, 2, 4, 5, 6)]
    for side, choices in ((lambda x: x >= 0, ahead), (lambda x: x < 0, behind)):
        for reference, choose in choices:
            free = [i for i in range(SLOTS) if side(far[i]) and i not in given.values()]
            if free and reference not in given:
                given[reference] = choose(free)
    return [given.get(r, earliest(range(SLOTS))) for r in range(REFS)]


def _starts(io: Codec, s: dict, columns: int, rows: int) -> dict:
    """Where tiles begin, in units of four samples, with the end as the last number."""
    unit = 32 if s["superblock_128"] else 16
    across, down = -(-columns // unit), -(-rows // unit)
    log2 = lambda size, target: max(0, (-(-target // size) - 1).bit_length())
    widest, area = 4096 // (4 * unit), 4096 * 2304 // (4 * unit) ** 2
    least = log2(widest, across)

    def grown(name: str, low: int, high: int) -> int:
        while low < high and io.f(f"{name}.{low}"):
            low += 1
        return low

    def listed(name: str, total: int, most: int) -> list[int]:
        starts = [0]
        while starts[-1] < total:
            starts.append(starts[-1] + 1 + io.ns(f"{name}.{len(starts) - 1}", min(total - starts[-1], most)))
        return starts

    if io.f("uniform_tiles"):
        wide = grown("more_columns", least, min(6, log2(1, across)))
        high = grown("more_rows", max(max(least, log2(area, across * down)) - wide, 0), min(6, log2(1, down)))
        x, y = (list(range(0, n, -(-n >> k) or 1)) + [n] for n, k in ((across, wide), (down, high)))
    else:
        x = listed("tile_width_less_1", across, widest)
        total = across * down
        limit = total >> (max(least, log2(area, total)) + 1) if max(least, log2(area, total)) else total
        y = listed("tile_height_less_1", down, max(1, limit // max(b - a for a, b in zip(x, x[1:], strict=False))))
        wide, high = log2(1, len(x) - 1), log2(1, len(y) - 1)
    if wide or high:
        io.f("context_tile", wide + high), io.f("tile_size_bytes_less_1", 2)
    return {"tile_columns": [min(i * unit, columns) for i in x], "tile_rows": [min(i * unit, rows) for i in y]}


def _motion(io: Codec, previous: list[list[int]], precise: int) -> tuple[list[int], list[list[int]]]:
    """Kind (0 none, 1 shift, 2 rotation and zoom, 3 affine) and model of the motion against each reference."""
    kinds, models = [], []
    for r in range(REFS):
        model = list(IDENTITY)
        kind = 0 if not io.f(f"moves.{r}") else 2 if io.f(f"rotates.{r}") else 1 if io.f(f"shifts.{r}") else 3
        for i in [[], [0, 1], [2, 3, 0, 1], [2, 3, 4, 5, 0, 1]][kind]:
            bits, precision = (12, 15) if i > 1 else (12, 6) if kind > 1 else (8 + precise, 2 + precise)
            one = int(i in (2, 5))
            near = io.near(f"motion.{r}.{i}", 1 << bits, (previous[r][i] >> (16 - precision)) - (one << precision))
            model[i] = (near << (16 - precision)) + (one << 16)
            if kind == 2 and i == 3:
                model[4], model[5] = -model[3], model[2]
        kinds.append(kind)
        models.append(model)
    return kinds, models


def frame(io: Codec, s: dict, slots: list[dict | None]) -> dict:
    """The fields of a frame header and what follows from them; slots are filled as the frame asks.

    ValueError if the header ends early or needs a slot that nothing has filled; slots are then left as they were.
    Frames are taken as those of the base layer. Film grain, at the end of a header, is not walked.
    """
    f = io.f
    bits, reduced = s["hint_bits"], s["reduced_still"]

    def slot(i: int) -> dict:
        if slots[i] is None:
            raise ValueError(f"slot {i} is empty")
        return slots[i]

    if not reduced and f("show_existing"):
        i = f("shown_slot", 3)
        if s["model"] and not s["equal"]:
            f("presentation_time", s["time_bits"])
        if s["id_bits"]:
            f("display_id", s["id_bits"])
        held = slot(i)
        if held["frame_type"] == KEY:
            slots[:] = [held] * SLOTS
        return {"show_existing": True, "shown_slot": i, "show_frame": True, "frame_type": held["frame_type"], "order_hint": held["hint"]}
    kind, shown, resilient = KEY, 1, 1
    if not reduced:
        kind, shown = f("frame_type", 2), f("show_frame")
        if shown and s["model"] and not s["equal"]:
            f("presentation_time", s["time_bits"])
        if not shown:
            f("showable")
        resilient = 1 if kind == SWITCH or (kind == KEY and shown) else f("error_resilient")
    intra = kind in (KEY, INTRA_ONLY)
    still = f("disable_update")
    screen = f("allow_screen") if s["screen"] == 2 else s["screen"]
    integer = (f("integer_motion") if s["integer"] == 2 else s["integer"]) if screen else 0
    if s["id_bits"]:
        f("frame_id", s["id_bits"])
    other_size = 0 if reduced else 1 if kind == SWITCH else f("other_size")
    hint = f("order_hint", bits)
    primary = NO_PRIMARY if intra or resilient else f("primary_reference", 3)
    if s["model"] and f("removal_times"):
        for i, (modelled, layers) in enumerate(zip(s["modelled"], s["idcs"], strict=True)):
            if modelled and (not layers or layers & 0x101 == 0x101):
                f(f"removal_time.{i}", s["removal_bits"])
    refresh = 255 if kind == SWITCH or (kind == KEY and shown) else f("refresh", 8)
    if (not intra or refresh != 255) and resilient and bits:
        for i in range(SLOTS):
            f(f"slot_hint.{i}", bits)
    refs: list[int] = []
    size: dict = {}

    def scaled(width: int, height: int) -> None:
        denominator = 9 + f("denominator", 3) if s["superres"] and f("use_superres") else 8
        size.update(upscaled_width=width, height=height, width=(width * 8 + denominator // 2) // denominator)

    def sized() -> None:
        width, height = (f("frame_width_less_1", s["width_bits"]) + 1, f("frame_height_less_1", s["height_bits"]) + 1) if other_size else (s["width"], s["height"])
        scaled(width, height)
        other = f("other_render_size")
        size.update(render_width=f("render_width_less_1", 16) + 1 if other else width, render_height=f("render_height_less_1", 16) + 1 if other else height)

    precise, ref_mvs, copies = 0, 0, 0
    if intra:
        sized()
        copies = f("allow_copies") if screen and size["upscaled_width"] == size["width"] else 0
    else:
        if bits and f("short_references"):
            last, golden = f("last_slot", 3), f("golden_slot", 3)
            refs = assign_references([slot(i)["hint"] for i in range(SLOTS)], hint, bits, last, golden)
        short = bool(refs)
        for i in range(REFS):
            if not short:
                refs.append(f(f"reference.{i}", 3))
            if s["id_bits"]:
                f(f"delta_id_less_1.{i}", s["delta_bits"])
        found = next((r for i, r in enumerate(refs) if f(f"found_size.{i}")), None) if other_size and not resilient else None
        if found is None:
            sized()
        else:
            held = slot(found)
            size.update(render_width=held["render_width"], render_height=held["render_height"])
            scaled(held["upscaled_width"], held["height"])
        precise = 0 if integer else f("precise_motion")
        if not f("switchable_filter"):
            f("filter", 2)
        f("switchable_motion")
        ref_mvs = f("use_ref_mvs") if s["ref_mvs"] and not resilient else 0
    if not reduced and not still:
        f("disable_end_update")
    tiles = _starts(io, s, 2 * ((size["width"] + 7) >> 3), 2 * ((size["height"] + 7) >> 3))
    planes = 1 if s["mono"] else 3

    base, deltas = f("base_q", 8), []

    def delta(name: str) -> None:
        deltas.append(io.su(name, 7) if f(f"{name}.coded") else 0)

    delta("delta_y_dc")
    if planes > 1:
        apart = f("delta_v_apart") if s["separate"] else 0
        for name in ("delta_u_dc", "delta_u_ac", *(("delta_v_dc", "delta_v_ac") if apart else ())):
            delta(name)
    if f("matrices"):
        f("matrix_y", 4), f("matrix_u", 4)
        if s["separate"]:
            f("matrix_v", 4)
    past = slot(refs[primary]) if primary != NO_PRIMARY else {"features": {}, "filter_deltas": FIRST_DELTAS, "motion": [IDENTITY] * REFS}
    features: dict[tuple[int, int], int] = {}
    if f("segments"):
        features = past["features"]
        update = 1
        if primary != NO_PRIMARY:
            if f("update_map"):
                f("map_over_time")
            update = f("update_features")
        if update:
            features = {}
            for i in range(SLOTS):
                for j, (n, signed, limit) in enumerate(FEATURES):
                    if f(f"feature.{i}.{j}"):
                        name = f"feature_value.{i}.{j}"
                        features[i, j] = max(-limit, min(limit, io.su(name, n + 1) if signed else f(name, n)))
    changing = f("delta_q_present") if base else 0
    if changing:
        f("delta_q_step", 2)
        if not copies and f("delta_filter_present"):
            f("delta_filter_step", 2), f("delta_filter_multi")
    quantizers = [max(0, min(255, base + features.get((i, 0), 0))) for i in range(SLOTS)]
    lossless = not any(quantizers) and not any(deltas)
    filters, filter_deltas = [0, 0], list(FIRST_DELTAS)
    if not lossless and not copies:
        filters, filter_deltas = [f("filter_level.0", 6), f("filter_level.1", 6)], list(past["filter_deltas"])
        if planes > 1 and any(filters):
            filters += [f("filter_level.2", 6), f("filter_level.3", 6)]
        f("sharpness", 3)
        if f("filter_deltas") and f("update_filter_deltas"):
            for i in range(len(filter_deltas)):
                if f(f"update_delta.{i}"):
                    filter_deltas[i] = io.su(f"filter_delta.{i}", 7)
    strengths: list[list[int]] = []
    if not lossless and not copies and s["cdef"]:
        f("damping_less_3", 2)
        for i in range(1 << f("cdef_bits", 2)):
            pairs = [(f(f"primary.{i}.{p}", 4), f(f"secondary.{i}.{p}", 2)) for p in range(min(planes, 2))]
            strengths.append([x for a, b in pairs for x in (a, b + (b == 3))])
    restorations, restoration_units = [], []
    if not (lossless and size["width"] == size["upscaled_width"]) and not copies and s["restoration"]:
        restorations = [RESTORATIONS[f(f"restoration.{p}", 2)] for p in range(planes)]
        if set(restorations) != {"NONE"}:
            shift = f("larger_units")
            if s["superblock_128"]:
                shift += 1
            elif shift:
                shift += f("largest_units")
            chroma = f("smaller_chroma_units") if s["x"] and s["y"] and set(restorations[1:]) - {"NONE"} else 0
            restoration_units = [64 << shift, *[64 << shift >> chroma] * (planes - 1)]
    mode = "ONLY_4X4" if lossless else "SELECT" if f("select_transform") else "LARGEST"
    both = 0 if intra else f("two_references")
    skipped = None
    if both and bits:
        apart = [distance(slot(r)["hint"], hint, bits) for r in refs]
        before, after = sorted({x for x in apart if x < 0}), [x for x in apart if x > 0]
        pair = [before[-1], min(after)] if before and after else before[-2:]
        if len(pair) == 2 and f("skip_mode"):
            skipped = sorted(apart.index(x) for x in pair)
    if not intra and not resilient and s["warped"]:
        f("allow_warped")
    f("reduced_transforms")
    kinds, models = ([0] * REFS, [IDENTITY] * REFS) if intra else _motion(io, past["motion"], precise)
    held = size | {"hint": hint, "frame_type": kind, "features": features, "filter_deltas": filter_deltas, "motion": models}
    for i in range(SLOTS):
        if refresh >> i & 1:
            slots[i] = held
    return {
        "show_existing": False, "frame_type": kind, "show_frame": bool(shown), "error_resilient": bool(resilient), "order_hint": hint, "primary_reference": primary, "refresh": refresh,
        "references": refs, **size, **tiles, "base_q": base, "lossless": lossless, "filter_levels": filters, "filter_deltas": filter_deltas, "cdef_strengths": strengths,
        "restorations": restorations, "restoration_units": restoration_units, "transform_mode": mode, "skip_references": skipped, "motion_kinds": kinds, "motion_models": models,
    }


_INT, _INTS = pa.int32(), pa.list_(pa.int32())
FIELDS = pa.map_(pa.string(), pa.int64())
PLACE = [("path", pa.string()), ("sample_index", _INT), ("obu_index", _INT)]
#: Columns of full_frame_headers, as Spark and as Arrow know them.
HEADER = [
    *PLACE, ("run", pa.int64()), ("show_existing", pa.bool_()), ("shown_slot", _INT), ("frame_type", _INT), ("show_frame", pa.bool_()), ("error_resilient", pa.bool_()), ("order_hint", _INT),
    ("primary_reference", _INT), ("refresh", _INT), ("references", _INTS), ("width", _INT), ("height", _INT), ("upscaled_width", _INT), ("render_width", _INT), ("render_height", _INT),
    ("tile_columns", _INTS), ("tile_rows", _INTS), ("base_q", _INT), ("lossless", pa.bool_()), ("filter_levels", _INTS), ("filter_deltas", _INTS), ("cdef_strengths", pa.list_(_INTS)),
    ("restorations", pa.list_(pa.string())), ("restoration_units", _INTS), ("transform_mode", pa.string()), ("skip_references", _INTS), ("motion_kinds", _INTS), ("motion_models", pa.list_(_INTS)),
    ("header_bits", _INT), ("fields", FIELDS), ("sequence_fields", FIELDS), ("error", pa.string()),
]


def _ddl(columns: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.string(): "string", _INT: "int", pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary", _INTS: "array<int>", pa.list_(_INTS): "array<array<int>>", pa.list_(pa.string()): "array<string>", FIELDS: "map<string,bigint>"}
    return ", ".join(f"`{name}` {names[kind]}" for name, kind in columns)


def _in_order(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: (r["sample_index"], r["obu_index"]))


def full_frame_headers(units: DataFrame) -> DataFrame:
    """Every field of the frame headers among units (columns of media.units), one row each.

    `fields` and `sequence_fields` hold the fields as they are coded, by name; the other columns hold what follows from
    them and from the slots. Frames before the first sequence header of their file are left out. A header that ends
    early or needs an empty slot gives a row with `error`, and fills no slot. Only the first HEADER_BYTES of a payload
    are moved. A group holds the headers from one shown key frame to the next (`run` counts them in each file); a file
    without any is one group. Empty input: no rows.
    """
    order = W.partitionBy("path").orderBy("sample_index", "obu_index")
    head = F.substring("payload", 1, HEADER_BYTES)
    rows = units.where(F.col("obu_type").isin(SEQUENCE, FRAME_HEADER, FRAME)).select("path", "sample_index", "obu_index", "obu_type", head.alias("head"))
    rows = rows.withColumn("active", F.last(F.when(F.col("obu_type") == SEQUENCE, F.col("head")), ignorenulls=True).over(order))
    rows = rows.where((F.col("obu_type") != SEQUENCE) & F.col("active").isNotNull())
    byte = lambda c: F.coalesce(F.conv(F.hex(F.substring(c, 1, 1)), 16, 10).cast("int"), F.lit(0))
    begins = (byte("active").bitwiseAND(8) == 8) | (byte("head").bitwiseAND(0xF0) == 0x10)
    rows = rows.withColumn("run", F.sum(begins.cast("long")).over(order))
    schema = pa.schema(HEADER)

    def read(table: pa.Table) -> pa.Table:
        slots: list[dict | None] = [None] * SLOTS
        out = []
        for r in _in_order(table):
            row = {c: r[c] for c in ("path", "sample_index", "obu_index", "run")}
            try:
                active, io = Reader(r["active"]), Reader(r["head"])
                row |= frame(io, sequence(active), slots) | {"header_bits": io.at, "fields": io.values, "sequence_fields": active.values}
            except ValueError as e:
                row["error"] = str(e)
            out.append(row)
        return pa.Table.from_pylist(out, schema=schema)

    return rows.select("path", "sample_index", "obu_index", "run", "head", "active").groupBy("path", "run").applyInArrow(read, _ddl(HEADER))


def frame_header_payloads(headers: DataFrame) -> DataFrame:
    """(path, sample_index, obu_index, payload): frame headers written from `fields`, `sequence_fields` and `run`.

    They are standalone headers: a one and zeros fill up the last byte. A field that the map lacks is written as 0;
    fields that do not fit, or slots that nothing has filled, give a null payload. Rows without fields are left out.
    """
    columns = [*PLACE, ("payload", pa.binary())]
    schema = pa.schema(columns)

    def write(table: pa.Table) -> pa.Table:
        slots: list[dict | None] = [None] * SLOTS
        out = []
        for r in _in_order(table):
            io = Writer(dict(r["fields"]))
            try:
                frame(io, sequence(Writer(dict(r["sequence_fields"]))), slots)
                data = io.bytes(trailing=True)
            except ValueError:
                data = None
            out.append({c: r[c] for c, _ in PLACE} | {"payload": data})
        return pa.Table.from_pylist(out, schema=schema)

    rows = headers.where("fields is not null and sequence_fields is not null")
    return rows.select("path", "sample_index", "obu_index", "run", "fields", "sequence_fields").groupBy("path", "run").applyInArrow(write, _ddl(columns))


def _each_row(rows: DataFrame, source: str, target: str, kind: pa.DataType, convert: Callable) -> DataFrame:
    columns = [*PLACE, (target, kind)]
    schema = pa.schema(columns)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c, _ in PLACE} | {target: convert(r[source])} for r in batch.to_pylist()], schema=schema)

    return rows.select("path", "sample_index", "obu_index", source).mapInArrow(run, _ddl(columns))


def sequence_fields(units: DataFrame) -> DataFrame:
    """(path, sample_index, obu_index, fields): the sequence headers among units; null fields if one ends early."""

    def read(data: bytes) -> dict | None:
        io = Reader(data)
        try:
            sequence(io)
        except ValueError:
            return None
        return io.values

    return _each_row(units.where(F.col("obu_type") == SEQUENCE), "payload", "fields", FIELDS, read)


def sequence_payloads(rows: DataFrame) -> DataFrame:
    """(path, sample_index, obu_index, payload): sequence headers written from `fields`; null if one does not fit."""

    def write(fields: list | None) -> bytes | None:
        io = Writer(dict(fields or ()))
        try:
            sequence(io)
            return io.bytes(trailing=True)
        except ValueError:
            return None

    return _each_row(rows.where("fields is not null"), "fields", "payload", pa.binary(), write)


def tiles(headers: DataFrame) -> DataFrame:
    """The tiles of each frame: their row and column, where they begin and end in units of four samples."""
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.get(c, i - 1).alias("from"), F.get(c, i).alias("to")))
    rows = headers.where("tile_columns is not null").select("path", "sample_index", "obu_index", F.posexplode(ends(F.col("tile_rows"))).alias("tile_row", "y"), "tile_columns")
    rows = rows.select("path", "sample_index", "obu_index", "tile_row", "y", F.posexplode(ends(F.col("tile_columns"))).alias("tile_column", "x"))
    return rows.select("path", "sample_index", "obu_index", "tile_row", "tile_column", F.col("y.from").alias("row_start"), F.col("y.to").alias("row_end"), F.col("x.from").alias("column_start"), F.col("x.to").alias("column_end"))
