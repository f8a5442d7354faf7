"""Blocks on a grid of cells: masks of matching neighbours, partition of areas into blocks, affine fits, generated masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a wedge fades over its border, on straight, even and odd lines.
BORDERS = {"straight": (0, 2, 7, 21, 43, 57, 62, 64), "even": (1, 4, 11, 27, 46, 58, 62, 63), "odd": (1, 2, 6, 18, 37, 53, 60, 63)}
#: Directions of wedges, and of the sixteen wedges of a shape their direction and where they lie, in eighths.
HORIZONTAL, VERTICAL, OBLIQUE27, OBLIQUE63, OBLIQUE117, OBLIQUE153 = range(6)
_OBLIQUE = ((OBLIQUE27, 4, 4), (OBLIQUE63, 4, 4), (OBLIQUE117, 4, 4), (OBLIQUE153, 4, 4))
_SHIFTED = ((OBLIQUE27, 4, 2), (OBLIQUE27, 4, 6), (OBLIQUE153, 4, 2), (OBLIQUE153, 4, 6), (OBLIQUE63, 2, 4), (OBLIQUE63, 6, 4), (OBLIQUE117, 2, 4), (OBLIQUE117, 6, 4))
WEDGES = {
    "tall": (*_OBLIQUE, (HORIZONTAL, 4, 2), (HORIZONTAL, 4, 4), (HORIZONTAL, 4, 6), (VERTICAL, 4, 4), *_SHIFTED),
    "wide": (*_OBLIQUE, (VERTICAL, 2, 4), (VERTICAL, 4, 4), (VERTICAL, 6, 4), (HORIZONTAL, 4, 4), *_SHIFTED),
    "square": (*_OBLIQUE, (HORIZONTAL, 4, 2), (HORIZONTAL, 4, 6), (VERTICAL, 2, 4), (VERTICAL, 6, 4), *_SHIFTED),
}
#: Which of the sixteen are turned over, by width and height.
TURNED = {(32, 32): 0x7BFB, (32, 16): 0x7BEB, (32, 8): 0x6BEB, (16, 32): 0x7BEB, (16, 16): 0x7BFB, (16, 8): 0x7BEB, (8, 32): 0x7AEB, (8, 16): 0x7BEB, (8, 8): 0x7BFB}
#: The slope of an angle of so many degrees.
SLOPES = {
    3: 1023, 6: 547, 9: 372, 14: 273, 17: 215, 20: 178, 23: 151, 26: 132, 29: 116, 32: 102, 36: 90, 39: 80, 42: 71, 45: 64,
    48: 57, 51: 51, 54: 45, 58: 40, 61: 35, 64: 31, 67: 27, 70: 23, 73: 19, 76: 15, 81: 11, 84: 7, 87: 3,
}
#: Squares that one task splits, about.
ROOTS = 16_384


def neighbour_masks(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """blocks with above_mask, left_mask (long) and overlappable (boolean).

    blocks: block_id, row, col, w, h (in cells, 32 at most) and ref; cells: row, col, ref, each cell once, ref 0 or less
    for cells without a reference. Bit k of a mask is set if the k-th cell along that edge has the block's ref; bit 32
    of left_mask stands for the corner above and left, bit 32 of above_mask for the one above and right (not of blocks
    32 cells wide or high). overlappable: a cell at an odd place along an edge has a reference. Cells beyond the grid
    do not exist. Edges are exploded and joined with cells by their place: no block meets cells that do not touch it.
    """
    along = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    edge = lambda side, row, col, bit: F.struct(F.lit(side).alias("side"), row.cast("long").alias("row"), col.cast("long").alias("col"), bit.cast("int").alias("bit"))
    row, col, w, h = (F.col(c) for c in ("row", "col", "w", "h"))
    above = F.transform(along(w), lambda k: edge("above", row - 1, col + k, k))
    left = F.transform(along(h), lambda k: edge("left", row + k, col - 1, k))
    corners = F.array(edge("left", row - 1, col - 1, F.lit(32)), edge("above", row - 1, col + w, F.when(F.greatest(w, h) < 32, 32)))
    touched = blocks.select("block_id", F.col("ref").alias("own"), F.explode(F.concat(above, left, corners)).alias("e")).where("e.bit is not null").select("block_id", "own", "e.*")
    met = touched.join(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "ref"), ["row", "col"])
    mask = lambda side: F.coalesce(F.bit_or(F.when((F.col("side") == side) & (F.col("ref") == F.col("own")), F.expr("shiftleft(1L, bit)"))), F.lit(0).cast("long"))
    over = F.coalesce(F.bool_or((F.col("bit") < 32) & (F.col("bit") % 2 == 1) & (F.col("ref") > 0)), F.lit(False))
    masks = met.groupBy("block_id").agg(mask("above").alias("above_mask"), mask("left").alias("left_mask"), over.alias("overlappable"))
    none = {"above_mask": 0, "left_mask": 0, "overlappable": False}
    return blocks.join(masks, "block_id", "left").fillna(none)


def partition_areas(roots: DataFrame, size: int, symbol) -> DataFrame:
    """roots exploded to their leaf blocks: row, col, w, h, and seen_w, seen_h (what lies within the area).

    roots: top, left (place of a square of size cells), rows, cols (of the area), and whatever else. symbol(root
    columns by name, row, col, size) gives 0 for a whole block, 1 for halves above one another, 2 for halves side by
    side, 3 for four quarters. A square whose lower half begins beyond the area is halved for 0 to 2; one whose right
    half does, likewise, side by side; where both do, it is quartered. What begins beyond the area is left out; a square
    of one cell is whole. Every level is one compiled step that turns a square into its parts, and leaves what is whole
    as it is: no lists of nodes, no recursion of plans. A root has many leaves, so roots are dealt out evenly first,
    ROOTS to a task; a table in one file would otherwise be one task.
    """
    names, place = roots.columns, ["__row", "__col", "__w", "__h", "__open"]
    rows, cols = F.col("rows"), F.col("cols")
    inside = (F.col("__row") < rows) & (F.col("__col") < cols)
    part = lambda row, col, w, h, open_: F.struct(*[x.alias(c) for x, c in zip((row, col, F.lit(w).cast("long"), F.lit(h).cast("long"), F.lit(open_)), place, strict=True)])

    found = roots.repartition(max(1, -(-roots.count() // ROOTS)))
    found = found.select(*names, F.col("top").cast("long").alias("__row"), F.col("left").cast("long").alias("__col"), F.lit(size).cast("long").alias("__w"), F.lit(size).cast("long").alias("__h"), F.lit(True).alias("__open")).where(inside)
    n = size
    while n > 1:
        half, row, col = n // 2, F.col("__row"), F.col("__col")
        below, beside, said = row + half < rows, col + half < cols, symbol(row, col, F.lit(n).cast("long"))
        kind = F.when(below & beside, said).when(beside, F.when(said == 3, 3).otherwise(1)).when(below, F.when(said == 3, 3).otherwise(2)).otherwise(3)
        k = F.col("__kind")
        parts = (
            F.when(~F.col("__open"), F.array(F.struct(*place)))
            .when(k == 0, F.array(part(row, col, n, n, False)))
            .when(k == 1, F.array(part(row, col, n, half, False), part(row + half, col, n, half, False)))
            .when(k == 2, F.array(part(row, col, half, n, False), part(row, col + half, half, n, False)))
            .when(k == 3, F.array(*[part(row + dy * half, col + dx * half, half, half, True) for dy in (0, 1) for dx in (0, 1)]))
        )
        found = found.withColumn("__kind", kind).select(*names, F.inline(parts)).where(inside)
        n = half
    seen_w, seen_h = F.least(F.col("__w"), cols - F.col("__col")), F.least(F.col("__h"), rows - F.col("__row"))
    return found.select(*names, F.col("__row").alias("row"), F.col("__col").alias("col"), F.col("__w").alias("w"), F.col("__h").alias("h"), seen_w.cast("long").alias("seen_w"), seen_h.cast("long").alias("seen_h"))


def affine_fit(samples: DataFrame) -> DataFrame:
    """(block_id, n, m0 to m5, alpha, beta, gamma, delta, valid): the least-squares affine motion of each block.

    samples: block_id, nth (their order), sx, sy (from), dx, dy (to), mv_x, mv_y, w, h, at_x, at_y (the block's motion, size
    and place in cells), coordinates below 2^10. The first eight of a block count; of these, those whose motion differs
    from the block's by more than four times its longer side (4 to 28), save the first if none is left. The normal
    equations are summed in whole numbers and solved by a fixed-point reciprocal of the determinant. Without a solution
    m0 to delta are null; valid also wants a shear that is small enough.
    """
    signed = lambda v, n: f"(if({v} < 0, -1, 1) * shiftright(abs({v}) + shiftright(shiftleft(1L, {n}), 1), {n}))"
    clip = lambda v, low, high: f"greatest({low}, least({high}, {v}))"
    coarse = lambda v: f"(if({v} < 0, -1, 1) * shiftleft(shiftright(abs({clip(v, -32768, 32767)}) + 32, 6), 6))"
    # The reciprocal of d: eight bits below its leading one choose 2^22 / (256 + f).
    exponent = lambda d: f"(length(bin({d})) - 1)"
    part = lambda d: f"least(256, if({exponent(d)} > 8, shiftright({d} - shiftleft(1L, {exponent(d)}) + shiftleft(1L, greatest(0, {exponent(d)} - 9)), greatest(0, {exponent(d)} - 8)), shiftleft({d} - shiftleft(1L, {exponent(d)}), greatest(0, 8 - {exponent(d)}))))"
    reciprocal = lambda d: f"((4194304 + shiftright(256 + {part(d)}, 1)) div (256 + {part(d)}))"
    rows = samples.sparkSession.sql(f"""
        with firsts as (select *, row_number() over (partition by block_id order by nth) as k from {{samples}}),
        near as (select *, abs(dx - sx - mv_x) + abs(dy - sy - mv_y) <= 4 * {clip('greatest(w, h)', 4, 28)} as near from firsts where k <= 8),
        kept as (select * from (select *, max(near) over (partition by block_id) as some from near) where near or (not some and k = 1)),
        placed as (select *, sx - 8 * (2 * w - 1) as x, sy - 8 * (2 * h - 1) as y, dx - 8 * (2 * w - 1) - mv_x as u, dy - 8 * (2 * h - 1) - mv_y as v from kept),
        summed as (
            select block_id, count(*) as n, first(mv_x) as mv_x, first(mv_y) as mv_y, first(at_x * 4 + 2 * w - 1) as cx, first(at_y * 4 + 2 * h - 1) as cy,
                coalesce(sum(shiftright(x * x, 2) + 2 * x + 8) filter (where ok), 0) as a00, coalesce(sum(shiftright(x * y, 2) + x + y + 4) filter (where ok), 0) as a01, coalesce(sum(shiftright(y * y, 2) + 2 * y + 8) filter (where ok), 0) as a11,
                coalesce(sum(shiftright(x * u, 2) + x + u + 8) filter (where ok), 0) as bx0, coalesce(sum(shiftright(y * u, 2) + y + u + 4) filter (where ok), 0) as bx1,
                coalesce(sum(shiftright(x * v, 2) + x + v + 4) filter (where ok), 0) as by0, coalesce(sum(shiftright(y * v, 2) + y + v + 8) filter (where ok), 0) as by1
            from (select *, abs(x - u) < 256 and abs(y - v) < 256 as ok from placed) group by block_id
        ),
        det as (select *, a00 * a11 - a01 * a01 as det from summed),
        inv as (select *, if(det < 0, -1, 1) * {reciprocal('abs(det)')} as r, {exponent('abs(det)')} - 2 as s from det where det <> 0),
        scaled as (select *, if(s < 0, r * shiftleft(1L, greatest(0, -s)), r) as i, greatest(0, s) as e from inv),
        solved as (
            select *, {clip(signed('((a11 * bx0 - a01 * bx1) * i)', 'e'), 0xE001, 0x11FFF)} as m2, {clip(signed('((a00 * bx1 - a01 * bx0) * i)', 'e'), -0x1FFF, 0x1FFF)} as m3,
                {clip(signed('((a11 * by0 - a01 * by1) * i)', 'e'), -0x1FFF, 0x1FFF)} as m4, {clip(signed('((a00 * by1 - a01 * by0) * i)', 'e'), 0xE001, 0x11FFF)} as m5 from scaled
        ),
        moved as (
            select *, {clip('mv_x * 8192 - (cx * (m2 - 65536) + cy * m3)', -0x800000, 0x7FFFFF)} as m0, {clip('mv_y * 8192 - (cx * m4 + cy * (m5 - 65536))', -0x800000, 0x7FFFFF)} as m1,
                {reciprocal('m2')} as q, {exponent('m2')} + 14 as z from solved
        ),
        shear as (
            select *, {coarse('(m2 - 65536)')} as alpha, {coarse('m3')} as beta, {coarse(signed('(m4 * 65536 * q)', 'z'))} as gamma,
                {coarse(f"(m5 - {signed('(m3 * m4 * q)', 'z')} - 65536)")} as delta from moved
        )
        select d.block_id, d.n, m0, m1, m2, m3, m4, m5, alpha, beta, gamma, delta, coalesce(4 * abs(alpha) + 7 * abs(beta) < 65536 and 4 * abs(gamma) + 4 * abs(delta) < 65536, false) as valid
        from det d left join shear s on d.block_id = s.block_id""", samples=samples)
    return rows.select("block_id", *[F.col(c).cast("long").alias(c) for c in ("n", "m0", "m1", "m2", "m3", "m4", "m5", "alpha", "beta", "gamma", "delta")], "valid")


def wedge_masks(spark: SparkSession) -> DataFrame:
    """(w, h, nth, x, y, weight): the weights, 0 to 64, of all wedges of all shapes; a dimension table of fixed size.

    A wedge is a straight border that fades over eight samples, vertical or inclined by one sample every two lines, and
    its turns and mirror images; a mask is a window of it.
    """
    shapes = [(w, h, k, *(WEDGES["tall" if h > w else "wide" if h < w else "square"][k]), turned >> k & 1) for (w, h), turned in TURNED.items() for k in range(16)]
    rows = spark.createDataFrame(shapes, "w int, h int, nth int, direction int, dx int, dy int, turned int")
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    x, y = 32 - F.shiftright(F.col("w") * F.col("dx"), 3) + F.col("x"), 32 - F.shiftright(F.col("h") * F.col("dy"), 3) + F.col("y")
    way = F.col("direction")
    across = F.when(way.isin(HORIZONTAL, OBLIQUE27), y).when(way == OBLIQUE153, y).when(way == OBLIQUE117, 63 - x).otherwise(x)
    down = F.when(way.isin(HORIZONTAL, OBLIQUE27), x).when(way == OBLIQUE153, 63 - x).otherwise(y)
    straight = way.isin(HORIZONTAL, VERTICAL)
    centre = F.when(straight, 32).otherwise(48 - F.floor(down / 2) - down % 2)
    at = (across - centre + 4).cast("int")
    border = F.when(straight, F.lit(list(BORDERS["straight"]))).when(down % 2 == 0, F.lit(list(BORDERS["even"]))).otherwise(F.lit(list(BORDERS["odd"])))
    weight = F.when(at < 0, 0).when(at > 7, 64).otherwise(F.get(border, at))
    return rows.select("w", "h", "nth", "x", "y", F.when(F.col("turned") == 1, 64 - weight).otherwise(weight).cast("int").alias("weight"))


def slope_table(spark: SparkSession) -> DataFrame:
    """(angle, dx, dy): the slopes of all angles from 1 to 269 degrees, 0 where a direction has none; of fixed size.

    An odd angle counts as the even one below it where the table has neither.
    """

    def slope(angle: int) -> int:
        return next((SLOPES[a] for a in (2 * (angle // 2), 2 * (angle // 2) + 1) if a in SLOPES), 0)

    rows = [(a, slope(a) if a < 90 else slope(180 - a) if 90 < a < 180 else 0, slope(a - 90) if 90 < a < 180 else slope(270 - a) if a > 180 else 0) for a in range(1, 270)]
    return spark.createDataFrame(rows, "angle int, dx int, dy int")


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    """rows with the columns of a dimension table of most rows at most, broadcast; a larger table is joined by shuffling."""
    small = len(table.limit(most + 1).collect()) <= most
    return rows.join(F.broadcast(table) if small else table, keys, "left")
