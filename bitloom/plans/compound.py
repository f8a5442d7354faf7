"""Table queries that call the library's operators: interval joins, composed folds, grids, rules, writers and readers.

Each query has an oracle from its operator's definition: joins by inequality, folds one row after another, brute force
over cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import grids, intervals, rules, scans
from ..sources import media, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str):
    def known(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__], ORACLES[run.__name__] = run, oracle
        return run

    return known


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day() -> Column:
    """The day of an event, as a number."""
    return F.datediff(F.to_date("ts"), F.lit("1970-01-01"))


def _delta() -> Column:
    """What an event adds to a level."""
    return F.floor("value").cast("long") % 41 - 20


@_query("""with runs as (select p_partkey % 16 as track, p_partkey as a, lead(p_partkey) over (partition by p_partkey % 16 order by p_partkey) as b, p_size from part where p_size >= 25)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(p_size as bigint) as samples_per_chunk, a as first_chunk from lineitem left join runs on l_partkey % 16 = track and l_partkey >= a and (b is null or l_partkey < b)""")
def stsc_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run begins with each part of size 25 or more and holds, on its track, until the next; lines take their part's run."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_partkey") % 16).alias("track"))
    runs = _table(spark, sf_dir, "part").where("p_size >= 25").select((F.col("p_partkey") % 16).alias("track"), F.col("p_size").cast("long").alias("samples_per_chunk"), F.col("p_partkey").alias("first_chunk"))
    return intervals.last_run_join(lines, runs, ["track"], "l_partkey", "first_chunk", 4096).drop("track")


@_query("""with h as (select event_type, list_reduce(list_prepend(cast(0 as hugeint), list(cast(event_id % 1000 as hugeint) order by ts, event_id)), lambda h, v: (h * 31 + v) % 18446744073709551616) as h from events group by event_type)
    select event_type, cast(case when h >= 9223372036854775808 then h - 18446744073709551616 else h end as bigint) as checksum from h""")
def ordered_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum h = 31 h + v modulo 2^64 over all events of a type, in order: few keys, each with much of the table."""
    events = _table(spark, sf_dir, "events")
    quarter_day = _day() * 4 + F.floor(F.hour("ts") / 6)
    return scans.fold(events, ["event_type"], ["ts", "event_id"], F.col("event_id") % 1000, scans.Polynomial(31), 0, quarter_day).select("event_type", F.col("value").alias("checksum"))


@_query("""select user_id, list_reduce(list_prepend(cast(128 as bigint), list(cast(floor(value) as bigint) % 41 - 20 order by ts, event_id)), lambda q, d: greatest(1, least(255, q + d))) as q from events group by user_id""")
def clamped_running_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level that all of a user's deltas move in turn, kept within 1 to 255."""
    week = F.floor(_day() / 7)
    return scans.fold(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], _delta(), scans.Clamped(1, 255), 128, week).select("user_id", F.col("value").alias("q"))


@_query("""with recursive n as (select event_type, event_id, cast(floor(value) as bigint) % 41 - 20 as d, row_number() over (partition by event_type order by ts, event_id) as k from events),
    walk(event_type, k, event_id, q) as (select event_type, k, event_id, greatest(1, least(255, 128 + d)) from n where k = 1 union all select n.event_type, n.k, n.event_id, greatest(1, least(255, q + d)) from walk w join n on n.event_type = w.event_type and n.k = w.k + 1)
    select event_id, q as level from walk""")
def clamped_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level after each event, its type being the key: few keys, each in as many tasks as it has days."""
    levels = scans.running(_table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], _delta(), scans.Clamped(1, 255), 128, _day(), ["event_id"])
    return levels.select("event_id", F.col("value").alias("level"))


@_query(
    "select user_id, cast(r[1] as int) as p0, cast(r[2] as int) as p1, cast(r[3] as int) as p2, cast(r[4] as int) as p3, cast(r[5] as int) as n from (select user_id, list_reduce(list_prepend([26215, 19661, 13108, 6554, 0], list([event_id * 7 % 5, 0, 0, 0, 0] order by ts, event_id)), lambda s, x: ["
    + ", ".join(f"case when {i} < x[1] then s[{i + 1}] + ((32768 - s[{i + 1}]) >> (5 + (s[5] >> 4))) else s[{i + 1}] - (s[{i + 1}] >> (5 + (s[5] >> 4))) end" for i in range(4))
    + ", least(32, s[5] + 1)]) as r from events group by user_id)"
)
def adaptive_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counts that adapt to each of a user's symbols."""
    return scans.adapted_counts(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_id") * 7 % 5, [26215, 19661, 13108, 6554])


_GRID = "(p_partkey - 1) // 128 as r, (p_partkey - 1) % 128 as c, p_size % 4 as ref"


@_query(f"""with cells as (select p_partkey, {_GRID} from part), sized as (select *, (r // 16) * 8 + c // 16 as s from cells),
    blocks as (select *, cast(power(2, s % 4) as bigint) as w, cast(power(2, s // 4 % 4) as bigint) as h from sized),
    kept as (select * from blocks where r % h = 0 and c % w = 0),
    met as (select b.p_partkey, x.c - b.c as k, 1 as above, x.ref, b.ref as own from kept b join cells x on x.r = b.r - 1 and x.c >= b.c and x.c < b.c + b.w
        union all select b.p_partkey, x.r - b.r, 0, x.ref, b.ref from kept b join cells x on x.c = b.c - 1 and x.r >= b.r and x.r < b.r + b.h
        union all select b.p_partkey, 32, 0, x.ref, b.ref from kept b join cells x on x.r = b.r - 1 and x.c = b.c - 1
        union all select b.p_partkey, 32, 1, x.ref, b.ref from kept b join cells x on x.r = b.r - 1 and x.c = b.c + b.w)
    select b.p_partkey as block_id, coalesce((select cast(sum(power(2, k)) as bigint) from met m where m.p_partkey = b.p_partkey and above = 1 and m.ref = own), 0) as above_mask,
        coalesce((select cast(sum(power(2, k)) as bigint) from met m where m.p_partkey = b.p_partkey and above = 0 and m.ref = own), 0) as left_mask,
        exists (select 1 from met m where m.p_partkey = b.p_partkey and k < 32 and k % 2 = 1 and m.ref > 0) as overlappable from kept b""")
def neighbour_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells of a grid 128 wide; blocks of 1 to 8 cells a side, a shape for each 16 by 16 cells."""
    part = _table(spark, sf_dir, "part").selectExpr("p_partkey as block_id", "(p_partkey - 1) div 128 as row", "(p_partkey - 1) % 128 as col", "p_size % 4 as ref")
    shape = part.withColumn("s", F.expr("row div 16 * 8 + col div 16")).selectExpr("*", "shiftleft(1, cast(s % 4 as int)) as w", "shiftleft(1, cast(s div 4 % 4 as int)) as h").where("row % h = 0 and col % w = 0")
    return grids.neighbour_masks(shape, part).select("block_id", "above_mask", "left_mask", "overlappable")


@_query("""with recursive areas as (select p_partkey as area, 1 + p_size as rows, 1 + p_partkey * 7 % 45 as cols from part),
    nodes(area, rows, cols, r, c, n) as (
        select area, rows, cols, cast(r as bigint), cast(c as bigint), cast(16 as bigint) from areas, (select unnest(range(0, 64, 16)) as r) x, (select unnest(range(0, 64, 16)) as c) y where r < rows and c < cols
        union all select area, rows, cols, r + dy * n // 2, c + dx * n // 2, n // 2 from nodes cross join (select unnest([0, 1]) as dx) a cross join (select unnest([0, 1]) as dy) b
            where n > 1 and ((r + n // 2 >= rows and c + n // 2 >= cols) or (area + 3 * r + 5 * c + n) % 4 = 3) and r + dy * n // 2 < rows and c + dx * n // 2 < cols
    ),
    judged as (select *, r + n // 2 < rows as below, c + n // 2 < cols as beside, (area + 3 * r + 5 * c + n) % 4 as s from nodes),
    kinds as (select *, case when n = 1 then 0 when below and beside then s when not below and not beside then 3 when s = 3 then 3 when beside then 1 else 2 end as k from judged),
    leaves as (
        select area, rows, cols, r, c, n as w, n as h from kinds where k = 0
        union all select area, rows, cols, r + d * n // 2, c, n, n // 2 from kinds cross join (select unnest([0, 1]) as d) x where k = 1
        union all select area, rows, cols, r, c + d * n // 2, n // 2, n from kinds cross join (select unnest([0, 1]) as d) x where k = 2
    )
    select area, r as row, c as col, w, h, least(w, cols - c) as seen_w, least(h, rows - r) as seen_h from leaves where r < rows and c < cols""")
def partition_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An area for each part, covered by squares of 16 cells that split by a rule of their place, and must at the borders."""
    areas = _table(spark, sf_dir, "part").selectExpr("p_partkey as area", "cast(1 + p_size as bigint) as rows", "1 + p_partkey * 7 % 45 as cols")
    starts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(16).cast("long")))
    roots = areas.withColumn("top", starts("rows")).withColumn("left", starts("cols"))
    return grids.partition_areas(roots, 16, lambda r, c, n: (F.col("area") + 3 * r + 5 * c + n) % 4).select("area", "row", "col", "w", "h", "seen_w", "seen_h")


_SAMPLES = """select l_partkey as block_id, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as nth, cast(l_linenumber * 9 as bigint) as sx, cast(l_quantity as bigint) as sy,
    l_linenumber * 9 + l_partkey % 9 - 4 + cast(l_quantity as bigint) {div} 8 as dx, cast(l_quantity as bigint) + l_partkey % 5 - 2 + (case when l_orderkey % 11 = 0 then 90 else l_orderkey % 3 end) as dy,
    l_partkey % 9 - 4 as mv_x, l_partkey % 5 - 2 as mv_y, 2 + 2 * (l_partkey % 3) as w, 2 + 2 * (l_partkey % 4) as h, l_partkey % 50 as at_x, l_partkey % 40 as at_y from {lineitem}"""
_HALF = lambda v, e: f"(case when {v} < 0 then -((-({v}) + power(2, {e})::hugeint // 2) // power(2, {e})::hugeint) else ({v} + power(2, {e})::hugeint // 2) // power(2, {e})::hugeint end)"
_LOG = lambda d: f"(length(ltrim(bin(cast({d} as bigint)), '0')) - 1)"
_FRACTION = lambda d: f"(case when {_LOG(d)} > 8 then floor((({d}) - power(2, {_LOG(d)}) + power(2, {_LOG(d)} - 9)) / power(2, {_LOG(d)} - 8)) else (({d}) - power(2, {_LOG(d)})) * power(2, 8 - {_LOG(d)}) end)"
_RECIPROCAL = lambda d: f"cast(round(4194304.0 / (256 + least(256, {_FRACTION(d)}))) as hugeint)"
_COARSE = lambda v: f"cast(sign({v}) * floor((least(abs(greatest(-32768, least(32767, {v}))), 32768) + 32) / 64.0) * 64 as bigint)"


@_query(f"""with s as ({_SAMPLES.replace('{div}', '//').replace('{lineitem}', 'lineitem')}), f as (select * from s where nth <= 8),
    d as (select *, abs(dx - sx - mv_x) + abs(dy - sy - mv_y) <= 4 * least(28, greatest(4, w, h)) as ok from f),
    k as (select * from d x where ok or (nth = 1 and not exists (select 1 from d y where y.block_id = x.block_id and y.ok))),
    p as (select *, sx - 16 * w + 8 as x, sy - 16 * h + 8 as y, dx - 16 * w + 8 - mv_x as u, dy - 16 * h + 8 - mv_y as v from k),
    e as (select *, case when abs(x - u) < 256 and abs(y - v) < 256 then 1 else 0 end as t from p),
    m as (select block_id, count(*) as n, any_value(mv_x) as mv_x, any_value(mv_y) as mv_y, any_value(4 * at_x + 2 * w - 1) as cx, any_value(4 * at_y + 2 * h - 1) as cy,
        cast(sum(t * (floor(x * x / 4.0) + 2 * x + 8)) as hugeint) as a, cast(sum(t * (floor(x * y / 4.0) + x + y + 4)) as hugeint) as b, cast(sum(t * (floor(y * y / 4.0) + 2 * y + 8)) as hugeint) as c,
        cast(sum(t * (floor(x * u / 4.0) + x + u + 8)) as hugeint) as xu, cast(sum(t * (floor(y * u / 4.0) + y + u + 4)) as hugeint) as yu, cast(sum(t * (floor(x * v / 4.0) + x + v + 4)) as hugeint) as xv, cast(sum(t * (floor(y * v / 4.0) + y + v + 8)) as hugeint) as yv
        from e group by block_id),
    i as (select *, a * c - b * b as det, {_RECIPROCAL('abs(a * c - b * b)')} * sign(a * c - b * b)::hugeint as r, {_LOG('abs(a * c - b * b)')} - 2 as z from m where a * c - b * b <> 0),
    j as (select *, case when z < 0 then r * power(2, -z)::hugeint else r end as q, greatest(z, 0) as s from i),
    o as (select *, greatest(57345, least(73727, {_HALF('((c * xu - b * yu) * q)', 's')})) as m2, greatest(-8191, least(8191, {_HALF('((a * yu - b * xu) * q)', 's')})) as m3,
        greatest(-8191, least(8191, {_HALF('((c * xv - b * yv) * q)', 's')})) as m4, greatest(57345, least(73727, {_HALF('((a * yv - b * xv) * q)', 's')})) as m5 from j),
    g as (select *, {_HALF(f"(m4 * 65536 * {_RECIPROCAL('m2')})", f"({_LOG('m2')} + 14)")} as g0, m5 - {_HALF(f"(m3 * m4 * {_RECIPROCAL('m2')})", f"({_LOG('m2')} + 14)")} - 65536 as d0 from o),
    h as (select *, {_COARSE('(m2 - 65536)')} as alpha, {_COARSE('m3')} as beta, {_COARSE('g0')} as gamma, {_COARSE('d0')} as delta from g)
    select m.block_id, m.n, cast(greatest(-8388608, least(8388607, m.mv_x * 8192 - m.cx * (m2 - 65536) - m.cy * m3)) as bigint) as m0, cast(greatest(-8388608, least(8388607, m.mv_y * 8192 - m.cx * m4 - m.cy * (m5 - 65536))) as bigint) as m1,
        cast(m2 as bigint) as m2, cast(m3 as bigint) as m3, cast(m4 as bigint) as m4, cast(m5 as bigint) as m5, alpha, beta, gamma, delta, coalesce(4 * abs(alpha) + 7 * abs(beta) < 65536 and 4 * abs(gamma) + 4 * abs(delta) < 65536, false) as valid
    from m left join h on m.block_id = h.block_id""")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as samples of motion, parts as blocks: the affine motion that fits each part's first lines, outliers left out."""
    return grids.affine_fit(spark.sql(_SAMPLES.replace("{div}", "div"), lineitem=_table(spark, sf_dir, "lineitem")))


_SETTINGS = """select p_partkey, p_size * 1500 as width, case when p_partkey % 97 = 0 then 0 else 1080 end as height, p_partkey % 4 as profile, case p_partkey % 5 when 0 then null when 1 then 10 when 2 then 12 when 3 then 9 else 8 end as bit_depth,
    p_partkey % 7 % 4 as pixel_format, p_partkey % 70 as qp, cast(floor(p_retailprice) as int) % 8 as speed, p_partkey % 3 as rate_control, case when p_partkey % 2 = 0 then 500 end as bitrate from {part}"""


@_query(f"""with s as ({_SETTINGS.replace('{part}', 'part')}), f as (select p_partkey, width, height, profile, coalesce(bit_depth, 8) as d, pixel_format as f, qp, speed, rate_control, coalesce(bitrate, 0) as bitrate from s)
    select p_partkey, case when width <= 0 or height <= 0 then 'width and height are above 0' when width > 65536 then 'width and height are at most 65536' when d not in (8, 10, 12) then 'bit depth is 8, 10 or 12' when profile = 3 then 'profile is 0 to 2'
        when profile < 2 and d = 12 then 'main and high have no 12 bits' when profile = 0 and f in (1, 2) then 'main is 4:2:0 or monochrome' when profile = 1 and f <> 2 then 'high is 4:4:4'
        when qp > 63 then 'quantizer is 0 to 63' when speed > 6 then 'speed is 0 to 6' when rate_control > 0 and bitrate = 0 then 'constant and variable rates have a bitrate' end as error from f""")
def settings_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as settings of sessions, some of them left out: what is wrong with them first."""
    settings = rules.with_defaults(spark.sql(_SETTINGS, part=_table(spark, sf_dir, "part")))
    return settings.select("p_partkey", rules.first_violation(rules.settings_rules()).alias("error"))


@_query(f"""with s as ({_SETTINGS.replace('{part}', 'part')}), v as (select *, coalesce(bit_depth, 8) as d from s)
    select p_partkey, profile, width - 1 as max_width_minus_1, length(ltrim(bin(greatest(width - 1, 1)), '0')) as width_bits, d >= 10 as high_bit_depth, d = 12 as twelve_bit, pixel_format = 3 as mono_chrome,
        case when pixel_format = 2 then 0 else 1 end as subsampling_x, case when pixel_format in (1, 2) then 0 else 1 end as subsampling_y, 30 as time_scale from v""")
def settings_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sequence headers of those settings say."""
    said = rules.sequence_of(rules.with_defaults(spark.sql(_SETTINGS, part=_table(spark, sf_dir, "part"))))
    return said.select("p_partkey", *[f"sequence.{c}" for c in ("profile", "max_width_minus_1", "width_bits", "high_bit_depth", "twelve_bit", "mono_chrome", "subsampling_x", "subsampling_y")], "sequence.timing.time_scale")


@_query("""with b as (select l_returnflag as flag, l_quantity not between 1 and 50 as q, l_discount > 0.08 as d, l_tax > 0.07 as t, l_extendedprice <= 1000 as p from lineitem)
    select flag, 'quantity' as rule, count(*) filter (q) as broken, count(*) as n from b group by flag union all select flag, 'discount', count(*) filter (d), count(*) from b group by flag
    union all select flag, 'tax', count(*) filter (t), count(*) from b group by flag union all select flag, 'price', count(*) filter (p), count(*) from b group by flag""")
def rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each flag break each rule; rules that no line breaks are counted as 0."""
    asked = {"quantity": F.col("l_quantity").between(1, 50), "discount": F.col("l_discount") <= 0.08, "tax": F.col("l_tax") <= 0.07, "price": F.col("l_extendedprice") > 1000}
    lines = _table(spark, sf_dir, "lineitem")
    counted = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(~holds, F.lit(True))).alias(name) for name, holds in asked.items()])
    return counted.select("flag", "n", F.explode(F.create_map(*[x for name in asked for x in (F.lit(name), F.col(name))])).alias("rule", "broken"))


@_query("""with sides as (select unnest([4, 8, 16, 32, 64]) as n) select p_partkey, w, h, w between 8 and 32 and h between 8 and 32 as wedge, w between 8 and 32 and h between 8 and 32 and w <= 2 * h and h <= 2 * w as inter_intra,
    p_size % 3 = 0 and p_partkey % 2 = 0 and p_partkey % 5 = 0 as lossless from (select *, case p_partkey % 5 when 0 then 4 when 1 then 8 when 2 then 16 when 3 then 32 else 64 end as w, case p_size % 5 when 0 then 4 when 1 then 8 when 2 then 16 when 3 then 32 else 64 end as h from part)""")
def block_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which blocks may use a wedge or inter-intra prediction, and which are coded without loss."""
    part = _table(spark, sf_dir, "part")
    side = lambda x: F.shiftleft(F.lit(1), 2) * F.call_function("shiftleft", F.lit(1), (x % 5).cast("int"))
    rows = part.select("p_partkey", "p_size", side(F.col("p_partkey")).alias("w"), side(F.col("p_size")).alias("h"))
    deltas = F.array((F.col("p_partkey") % 2).cast("long"), (F.col("p_partkey") % 5).cast("long"))
    return rows.select("p_partkey", "w", "h", rules.wedge_allowed(F.col("w"), F.col("h")).alias("wedge"), rules.inter_intra_allowed(F.col("w"), F.col("h")).alias("inter_intra"), rules.coded_lossless(F.col("p_size") % 3, deltas).alias("lossless"))


def _wedge_oracle() -> str:
    """Weights of the sixteen wedges of 8 by 8, by how far a sample lies beyond the border along its line."""
    wedges = ", ".join(f"({k}, {way}, {dx}, {dy}, {grids.TURNED[8, 8] >> k & 1})" for k, (way, dx, dy) in enumerate(grids.WEDGES["square"]))
    borders = {k: list(v) for k, v in grids.BORDERS.items()}
    return f"""with shapes as (select * from (values {wedges}) t(nth, way, dx, dy, turned)), placed as (select *, i, 32 - dx + i % 8 as x, 32 - dy + i // 8 as y from shapes cross join (select unnest(range(64)) as i)),
        lines as (select *, case when way in (0, 2, 5) then y when way = 4 then 63 - x else x end as a, case when way in (0, 2) then x when way = 5 then 63 - x else y end as b from placed),
        far as (select *, case when way < 2 then a - 32 else a - (48 - (b + 1) // 2) end + 4 as j from lines),
        weights as (select nth, i, case when turned = 1 then 64 - m else m end as m from (select *, case when j < 0 then 0 when j > 7 then 64 when way < 2 then {borders['straight']}[j + 1] when b % 2 = 0 then {borders['even']}[j + 1] else {borders['odd']}[j + 1] end as m from far)),
        pix as (select vec_id, unnest(range(len(embedding))) as i, unnest(list_transform(embedding, lambda x: cast(greatest(0, least(255, 128 + floor(x * 256))) as int))) as v from embeddings)
        select vec_id, cast(p.i as bigint) as i, cast(floor((v * m + (255 - v) * (64 - m) + 32) / 64.0) as bigint) as y from pix p join weights w on w.nth = vec_id % 16 and w.i = p.i"""


@_query(_wedge_oracle())
def wedge_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as blocks of 8 by 8 samples, blended with their negative along a wedge of the generated dimension."""
    vectors = _table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(transform(embedding, x -> cast(greatest(0, least(255, 128 + floor(x * 256))) as int))) as (i, v)")
    masks = grids.wedge_masks(spark).where("w = 8 and h = 8").selectExpr("nth", "8 * y + x as i", "weight as m")
    joined = grids.look_up(vectors.withColumn("nth", F.expr("cast(vec_id % 16 as int)")), masks, ["nth", "i"])
    return joined.selectExpr("vec_id", "cast(i as bigint) as i", "cast(shiftright(v * m + (255 - v) * (64 - m) + 32, 6) as bigint) as y")


@_query(f"""with slopes as (select * from (values {', '.join(f'({a}, {s})' for a, s in grids.SLOPES.items())}) t(a, s)), asked as (select event_id, cast([45, 67, 90, 113, 135, 157, 180, 203][event_id % 8 + 1] + 3 * (event_id % 7 - 3) as int) as angle from events),
    folded as (select *, case when angle < 90 then angle when angle > 90 and angle < 180 then 180 - angle end as x, case when angle > 90 and angle < 180 then angle - 90 when angle > 180 then 270 - angle end as y from asked)
    select event_id, angle, coalesce((select max(s) from slopes where a // 2 = x // 2), 0) as dx, coalesce((select max(s) from slopes where a // 2 = y // 2), 0) as dy from folded""")
def slope_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as directions, a base angle and up to three steps of three degrees: their slopes, looked up."""
    angle = F.get(F.lit([45, 67, 90, 113, 135, 157, 180, 203]), (F.col("event_id") % 8).cast("int")) + 3 * (F.col("event_id") % 7 - 3)
    return grids.look_up(_table(spark, sf_dir, "events").select("event_id", angle.cast("int").alias("angle")), grids.slope_table(spark), ["angle"])


@_query("""with u as (select conv_id, turn, case role when 'user' then 6 when 'assistant' then 3 else 5 end as t, encode(text) as p, turn % 8 as temporal, row_number() over (partition by conv_id order by turn, role, text) - 1 as k from conversations)
    select cast(conv_id as varchar) as path, cast(k as int) as obu_index, t as obu_type, cast(temporal as int) as temporal_id, cast(octet_length(p) as bigint) as size, sha256(p) as digest, true as has_size from u""")
def unit_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as streams of record units, one for each turn, and read back."""
    turns = _table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as string) as path", "0 as sample_index", "cast(row_number() over (partition by conv_id order by turn, role, text) - 1 as int) as obu_index",
        "case role when 'user' then 6 when 'assistant' then 3 else 5 end as obu_type", "cast(turn % 8 as int) as temporal_id", "0 as spatial_id", "cast(text as binary) as payload", "cast(null as string) as error",
    )
    return media.units(writers.sample_bytes(turns)).select("path", "obu_index", "obu_type", "temporal_id", "size", F.sha2("payload", 256).alias("digest"), "has_size")


@_query("""with n as (select user_id, event_id, props, row_number() over (partition by user_id order by ts, event_id) - 1 as k from events)
    select cast(user_id as varchar) as path, cast(k as int) as sample_index, event_id as pts, cast(octet_length(encode(props)) as bigint) as size,
        cast(32 + 12 * (k + 1) + coalesce(sum(octet_length(encode(props))) over (partition by user_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as frame_offset, sha256(encode(props)) as digest from n""")
def ivf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events written as files of frames, and read back with their places."""
    frames = _table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as path", "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as sample_index", "event_id as pts", "cast(props as binary) as data")
    return media.ivf_samples(writers.ivf_bytes(frames, width=320, height=240)).select("path", "sample_index", "pts", F.octet_length("data").cast("long").alias("size"), F.col("offset").alias("frame_offset"), F.sha2("data", 256).alias("digest"))


@_query("""select event_id, v as leb128, cast(case when v < 128 then 1 when v < 16384 then 2 when v < 2097152 then 3 when v < 268435456 then 4 when v < 34359738368 then 5 else 6 end as int) as n_bytes, event_id % 5000 as uvlc,
    2 * (length(ltrim(bin(event_id % 5000 + 1), '0'))) - 1 as uvlc_bits, event_id % 64 - 32 as su, event_id % 11 as ns from (select event_id, event_id * event_id as v from events)""")
def bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in four codes of variable length and read back."""
    e = F.col("event_id")
    # Each code is a column of its own before it is read, so that it is made once a row.
    said = _table(spark, sf_dir, "events").select("event_id", F.concat(bits.leb128_encode(e * e), F.lit(b"\x05\x80")).alias("data"), bits.uvlc_encode(e % 5000).alias("said"))
    read = said.select("event_id", bits.leb128_decode(F.col("data")).alias("read"), "said")
    # A number below 11: three bits up to 4, four beyond.
    low = F.when(e % 11 < 5, F.lpad(F.bin(e % 11), 3, "0")).otherwise(F.lpad(F.bin(e % 11 + 5), 4, "0"))
    return read.select(
        "event_id", F.col("read.value").alias("leb128"), F.col("read.n").cast("int").alias("n_bytes"), bits.uvlc_decode(F.concat("said", F.lit("01"))).alias("uvlc"), F.length("said").cast("long").alias("uvlc_bits"),
        bits.su_decode(F.lpad(F.bin(F.pmod(e % 64 - 32, F.lit(64))), 6, "0"), 6).alias("su"), bits.ns_decode(F.concat(low, F.lit("10")), 11).alias("ns"),
    )


_PIXELS = "select vec_id, unnest(range(len(embedding))) as i, unnest(list_transform(embedding, lambda x: cast(greatest(0, least(255, 128 + floor(x * 256))) as int))) as v from embeddings"
_SAMPLES_OF = "transform(embedding, x -> cast(greatest(0, least(255, 128 + floor(x * 256))) as int))"
#: Eight taps for each sixteenth of a sample up to a half, in 64ths; the others are these read backwards.
TAPS = (
    (0, 0, 0, 64, 0, 0, 0, 0), (0, 1, -3, 63, 4, -1, 0, 0), (0, 1, -5, 61, 9, -2, 0, 0), (0, 1, -6, 58, 14, -4, 1, 0), (0, 1, -7, 55, 19, -5, 1, 0),
    (0, 1, -7, 51, 24, -6, 1, 0), (0, 1, -8, 47, 29, -6, 1, 0), (0, 1, -7, 42, 33, -6, 1, 0), (0, 1, -7, 38, 38, -7, 1, 0),
)
PHASES = {p: TAPS[p] if p < 9 else TAPS[16 - p][::-1] for p in range(16)}


@_query(f"""with p as ({_PIXELS}), taps as (select phase, unnest(range(-3, 5)) as d, unnest(w) as w from (values {', '.join(f'({p}, {list(w)})' for p, w in PHASES.items())}) t(phase, w))
    select a.vec_id, cast(a.i as bigint) as i, cast(greatest(0, least(255, floor((sum(w * b.v) + 32) / 64.0))) as bigint) as y from p a join taps on phase = a.vec_id % 16 join p b on b.vec_id = a.vec_id and b.i = greatest(0, least(63, a.i + d)) group by a.vec_id, a.i""")
def fir8_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples moved by a sixteenth for each vector, the taps of its phase looked up in a dimension."""
    phases = spark.createDataFrame([(p, *w) for p, w in PHASES.items()], "phase int, " + ", ".join(f"w{k} int" for k in range(8)))
    vectors = _table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"{_SAMPLES_OF} as q", "cast(vec_id % 16 as int) as phase")
    rows = grids.look_up(vectors, phases, ["phase"]).selectExpr("*", "explode(sequence(0, 63)) as i")
    total = " + ".join(f"w{k} * q[greatest(0, least(63, i + {k - 3}))]" for k in range(8))
    return rows.selectExpr("vec_id", "cast(i as bigint) as i", f"cast(greatest(0, least(255, shiftright({total} + 32, 6))) as bigint) as y")


def _smooth(n: int, bits: int) -> list[str]:
    """For each of the 2n samples around an edge at e, the weighted sum of its 2n + 1 neighbours, cut off at n + 1 from the edge."""
    taps = lambda j: 2 if abs(j) <= (0 if (n, bits) == (3, 3) else 1) else 1
    return [f"shiftright({' + '.join(f'{taps(j)} * q[e + {max(-n - 1, min(n, i + j))}]' for j in range(-n, n + 1))} + {1 << bits - 1}, {bits})" for i in range(-n, n)]


def _smooth_oracle(n: int, bits: int, step: int) -> str:
    return f"""(with p as (select vec_id, i, v >> 5 as v from ({_PIXELS})), e as (select unnest(range({step}, 64, {step})) as e), at as (select e, unnest(range(-{n}, {n})) as k from e),
        flat as (select vec_id, e from p cross join e where i >= e - {n + 1} and i <= e + {n} group by vec_id, e having max(v) filter (i < e) - min(v) filter (i < e) <= 1 and max(v) filter (i >= e) - min(v) filter (i >= e) <= 1),
        taps as (select unnest(range(-{n}, {n + 1})) as j), near as (select e, k, greatest(-{n + 1}, least({n}, k + j)) + e as i, case when abs(j) <= {0 if (n, bits) == (3, 3) else 1} then 2 else 1 end as w from at cross join taps)
        select vec_id, cast(e as bigint) as edge, {2 * n + 2} as width, cast(k as bigint) as k, cast((sum(w * v) + {1 << bits - 1}) // {1 << bits} as bigint) as y from flat join near using (e) join p using (vec_id, i) group by vec_id, e, k)""".replace(" at as (", " placed as (").replace("from at cross", "from placed cross")


@_query(f"select * from {_smooth_oracle(3, 3, 8)} union all select * from {_smooth_oracle(6, 4, 16)}")
def deblock_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose sides are flat, smoothed over three samples a side (every 8th edge) and over six (every 16th)."""
    vectors = _table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"transform({_SAMPLES_OF}, x -> shiftright(x, 5)) as q")
    out = []
    for n, bits_, step in ((3, 3, 8), (6, 4, 16)):
        rows = vectors.selectExpr("vec_id", "q", f"explode(sequence({step}, 63, {step})) as e")
        side = lambda first: f"array({', '.join(f'q[e + {first + k}]' for k in range(n + 1))})"  # noqa: E731, B023
        flat = " and ".join(f"array_max({side(s)}) - array_min({side(s)}) <= 1" for s in (-n - 1, 0))
        out.append(rows.where(flat).selectExpr("vec_id", "cast(e as bigint) as edge", f"{2 * n + 2} as width", f"posexplode(array({', '.join(_smooth(n, bits_))})) as (pos, y)").selectExpr("vec_id", "edge", "width", f"cast(pos - {n} as bigint) as k", "cast(y as bigint) as y"))
    return out[0].unionByName(out[1])


@_query(f"""with p as ({_PIXELS}), n as (select a.vec_id, a.i, 16 * a.v as a, 16 * b.v as b from p a join p b on b.vec_id = a.vec_id and b.i = 63 - a.i), m as (select *, least(64, 38 + floor((abs(a - b) + 8) / 256.0)) as m, vec_id % 13 + 2 as w from n)
    select vec_id, cast(i as bigint) as i, cast(floor((a + b + 16) / 32.0) as bigint) as average, cast(floor((a * w + b * (16 - w) + 128) / 256.0) as bigint) as weighted, cast(floor((a * m + b * (64 - m) + 512) / 1024.0) as bigint) as by_difference from m""")
def compound_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictions of four more bits each: their average, a weighted one, and one weighted by how far they differ."""
    vectors = _table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"{_SAMPLES_OF} as q")
    rows = vectors.selectExpr("vec_id", "q", "explode(sequence(0, 63)) as i").selectExpr("vec_id", "i", "16 * q[i] as a", "16 * q[63 - i] as b", "cast(vec_id % 13 + 2 as int) as w")
    rows = rows.withColumn("m", F.expr("least(64, 38 + shiftright(abs(a - b) + 8, 8))"))
    blend = {"average": "shiftright(a + b + 16, 5)", "weighted": "shiftright(a * w + b * (16 - w) + 128, 8)", "by_difference": "shiftright((a - b) * m + 64 * b + 512, 10)"}
    return rows.selectExpr("vec_id", "cast(i as bigint) as i", *[f"cast({x} as bigint) as {name}" for name, x in blend.items()])


@_query("""with s as (select p_partkey, 2 + p_size % 15 as n, unnest(range(1, 2 + p_size % 15)) as k from part) select p_partkey, string_agg(cast(32768 - (32768 * k) // n as varchar), ',' order by k) as counts, cast(max(n) as bigint) as n from s group by p_partkey""")
def uniform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cumulative counts that n equally likely symbols begin with, falling from 2^15."""
    counts = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: (32768 - F.floor(32768 * k / F.col("n"))).cast("string"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", (F.lit(2) + F.col("p_size") % 15).cast("int").alias("n"))
    return rows.select("p_partkey", F.array_join(counts, ",").alias("counts"), F.col("n").cast("long").alias("n"))


@_query("""with cells as (select p_partkey // 256 * 256 + p_partkey % 256 as packed, p_size from part), asked as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_partkey as packed, l_partkey // 4096 as region from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, coalesce((select max(p_size) from cells c where c.packed = a.packed and p_size > 20), -1) as strength, (select count(*) from cells c where c.packed // 4096 = a.region and p_size > 20) as known from asked a""")
def packed_key_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters kept as a map of packed keys (row * 256 + column) for each region of 4,096 cells, and looked up there; without one, -1."""
    cells = _table(spark, sf_dir, "part").where("p_size > 20").selectExpr("p_partkey div 256 * 256 + p_partkey % 256 as packed", "p_size")
    maps = cells.groupBy(F.expr("packed div 4096").alias("region")).agg(F.map_from_entries(F.collect_list(F.struct("packed", "p_size"))).alias("known"))
    lines = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_partkey div 4096 as region")
    found = lines.join(maps, "region", "left")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.coalesce(F.expr("known[l_partkey]"), F.lit(-1)).alias("strength"), F.coalesce(F.cardinality("known"), F.lit(0)).cast("long").alias("known"))


@_query("""with rows as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_partkey % 500 as y, l_partkey % 2 as sub from lineitem), params as (select p_partkey % 8 as unit, max(p_size) as strength from part where p_size > 20 group by p_partkey % 8),
    placed as (select *, (y * (1 + sub) + 8) // 64 as stripe, (select min(u) from (select unnest(range(8)) as u) t where 64 * (u + 1) > y or u = 7) as unit from rows)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, stripe, greatest(0, (64 * stripe - 8) // (1 + sub)) as begins, least(500, (64 * stripe + 56) // (1 + sub)) as ends, coalesce(strength, 0) as strength from placed left join params using (unit)""")
def restoration_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows of planes 500 high, every other one of half height: their stripe (64 rows of the whole height, eight rows early), and the parameters of their unit.

    Of units of 64 rows a plane has as many as fit, the last one up to half as high again.
    """
    height, unit = 500, 64
    units = max(1, (height + unit // 2) // unit)
    params = _table(spark, sf_dir, "part").where("p_size > 20").groupBy((F.col("p_partkey") % 8).alias("unit")).agg(F.max("p_size").alias("strength"))
    lines = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", f"l_partkey % {height} as y", "cast(l_partkey % 2 as int) as sub")
    stripe = F.expr("shiftright(if(sub = 1, 2 * y, y) + 8, 6)")
    rows = lines.withColumn("stripe", stripe).withColumn("unit", F.least(F.lit(units - 1), F.floor(F.col("y") / unit)))
    found = grids.look_up(rows, params, ["unit"])
    half = lambda x: f"if(sub = 1, shiftright({x}, 1), {x})"
    return found.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "stripe", f"greatest(0, {half('64 * stripe - 8')}) as begins", f"least({height}, {half('64 * stripe + 56')}) as ends", "coalesce(strength, 0) as strength")


@_query("""with b as (select p_partkey, p_partkey % 3 as kind, p_partkey % 2 as coarse, 4 * (p_partkey % 90) + 2 * (1 + p_size % 8) - 1 as x, 4 * (p_partkey % 60) + 2 * (1 + p_size % 4) - 1 as y, (p_partkey * 7919 % 200000) - 100000 as m0, (p_partkey * 104729 % 200000) - 100000 as m1, p_partkey % 801 - 400 as a, p_partkey % 601 - 300 as c from part),
    f as (select *, a * x + c * y + m0 as xc, a * y - c * x + m1 as yc, case when coarse = 1 then 16384.0 else 8192.0 end as unit from b)
    select p_partkey, cast(case kind when 0 then 0 when 1 then floor(m1 / 8192.0) else sign(xc) * floor(abs(xc) / unit + 0.5) * (1 + coarse) end as bigint) as mv_x, cast(case kind when 0 then 0 when 1 then floor(m0 / 8192.0) else sign(yc) * floor(abs(yc) / unit + 0.5) * (1 + coarse) end as bigint) as mv_y from f""")
def global_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as blocks under a motion of the whole frame (none, a shift, a turn with zoom): the block's vector in eighths of a sample.

    A shift is cut down to eighths; a turn moves the block's centre, halves rounded away from zero, to quarters where
    vectors are coarse.
    """
    blocks = _table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_partkey % 3 as kind", "cast(p_partkey % 2 as int) as coarse", "4 * (p_partkey % 90) + 2 * (1 + p_size % 8) - 1 as x", "4 * (p_partkey % 60) + 2 * (1 + p_size % 4) - 1 as y",
        "p_partkey * 7919 % 200000 - 100000 as m0", "p_partkey * 104729 % 200000 - 100000 as m1", "p_partkey % 801 - 400 + 65536 as m2", "p_partkey % 601 - 300 as m3",
    )
    moved = blocks.selectExpr("*", "(m2 - 65536) * x + m3 * y + m0 as xc", "(m2 - 65536) * y - m3 * x + m1 as yc")
    turned = lambda v: f"if({v} < 0, -1, 1) * if(coarse = 1, 2 * shiftright(abs({v}) + 8192, 14), shiftright(abs({v}) + 4096, 13))"
    vector = lambda shift, v: f"cast(case kind when 0 then 0 when 1 then shiftright({shift}, 13) else {turned(v)} end as bigint)"
    return moved.selectExpr("p_partkey", f"{vector('m1', 'xc')} as mv_x", f"{vector('m0', 'yc')} as mv_y")
