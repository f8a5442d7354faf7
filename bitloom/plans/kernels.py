"""Sample and coding kernels as array expressions, and operators whose oracle is written from the definition alone.

A stencil reads its neighbours inside one array, by clamped places, and is exploded last: no shuffle, no sort. The
oracles say the same relationally (rows of samples joined by place, counts of earlier rows, interval joins), so that a
wrong formula cannot agree with itself.
"""

from __future__ import annotations

SPARK_Q = "transform(embedding, x -> cast(greatest(0, least(255, 128 + floor(x * 256))) as int))"
DUCK_Q = "list_transform(embedding, lambda x: cast(greatest(0, least(255, 128 + floor(x * 256))) as int))"
DUCK_PIX = f"select vec_id, unnest(range(len(embedding))) as i, unnest({DUCK_Q}) as v from embeddings"
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
EARLIER = "b.user_id = a.user_id and (b.ts, b.event_id) < (a.ts, a.event_id)"
NUMBERED = "select *, row_number() over (partition by user_id order by ts, event_id) as n from events"
#: Three kernels of edge smoothing, and the weights of inter-intra masks.
EDGE_KERNELS = ((0, 4, 8, 4, 0), (0, 5, 6, 5, 0), (2, 4, 4, 4, 2))
MASK_WEIGHTS = (60, 52, 45, 39, 34, 30, 26, 22, 19, 17, 15, 13, 11, 10, 8, 7, 6, 6, 5, 4, 4, 3, 3, 2, 2, 2, 2, 1, 1, 1, 1, 1)


def at(d: int | str, q: str = "q") -> str:
    """The sample d places on, edges repeated."""
    return f"{q}[cast(greatest(0, least(63, i + ({d}))) as int)]"


def exploded(**columns: str) -> str:
    """Spark: one row for each sample with these expressions of q, v and i."""
    fields = ", ".join(f"cast({e} as bigint) as {n}" for n, e in columns.items())
    return f"select vec_id, cast(pos as bigint) as i, y.* from (select vec_id, posexplode(transform(q, (v, i) -> struct({fields}))) as (pos, y) from (select vec_id, {SPARK_Q} as q from {{embeddings}}))"


def neighbours(*d: int) -> str:
    """DuckDB: each sample with its neighbours t_3 .. t3, joined by clamped place."""
    name = lambda k: f"t{str(k).replace('-', '_')}"
    return f"""with p as ({DUCK_PIX}), n as (select p.vec_id, p.i, p.v, d, q.v as w from p cross join (select unnest({list(d)}) as d) join p q on q.vec_id = p.vec_id and q.i = greatest(0, least(63, p.i + d)))
        select vec_id, cast(i as bigint) as i, any_value(v) as v, {', '.join(f'max(w) filter (d = {k}) as {name(k)}' for k in d)} from n group by vec_id, i"""


def clip(x: str, low: int = 0, high: int = 255) -> str:
    return f"greatest({low}, least({high}, {x}))"


def median(x: str, low: int = 0, high: int = 255) -> str:
    return f"list_sort([{low}, {high}, cast({x} as bigint)])[2]"


def _lift(a: str, b: str, c: str, d: str) -> tuple[str, str, str, str]:
    """One step of the lossless 4-point transform."""
    t4 = f"shiftright({a} + {b} - ({c} - {d}), 1)"
    t3, t1 = f"({t4} - {d})", f"({t4} - {b})"
    return f"({a} + {b} - {t3})", t3, t1, f"({c} - {d} + {t1})"


def _wht_oracle() -> str:
    rows = ", ".join(f"sum(case when i % 4 = {k} then v >> 2 end) as in{k}" for k in range(4))
    step = "select *, in0 + in1 as t0, in2 - in3 as t2, floor((in0 + in1 - in2 + in3) / 2.0) as t4 from"
    outs = "t0 - (t4 - in3) as o0, t4 - in3 as o1, t4 - in1 as o2, t2 + (t4 - in1) as o3"
    return f"""with r as (select vec_id, i // 16 as block, i % 16 // 4 as y, {rows} from ({DUCK_PIX}) group by vec_id, i // 16, i % 16 // 4),
        r2 as (select vec_id, block, y, {outs} from ({step} r)),
        cells as (select vec_id, block, y, unnest([0, 1, 2, 3]) as x, unnest([o0, o1, o2, o3]) as o from r2),
        c as (select vec_id, block, x, {', '.join(f'sum(case when y = {k} then o end) as in{k}' for k in range(4))} from cells group by vec_id, block, x),
        c2 as (select vec_id, block, x, {outs} from ({step} c))
        select vec_id, cast(block as bigint) as block, cast(x as bigint) as x, cast(o0 as bigint) as o0, cast(o1 as bigint) as o1, cast(o2 as bigint) as o2, cast(o3 as bigint) as o3 from c2"""


_WHT_ROWS = "transform(sequence(0, 3), y -> array(" + ", ".join(_lift(*[f"shiftright(q[16 * b + 4 * y + {k}], 2)" for k in range(4)])) + "))"
_WHT_COLUMNS = ", ".join(f"cast({o} as bigint) as o{k}" for k, o in enumerate(_lift("r[0][x]", "r[1][x]", "r[2][x]", "r[3][x]")))
_CDEF = lambda t: f"sign({t} - v) * least(abs({t} - v), greatest(0, 6 - shiftright(abs({t} - v), 2)))"
_CDEF_SPARK = "cast(" + f"4 * ({_CDEF(at(-1))} + {_CDEF(at(1))}) + 2 * ({_CDEF(at(-2))} + {_CDEF(at(2))})" + " as int)"
_SPREAD = ", ".join(at(d) for d in (-2, -1, 1, 2))
#: Spark: the narrow deblocking filter between p1 p0 | q0 q1; f holds the clamped difference.
_HEV = f"(abs({at(-2)} - {at(-1)}) > 8 or abs({at(1)} - v) > 8)"
_F = clip(f"if({_HEV}, {clip(f'{at(-2)} - {at(1)}', -128, 127)}, 0) + 3 * (v - {at(-1)})", -128, 127)
_F1, _F2 = f"({clip(f'{_F} + 4', -128, 127)} >> 3)", f"({clip(f'{_F} + 3', -128, 127)} >> 3)"
_G = f"if({_HEV}, 0, ({_F1} + 1) >> 1)"
#: Sums over a square of radius r around each sample of 8 by 8, unrolled so that they are compiled; borders repeat.
_BOX = lambda r, q: " + ".join(f"{q}[y{dy + 2} + x{dx + 2}]" for dy in range(-r, r + 1) for dx in range(-r, r + 1))
_BOX_PLACES = ", ".join(f"cast(greatest(0, least(7, i div 8 + {d})) * 8 as int) as y{d + 2}, cast(greatest(0, least(7, i % 8 + {d})) as int) as x{d + 2}" for d in range(-2, 3))
#: The place of each sample of 8 by 8 in the order of anti-diagonals, from 1 on.
_WAVEFRONT = [1 + sorted(range(64), key=lambda i: (i % 8 + i // 8, -(i % 8))).index(i) for i in range(64)]
_PRIME = 1_000_003

#: name -> (Spark SQL with tables in braces, oracle SQL)
SQL: dict[str, tuple[str, str]] = {
    # --- stencils ------------------------------------------------------------------------------------------------
    "fir7": (
        exploded(y=clip(f"shiftright(3 * ({at(-3)} + {at(3)}) - 7 * ({at(-2)} + {at(2)}) + 15 * ({at(-1)} + {at(1)}) + 106 * v + 64, 7)")),
        f"select vec_id, i, {median('floor((3 * (t_3 + t3) - 7 * (t_2 + t2) + 15 * (t_1 + t1) + 106 * v + 64) / 128.0)')} as y from ({neighbours(-3, -2, -1, 1, 2, 3)})",
    ),
    "fir8": (
        exploded(y=clip(f"shiftright(2 * ({at(-2)} + {at(3)}) - 14 * ({at(-1)} + {at(2)}) + 76 * (v + {at(1)}) + 64, 7)")),
        f"select vec_id, i, {median('floor((2 * (t_2 + t3) - 14 * (t_1 + t2) + 76 * (v + t1) + 64) / 128.0)')} as y from ({neighbours(-2, -1, 1, 2, 3)})",
    ),
    "cdef_1d": (
        exploded(y=f"greatest(least(v, {_SPREAD}), least(greatest(v, {_SPREAD}), v + shiftright(8 + {_CDEF_SPARK} - if({_CDEF_SPARK} < 0, 1, 0), 4)))"),
        f"""with n as ({neighbours(-2, -1, 1, 2)}), taps as (select vec_id, i, v, unnest([t_1, t1, t_2, t2]) as t, unnest([4, 4, 2, 2]) as w from n),
        s as (select vec_id, i, v, sum(w * sign(t - v) * least(abs(t - v), greatest(0, 6 - abs(t - v) // 4))) as s, least(v, min(t)) as low, greatest(v, max(t)) as high from taps group by vec_id, i, v)
        select vec_id, i, cast(greatest(low, least(high, v + floor((8 + s - (case when s < 0 then 1 else 0 end)) / 16.0))) as bigint) as y from s""",
    ),
    "deblock_narrow": (
        f"select vec_id, i, p1, p0, q0, q1 from ({exploded(p1=clip(f'{at(-2)} + {_G}'), p0=clip(f'{at(-1)} + {_F2}'), q0=clip(f'v - {_F1}'), q1=clip(f'{at(1)} - {_G}'), m=f'abs({at(-1)} - v) * 2 + (abs({at(-2)} - {at(1)}) >> 1)')}) where i % 4 = 0 and i > 0 and m <= 60",
        f"""with n as (select vec_id, i, t_2 as p1, t_1 as p0, v as q0, t1 as q1 from ({neighbours(-2, -1, 1)})),
        h as (select *, abs(p1 - p0) > 8 or abs(q1 - q0) > 8 as hev from n where i % 4 = 0 and i > 0 and 2 * abs(p0 - q0) + abs(p1 - q1) // 2 <= 60),
        f as (select *, {median(f"case when hev then {median('p1 - q1', -128, 127)} else 0 end + 3 * (q0 - p0)", -128, 127)} as f from h),
        g as (select *, floor({median('f + 4', -128, 127)} / 8.0) as f1, floor({median('f + 3', -128, 127)} / 8.0) as f2 from f),
        k as (select *, case when hev then 0 else floor((f1 + 1) / 2.0) end as g from g)
        select vec_id, i, {median('p1 + g')} as p1, {median('p0 + f2')} as p0, {median('q0 - f1')} as q0, {median('q1 - g')} as q1 from k""",
    ),
    "deblock_flat": (
        f"""select vec_id, i, p1, p0, q0, q1 from (select vec_id, cast(pos as bigint) as i, y.* from (select vec_id, posexplode(transform(q, (v, i) -> struct(
            cast(shiftright(3 * {at(-3)} + 2 * {at(-2)} + 2 * {at(-1)} + v + 4, 3) as bigint) as p1, cast(shiftright({at(-3)} + 2 * {at(-2)} + 2 * {at(-1)} + 2 * v + {at(1)} + 4, 3) as bigint) as p0,
            cast(shiftright({at(-2)} + 2 * {at(-1)} + 2 * v + 2 * {at(1)} + {at(2)} + 4, 3) as bigint) as q0, cast(shiftright({at(-1)} + 2 * v + 2 * {at(1)} + 3 * {at(2)} + 4, 3) as bigint) as q1,
            greatest(abs({at(-3)} - {at(-1)}), abs({at(-2)} - {at(-1)}), abs({at(1)} - v), abs({at(2)} - v)) as m))) as (pos, y)
            from (select vec_id, transform({SPARK_Q}, x -> shiftright(x, 5)) as q from {{embeddings}}))) where i % 4 = 0 and i > 0 and m <= 1""",
        f"""with n as (select vec_id, i, t_3 >> 5 as p2, t_2 >> 5 as p1, t_1 >> 5 as p0, v >> 5 as q0, t1 >> 5 as q1, t2 >> 5 as q2 from ({neighbours(-3, -2, -1, 1, 2)}) where i % 4 = 0 and i > 0),
        flat as (select * from n where list_max([abs(p2 - p0), abs(p1 - p0), abs(q1 - q0), abs(q2 - q0)]) <= 1)
        select vec_id, i, cast(floor((list_sum([p2, p2, p2, p1, p1, p0, p0, q0]) + 4) / 8) as bigint) as p1, cast(floor((list_sum([p2, p1, p1, p0, p0, q0, q0, q1]) + 4) / 8) as bigint) as p0,
            cast(floor((list_sum([p1, p0, p0, q0, q0, q1, q1, q2]) + 4) / 8) as bigint) as q0, cast(floor((list_sum([p0, q0, q0, q1, q1, q2, q2, q2]) + 4) / 8) as bigint) as q1 from flat""",
    ),
    "box_sums": (
        f"""select vec_id, cast(i as bigint) as i, cast({_BOX(1, 'q')} as bigint) as s3, cast({_BOX(1, 'p')} as bigint) as ss3, cast({_BOX(2, 'q')} as bigint) as s5, cast({_BOX(2, 'p')} as bigint) as ss5
        from (select vec_id, i, q, p, {_BOX_PLACES} from (select vec_id, q, p, explode(sequence(0, 63)) as i from (select vec_id, q, transform(q, x -> x * x) as p from (select vec_id, {SPARK_Q} as q from {{embeddings}}))))""",
        f"""with p as (select vec_id, i, i // 8 as y, i % 8 as x, v from ({DUCK_PIX})), d as (select unnest(range(-2, 3)) as d),
        n as (select p.vec_id, p.i, q.v, greatest(abs(dy.d), abs(dx.d)) as r from p cross join d dy cross join d dx join p q on q.vec_id = p.vec_id and q.y = greatest(0, least(7, p.y + dy.d)) and q.x = greatest(0, least(7, p.x + dx.d)))
        select vec_id, cast(i as bigint) as i, cast(sum(v) filter (r <= 1) as bigint) as s3, cast(sum(v * v) filter (r <= 1) as bigint) as ss3, cast(sum(v) as bigint) as s5, cast(sum(v * v) as bigint) as ss5 from n group by vec_id, i""",
    ),
    "edge_smooth": (
        exploded(**{f"y{k + 1}": f"shiftright({' + '.join(f'{w} * {at(j - 2)}' for j, w in enumerate(kernel) if w)} + 8, 4)" for k, kernel in enumerate(EDGE_KERNELS)}),
        f"""with n as ({neighbours(-2, -1, 1, 2)}), k as (select * from (values {', '.join(f'({s + 1}, {list(kernel)})' for s, kernel in enumerate(EDGE_KERNELS))}) t(s, w)),
        r as (select vec_id, i, s, cast((list_inner_product(cast(w as double[]), cast([t_2, t_1, v, t1, t2] as double[])) + 8) as bigint) >> 4 as y from n cross join k)
        select vec_id, i, max(y) filter (s = 1) as y1, max(y) filter (s = 2) as y2, max(y) filter (s = 3) as y3 from r group by vec_id, i""",
    ),
    "edge_upsample": (
        exploded(even="v", odd=clip(f"shiftright(9 * (v + {at(1)}) - {at(-1)} - {at(2)} + 8, 4)")),
        f"select vec_id, i, cast(v as bigint) as even, {median('floor((9 * v + 9 * t1 - t_1 - t2 + 8) / 16.0)')} as odd from ({neighbours(-1, 1, 2)})",
    ),
    "wht4": (
        f"""select vec_id, cast(b as bigint) as block, cast(x as bigint) as x, {_WHT_COLUMNS} from (select vec_id, b, r, explode(sequence(0, 3)) as x from (
            select vec_id, b, {_WHT_ROWS} as r from (select vec_id, q, explode(sequence(0, 3)) as b from (select vec_id, {SPARK_Q} as q from {{embeddings}}))))""",
        _wht_oracle(),
    ),
    "wavefront_order": (
        f"select vec_id, cast(i as bigint) as i, cast(array({', '.join(map(str, _WAVEFRONT))})[i] as bigint) as n from (select vec_id, posexplode({SPARK_Q}) as (i, v) from {{embeddings}})",
        f"select vec_id, cast(i as bigint) as i, cast(row_number() over (partition by vec_id order by i % 8 + i // 8, i % 8 desc) as bigint) as n from ({DUCK_PIX})",
    ),
    "mask_blend": (
        exploded(y=f"shiftright({at('63 - 2 * i')} * m + v * (64 - m) + 32, 6)".replace("m", f"array{MASK_WEIGHTS}[least(i % 8, i div 8) * 4]")),
        f"""with p as ({DUCK_PIX}) select a.vec_id, cast(a.i as bigint) as i, cast(floor((b.v * m.w + a.v * (64 - m.w) + 32) / 64.0) as bigint) as y
        from p a join p b on b.vec_id = a.vec_id and b.i = 63 - a.i join (select unnest({list(MASK_WEIGHTS)}) as w, unnest(range(32)) as k) m on m.k = 4 * (case when a.i % 8 < a.i // 8 then a.i % 8 else a.i // 8 end)""",
    ),
    "poly_checksum": (
        f"select vec_id, aggregate({SPARK_Q}, 0L, (a, x) -> (a * 31 + x) % {_PRIME}) as checksum from {{embeddings}}",
        f"select vec_id, cast(sum(v * w) % {_PRIME} as bigint) as checksum from ({DUCK_PIX}) join (select unnest({[pow(31, 63 - i, _PRIME) for i in range(64)]}) as w, unnest(range(64)) as k) on k = i group by vec_id",
    ),
    # --- windows and joins ---------------------------------------------------------------------------------------
    "gop_report": (
        """with p as (select user_id, ts, event_id, cast(floor(value * 100) as bigint) as size,
            case when row_number() over (partition by user_id order by ts, event_id) = 1 or event_type = 'signup' then 1 else 0 end as is_key from {events}),
        g as (select *, sum(is_key) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as gop,
            coalesce(sum(size) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as begins from p)
        select user_id, cast(gop as bigint) as gop_id, cast(count(*) as bigint) as packets, cast(sum(is_key) as bigint) as key_packets,
            cast(sum(size) as bigint) as bytes, cast(min(begins) as bigint) as first_offset from g group by user_id, gop""",
        f"""with p as (select user_id, ts, event_id, cast(floor(value * 100) as bigint) as size, event_type = 'signup' or not exists (select 1 from events b where {EARLIER}) as is_key from events a),
        g as (select a.event_id, any_value(a.user_id) as user_id, any_value(a.size) as size, any_value(a.is_key) as is_key, count(b.event_id) filter (b.is_key) + any_value(case when a.is_key then 1 else 0 end) as gop, coalesce(sum(b.size), 0) as begins
            from p a left join p b on {EARLIER} group by a.event_id)
        select user_id, cast(gop as bigint) as gop_id, count(*) as packets, count_if(is_key) as key_packets, cast(sum(size) as bigint) as bytes, cast(min(begins) as bigint) as first_offset from g group by user_id, gop""",
    ),
    "sample_offsets": (
        f"""select {KEY}, cast(coalesce(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by {KEY} rows between unbounded preceding and 1 preceding), 0) + 1000 * l_orderkey as bigint) as sample_offset
        from {{lineitem}}""",
        f"""with l as (select *, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem)
        select a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_extendedprice, cast(1000 * a.l_orderkey + coalesce(sum(cast(b.l_quantity as bigint)), 0) as bigint) as sample_offset
        from l a left join l b on a.l_orderkey = b.l_orderkey and b.k < a.k group by {', '.join('a.' + c for c in KEY.split(', '))}""",
    ),
    "row_numbers": ("select event_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as idx from {events}", f"select a.event_id, count(b.event_id) as idx from events a left join events b on {EARLIER} group by a.event_id"),
    "limit_first_n": (
        "select user_id, event_id, cast(n as bigint) as n from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n from {events}) where n <= 10",
        f"select a.user_id, a.event_id, count(b.event_id) + 1 as n from events a left join events b on {EARLIER} group by a.user_id, a.event_id having count(b.event_id) < 10",
    ),
    "asof_before": (
        """select event_id, click.event_id as last_click from (select event_id, event_type, max(case when event_type = 'click' then struct(ts, event_id) end)
            over (partition by user_id order by ts range between unbounded preceding and current row) as click from {events}) where event_type = 'purchase'""",
        "select p.event_id, (select arg_max(c.event_id, {'t': c.ts, 'e': c.event_id}) from events c where c.event_type = 'click' and c.user_id = p.user_id and c.ts <= p.ts) as last_click from events p where event_type = 'purchase'",
    ),
    "asof_after": (
        """select event_id, click.event_id as next_click from (select event_id, event_type, min(case when event_type = 'click' then struct(ts, event_id) end)
            over (partition by user_id order by ts range between current row and unbounded following) as click from {events}) where event_type = 'purchase'""",
        "select p.event_id, (select arg_min(c.event_id, {'t': c.ts, 'e': c.event_id}) from events c where c.event_type = 'click' and c.user_id = p.user_id and c.ts >= p.ts) as next_click from events p where event_type = 'purchase'",
    ),
    "stss_left_join": (
        "select e.event_id, coalesce(s.is_sync, false) as is_sync from {events} e left join (select event_id, true as is_sync from {events} where event_type = 'signup') s on e.event_id = s.event_id",
        "select event_id, event_id in (select event_id from events where event_type = 'signup') as is_sync from events",
    ),
    "grid_key_join": (
        f"""with params as (select cast(floor(p_partkey / 16) as bigint) as cell, cast(min(p_size) as bigint) as strength from {{part}} where p_size > 10 group by floor(p_partkey / 16))
        select {KEY}, coalesce(strength, 0) as strength from {{lineitem}} left join params on cast(floor(l_partkey / 16) as bigint) = cell""",
        f"select {KEY}, cast(coalesce((select min(p_size) from part where p_size > 10 and p_partkey // 16 = l_partkey // 16), 0) as bigint) as strength from lineitem",
    ),
    "edge_pairs": (
        f"""select * from (select {KEY}, cast(l_quantity as bigint) as q, cast(lag(l_quantity) over (partition by l_suppkey order by {KEY}, l_quantity) as bigint) as p from {{lineitem}}) where p is not null and abs(p - q) <= 4""",
        f"""with n as (select *, row_number() over (partition by l_suppkey order by {KEY}, l_quantity) as n from lineitem)
        select {', '.join('b.' + k.strip() for k in KEY.split(','))}, cast(b.l_quantity as bigint) as q, cast(a.l_quantity as bigint) as p from n a join n b on b.l_suppkey = a.l_suppkey and b.n = a.n + 1 where abs(a.l_quantity - b.l_quantity) <= 4""",
    ),
    "neighbour_exists": (
        """select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before, lead(event_type) over (partition by user_id order by ts, event_id) as after from {events})
        where event_type = before or event_type = after""",
        f"with n as ({NUMBERED}) select distinct a.event_id from n a join n b on a.user_id = b.user_id and abs(a.n - b.n) = 1 and a.event_type = b.event_type",
    ),
    "neighbour_absent": (
        """select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before, lead(event_type) over (partition by user_id order by ts, event_id) as after from {events})
        where coalesce(event_type <> before, true) and coalesce(event_type <> after, true)""",
        f"with n as ({NUMBERED}) select event_id from n a where not exists (select 1 from n b where b.user_id = a.user_id and abs(a.n - b.n) = 1 and a.event_type = b.event_type)",
    ),
    "slot_lookup": ("select s_suppkey, n_name as slot_name from {supplier} join {nation} on s_nationkey = n_nationkey", "select s_suppkey, (select n_name from nation where n_nationkey = s_nationkey) as slot_name from supplier where s_nationkey in (select n_nationkey from nation)"),
    "default_lookup": (
        "select c_custkey, coalesce(n, 0) as orders from {customer} left join (select o_custkey, cast(count(*) as bigint) as n from {orders} group by o_custkey) on c_custkey = o_custkey",
        "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as orders from customer",
    ),
    "scatter_last_wins": (
        "select l_partkey % 97 as row, l_suppkey % 13 as col, cast(max_by(l_quantity, struct(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) as bigint) as v from {lineitem} group by l_partkey % 97, l_suppkey % 13",
        """select row, col, cast(l_quantity as bigint) as v from (select *, l_partkey % 97 as row, l_suppkey % 13 as col,
            row_number() over (partition by l_partkey % 97, l_suppkey % 13 order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as n from lineitem) where n = 1""",
    ),
    "zip_diff": (
        f"""with n as (select l_suppkey, l_returnflag = 'A' as ours, cast(l_quantity as bigint) as x, row_number() over (partition by l_suppkey, l_returnflag order by {KEY}, l_quantity) - 1 as i from {{lineitem}} where l_returnflag in ('A', 'R')),
        z as (select l_suppkey, i, max(if(ours, x, null)) as a, max(if(ours, null, x)) as b from n group by l_suppkey, i),
        d as (select *, if(a <> b, row_number() over (partition by l_suppkey, a <> b order by i), null) as k from z)
        select l_suppkey, count_if(a is not null and b is not null) as n, count_if(a <> b) as diffs, max(abs(a - b)) as max_diff, cast(min(if(a <> b, i, null)) as bigint) as first_diff, count_if(a is null or b is null) as unmatched,
            concat_ws(',', {', '.join(f"max(if(k = {k}, i, null))" for k in range(1, 6))}) as first_five from d group by l_suppkey""",
        f"""with l as (select l_suppkey, list(cast(l_quantity as bigint) order by {KEY}, l_quantity) filter (l_returnflag = 'A') as a, list(cast(l_quantity as bigint) order by {KEY}, l_quantity) filter (l_returnflag = 'R') as b from lineitem where l_returnflag in ('A', 'R') group by l_suppkey),
        m as (select l_suppkey, coalesce(a, []) as a, coalesce(b, []) as b from l),
        d as (select l_suppkey, least(len(a), len(b)) as n, greatest(len(a), len(b)) - least(len(a), len(b)) as unmatched, list_transform(range(1, least(len(a), len(b)) + 1), lambda i: abs(a[i] - b[i])) as d from m),
        p as (select *, list_filter(range(n), lambda i: d[i + 1] > 0) as p from d)
        select l_suppkey, cast(n as bigint) as n, len(p) as diffs, list_max(d) as max_diff, cast(p[1] as bigint) as first_diff, cast(unmatched as bigint) as unmatched, array_to_string(p[1:5], ',') as first_five from p""",
    ),
    # --- aggregates ----------------------------------------------------------------------------------------------
    "type_histogram": ("select event_type, cast(count(*) as bigint) as n from {events} group by event_type", "select t as event_type, (select count(*) from events where event_type = t) as n from (select distinct event_type as t from events)"),
    "sync_count": (
        "select user_id, cast(sum(case when event_type = 'signup' then 1 else 0 end) as bigint) as syncs, cast(count(*) as bigint) as samples from {events} group by user_id",
        "select u as user_id, (select count(*) from events where user_id = u and event_type = 'signup') as syncs, (select count(*) from events where user_id = u) as samples from (select distinct user_id as u from events)",
    ),
    "tu_fu_obu_totals": (
        """with g as (select o_orderstatus, l_orderkey, l_partkey, count(*) as n, grouping_id(o_orderstatus, l_orderkey, l_partkey) as level from {orders} join {lineitem} on o_orderkey = l_orderkey
            group by grouping sets ((o_orderstatus, l_orderkey), (o_orderstatus, l_partkey), (l_partkey))),
        r as (select o_orderstatus, level = 6 as over_all, count_if(level = 1) as units, count_if(level = 2) as frames, count_if(level = 6) as all_frames, sum(if(level = 1, n, 0)) as obus from g group by o_orderstatus, level = 6)
        select o_orderstatus, units, frames, obus from (
            select o_orderstatus, over_all, grouping(o_orderstatus) as whole, sum(units) as units, if(grouping(o_orderstatus) = 1, sum(all_frames), sum(frames)) as frames, sum(obus) as obus from r
            group by grouping sets ((o_orderstatus, over_all), ())) where whole = 1 or not over_all""",
        """with j as (select o_orderstatus, l_orderkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey)
        select o_orderstatus, count(distinct l_orderkey) as units, count(distinct l_partkey) as frames, count(*) as obus from j group by o_orderstatus
        union all select null, count(distinct l_orderkey), count(distinct l_partkey), count(*) from j""",
    ),
    "lsq_sums": (
        """select l_suppkey, cast(sum(x * x) as bigint) as sxx, cast(sum(x * y) as bigint) as sxy, cast(sum(y * y) as bigint) as syy, cast(count(*) as bigint) as n
        from (select l_suppkey, cast(l_quantity as bigint) as x, cast(round(l_discount * 100) as bigint) as y from {lineitem}) group by l_suppkey""",
        """select l_suppkey, cast(list_inner_product(x, x) as bigint) as sxx, cast(list_inner_product(x, y) as bigint) as sxy, cast(list_inner_product(y, y) as bigint) as syy, cast(len(x) as bigint) as n
        from (select l_suppkey, list(p[1]) as x, list(p[2]) as y from (select l_suppkey, [cast(l_quantity as double), round(l_discount * 100)] as p from lineitem) group by l_suppkey)""",
    ),
    "weighted_candidates": (
        """with v as (select user_id, cast(event_id % 13 as bigint) as mv, sum(cast(1 + event_id % 3 as bigint)) as weight, min(event_id) as first_seen from {events} group by user_id, event_id % 13)
        select user_id, mv, cast(weight as bigint) as weight, cast(place as bigint) as place from (select *, row_number() over (partition by user_id order by weight desc, first_seen) as place from v) where place <= 8""",
        """with v as (select user_id, cast(event_id % 13 as bigint) as mv, cast(sum(1 + event_id % 3) as bigint) as weight, min(event_id) as first_seen from events group by user_id, event_id % 13)
        select a.user_id, a.mv, a.weight, count(b.mv) + 1 as place from v a left join v b on a.user_id = b.user_id and (b.weight > a.weight or (b.weight = a.weight and b.first_seen < a.first_seen)) group by a.user_id, a.mv, a.weight having count(b.mv) < 8""",
    ),
    "candidate_context": (
        """with v as (select user_id, cast(event_id % 13 as bigint) as mv, sum(1 + event_id % 3) as weight, min(event_id) as first_seen from {events} group by user_id, event_id % 13),
        s as (select user_id, slice(array_sort(collect_list(struct(-weight as w, first_seen as f, mv as mv))), 1, 8) as c from v group by user_id)
        select user_id, cast(pos as bigint) as idx, coalesce(e.mv, -1) as mv, cast(case when pos + 1 >= size(c) then 2 when -c[pos].w >= 10 then if(-c[pos + 1].w < 10, 1, 0) when -c[pos + 1].w < 10 then 2 else 0 end as bigint) as context
        from (select user_id, c, posexplode(concat(c, if(size(c) < 2, array_repeat(cast(null as struct<w: bigint, f: bigint, mv: bigint>), 2 - size(c)), array()))) as (pos, e) from s)""",
        """with v as (select user_id, cast(event_id % 13 as bigint) as mv, sum(1 + event_id % 3) as weight, min(event_id) as first_seen from events group by user_id, event_id % 13),
        r as (select *, row_number() over (partition by user_id order by weight desc, first_seen) - 1 as idx from v), t as (select * from r where idx < 8), u as (select user_id, max(idx) as last from t group by user_id),
        g as (select user_id, unnest(range(greatest(last, 1) + 1)) as idx from u)
        select g.user_id, cast(g.idx as bigint) as idx, coalesce(a.mv, -1) as mv,
            cast(case when b.mv is null then 2 when (a.weight >= 10) = (b.weight >= 10) and a.weight >= 10 then 0 when a.weight >= 10 then 1 when b.weight < 10 then 2 else 0 end as bigint) as context
        from g left join t a on a.user_id = g.user_id and a.idx = g.idx left join t b on b.user_id = g.user_id and b.idx = g.idx + 1""",
    ),
    "two_segment_sort": (
        """with v as (select user_id, cast(event_id % 13 as bigint) as mv, sum(1 + event_id % 3) as weight, min(event_id) as first_seen from {events} group by user_id, event_id % 13),
        n as (select *, row_number() over (partition by user_id order by first_seen) as seen from v)
        select user_id, mv, cast(row_number() over (partition by user_id order by if(seen <= 4, 0, 1), weight desc, first_seen) as bigint) as place from n""",
        """with v as (select user_id, cast(event_id % 13 as bigint) as mv, sum(1 + event_id % 3) as weight, min(event_id) as first_seen from events group by user_id, event_id % 13),
        l as (select user_id, list({'s': first_seen, 'w': weight, 'm': mv} order by first_seen) as c from v group by user_id),
        s as (select user_id, list_concat(list_sort(list_transform(c[1:4], lambda x: {'w': -x.w, 's': x.s, 'm': x.m})), list_sort(list_transform(c[5:], lambda x: {'w': -x.w, 's': x.s, 'm': x.m}))) as c from l)
        select user_id, x.m as mv, cast(i as bigint) as place from (select user_id, unnest(c) as x, unnest(range(1, len(c) + 1)) as i from s)""",
    ),
    "all_skip_cells": (
        "select l_orderkey as cell, cast(count(*) as bigint) as n from {lineitem} group by l_orderkey having min(case when l_quantity < 40 then 1 else 0 end) = 1",
        "select l_orderkey as cell, count(*) as n from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_quantity >= 40) group by l_orderkey",
    ),
    # --- scalar functions ----------------------------------------------------------------------------------------
    "round_shift": (f"select {KEY}, (cast(floor(l_extendedprice) as bigint) - 30000 + 32) >> 6 as y from {{lineitem}}", f"select {KEY}, cast(floor((floor(l_extendedprice) - 30000 + 32) / 64) as bigint) as y from lineitem"),
    "clamp": ("select event_id, greatest(10L, least(200L, cast(floor(value * 3) as bigint))) as y from {events}", f"select event_id, {median('floor(value * 3)', 10, 200)} as y from events"),
    "mod_distance": (
        "select event_id, cast((((event_id % 128) - (user_id % 128)) & 63) - (((event_id % 128) - (user_id % 128)) & 64) as bigint) as d from {events}",
        "select event_id, cast((event_id - user_id + cast(12800000000 as bigint) + 64) % 128 - 64 as bigint) as d from events",
    ),
    "paeth_select": (
        f"""select {KEY}, case when abs(b - a) <= abs(b - l) and abs(b - a) <= abs(b - t) then a when abs(b - l) <= abs(b - t) then l else t end as y
        from (select *, a + l - t as b from (select *, cast(l_quantity as bigint) as a, cast(l_partkey % 50 as bigint) as l, cast(l_suppkey % 50 as bigint) as t from {{lineitem}}))""",
        f"""with s as (select *, cast(l_quantity as bigint) as a, l_partkey % 50 as l, l_suppkey % 50 as t from lineitem)
        select {KEY}, list_sort([{{'d': abs(l - t), 'k': 1, 'v': a}}, {{'d': abs(a - t), 'k': 2, 'v': l}}, {{'d': abs(a + l - 2 * t), 'k': 3, 'v': t}}])[1].v as y from s""",
    ),
    "yuv_to_rgb": (
        """select event_id, greatest(0, least(255, y + ((91881 * v + 32768) >> 16))) as r, greatest(0, least(255, y - ((22554 * u + 46802 * v + 32768) >> 16))) as g, greatest(0, least(255, y + ((116130 * u + 32768) >> 16))) as b
        from (select event_id, event_id % 256 as y, user_id * 7 % 256 - 128 as u, (event_id * 13 + user_id) % 256 - 128 as v from {events})""",
        f"""select event_id, {median('y + floor((91881 * v + 32768) / 65536.0)')} as r, {median('y - floor((22554 * u + 46802 * v + 32768) / 65536.0)')} as g, {median('y + floor((116130 * u + 32768) / 65536.0)')} as b
        from (select event_id, event_id % 256 as y, user_id * 7 % 256 - 128 as u, (event_id * 13 + user_id) % 256 - 128 as v from events)""",
    ),
    "su_decode": ("select event_id, cast(case when v >= 32 then v - 64 else v end as bigint) as y from (select event_id, event_id % 64 as v from {events})", "select event_id, cast(event_id % 32 - 32 * (event_id % 64 // 32) as bigint) as y from events"),
    "ns_decode": (
        """select event_id, n, cast(case when v < m then v else v * 2 - m + b end as bigint) as y from (select *, (1 << w) - n as m, event_id % (1 << (w - 1)) as v, user_id % 2 as b from (select *, length(bin(n)) as w from (select event_id, user_id, 2 + event_id % 11 as n from {events})))""",
        """with w as (select n, cast(length(bin(n)) as int) as w, cast(pow(2, length(bin(n))) as bigint) - n as m from (select unnest(range(2, 13)) as n)),
        words as (select n, w, v, b from (select n, w, m, unnest(range(cast(pow(2, w - 1) as bigint))) as v from w) cross join (select unnest([0, 1]) as b) where v >= m or b = 0),
        codes as (select n, v, b, count(*) over (partition by n, v) as k, row_number() over (partition by n order by v, b) - 1 as y from words)
        select event_id, e.n, cast(y as bigint) as y from (select event_id, user_id, 2 + event_id % 11 as n from events) e join w on w.n = e.n
            join codes c on c.n = e.n and c.v = event_id % cast(pow(2, w.w - 1) as bigint) and (c.k = 1 or c.b = user_id % 2)""",
    ),
    "trailing_zeros": (
        "select event_id, cast(if(event_id = 0, 0, length(bin(event_id & -event_id)) - 1) as bigint) as y from {events}",
        "select event_id, coalesce(list_max(list_filter(range(0, 40), lambda k: event_id > 0 and event_id % (cast(1 as bigint) << k) = 0)), 0) as y from events",
    ),
    "divisor_approximation": (
        """select event_id, cast((4194304 + (256 + f) div 2) div (256 + f) as bigint) as multiplier, cast(s + 14 as bigint) as shift from (select event_id, s, least(256, if(s > 8, (e + shiftleft(1L, s - 9)) >> (s - 8), shiftleft(e, 8 - s))) as f
            from (select event_id, s, event_id * 37 + 1 - shiftleft(1L, s) as e from (select event_id, length(bin(event_id * 37 + 1)) - 1 as s from {events})))""",
        """with d as (select event_id, event_id * 37 + 1 as d, list_max(list_filter(range(0, 40), lambda k: (cast(1 as bigint) << k) <= event_id * 37 + 1)) as s from events),
        f as (select event_id, s, case when s > 8 then floor((d - pow(2, s)) / pow(2, s - 8) + 0.5) else (d - pow(2, s)) * pow(2, 8 - s) end as f from d)
        select event_id, cast(round(4194304 / (256 + least(256, f))) as bigint) as multiplier, s + 14 as shift from f""",
    ),
    "golomb_code": (
        "select event_id, bits, cast(shiftleft(1L, instr(bits, '1') - 1) - 1 + cast(coalesce(conv(substring(bits, instr(bits, '1') + 1), 2, 10), '0') as bigint) as bigint) as decoded from (select event_id, concat(repeat('0', length(bin(v + 1)) - 1), bin(v + 1)) as bits from (select event_id, event_id % 5000 as v from {events}))",
        "select event_id, repeat('0', n) || bin(v + 1) as bits, v as decoded from (select event_id, event_id % 5000 as v, list_max(list_filter(range(0, 20), lambda k: (1 << k) <= event_id % 5000 + 1)) as n from events)",
    ),
    "subexp_decode": (
        """select event_id, cast(if(ref * 2 <= 64, c, 63 - c) as bigint) as y from (select event_id, ref, case when v > 2 * r then v when v % 2 = 0 then r + (v >> 1) else r - ((v + 1) >> 1) end as c
            from (select event_id, ref, if(ref * 2 <= 64, ref, 63 - ref) as r, a + b as v from (select event_id, user_id % 64 as ref, if(p = 0, 0, 1 << (2 + p)) as a, event_id div 4 % (1 << greatest(3, 2 + p)) as b from (select event_id, user_id, cast(event_id % 4 as int) as p from {events}))))""",
        """with v as (select event_id, user_id % 64 as ref, a + event_id // 4 % n as v from events join (values (0, 0, 8), (1, 8, 8), (2, 16, 16), (3, 32, 32)) t(p, a, n) on p = event_id % 4),
        c as (select e.event_id, ref, v, case when 2 * ref <= 64 then ref else 63 - ref end as r from v e),
        z as (select *, case when v > 2 * r then v else r + (case when v % 2 = 0 then 1 else -1 end) * ceil(v / 2.0) end as x from c)
        select event_id, cast(case when 2 * ref <= 64 then x else 63 - x end as bigint) as y from z""",
    ),
    "size_classes": (
        """select event_id, case when m >= 32 then 'TX_32X32' when m >= 16 then 'TX_16X16' when m >= 8 then 'TX_8X8' else 'TX_4X4' end as max_tx, cast(greatest(0, least(6, length(bin(w * h - 1)) - 4)) as bigint) as eob_class
            from (select event_id, w, h, least(w, h) as m from (select event_id, 4 << cast(event_id % 5 as int) as w, 4 << cast(user_id % 5 as int) as h from {events}))""",
        """with s as (select event_id, cast(pow(2, 2 + event_id % 5) as bigint) as w, cast(pow(2, 2 + user_id % 5) as bigint) as h from events)
        select event_id, n as max_tx, c as eob_class from s join (values (4, 'TX_4X4'), (8, 'TX_8X8'), (16, 'TX_16X16'), (32, 'TX_32X32')) t(d, n) on d = least(32, w, h)
            join (select unnest([16, 32, 64, 128, 256, 512, 1024, 2048, 4096]) as k, cast(unnest([0, 1, 2, 3, 4, 5, 6, 6, 6]) as bigint) as c) on k = w * h""",
    ),
    "mv_precision": (
        "select event_id, (mv - (mv >> 31)) & ~1L as quarter, (mv - (mv >> 31) + 3) & ~7L as whole from (select event_id, event_id % 401 - 200 as mv from {events})",
        "select event_id, cast(2 * trunc(mv / 2.0) as bigint) as quarter, cast(8 * floor((mv + (case when mv < 0 then 4 else 3 end)) / 8.0) as bigint) as whole from (select event_id, event_id % 401 - 200 as mv from events)",
    ),
    "deblock_limits": (
        """select event_id, level, greatest(1, if(sharp > 0, least(level >> cast((sharp + 3) >> 2 as int), 9 - sharp), level)) as inner_limit, 2 * (level + 2) + greatest(1, if(sharp > 0, least(level >> cast((sharp + 3) >> 2 as int), 9 - sharp), level)) as edge_limit
        from (select event_id, coalesce(nullif(event_id % 5 * 13, 0), event_id % 64) as level, user_id % 8 as sharp from {events})""",
        """with l as (select event_id, case when event_id % 5 = 0 then event_id % 64 else event_id % 5 * 13 end as level, user_id % 8 as sharp from events),
        i as (select *, list_max([1, case sharp when 0 then level else list_min([level // (case when sharp <= 4 then 2 else 4 end), 9 - sharp]) end]) as inner_limit from l)
        select event_id, level, inner_limit, 4 + 2 * level + inner_limit as edge_limit from i""",
    ),
    "tick_times": (
        """select event_id, floor((t + c) * 1000000 / 24000) as micros, cast(t * 1000000 div 24000 as bigint) as decode_micros, (t + c) < 0 as before_start from (select event_id, event_id * 1001 as t, (user_id % 5 - 3) * 1001 as c from {events})""",
        """with e as (select event_id, event_id * 1001 as t, (event_id + user_id % 5 - 3) * 1001 as p from events)
        select event_id, cast(case when p < 0 then -((-p * 1000000 + 23999) // 24000) else p * 1000000 // 24000 end as bigint) as micros, cast(t * 1000000 // 24000 as bigint) as decode_micros, p < 0 as before_start from e""",
    ),
    # --- strings -------------------------------------------------------------------------------------------------
    "enum_labels": (
        "select /*+ broadcast(t) */ event_id, coalesce(t.label, 'UNKNOWN') as label from {events} e left join (values ('signup', 'KEY_FRAME'), ('click', 'INTER_FRAME'), ('purchase', 'INTRA_ONLY_FRAME'), ('view', 'SWITCH_FRAME')) t(kind, label) on t.kind = e.event_type",
        "select event_id, case event_type when 'signup' then 'KEY_FRAME' when 'click' then 'INTER_FRAME' when 'purchase' then 'INTRA_ONLY_FRAME' when 'view' then 'SWITCH_FRAME' else 'UNKNOWN' end as label from events",
    ),
    "fourcc": (
        "select doc_id, substring(text, 1, 4) as fourcc, cast(conv(nullif(substring(hex(encode(text, 'utf-8')), 1, 2), ''), 16, 10) as bigint) as first_byte from {documents}",
        "select doc_id, left(text, 4) as fourcc, cast('0x' || nullif(left(hex(encode(text)), 2), '') as bigint) as first_byte from documents",
    ),
    "bytes_fields": (
        "select doc_id, b >> 7 as forbidden, (b >> 3) & 15 as unit_type, (b >> 2) & 1 as has_extension, (b >> 1) & 1 as has_size from (select doc_id, cast(conv(nullif(substring(hex(encode(text, 'utf-8')), 1, 2), ''), 16, 10) as bigint) as b from {documents})",
        "select doc_id, b // 128 as forbidden, b % 128 // 8 as unit_type, b % 8 // 4 as has_extension, b % 4 // 2 as has_size from (select doc_id, cast('0x' || nullif(left(hex(encode(text)), 2), '') as bigint) as b from documents)",
    ),
    "format_sniff": (
        "select page_id, case when substring(html, 1, 4) = 'DKIF' then 'ivf' when substring(html, 5, 4) in ('ftyp', 'moov', 'mdat', 'free', 'skip', 'wide', 'pnot') then 'mp4' when lower(ltrim(html)) like '<!doctype%' or lower(ltrim(html)) like '<html%' then 'html' else 'unknown' end as format from {pages}",
        "select page_id, case when regexp_matches(html, '^DKIF') then 'ivf' when regexp_matches(html, '(?s)^.{4}(ftyp|moov|mdat|free|skip|wide|pnot)') then 'mp4' when regexp_matches(html, '(?i)^ *<(!doctype|html)') then 'html' else 'unknown' end as format from pages",
    ),
    "suffix_class": (
        "select page_id, case when endswith(url, '.html') then 'page' when endswith(url, '/') then 'folder' else 'other' end as kind from {pages}",
        "select page_id, case when regexp_matches(url, '\\.html$') then 'page' when right(url, 1) = '/' then 'folder' else 'other' end as kind from pages",
    ),
    "subsampling_label": (
        "select event_id, case when event_id % 7 = 0 then 'monochrome' when event_id % 2 = 1 and user_id % 2 = 1 then '4:2:0' when event_id % 2 = 1 then '4:2:2' else '4:4:4' end as chroma from {events}",
        "select event_id, n as chroma from events join (values (true, 0, 0, 'monochrome'), (true, 0, 1, 'monochrome'), (true, 1, 0, 'monochrome'), (true, 1, 1, 'monochrome'), (false, 1, 1, '4:2:0'), (false, 1, 0, '4:2:2'), (false, 0, 1, '4:4:4'), (false, 0, 0, '4:4:4')) t(m, x, y, n) on m = (event_id % 7 = 0) and x = event_id % 2 and y = user_id % 2",
    ),
    "header_line": (
        "select p_partkey, line, cast(regexp_extract(line, ' W([0-9]+)', 1) as bigint) as width, cast(regexp_extract(line, ' H([0-9]+)', 1) as bigint) as height from (select p_partkey, format_string('YUV4MPEG2 W%d H%d F30:1 Ip A1:1 C420jpeg', p_size * 16, p_size * 9) as line from {part})",
        "select p_partkey, 'YUV4MPEG2 W' || 16 * p_size || ' H' || 9 * p_size || ' F30:1 Ip A1:1 C420jpeg' as line, cast(16 * p_size as bigint) as width, cast(9 * p_size as bigint) as height from part",
    ),
    # --- ordered state -------------------------------------------------------------------------------------------
    "encoder_session": (
        """select user_id, event_id, n as frame_count, (n = 0 or n % 30 = 0 or event_type = 'signup') as is_key, concat('2,', case when n = 0 or n % 30 = 0 or event_type = 'signup' then '1,' else '' end, '6') as obus
        from (select user_id, event_id, event_type, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as n from {events})""",
        f"""with n as (select a.user_id, a.event_id, a.event_type, count(b.event_id) as n from events a left join events b on {EARLIER} group by a.user_id, a.event_id, a.event_type)
        select user_id, event_id, n as frame_count, n % 30 = 0 or event_type = 'signup' as is_key, case when n % 30 = 0 or event_type = 'signup' then '2,1,6' else '2,6' end as obus from n""",
    ),
    "error_policies": (
        """select event_id, event_type = 'error' as skipped, (errors > 0) as stopped, shown from (select event_id, event_type, sum(case when event_type = 'error' then 1 else 0 end) over w as errors,
            last_value(case when event_type <> 'error' then event_id end) ignore nulls over w as shown from {events} window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row))""",
        """select a.event_id, a.event_type = 'error' as skipped, coalesce(bool_or(b.event_type = 'error'), false) as stopped, arg_max(b.event_id, {'t': b.ts, 'e': b.event_id}) filter (b.event_type <> 'error') as shown
        from events a join events b on b.user_id = a.user_id and (b.ts, b.event_id) <= (a.ts, a.event_id) group by a.event_id, a.event_type""",
    ),
}
