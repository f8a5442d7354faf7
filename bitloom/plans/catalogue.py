"""Table queries: each operator's semantics over the star schema, events, embeddings and texts.

A query is Spark SQL over DataFrames in braces with an oracle of its own. They demonstrate operator semantics on
tables, not conformance of any bitstream. Folds over an ordered array (collect_list) hold one group in one row: the
events of a user, the turns of a conversation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compound, kernels

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
#: Embeddings as samples of 0 to 255.
SPARK_Q = "transform(embedding, x -> cast(greatest(0, least(255, 128 + floor(x * 256))) as int))"
DUCK_Q = "list_transform(embedding, lambda x: cast(greatest(0, least(255, 128 + floor(x * 256))) as int))"
SPARK_PIX = f"select vec_id, pos as i, v from (select vec_id, posexplode({SPARK_Q}) as (pos, v) from {{embeddings}})"
DUCK_PIX = f"select vec_id, unnest(range(len(embedding))) as i, unnest({DUCK_Q}) as v from embeddings"

#: name -> (Spark SQL, oracle SQL or None where it is the same without braces)
SQL: dict[str, tuple[str, str | None]] = {
    # --- windows -------------------------------------------------------------------------------------------------
    "forward_fill": (
        """select event_id, last_value(case when event_type = 'click' then value end) ignore nulls over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_click
        from {events}""",
        "select event_id, last_value(case when event_type = 'click' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_click from events",
    ),
    "tumbling_gop": (
        """select user_id, cast(idx / 4 as bigint) as gop, cast(count(*) as bigint) as n from (select user_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) - 
            pmod(cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint), 4) as idx from {events}) group by user_id, idx""",
        "select user_id, cast(idx // 4 as bigint) as gop, cast(count(*) as bigint) as n from (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx from events) group by user_id, idx // 4",
    ),
    # --- aggregates ----------------------------------------------------------------------------------------------
    "rounded_mean": (
        "select l_suppkey, cast((sum(cast(l_quantity as bigint)) + count(*) div 2) div count(*) as bigint) as dc from {lineitem} group by l_suppkey",
        "select l_suppkey, cast((sum(cast(l_quantity as bigint)) + count(*) // 2) // count(*) as bigint) as dc from lineitem group by l_suppkey",
    ),
    "mean_removal": (
        f"with q as (select vec_id, {SPARK_Q} as q from {{embeddings}}), m as (select vec_id, q, shiftright(aggregate(q, 0, (a, x) -> a + x) + 32, 6) as m from q) select vec_id, cast(pos as bigint) as i, cast(d as bigint) as ac from (select vec_id, posexplode(transform(q, x -> x - m)) as (pos, d) from m)",
        f"with q as (select vec_id, {DUCK_Q} as q from embeddings), m as (select vec_id, q, (list_sum(q) + 32) >> 6 as m from q) select vec_id, cast(unnest(range(64)) as bigint) as i, cast(unnest(list_transform(q, lambda x: x - m)) as bigint) as ac from m",
    ),
    "direction_argmax": (
        """with c as (select user_id, cast(event_id % 8 as bigint) as dir, sum(cast(floor(value * 100) as bigint)) as cost from {events} group by user_id, event_id % 8)
        select user_id, cast(max_by(dir, struct(cost, -dir)) as bigint) as dir, cast(max(cost) as bigint) as cost from c group by user_id""",
        """with c as (select user_id, cast(event_id % 8 as bigint) as dir, sum(cast(floor(value * 100) as bigint)) as cost from events group by user_id, event_id % 8)
        select user_id, cast(arg_max(dir, {'c': cost, 'd': -dir}) as bigint) as dir, cast(max(cost) as bigint) as cost from c group by user_id""",
    ),
    "capped_abs_sum": (
        f"select vec_id, cast(least(63, aggregate(q, 0, (a, x) -> a + abs(x - 128))) as bigint) as level, cast(aggregate(q, 0, (a, x) -> a | x) as bigint) as bits, cast(pmod(sign(aggregate(q, 0, (a, x) -> a + x - 128)) * -2, 3) as bigint) as sign_code from (select vec_id, {SPARK_Q} as q from {{embeddings}})",
        f"select vec_id, cast(least(63, sum(greatest(v - 128, 128 - v))) as bigint) as level, cast(bit_or(v) as bigint) as bits, cast(case when sum(v) < 8192 then 2 when sum(v) > 8192 then 1 else 0 end as bigint) as sign_code from ({DUCK_PIX}) group by vec_id",
    ),
    # --- joins ---------------------------------------------------------------------------------------------------
    "ctts_runlength_join": (
        """with s as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n from {events}),
        r as (select user_id, event_id % 50 as off, sum(1 + event_id % 4) over (partition by user_id order by event_id rows between unbounded preceding and current row) - (1 + event_id % 4) + 1 as from_n from {events} where event_type = 'signup'),
        u as (select user_id, n as at, 1 as side, event_id, cast(null as bigint) as off from s union all select user_id, from_n, 0, null, off from r)
        select event_id, cast(off as bigint) as cts from (select *, last_value(off) ignore nulls over (partition by user_id order by at, side rows between unbounded preceding and current row) as o from u) t where side = 1""".replace("cast(off as bigint) as cts", "cast(o as bigint) as cts"),
        """with s as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n from events),
        r as (select user_id, event_id % 50 as off, sum(1 + event_id % 4) over (partition by user_id order by event_id rows between unbounded preceding and current row) - (1 + event_id % 4) + 1 as from_n from events where event_type = 'signup'),
        b as (select *, lead(from_n) over (partition by user_id order by from_n) as to_n from r)
        select event_id, cast(off as bigint) as cts from s left join b on s.user_id = b.user_id and n >= from_n and (to_n is null or n < to_n)""",
    ),
    # --- scalar functions ----------------------------------------------------------------------------------------
    "floor_log2": ("select event_id, cast(length(bin(event_id + 1)) - 1 as bigint) as y from {events}", "select event_id, cast(length(ltrim(bin(event_id + 1), '0')) - 1 as bigint) as y from events"),
    "inverse_recenter": (
        "select event_id, cast(case when v > 2 * r then v when v % 2 = 0 then r + shiftright(v, 1) else r - shiftright(v + 1, 1) end as bigint) as y from (select event_id, event_id % 64 as v, user_id % 32 as r from {events})",
        "select event_id, cast(case when v > 2 * r then v when v % 2 = 0 then r + (v >> 1) else r - ((v + 1) >> 1) end as bigint) as y from (select event_id, event_id % 64 as v, user_id % 32 as r from events)",
    ),
    "dequant": (
        f"select vec_id, cast(pos as bigint) as i, cast(sign(c) * shiftright(abs(c) * 37, 1) as bigint) as y from (select vec_id, posexplode(transform({SPARK_Q}, x -> x - 128)) as (pos, c) from {{embeddings}})",
        f"select vec_id, cast(i as bigint) as i, cast(sign(v - 128) * ((abs(v - 128) * 37) >> 1) as bigint) as y from ({DUCK_PIX})",
    ),
    "blend": (
        f"select vec_id, cast(pos as bigint) as i, cast(y as bigint) as y from (select vec_id, posexplode(transform(zip_with(q, reverse(q), (a, b) -> struct(a as a, b as b)), (x, k) -> shiftright(x.a * (64 - k) + x.b * k + 32, 6))) as (pos, y) from (select vec_id, {SPARK_Q} as q from {{embeddings}}))",
        f"select vec_id, cast(i as bigint) as i, cast((v * (64 - i) + w * i + 32) >> 6 as bigint) as y from (select vec_id, i, v, first_value(v) over (partition by vec_id, least(i, 63 - i) order by case when true then -i end rows between unbounded preceding and unbounded following) as hi, last_value(v) over (partition by vec_id, least(i, 63 - i) order by -i rows between unbounded preceding and unbounded following) as lo, case when i < 32 then hi else lo end as w from ({DUCK_PIX}))",
    ),
    "leb128_len": (
        "select event_id, case when v = 0 then 1 else cast(ceil(length(bin(v)) / 7.0) as int) end as n_bytes from (select event_id, event_id * 8191 as v from {events})",
        "select event_id, case when v = 0 then 1 else cast(ceil(length(ltrim(bin(v), '0')) / 7.0) as int) end as n_bytes from (select event_id, event_id * 8191 as v from events)",
    ),
    "leb128_roundtrip": (
        """select event_id, aggregate(transform(bytes, (b, i) -> shiftleft(b & 127, cast(7 * i as int))), 0L, (a, x) -> a | x) as v, cast(size(bytes) as bigint) as n
        from (select event_id, transform(sequence(0, greatest(0, cast(ceil(length(bin(event_id * 8191)) / 7.0) as int) - 1)), i -> shiftright(event_id * 8191, 7 * i) & 127) as bytes from {events})""",
        "select event_id, event_id * 8191 as v, cast(greatest(1, ceil(length(ltrim(bin(event_id * 8191), '0')) / 7.0)) as bigint) as n from events",
    ),
    "uvlc_bits": ("select event_id, concat(repeat('0', length(bin(event_id + 1)) - 1), bin(event_id + 1)) as bits from {events}", "select event_id, concat(repeat('0', length(ltrim(bin(event_id + 1), '0')) - 1), ltrim(bin(event_id + 1), '0')) as bits from events"),
    # --- arrays and sets -----------------------------------------------------------------------------------------
    "scan_permutation": (
        f"select vec_id, cast(pos as bigint) as i, cast(v as bigint) as v from (select vec_id, posexplode(transform(sequence(0, 63), k -> q[k % 8 * 8 + k div 8])) as (pos, v) from (select vec_id, {SPARK_Q} as q from {{embeddings}}))",
        f"select vec_id, cast(i % 8 * 8 + i // 8 as bigint) as i, cast(v as bigint) as v from ({DUCK_PIX})",
    ),
    "sorted_union": (
        f"select vec_id, array_join(array_sort(array_union(slice(q, 1, 8), slice(q, 9, 8))), ',') as colors from (select vec_id, {SPARK_Q} as q from {{embeddings}})",
        f"select vec_id, array_to_string(list_sort(list_distinct(q[1:16])), ',') as colors from (select vec_id, {DUCK_Q} as q from embeddings)",
    ),
    "merge_all": (
        f"select vec_id, array_join(array_sort(concat(slice(q, 1, 8), slice(q, 9, 8))), ',') as colors from (select vec_id, {SPARK_Q} as q from {{embeddings}})",
        f"select vec_id, array_to_string(list_sort(q[1:16]), ',') as colors from (select vec_id, {DUCK_Q} as q from embeddings)",
    ),
    "complement_fill": (
        "select event_id, array_join(concat(chosen, array_except(sequence(0, 7), chosen)), ',') as ranked from (select event_id, array_distinct(array(cast(event_id % 8 as int), cast(user_id % 8 as int))) as chosen from {events})",
        "select event_id, array_to_string(list_concat(chosen, list_filter(range(8), lambda x: not list_contains(chosen, x))), ',') as ranked from (select event_id, case when event_id % 8 = user_id % 8 then [event_id % 8] else [event_id % 8, user_id % 8] end as chosen from events)",
    ),
    "flatten_nested": (
        "select conv_id, cast(pos as bigint) as unit, t.turn, t.role from (select conv_id, posexplode(array_sort(collect_list(struct(turn, role)))) as (pos, t) from {conversations} group by conv_id)",
        "select conv_id, cast(row_number() over (partition by conv_id order by turn, role) - 1 as bigint) as unit, turn, role from conversations",
    ),
    "slot_upsert": (
        "select user_id, cast(event_id % 8 as bigint) as slot, max_by(event_type, struct(ts, event_id)) as held from {events} group by user_id, event_id % 8",
        "select user_id, cast(event_id % 8 as bigint) as slot, arg_max(event_type, {'t': ts, 'e': event_id}) as held from events group by user_id, event_id % 8",
    ),
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})

    return run


SQL |= kernels.SQL
QUERIES = {name: _query(sql) for name, (sql, _) in SQL.items()} | compound.QUERIES
ORACLES = {name: oracle or re.sub(r"\{(\w+)\}", r"\1", sql) for name, (sql, oracle) in SQL.items()} | compound.ORACLES
