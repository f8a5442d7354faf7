"""Interval joins, composed folds, grids and rules against plain Python, with hot keys, ties and nulls."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import grids, intervals, rules, scans


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_last_run_join(spark, block):
    r = random.Random(block)
    runs = [(r.choice("ab"), r.randrange(-50, 200), r.randrange(9)) for _ in range(40)] + [(None, 3, 1), ("a", None, 1), ("z", 5, 5)]
    points = [(r.choice("abc"), r.randrange(-80, 260), i) for i in range(300)] + [(None, 9, 900), ("a", None, 901), ("b", 77, 902), ("b", 77, 902)]
    got = intervals.last_run_join(spark.createDataFrame(points, "k string, p long, id int"), spark.createDataFrame(runs, "k string, s long, v int"), ["k"], "p", "s", block)
    assert got.columns == ["k", "p", "id", "s", "v"]

    def want(k, p):
        found = [(s, v) for key, s, v in runs if k is not None and p is not None and key == k and s is not None and s <= p]
        return max(found) if found else (None, None)

    assert sorted(map(tuple, got.collect()), key=str) == sorted([(k, p, i, *want(k, p)) for k, p, i in points], key=str)
    with pytest.raises(ValueError):
        intervals.last_run_join(spark.createDataFrame(points, "k string, p long, v int"), spark.createDataFrame(runs, "k string, s long, v int"), ["k"], "p", "s", 9)


def test_a_hot_key_lies_in_many_tasks(spark):
    """One key has all rows: the window over them is cut by ranges of places, and so is the fold."""
    rows = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("p"))
    runs = rows.where("p % 100 = 0").select("k", F.col("p").alias("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = intervals.last_run_join(rows, runs, ["k"], "p", "s", 500).select("p", "s", F.spark_partition_id().alias("part"))
        assert got.where("s <> p - p % 100").count() == 0
        assert got.groupBy("part").count().agg(F.max("count")).first()[0] < 12_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = scans.composites(rows.withColumn("b", F.floor(F.col("p") / 500)), ["k", "b"], ["p"], F.col("p"), scans.Polynomial())
    assert parts.count() == 40


def test_folds(spark):
    r = random.Random(3)
    rows = [(r.choice(["x", "y", None]), t, r.randrange(-40, 40) if r.random() < 0.95 else None) for t in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(5)

    def plain(step, start):
        last, after = {}, {}
        for k, t, v in rows:
            last[k] = after[t] = step(last.get(k, start), v or 0)
        return last, after

    signed = lambda h: (h + 2**63) % 2**64 - 2**63
    for steps, step, start in ((scans.Polynomial(31), lambda h, v: signed(h * 31 + v), 7), (scans.Clamped(-25, 60), lambda q, v: max(-25, min(60, q + v)), 0)):
        last, after = plain(step, start)
        for block in (F.floor(F.col("t") / 64), F.lit(0), F.col("t")):
            assert {x["k"]: x["value"] for x in scans.fold(df, ["k"], ["t"], F.col("v"), steps, start, block).collect()} == last
        assert {x["t"]: x["value"] for x in scans.running(df, ["k"], ["t"], F.col("v"), steps, start, F.floor(F.col("t") / 64), ["t"]).collect()} == after
    assert scans.fold(df.limit(0), ["k"], ["t"], F.col("v"), scans.Clamped(0, 1), 0, F.lit(0)).count() == 0


def test_groups_go_on_over_batches():
    import pyarrow as pa

    values = list(range(1, 60))
    batches = [pa.RecordBatch.from_arrays([pa.array(["a"] * len(values[i : i + 7])), pa.array(values[i : i + 7])], ["__group", "__value"]) for i in range(0, len(values), 7)]
    [(_, state)] = list(scans._groups(iter(batches), scans.Polynomial(3), False, True))
    want = 0
    for v in values:
        want = (want * 3 + v) % 2**64
    assert int(state[1][0]) % 2**64 == want


def test_partitions_tile_their_areas(spark):
    areas = [(i, 1 + i * 7 % 70, 1 + i * 13 % 50) for i in range(60)]
    roots = [(i, n, m, t, c) for i, n, m in areas for t in range(0, n, 32) for c in range(0, m, 32)]
    df = spark.createDataFrame(roots, "id int, rows long, cols long, top long, left long")
    found = grids.partition_areas(df, 32, lambda r, c, n: F.pmod(F.col("id") + r + 3 * c + n, F.lit(4))).collect()
    for i, n, m in areas:
        seen = np.zeros((n, m), dtype=int)
        for b in (x for x in found if x["id"] == i):
            assert b["row"] < n and b["col"] < m and b["seen_w"] == min(b["w"], m - b["col"]) and b["seen_h"] == min(b["h"], n - b["row"])
            seen[b["row"] : b["row"] + b["h"], b["col"] : b["col"] + b["w"]] += 1
        assert (seen == 1).all()


def test_squares_of_one_file_are_split_in_many_tasks(spark, monkeypatch):
    """All leaves of a recursion in plain Python; roots that lie in one task are dealt out, null and unknown symbols are left out."""
    monkeypatch.setattr(grids, "ROOTS", 10, raising=False)
    areas = [(i, 1 + i * 7 % 30, 1 + i * 11 % 30) for i in range(120)]
    df = spark.createDataFrame([(i, n, m, t, c) for i, n, m in areas for t in range(0, n, 16) for c in range(0, m, 16)], "id int, rows long, cols long, top long, left long").coalesce(1)
    symbol = lambda i, r, c, n: None if i == 7 else (i + r + 3 * c + n) % (6 if i % 5 == 0 else 4)
    found = grids.partition_areas(df, 16, lambda r, c, n: F.when(F.col("id") != 7, F.pmod(F.col("id") + r + 3 * c + n, F.when(F.col("id") % 5 == 0, 6).otherwise(4))))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 5

    def leaves(i, rows, cols, r, c, n):
        if r >= rows or c >= cols:
            return []
        h, s = n // 2, symbol(i, r, c, n)
        below, beside = r + h < rows, c + h < cols
        k = 0 if n == 1 else s if below and beside else (3 if s == 3 else 1) if beside else (3 if s == 3 else 2) if below else 3
        whole = {0: [(r, c, n, n)], 1: [(r, c, n, h), (r + h, c, n, h)], 2: [(r, c, h, n), (r, c + h, h, n)]}.get(k, [])
        return [x for x in whole if x[0] < rows and x[1] < cols] + [x for a in (r, r + h) for b in (c, c + h) if k == 3 for x in leaves(i, rows, cols, a, b, h)]

    want = [(i, *x) for i, n, m in areas for t in range(0, n, 16) for c in range(0, m, 16) for x in leaves(i, n, m, t, c, 16)]
    assert sorted(map(tuple, found.select("id", "row", "col", "w", "h").collect())) == sorted(want)


def wedge(way):
    """A mask of 64 by 64 by drawing its lines and turning it."""
    line = lambda border, centre: [0 if x < centre - 4 else 64 if x >= centre + 4 else border[x - centre + 4] for x in range(64)]
    upright = np.array([line(grids.BORDERS["straight"], 32)] * 64)
    steep = np.array([line(grids.BORDERS["odd" if y % 2 else "even"], 48 - (y + 1) // 2) for y in range(64)])
    return {grids.VERTICAL: upright, grids.HORIZONTAL: upright.T, grids.OBLIQUE63: steep, grids.OBLIQUE27: steep.T, grids.OBLIQUE117: steep[:, ::-1], grids.OBLIQUE153: steep.T[:, ::-1]}[way]


def test_wedges_of_all_shapes(spark):
    got = {}
    for r in grids.wedge_masks(spark).collect():
        got.setdefault((r["w"], r["h"], r["nth"]), {})[r["y"], r["x"]] = r["weight"]
    assert len(got) == 9 * 16
    for (w, h, k), cells in got.items():
        way, dx, dy = grids.WEDGES["tall" if h > w else "wide" if h < w else "square"][k]
        at = wedge(way)[32 - h * dy // 8 :, 32 - w * dx // 8 :][:h, :w]
        want = 64 - at if grids.TURNED[w, h] >> k & 1 else at
        assert [[cells[y, x] for x in range(w)] for y in range(h)] == want.tolist()


def test_masks_at_borders_and_corners(spark):
    cells = spark.createDataFrame([(r, c, (r * 5 + c * 3) % 3) for r in range(6) for c in range(6)], "row int, col int, ref int")
    blocks = [(1, 0, 0, 2, 2, 1), (2, 2, 2, 2, 1, 0), (3, 4, 4, 2, 2, 1), (4, 5, 5, 32, 1, 2), (5, 9, 9, 1, 1, 0)]
    got = {b["block_id"]: (b["above_mask"], b["left_mask"], b["overlappable"]) for b in grids.neighbour_masks(spark.createDataFrame(blocks, "block_id int, row int, col int, w int, h int, ref int"), cells).collect()}
    ref = lambda r, c: (r * 5 + c * 3) % 3 if 0 <= r < 6 and 0 <= c < 6 else None
    for i, r, c, w, h, own in blocks:
        above = sum(1 << k for k in range(w) if ref(r - 1, c + k) == own) + ((1 << 32) if max(w, h) < 32 and ref(r - 1, c + w) == own else 0)
        left = sum(1 << k for k in range(h) if ref(r + k, c - 1) == own) + ((1 << 32) if ref(r - 1, c - 1) == own else 0)
        assert got[i] == (above, left, any((ref(r - 1, c + k) or 0) > 0 for k in range(1, w, 2)) or any((ref(r + k, c - 1) or 0) > 0 for k in range(1, h, 2)))


def test_rules_and_counters(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, False, 2, b"ab"), (9, 0, 0, False, 2, b"ab"), (2, None, 1, True, 0, b""), (2, 9, 5, True, 0, b""), (None, 0, 0, False, 7, b"x")], "obu_type int, temporal_id int, spatial_id int, extended boolean, size long, payload binary")
    judged, seen = rules.audited(rows.withColumn("error", rules.first_violation(rules.unit_rules())), rules.unit_rules(), "units")
    judged.write.parquet(str(tmp_path / "units"))
    assert [r["error"] for r in judged.collect()] == [None, "type is known", "extension is there", "temporal id has three bits", "type is known"]
    assert seen.get == {"rows": 5, "type is known": 2, "extension is there": 1, "temporal id has three bits": 2, "spatial id has two bits": 1, "size is the payload's": 1}


def test_sequence_rules_and_defaults(spark):
    names = "profile int, still boolean, reduced boolean, points int, stated_points int, timing_present boolean, timing string, model_present boolean, model string, max_width_minus_1 long, width_bits int, max_height_minus_1 long, height_bits int"
    good = (0, False, False, 1, 1, False, None, False, None, 63, 6, 0, 1)
    change = lambda **new: tuple(new.get(n.split()[0], v) for n, v in zip(names.split(", "), good))
    cases = [
        (good, None), (change(profile=3), "profile is 0 to 2"), (change(reduced=True), "reduced headers are of still pictures"), (change(points=0), "there is an operating point"), (change(reduced=True, still=True, timing_present=True), "reduced headers have no timing"),
        (change(stated_points=2), "all operating points are there"), (change(timing_present=True), "timing is there"), (change(model_present=True), "decoder model is there"), (change(max_width_minus_1=64), "width fits its bits"), (change(max_height_minus_1=2), "height fits its bits"),
    ]
    got = spark.createDataFrame([c for c, _ in cases], names).select(rules.first_violation(rules.sequence_rules()).alias("e")).collect()
    assert [r["e"] for r in got] == [e for _, e in cases]
    plain = rules.with_defaults(spark.createDataFrame([(320, 240, None), (320, 240, 10)], "width int, height int, bit_depth int"))
    assert plain.where(rules.first_violation(rules.settings_rules()).isNull()).count() == 2
    said = [r["sequence"] for r in rules.sequence_of(plain).orderBy("bit_depth").collect()]
    assert [(s["width_bits"], s["height_bits"], s["high_bit_depth"], s["subsampling_x"], s["timing"]["time_scale"]) for s in said] == [(9, 8, False, 1, 30), (9, 8, True, 1, 30)]
