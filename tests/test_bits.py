import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitloom.functions import bits as B


def rows(spark, values, kind, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(column(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_leb128_decode(spark):
    data = [bytes.fromhex(x) for x in ("00", "01", "7F", "8001", "AC02", "E58E26")]
    got = rows(spark, data, "binary", B.leb128_decode)
    assert [(r["value"], r["n"]) for r in got] == [(0, 1), (1, 1), (127, 1), (128, 2), (300, 2), (624485, 3)]


def test_leb128_encode(spark):
    got = rows(spark, [0, 1, 127, 128, 300, 16384], "long", B.leb128_encode)
    assert [bytes(x).hex() for x in got] == ["00", "01", "7f", "8001", "ac02", "808001"]


def test_leb128_without_an_end(spark):
    data = [b"\x80" * 8, b"", None, b"\xff"]
    assert rows(spark, data, "binary", B.leb128_decode) == [None] * 4
    assert [r and r["value"] for r in rows(spark, data, "binary", lambda x: B.leb128_decode(x, strict=False))] == [0, None, None, 127]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, (1 << 50) - 1), min_size=1, max_size=40))
def test_leb128_round_trip(spark, values):
    got = rows(spark, values, "long", lambda x: B.leb128_decode(B.leb128_encode(x)))
    assert [r["value"] for r in got] == values


def test_leb128_of_large_numbers(spark):
    values = [(1 << 53) + 1, (1 << 56) - 1, (1 << 42) - 1, 1 << 42]
    got = rows(spark, values, "long", lambda x: B.leb128_decode(B.leb128_encode(x)))
    assert [(r["value"], r["n"]) for r in got] == [(values[0], 8), (values[1], 8), (values[2], 6), (values[3], 7)]
    assert bytes(rows(spark, [(1 << 63) - 1], "long", B.leb128_encode)[0]).hex() == "ff" * 8 + "7f"


def test_a_code_is_made_once(spark):
    """The code that is read is named many times; it is an argument, not a part of each of them."""
    plan = spark.range(1).select(B.leb128_decode(B.leb128_encode(F.col("id") * 3)).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("id#") < 10


def test_uvlc(spark):
    assert rows(spark, ["1", "010", "011", "00100", "00111", "0" * 33 + "1", "000"], "string", B.uvlc_decode) == [0, 1, 2, 3, 6, None, None]
    assert [len(x) for x in rows(spark, [0, 1, 2, 3, 6, 7], "long", B.uvlc_encode)] == [1, 3, 3, 5, 5, 7]


def test_su(spark):
    assert rows(spark, ["00000011", "11111101"], "string", lambda x: B.su_decode(x, 8)) == [3, -3]
    assert rows(spark, ["0010", "1110"], "string", lambda x: B.su_decode(x, 4)) == [2, -2]


def test_ns(spark):
    assert rows(spark, ["00", "01", "10", "110", "111"], "string", lambda x: B.ns_decode(x, 5)) == [0, 1, 2, 3, 4]


def test_bits_and_fields(spark):
    assert rows(spark, [b"\xa5\x01"], "binary", B.bits_of) == ["1010010100000001"]
    assert rows(spark, ["10100101"], "string", lambda x: B.field(x, 2, 3)) == [4]


@pytest.mark.parametrize("a, b, want", [(1, 0, 1), (0, 1, -1), (0, 127, 1), (127, 0, -1), (64, 0, -64)])
def test_relative_distance(spark, a, b, want):
    assert spark.range(1).select(B.relative_distance(F.lit(a), F.lit(b), 7)).first()[0] == want


def test_round_shift_and_clamp(spark):
    assert rows(spark, [7, 8, -8, -9, 0], "long", lambda x: B.round_shift(x, 4)) == [0, 1, 0, -1, 0]
    assert rows(spark, [-5, 3, 300], "long", lambda x: B.clamp(x, 0, 255)) == [0, 3, 255]
