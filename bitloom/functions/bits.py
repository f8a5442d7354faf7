"""Bit-field codecs as Spark column expressions. Bits are strings of 0 and 1, most significant first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, i: Column | int) -> Column:
    """The byte at place i (from 0) of a binary column; null beyond its end."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when((i >= 0) & (i < F.octet_length(data)), F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int"))


def bits_of(data: Column) -> Column:
    """All bits of a binary column."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.lpad(F.bin(F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")), 8, "0")), "")


def field(bits: Column, start: Column | int, n: Column | int) -> Column:
    """f(n): the number in n bits from place start (from 0)."""
    start, n = (F.lit(x) if isinstance(x, int) else x for x in (start, n))
    return F.conv(F.substring(bits, start + 1, n), 2, 10).cast("long")


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, which is made once, however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def leb128_encode(v: Column) -> Column:
    """Seven bits a byte, least significant first; the top bit says that another byte follows. A number of 64 bits takes ten bytes at most."""

    def parts(v: Column) -> Column:
        rest = [v, *[F.shiftrightunsigned(v, 7 * i) for i in range(1, 10)]]
        byte = lambda r, more: F.substring(F.lit(bytes(range(256))), (r.bitwiseAND(127) + more).cast("int") + 1, F.lit(1))
        # A byte is the last one if its number is below 128 and not negative.
        made = [F.when(r.between(0, 127), byte(r, 0)).otherwise(byte(r, 128)) for r in rest]
        return F.concat(made[0], *[F.when(r == 0, F.lit(b"")).otherwise(m) for r, m in zip(rest[1:], made[1:], strict=True)])

    return _let(v.cast("long"), parts)


def leb128_decode(data: Column, strict: bool = True) -> Column:
    """struct(value, n) of the number that data begins with; at most eight bytes are read.

    strict: null if the eighth byte (or the last one there is) says that another follows; else what was read counts.
    """
    size = F.least(F.octet_length(data), F.lit(8))
    # The eight bytes as one number, the first in its highest bits; data that ends before is followed by zeros.
    word = F.conv(F.rpad(F.hex(F.substring(data, 1, 8)), 16, "0"), 16, -10).cast("long")

    def read(x: Column) -> Column:
        # The highest bit of a byte that is not set there: its place is the length of the number that these bits make.
        length = F.length(F.bin(F.bitwise_not(x["word"]).bitwiseAND(-0x7F7F7F7F7F7F7F80)))
        n = F.when(length > 1, 9 - F.shiftright(length, 3)).otherwise(9)
        return F.struct(x["word"].alias("word"), (F.when(n <= x["size"], n) if strict else F.least(n, x["size"])).alias("n"))

    def number(x: Column) -> Column:
        septet = lambda i: F.shiftleft(F.shiftrightunsigned(x["word"], 56 - 8 * i).bitwiseAND(127), 7 * i)
        value = F.shiftrightunsigned(x["word"], 56).bitwiseAND(127)
        for i in range(1, 8):
            value = value + F.when(x["n"] > i, septet(i)).otherwise(0)
        return F.when((x["n"] > 0), F.struct(value.alias("value"), x["n"].alias("n")))

    return _let(_let(F.struct(word.alias("word"), size.alias("size")), read), number)


def uvlc_encode(v: Column) -> Column:
    """As many zeros as v + 1 has bits after its first, then v + 1."""
    return F.concat(F.repeat(F.lit("0"), F.length(F.bin(v + 1)) - 1), F.bin(v + 1))


def uvlc_decode(bits: Column) -> Column:
    """The number that bits begin with; null without a one, or after 32 zeros or more."""
    zeros = F.instr(bits, "1") - 1
    return F.when((zeros >= 0) & (zeros < 32), field(bits, zeros, zeros + 1) - 1)


def su_decode(bits: Column, n: int) -> Column:
    """A signed number in n bits."""
    v = field(bits, 0, n)
    return F.when(v >= 1 << (n - 1), v - (1 << n)).otherwise(v)


def ns_decode(bits: Column, n: int) -> Column:
    """A number below n in w - 1 or w bits, w being the bits that n - 1 needs and one more if n is a power of two."""
    w = n.bit_length()
    m = (1 << w) - n
    if w == 1:
        return F.lit(0).cast("long")
    v = field(bits, 0, w - 1)
    return F.when(v < m, v).otherwise(v * 2 - m + field(bits, w - 1, 1))


def round_shift(x: Column, n: int) -> Column:
    """x / 2**n, halves up."""
    return F.shiftright(x + (1 << (n - 1)), n) if n else x


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def relative_distance(a: Column, b: Column, bits: int) -> Column:
    """a - b on a clock of 2**bits ticks, as a signed number; 0 without a clock."""
    if not bits:
        return F.lit(0)
    half = 1 << (bits - 1)
    return (a - b).bitwiseAND(half - 1) - (a - b).bitwiseAND(half)
