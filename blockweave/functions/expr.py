"""Column expressions: modular arithmetic, zigzag, quantising, varint sizes. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 1 << 64


def wrap(x: Column, bits: int = 64) -> Column:
    """A sum or difference as a signed integer of `bits`, modulo 2**bits; session ANSI settings stay as they
    are. 64 bits: x is a decimal within one turn of the range; fewer: x is a long."""
    if bits == 64:
        half = F.lit(str(1 << 63)).cast("decimal(20,0)")
        turn = F.lit(str(_WORD)).cast("decimal(20,0)")
        return F.when(x >= half, x - turn).when(x < -half, x + turn).otherwise(x).cast("bigint")
    return F.pmod(x + F.lit(1 << bits - 1), F.lit(1 << bits)) - F.lit(1 << bits - 1)


def minus(a: Column, b: Column, bits: int = 64) -> Column:
    """a - b modulo 2**bits."""
    if bits == 64:
        return wrap(a.cast("decimal(20,0)") - b.cast("decimal(20,0)"))
    return wrap(a.cast("bigint") - b.cast("bigint"), bits)


def wrapped_sum(total: Column) -> Column:
    """A running sum, as decimal(38,0), modulo 2**64."""
    turn = F.lit(str(_WORD)).cast("decimal(38,0)")
    return wrap(F.pmod(total, turn).cast("decimal(20,0)"))


def zigzag(x: Column) -> Column:
    """(x << 1) ^ (x >> 63): the bits of the unsigned result as a long."""
    return F.shiftleft(x.cast("bigint"), 1).bitwiseXOR(F.shiftright(x.cast("bigint"), 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1).cast("bigint"))))


def complement(x: Column) -> Column:
    return F.bitwise_not(x)


def quantize(v: Column, scale: float, offset: float, low: int, high: int) -> Column:
    """round((v - offset) * scale), half away from zero, clamped; NaN is the lowest value."""
    q = F.round((v - F.lit(float(offset))) * F.lit(float(scale)))
    return F.when(F.isnan(v), F.lit(low)).otherwise(F.greatest(F.least(q, F.lit(float(high))), F.lit(float(low))).cast("int"))


def dequantize(q: Column, scale: float, offset: float) -> Column:
    return q.cast("double") * F.lit(1.0 / scale) + F.lit(float(offset))


def varint_size(u: Column) -> Column:
    """Bytes of the LEB128 form of the bits of a long."""
    out = F.when(u < 0, 10)
    for n in range(1, 10):
        out = out.when(u < (1 << 7 * n), n) if n < 9 else out.otherwise(9)
    return out


def byte_of(x: Column, lane: Column) -> Column:
    """Byte `lane` (lowest first) of the bits of a long."""
    return F.call_function("shiftrightunsigned", x, (lane * 8).cast("int")).bitwiseAND(F.lit(255).cast("bigint"))


def truncated_half(x: Column) -> Column:
    """x / 2 rounded towards zero."""
    return F.when(x < 0, -F.shiftright(-x, 1)).otherwise(F.shiftright(x, 1))


def paeth(a: Column, b: Column, c: Column, p: Column) -> Column:
    """The one of a, b, c nearest to p; ties to the first."""
    pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)
