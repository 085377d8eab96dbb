"""Unsigned 64-bit arithmetic on LONG columns (two's complement views).

Sums and products must wrap, which ANSI mode forbids: build frames that use them inside
``wrapping(spark)``.  The chosen semantics stay with the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession, functions as F

from ..params import HASH_SEED, signed

_TOP = -(1 << 63)


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def const(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def rotl(x: Column, r: int) -> Column:
    r &= 63
    return F.shiftleft(x, r).bitwiseOR(F.shiftrightunsigned(x, 64 - r)) if r else x


def rotr(x: Column, r: int) -> Column:
    return rotl(x, -r)


def rotl_by(x: Column, r: Column) -> Column:
    """Rotation by a column of counts (taken mod 64)."""
    n = F.pmod(r, F.lit(64)).cast("int")
    return F.when(n == 0, x).otherwise(F.call_function("shiftleft", x, n).bitwiseOR(F.call_function("shiftrightunsigned", x, 64 - n)))


def mix64(x: Column) -> Column:
    """The splitmix64 finaliser; needs wrapping."""
    x = x + const(HASH_SEED)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 30)) * const(0xBF58476D1CE4E5B9)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 27)) * const(0x94D049BB133111EB)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))


def order_key(x: Column) -> Column:
    """A LONG whose signed order is the unsigned order of x; its own inverse."""
    return x.bitwiseXOR(F.lit(_TOP).cast("long"))


def umin(x: Column) -> Column:
    """Unsigned minimum, as an aggregate."""
    return order_key(F.min(order_key(x)))


def uleast(x: Column, y: Column) -> Column:
    return order_key(F.least(order_key(x), order_key(y)))


def umod(x: Column, n: int) -> Column:
    """x mod n for 0 < n < 2 ** 61."""
    if n & (n - 1) == 0:
        return x.bitwiseAND(F.lit(n - 1).cast("long"))
    return ((F.shiftrightunsigned(x, 1) % n) * 2 + x.bitwiseAND(F.lit(1).cast("long"))) % n


def bucket_of(h: Column, buckets: int) -> Column:
    """The top log2(buckets) bits; bucket 0 when there is one."""
    m = (buckets - 1).bit_length()
    return F.shiftrightunsigned(h, 64 - m).cast("int") if m else F.lit(0)


def universal(x: Column, a: int, b: int, buckets: int) -> Column:
    """The multiply-shift hash of x into buckets; needs wrapping."""
    return bucket_of(x * const(a) + const(b), buckets)


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def xxh64_pair(x: Column, y: Column, seed: int) -> Column:
    """XXH64 of the sixteen bytes of two little-endian words; needs wrapping."""
    h = const((seed + _P5 + 16) & ((1 << 64) - 1))
    for lane in (x, y):
        h = h.bitwiseXOR(rotl(lane * const(_P2), 31) * const(_P1))
        h = rotl(h, 27) * const(_P1) + const(_P4)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 33)) * const(_P2)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 29)) * const(_P3)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 32))


def bit_position(bucket: Column, value: Column, bits: int, buckets: int, mode: str, seed: int) -> Column:
    """The sketch bit that a bucket's value flips.  Stripes narrower than two bits fall back to
    mixing, which needs wrapping."""
    stride = bits // buckets if buckets else 0
    if mode == "value":
        return umod(value, bits)
    if mode == "stripe" and stride >= 2:
        return (bucket.cast("long") * stride + umod(value, stride)) % bits
    return umod(xxh64_pair(value, bucket.cast("long"), seed), bits)


def popcount_xor(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda s, n: s + n)
