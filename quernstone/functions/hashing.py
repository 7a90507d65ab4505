"""Hashes on wrapping unsigned 64-bit numbers, as column expressions (to be built inside `wrapping`)
and in Python."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def wrap(x: int) -> int:
    """An unsigned 64-bit number as the signed one with the same bits."""
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Arithmetic of the DataFrames built inside wraps around: whether it checks for overflow is
    settled when they are built, so the session's own setting is restored at once."""
    name = "spark.sql.ansi.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def multiply(a: Column, by: int) -> Column:
    return a * F.lit(wrap(by)).cast("bigint")


def add(a: Column, b: Column) -> Column:
    return a + b


def splitmix64(x: Column) -> Column:
    z = add(x, F.lit(wrap(GOLDEN)))
    z = multiply(z.bitwiseXOR(F.shiftrightunsigned(z, 30)), 0xBF58476D1CE4E5B9)
    z = multiply(z.bitwiseXOR(F.shiftrightunsigned(z, 27)), 0x94D049BB133111EB)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def splitmix64_int(x: int) -> int:
    x = (x + GOLDEN) & _MASK
    z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


def fnv1a(word: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes."""
    step = lambda h, c: multiply(h.bitwiseXOR(F.conv(c, 16, 10).cast("bigint")), 0x100000001B3)
    return F.aggregate(F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit(".."), F.lit(0)), F.lit(wrap(0xCBF29CE484222325)), step)


def fnv1a_int(word: str) -> int:
    h = 0xCBF29CE484222325
    for c in word.encode():
        h = ((h ^ c) * 0x100000001B3) & _MASK
    return h


def context_hash(data: Column) -> Column:
    """Upper 32 bits of a multiplicative hash of binary data, as a context's number."""
    return F.shiftrightunsigned(F.aggregate(_bytes(data), F.lit(wrap(GOLDEN)), lambda h, b: multiply(h.bitwiseXOR(b), GOLDEN)), 32)


def word_fold(data: Column) -> Column:
    """The running hash of a word's bytes."""
    return F.aggregate(_bytes(data), F.lit(0).cast("bigint"), lambda h, b: multiply(h, GOLDEN).bitwiseXOR(b.bitwiseOR(F.lit(256))))


def _bytes(data: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("bigint"))


def unsigned_order(x: Column) -> Column:
    """Signed number whose order is the unsigned order of x."""
    return x.bitwiseXOR(F.lit(wrap(1 << 63)))


def unsigned_text(x: Column) -> Column:
    """The unsigned number with the bits of x, in decimal digits."""
    return F.conv(F.hex(x), 16, 10)
