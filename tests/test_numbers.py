import pytest
from pyspark.sql import functions as F

from quernstone.functions.numbers import digits, name_key, whole_number

CASES = [
    ("12", 12), (" 12 ", 12), ("+12", 12), ("-3", -3), ("12.0", 12), ("12.5", None), ("1,234,567", 1234567), ("1,23", None), ("12 345", 12345), ("12 345", 12345), ("1_000", 1000), ("1.234.567", 1234567),
    ("0x1F", 31), ("0X0b", 11), ("-0x2", -2), ("12 B", 12), ("29193B", 29193), ("1,024 bytes", 1024), ("1e6", 1000000), ("1.5e1", 15), ("1e-1", None), ("", None), (None, None), ("n/a", None), ("-", None), ("NaN", None), ("tune", None),
    ("?", None), ("0676463", 676463), ("99999999999999999999999999", None), ("9223372036854775807", 9223372036854775807), ("12\n", 12), ("0x7FFFFFFFFFFFFFFF", 9223372036854775807), ("0x0000000000000010", 16), ("-0x8000000000000000", -9223372036854775808), ("0x8000000000000000", None), ("0x10000000000000000", None), ("0x0", 0),
    ("9223372036854775808", None), ("-9223372036854775808", -9223372036854775808), ("1234567890123456789", 1234567890123456789), ("1,234,567,890,123,456,789", 1234567890123456789), ("1.00000000000000000001", None), ("1e018", 10**18), ("1_000.0", 1000),
    ("5.", 5), ("1e99999", None), ("0x", None), ("1 2", None),
]


def test_whole_number(spark):
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(CASES)], "k int, s string")
    got = {r.k: r.v for r in df.select("k", whole_number(F.col("s")).alias("v")).collect()}
    assert [got[k] for k in range(len(CASES))] == [v for _, v in CASES]


@pytest.mark.parametrize("raw, key", [(" Cinder-2\n", "cinder-2"), ("\tX", "x"), (" a ", "a"), ("  ", None), ("", None), (None, None)])
def test_name_key(spark, raw, key):
    assert spark.createDataFrame([(raw,)], "s string").select(name_key(F.col("s"))).first()[0] == key


def test_digits(spark):
    df = spark.createDataFrame([("9223372036854775807",), ("0000000000000000000012",), ("9223372036854775808",), ("-1",), ("",), (None,), (" 1",)], "s string")
    assert [r.v for r in df.select(digits(F.col("s")).alias("v")).collect()] == [9223372036854775807, 12, None, None, None, None, None]
