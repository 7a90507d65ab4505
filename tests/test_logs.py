from pyspark.sql import functions as F

from quernstone.operators import experiments as ex
from quernstone.sources import logs


def frame(spark, rows):
    names = ["id", "notes", "compressor_bytes", "archive_bytes", "score_total"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", x map<string,string>")
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in logs.FIELDS if c not in names])


def test_append_and_read(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    odd = 'a "quoted" \\ line\nbreak\ttab \u2014 \u65e5'
    logs.append(frame(spark, [("1", odd, "5", "7", "99", {"phase": "a", "id": "clash"}), ("2", None, None, "7", "x", None)]), path, F.col("x"))
    logs.append(frame(spark, [("3", "", "1", "9223372036854775807", None, {})]), path)
    spark.createDataFrame([("broken {",), ("[1]",), ("",), ('{"id": 4, "more": {"a": [1]}}',)], "value string").write.mode("append").text(path)
    got = {r.id: r for r in logs.read(spark, path, path + "-absent").collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert got["1"].notes == odd and got["1"].score_total == "12" and got["1"].extras == {"phase": "a"}
    assert got["2"].notes == "" and got["2"].score_total == "x"
    assert got["4"].notes is None and got["4"].extras == {"more": '{"a":[1]}'}
    assert logs.containing(logs.scan(spark, path), '"id":"2"').count() == 1


def test_missing_logs_are_empty(spark, tmp_path):
    assert logs.read(spark, f"file://{tmp_path}/none").count() == 0 and logs.scan(spark).count() == 0


def test_order_of_fields(spark):
    line = logs.lines(frame(spark, [("1", "n", "1", "2", None, {"zz": None, "aa": "b"})]), F.col("x")).first().value
    assert [p.split('":')[0].strip('{"') for p in line.split(',"')] == [*logs.FIELDS, "aa", "zz"]


def test_clock_and_bytes(spark):
    df = spark.createDataFrame([(0.9, 1023), (61.0, 1024), (3725.0, 3 << 30), (-5.0, 0), (None, None), (float("nan"), 210176)], "s double, b bigint")
    assert [(r.c, r.h) for r in df.select(ex.clock(F.col("s")).alias("c"), ex.human_bytes(F.col("b")).alias("h")).collect()] == [("0s", "1023 B"), ("1m01s", "1.0 KB"), ("1h02m05s", "3.00 GB"), ("0s", "0 B"), ("0s", None), ("0s", "205.2 KB")]


def test_size_literal_limits(spark):
    df = spark.createDataFrame([("10000000000",), ("9223372036854775807",), ("9223372036854775808",), ("8589934592G",), ("1 K",), ("2MiB",), ("-1",), ("1T",), (None,)], "s string")
    assert [r.v for r in df.select(ex.size_literal(F.col("s")).alias("v")).collect()] == [10**10, 2**63 - 1, None, None, 1024, 2 << 20, None, None, None]


def test_improvements_in_blocks(spark):
    rows = [("m", c, p, b) for p, (c, b) in enumerate([("a", 9), ("a", 7), ("b", 5), ("a", 8), (None, 3), ("a", 6), ("a", 6), (None, 2), ("b", 5)])]
    df = spark.createDataFrame(rows, "method string, corpus string, log_pos bigint, archive_bytes bigint")
    for width in (2, 100):
        assert sorted(r.log_pos for r in ex.improvements(df, width).collect() if r.better) == [0, 1, 2, 4, 5, 7]


def test_best_of_nothing(spark):
    t = spark.createDataFrame([], "archive_bytes bigint, tune int")
    assert tuple(ex.global_best(t).first()) == (0, 0)
