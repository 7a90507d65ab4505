import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators.prefix import running


@pytest.mark.parametrize("width, before", [(4, False), (4, True), (1000, False), (2, True)])
def test_against_brute_force(spark, width, before):
    rnd = random.Random(width)
    rows = [(p, rnd.choice([None, 1, 2, 5]), rnd.choice([None, None, f"x{p}"])) for p in range(0, 90) if rnd.random() < 0.6]
    df = spark.createDataFrame(rows, "pos bigint, n bigint, name string")
    got = {r.pos: (r.total_, r.last_) for r in running(df, "pos", 95, total=F.col("n"), last=F.col("name"), width=width, before=before).collect()}
    for p, *_ in rows:
        seen = [r for r in rows if r[0] < p or r[0] == p and not before]
        assert got[p] == (sum(r[1] or 0 for r in seen), next((r[2] for r in reversed(seen) if r[2]), None))


def test_rows_of_one_number_and_nothing(spark):
    df = spark.createDataFrame([(3, 1), (3, 2), (7, 4)], "pos bigint, n bigint")
    assert sorted(r.total_ for r in running(df, "pos", 7, total=F.col("n"), width=2).collect()) == [3, 3, 7]
    assert running(df.limit(0), "pos", 0, total=F.col("n")).count() == 0
