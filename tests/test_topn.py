import random

import pytest

from quernstone.operators import topn

SCHEMA = "g string, a bigint, b bigint, id bigint, place string, n int"


def brute(rows, n):
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    big = 1 << 62
    for g, rs in groups.items():
        rs.sort(key=lambda r: tuple(big if x is None else x for x in r[1:4]))
        out += [(g, k + 1, r[3]) for k, r in enumerate(rs[:n])]
    return sorted(out, key=str)


def run(spark, rows, n, **kw):
    got = topn.top_n(spark.createDataFrame(rows, SCHEMA), "g", ["a", "b", "id"], n, **kw).collect()
    return sorted([(r.g, r.place, r.id) for r in got], key=str)


@pytest.mark.parametrize("kw", [{}, {"heavy_rows": 10, "heavy_share": 0.05}, {"heavy_rows": 10, "heavy_share": 0.05, "task_rows": 7, "buckets": 4}])
def test_random(spark, kw):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot", "hot", "warm", None, *"abc"]), rnd.choice([None, *range(6)]), rnd.randint(0, 3), i, "x", 1) for i in range(300)]
    assert run(spark, rows, 5, **kw) == brute(rows, 5)


def test_ties_fill_one_range(spark):
    rows = [("hot", 1, 1, i, "x", 1) for i in range(200)] + [("b", 1, 1, 900, None, None)]
    assert run(spark, rows, 3, heavy_rows=10, heavy_share=0.1, task_rows=20) == brute(rows, 3)


def test_large_n_and_null_scores(spark):
    rows = [("hot", None if i % 3 == 0 else i % 7, None, i, "x", 1) for i in range(60)]
    assert run(spark, rows, 50, heavy_rows=10, heavy_share=0.1, task_rows=9, buckets=4) == brute(rows, 50)


def test_empty(spark):
    assert run(spark, [], 5) == []
