import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from quernstone.operators import orphans

REF, TARGET = "table_name string, log_pos bigint, period string, key string, at timestamp_ntz", "key string, since timestamp_ntz, until timestamp_ntz"
T0 = datetime(2024, 1, 1)
t = lambda h: T0 + timedelta(hours=h)


def brute(refs, targets):
    out = []
    for tab, pos, period, key, at in refs:
        if key is None:
            continue
        own = [(a, b) for k, a, b in targets if k == key and a is not None and (b is None or b > a)]
        if at is not None and any(a <= at and (b is None or at < b) for a, b in own):
            continue
        begun = at is not None and any(a <= at for a, _ in own)
        out.append((tab, pos, period, "missing" if not own else "deleted" if begun else "late"))
    return sorted(out, key=repr)


def run(spark, refs, targets, **kw):
    df = orphans.find_orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET), **kw)
    counts = orphans.count_orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET), **kw).collect()
    rows = sorted(((r.table_name, r.log_pos, r.period, r.reason) for r in df.collect()), key=repr)
    assert {(r.table_name, r.period, r.reason): r.n for r in counts} == Counter((a, c, d) for a, _, c, d in rows)
    return rows


@pytest.mark.parametrize("kw", [{}, {"heavy_rows": 5, "heavy_share": 0.05}, {"heavy_rows": 5, "heavy_share": 0.05, "broadcast_rows": 0}, {"heavy_rows": 5, "heavy_share": 1.0, "task_rows": 7, "broadcast_rows": 0}])
def test_random(spark, kw):
    rnd = random.Random(3)
    keys = ["hot"] * 6 + list("abcdefg")
    refs = [("t", i, rnd.choice(["2024-01", "2024-02", None]), rnd.choice(keys), t(rnd.randint(0, 60))) for i in range(120)]
    targets = [(rnd.choice(["hot", *"abcd"]), t(a := rnd.randint(0, 60)), rnd.choice([None, t(a + rnd.randint(-2, 20))])) for _ in range(40)]
    assert run(spark, refs, targets, **kw) == brute(refs, targets)


def test_edges(spark):
    refs = [("t", 1, "p", None, t(1)), ("t", 2, None, "a", None), ("t", 3, "p", "b", t(5)), ("t", 3, "p", "b", t(5)), ("t", 4, "p", "c", t(5)), ("t", 5, "p", "a", t(5)), ("t", 6, "p", "a", t(3))]
    targets = [("a", t(3), t(5)), ("a", t(3), t(5)), (None, t(1), None), ("c", None, None), ("b", t(9), t(9))]
    assert run(spark, refs, targets) == brute(refs, targets)
    assert ("t", 2, None, "late") in run(spark, refs, targets)


def test_empty(spark):
    assert run(spark, [], [("a", t(1), None)]) == []
    assert run(spark, [("t", 1, "p", "a", t(1))], []) == [("t", 1, "p", "missing")]


def test_lifetimes_merge(spark):
    rows = [("a", t(1), t(3)), ("a", t(2), t(5)), ("a", t(5), t(6)), ("a", t(800), t(900)), ("a", t(850), None), ("a", t(2000), t(2001))]
    got = sorted((r.since, r.until) for r in orphans.lifetimes(spark.createDataFrame(rows, TARGET)).collect())
    assert got == [(t(1), t(6)), (t(800), None)]


def test_extra_columns_and_counts(spark):
    refs = spark.createDataFrame([("t", 1, "p", "a", t(1), 7, "x")], REF + ", n int, since string")
    got = orphans.find_orphans(refs, spark.createDataFrame([], TARGET))
    assert got.first().asDict()["since"] == "x"
    assert orphans.count_orphans(refs, spark.createDataFrame([], TARGET)).first().n == 1
