import random
from collections import defaultdict

import pytest

packing = pytest.importorskip("quernstone.llm.packing")


def check(sizes, sources, clusters, capacity, apart=False):
    placed = packing.best_fit(sizes, sources, clusters, capacity, apart)
    load, members = defaultdict(int), defaultdict(list)
    for k, pieces in enumerate(placed):
        assert sum(p[2] for p in pieces) == sizes[k]
        assert [p[1] for p in pieces] == [sum(q[2] for q in pieces[:i]) for i in range(len(pieces))]
        assert len(pieces) == max(1, -(-sizes[k] // capacity))
        for b, _, n in pieces:
            load[b] += n
            members[b].append(k)
    assert all(v <= capacity for v in load.values())
    return placed, load, members


def test_random_invariants():
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randint(0, 80)
        sizes = [rnd.choice([0, rnd.randint(1, 30), rnd.randint(1, 260)]) for _ in range(n)]
        check(sizes, [rnd.choice(["a", "b", None]) for _ in range(n)], [rnd.choice([None, rnd.randint(0, 9)]) for _ in range(n)], 100, rnd.random() < 0.5)


def test_copies_stay_apart():
    sizes, clusters = [10] * 40 + [50] * 20, ["c"] * 4 + [None] * 36 + list(range(20))
    _, _, members = check(sizes, [None] * 60, clusters, 100)
    assert all(sum(clusters[k] == "c" for k in m) <= 1 for m in members.values())


def test_sources_apart_and_hot_source():
    rnd = random.Random(2)
    sizes = [rnd.randint(10, 60) for _ in range(60)]
    sources = [f"s{i % 12}" for i in range(60)]
    _, _, members = check(sizes, sources, [None] * 60, 100, True)
    assert all(len({sources[k] for k in m}) == len(m) for m in members.values())
    placed, load, _ = check([10] * 50, ["hot"] * 50, ["same"] * 50, 100, True)  # can't be kept apart
    assert len(load) == 5


def test_large_clusters_are_spread():
    # more copies than half the bins: still apart
    _, load, members = check([60] * 7 + [80] * 8, [None] * 15, ["c"] * 7 + [None] * 8, 100)
    assert all(sum(k < 7 for k in m) <= 1 for m in members.values())
    # 30 copies and at least 12 bins: at most three in one
    _, load, members = check([20] * 30 + [60] * 10, [None] * 40, ["c"] * 30 + [None] * 10, 100)
    assert all(sum(k < 30 for k in m) <= 3 for m in members.values()) and len(load) <= 14
    # copies larger than a bin: their rests count
    _, _, members = check([150] * 3 + [50] * 3, [None] * 6, ["c"] * 3 + [None] * 3, 100)
    assert all(sum(k < 3 for k in m) <= 1 for m in members.values())


def test_little_space_is_lost():
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 700) for _ in range(3000)]
    _, load, _ = check(sizes, [None] * 3000, [None] * 3000, 2048)
    assert len(load) <= -(-sum(sizes) // 2048) + 1


def test_exact_fit_against_search():
    """Best fit never needs more than 11/9 of the least number of bins, plus one."""
    from itertools import permutations

    rnd = random.Random(5)
    for _ in range(30):
        sizes = [rnd.randint(1, 10) for _ in range(6)]
        least = min(first_fit(p, 10) for p in permutations(sizes))
        _, load, _ = check(sizes, [None] * 6, [None] * 6, 10)
        assert len(load) <= least * 11 / 9 + 1


def first_fit(sizes, capacity):
    bins = []
    for s in sizes:
        for k, b in enumerate(bins):
            if b + s <= capacity:
                bins[k] += s
                break
        else:
            bins.append(s)
    return len(bins)


def test_pack_frame(spark):
    rows = [(i, None if i == 3 else i * 37 % 300, "s", "container") for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, n bigint, source string, container string")
    got = packing.pack(df, "id", "n", "source", capacity=100, shard_items=30).collect()
    size = defaultdict(int)
    load = defaultdict(int)
    for r in got:
        size[r.id] += r.size
        load[r.container] += r.size
    assert {i: size[i] for i in range(100)} == {i: n or 0 for i, n, *_ in rows}
    assert max(load.values()) <= 100
    assert packing.pack(df.limit(0), "id", "n").count() == 0


def test_documents_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack_documents(docs)
    assert got.select("doc_id").distinct().count() == docs.count()
    f = packing.fill(got).first()
    assert f.containers - f.tokens / packing.CAPACITY < 2
