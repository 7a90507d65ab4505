import random

import pytest

from quernstone.operators import hierarchy


def brute(edges):
    par = {}
    for i, p in edges:
        if i is not None:
            par[i] = min((x for x in (par.get(i), p) if x is not None), default=None) if i in par else p
    par = {i: p if p in par else None for i, p in par.items()}
    out = {}
    for i in par:
        path, seen = [i], {i: 0}
        while True:
            q = par[path[-1]]
            if q is None:
                out[i] = (path[-1], len(path) - 1, path[::-1])
                break
            if q in seen:
                out[i] = (min(path[seen[q] :]), -1, None)
                break
            seen[q] = len(path)
            path.append(q)
    return par, out


def check(spark, edges, **kw):
    df = spark.createDataFrame(edges, "id string, parent string")
    placed = hierarchy.hierarchy(df, **kw).cache()
    par, want = brute(edges)
    rows = {r.id: r for r in placed.collect()}
    assert {i: (r.root_id, r.depth) for i, r in rows.items()} == {i: w[:2] for i, w in want.items()}
    below = {i: {j for j, w in want.items() if w[2] and i in w[2]} for i, w in want.items() if w[2]}
    for i, js in below.items():
        r = rows[i]
        assert r.size == len(js) and r.hi - r.lo + 1 == r.size
        assert {j for j, x in rows.items() if x.depth >= 0 and x.root_id == r.root_id and r.lo <= x.lo <= r.hi} == js
    assert {r.id: r.path for r in hierarchy.paths(placed).collect()} == {i: w[2] for i, w in want.items()}
    pairs = {(r.ancestor_id, r.id, r.steps) for r in hierarchy.descendants(placed, placed.select("id"), bits=(1, 2)).collect()}
    assert pairs == {(i, j, want[j][1] - want[i][1]) for i, js in below.items() for j in js if i != j}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_random(spark, limit):
    rnd = random.Random(4)
    check(spark, [(f"n{i}", rnd.choice([None, "gone", *[f"n{rnd.randint(0, 39)}" for _ in range(12)]])) for i in range(40)], task_rows=20, broadcast_rows=limit, width=8)


def test_chain_family_and_cycles(spark):
    edges = [(f"c{i:02}", f"c{i - 1:02}" if i else None) for i in range(20)] + [(f"k{i}", "c03") for i in range(15)]
    edges += [("x", "y"), ("y", "z"), ("z", "x"), ("tail", "x"), ("tail2", "tail"), ("self", "self"), ("s2", "self"), ("p", "q"), ("q", "p")]
    check(spark, edges, width=4)
    check(spark, edges, task_rows=5, broadcast_rows=0)


@pytest.mark.parametrize("edges", [[], [("a", None)], [(None, "a"), ("a", None), ("a", None), ("b", "a"), ("b", "a")]])
def test_small(spark, edges):
    check(spark, edges)


def test_extra_columns(spark):
    df = spark.createDataFrame([("a", None, 1, "r"), ("b", "a", 2, "r")], "id string, parent string, depth int, root_id string")
    assert {(r.id, r.root_id, r.depth) for r in hierarchy.hierarchy(df).collect()} == {("a", "a", 0), ("b", "a", 1)}
