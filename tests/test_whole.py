"""Queries that once gave less than the whole: their rows against SQL and brute force."""

import os

import pytest

import __spark_entry__
from quernstone.functions import codecs
from quernstone.operators import hierarchy

DATA = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = __spark_entry__.queries()[name](spark, DATA)
    cur = c.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = sorted(map(tuple, df.select(names).collect()), key=str), sorted(cur.fetchall(), key=str)
    assert got == want and got
    return got


def test_descendants_of_all_nodes(spark):
    pairs = {x[:2] for x in same_as_sql(spark, "p5_all_descendants")}
    roots = {r.ancestor_id for r in __spark_entry__.queries()["p5_descendants"](spark, DATA).collect()}
    assert {a for a, _ in pairs} > roots


def test_descendants_on_cycles(spark):
    edges = [("x", "y"), ("y", "z"), ("z", "x"), ("tail", "x"), ("tail2", "tail"), ("self", "self"), ("s2", "self"), ("r", None), ("c", "r")]
    placed = hierarchy.hierarchy(spark.createDataFrame(edges, "id string, parent string"))
    got = {tuple(r) for r in hierarchy.descendants_on_cycles(placed).collect()}
    ring = {("y", "x", 1), ("z", "x", 2), ("z", "y", 1), ("x", "y", 2), ("x", "z", 1), ("y", "z", 2)}
    assert got == ring | {("x", "tail", 1), ("y", "tail", 2), ("z", "tail", 3), ("tail", "tail2", 1), ("x", "tail2", 2), ("y", "tail2", 3), ("z", "tail2", 4), ("self", "s2", 1)}


def test_unified_has_every_field(spark):
    rows = same_as_sql(spark, "p3_unified")
    columns = __spark_entry__.queries()["p3_unified"](spark, DATA).columns
    assert {"method", "tune", "corpus", "archive_bytes", "apm_rates", "parent", "rest"} <= set(columns) and len(rows[0]) == len(columns)
    assert same_as_sql(spark, "p3_steps")


def test_ladder_of_large_rungs(spark):
    assert {10**k for k in range(6, 10)} <= {v for r in same_as_sql(spark, "corpus_ladder_full") for v in r}


def test_factor_copies_runs_of_factors():
    # copies of 64 factors of a byte, then of factors that are copies themselves
    line = bytes(range(64))
    code = codecs.factor(line * 8)
    assert code == codecs.varint(68) + b"".join(bytes([0, x]) for x in line) + b"\1\0\x40\1\0\x40\1\x40\x02\1\x41\x02"
    assert codecs.unfactor(code) == line * 8
