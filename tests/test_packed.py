import random

import pytest

from quernstone.operators import packed

RATES, TEXT = ",;|/:", ",;|"
CASES = [
    ("5,,4,4", RATES, [(0, "5"), (2, "4"), (3, "4")]),
    ("7", RATES, []),
    ("[9]", RATES, []),
    ("[6; 7 ;8]", RATES, [(0, "6"), (1, "7"), (2, "8")]),
    ("[ 6 7 ]", RATES, [(0, "6"), (1, "7")]),
    ("(4/5/6)", RATES, [(0, "4"), (1, "5"), (2, "6")]),
    ("4:7", RATES, [(0, "4"), (1, "7")]),
    ("lr:fixed", TEXT, []),
    ("search/tune", TEXT, []),
    ("  a | | b  ", TEXT, [(0, "a"), (2, "b")]),
    ("a\t b", TEXT, [(0, "a"), (1, "b")]),
    (" , b", TEXT, []),
    ("6;", RATES, []),
    (" , b, c", TEXT, [(1, "b"), (2, "c")]),
    ("'7' '8'", RATES, [(0, "7"), (1, "8")]),
    ("\"note=a, b; c\"|x", TEXT, [(0, "note=a, b; c"), (1, "x")]),
    ("x;note=\"operator's pick; rerun\"", TEXT, [(0, "x"), (1, "note=operator's pick; rerun")]),
    ('note="the ""cold"" table",y', TEXT, [(0, 'note=the "cold" table'), (1, "y")]),
    ("it's, fine", TEXT, [(0, "it's"), (1, "fine")]),
    ("\"open, end", TEXT, [(0, '"open'), (1, "end")]),
    ('"",b', TEXT, []),
    ('"",b;c', TEXT, [(1, "b"), (2, "c")]),
    ("a,b c", TEXT, [(0, "a"), (1, "b"), (2, "c")]),
    ("", TEXT, []),
    ("   ", TEXT, []),
    (None, TEXT, []),
]


@pytest.mark.parametrize("limit", [100_000, 20, 0])
def test_cases(spark, limit):
    rows = [(k, s if d == TEXT else None, s if d == RATES else None, "extra") for k, (s, d, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id bigint, t string, r string, value string")
    got = {}
    for x in packed.split_packed(df, "id", {"t": TEXT, "r": RATES}, broadcast_marks=limit).collect():
        got.setdefault(x.id, []).append((x.place, x.value))
    for k, (s, _, want) in enumerate(CASES):
        assert sorted(got.get(k, [])) == want, s


def test_long_and_repeated(spark):
    text = ",".join(str(i) for i in range(5000))
    df = spark.createDataFrame([(1, text), (1, text)], "id bigint, t string")
    got = packed.split_packed(df, "id", {"t": TEXT}).collect()
    assert len(got) == 10_000 and {(r.place, r.value) for r in got} == {(i, str(i)) for i in range(5000)}


def test_quoting_round_trip(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        values = ["".join(rnd.choice("ab ,;|'\"=") for _ in range(rnd.randint(1, 6))).strip(" '\"=") or "z" for _ in range(rnd.randint(2, 5))]
        rows.append((i, rnd.choice([",", " ; ", "|"]).join('"' + v.replace('"', '""') + '"' for v in values), values))
    df = spark.createDataFrame([(i, s) for i, s, _ in rows], "id bigint, t string")
    got = {}
    for r in packed.split_packed(df, "id", {"t": TEXT}).collect():
        got.setdefault(r.id, {})[r.place] = r.value
    for i, s, values in rows:
        assert [got[i].get(k) for k in range(len(values))] == values, s


def test_empty(spark):
    assert packed.split_packed(spark.createDataFrame([], "id bigint, t string"), "id", {"t": TEXT}).count() == 0
