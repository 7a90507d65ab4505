import json
import random
from collections import Counter, defaultdict

from quernstone.operators import drift

SCHEMA = "run_dir string, log_name string, log_file string, file_seq int, line_no int, line string"
TYPES = {str: "string", int: "number", float: "number", bool: "boolean", list: "array", dict: "object"}


def brute(rows):
    files, order = defaultdict(list), defaultdict(dict)
    for rd, ln, lf, fs, _, line in rows:
        order[rd, ln][lf] = fs
        try:
            o = json.loads(line)
        except (ValueError, TypeError):
            continue
        if isinstance(o, dict):
            files[lf].append(o)

    def schema(rs):
        n, k, t = len(rs), Counter(), defaultdict(Counter)
        for o in rs:
            for a, v in o.items():
                k[a] += 1
                if v is not None:
                    t[a][TYPES[type(v)]] += 1
        return {a: next((x for x, y in t[a].items() if 2 * y > sum(t[a].values())), None) for a, m in k.items() if 2 * m > n}

    out = set()
    for names in order.values():
        chain = sorted(names, key=lambda f: (names[f], f))
        for a, b in zip(chain, chain[1:], strict=False):
            A, B = schema(files[a]), schema(files[b])
            gone, come = sorted(set(A) - set(B)), sorted(set(B) - set(A))
            key = lambda o: (o.get("id"), o.get("archive_sha256"))
            ka, kb = [{key(o) for o in files[x] if None not in key(o)} for x in (a, b)]
            shared = ka & kb
            sig = lambda f, x: frozenset((key(o), json.dumps(o[f], sort_keys=True)) for o in files[x] if key(o) in shared and f in o)
            for f in sorted(set(A) & set(B)):
                if A[f] and B[f] and A[f] != B[f]:
                    out.add((b, "type_changed", f, f))
            left = list(come)
            for g in gone:
                hit = next((m for m in left if sig(g, a) and sig(g, a) == sig(m, b)), None)
                if hit is None:
                    out.add((b, "removed", g, ""))
                else:
                    left.remove(hit)
                    out.add((b, "renamed", g, hit))
            out |= {(b, "added", "", m) for m in left}
    return out


def run(spark, rows):
    got = drift.schema_changes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len({(r.log_file, r.change_kind, r.field, r.new_field) for r in got})
    return {(r.log_file, r.change_kind, r.field, r.new_field) for r in got}


def make(seed):
    rnd, rows = random.Random(seed), []
    for s in range(6):
        names, types, last = {"u": "u", "v": "v", "w": "w"}, {"u": 0, "v": 0, "w": 0}, []
        for f in range(5):
            if rnd.random() < 0.6:
                k = rnd.choice(sorted(names))
                what = rnd.choice(["rename", "type", "drop"])
                if what == "rename":
                    names[k] = k + str(f)
                elif what == "type":
                    types[k] = (types[k] + 1) % 4
                elif len(names) > 1:
                    del names[k]
            if rnd.random() < 0.3:
                names[f"n{f}"], types[f"n{f}"] = f"n{f}", 0
            new = [{"id": f"{s}-{f}-{i}", **{k: rnd.randint(0, 99) for k in ("u", "v", "w", *[f"n{j}" for j in range(5)])}} for i in range(6)]
            recs, last = last + new, new[-2:]
            form = lambda k, v: [str(v), v, [str(v)], {"value": v}][types[k]]
            for i, r in enumerate(recs):
                o = {"id": r["id"], "archive_sha256": "h" + r["id"]} | {names[k]: form(k, r[k]) for k in names}
                if rnd.random() < 0.05:
                    o[rnd.choice(sorted(o))] = None
                rows.append((f"run{s}", "log", f"run{s}/f{f}", f, i, json.dumps(o)))
            rows += [(f"run{s}", "log", f"run{s}/f{f}", f, 90, x) for x in rnd.sample(['{"id":', "", "null", "# resumed", "[1]", None, "}", '"x"'], 2)]
    return rows


def test_random(spark):
    rows = make(7)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    line = lambda **k: json.dumps({"id": "1", "archive_sha256": "a"} | k)
    rows = [
        ("r", "l", "a", 1, 1, line(x=1, y="s")), ("r", "l", "b", 2, 1, line(z=1, y="s")), ("r", "l", "c", 3, 1, line(z=2, y=True)), ("r", "l", "c", 3, 2, line(z=2, y=True)),
        ("r", "l", "d", 4, 1, "broken"), ("r", "l", "e", 5, 1, '{"k": null}'), ("r", "m", "solo", 1, 1, line(q=1)), ("r", "l", "f", 6, 1, "{}"), (None, None, "n", None, None, None),
    ]
    assert run(spark, rows) == brute(rows)
    assert ("b", "renamed", "x", "z") in run(spark, rows) and ("c", "type_changed", "y", "y") in run(spark, rows)


def test_empty(spark):
    assert run(spark, []) == set()


TYPED = {"id": "string", "archive_sha256": "string", "u": "bigint", "v": "double", "w": "boolean"}


def unify(spark, rows, types=TYPED):
    df = spark.createDataFrame(rows, SCHEMA)
    known = drift.profile(df)
    rules = drift.migrations(known, drift.schema_changes(known))
    steps = {(r.log_file, r.step, r.field, r.name, r.from_type): r.n for r in drift.applied_steps(known, rules, types).collect()}
    return drift.unified(df, rules, types).collect(), steps


def test_unified_follows_renames(spark):
    rows = make(11)
    got, steps = unify(spark, rows)
    objects = [json.loads(x[5]) for x in rows if x[5] and x[5].startswith("{") and x[5].endswith("}") and len(x[5]) > 1]
    assert len(got) == len(objects)
    assert {r.id for r in got if r.id} == {o["id"] for o in objects if o["id"]}
    names = {x.split("=")[0] for r in got for x in r.rest.split("\n") if x and x[0] != "n"}
    assert names <= {"u", "v", "w", "?u", "?v", "?w"}
    flat = lambda v: v[0] if isinstance(v, list) else v["value"] if isinstance(v, dict) else v
    for f in {x[2] for x in rows}:  # under whatever name, no value of u is lost
        want = sorted(int(flat(v)) for x in rows if x[2] == f and x[5] and x[5][:2] == '{"' and x[5][-1] == "}" for k, v in json.loads(x[5]).items() if k.rstrip("0123456789") == "u" and v is not None)
        assert sorted(r.u for r in got if r.log_file == f and r.u is not None) == want
    assert any(k[1] == "rename" for k in steps) and any(k[1] == "cast" and k[3] in "uvw" for k in steps)


def test_casts_defaults_and_clashes(spark):
    line = lambda **k: json.dumps({"id": "1", "archive_sha256": "a"} | k)
    rows = [
        ("r", "l", "a", 1, 1, line(u=1, v="2.5", w="true")), ("r", "l", "b", 2, 1, line(x=1, v=[2.5], w=True)), ("r", "l", "b", 2, 2, '{"u": 7, "x": 9, "id": null}'),
        ("r", "l", "b", 2, 3, '{"x": {"value": "5", "unit": "s"}, "v": "n/a", "?u": 1}'), ("r", "l", "b", 2, 4, "{}"), ("r", "l", "b", 2, 5, "broken"), ("r", "l", "b", 2, 6, '{"v": [], "x": " 12 "}'),
    ]
    got, steps = unify(spark, rows)
    rows = {(r.log_file, r.line_no): (r.version, r.id, r.u, r.v, r.w, r.rest) for r in got}
    assert rows["a", 1] == (1, "1", 1, 2.5, True, "") and rows["b", 1] == (2, "1", 1, 2.5, True, "")
    assert rows["b", 2] == (2, None, 9, None, None, "?u=7")
    assert rows["b", 3] == (2, None, 5, None, None, '?u=1\nu={"unit":"s","value":"5"}\nv=n/a')
    assert rows["b", 4] == (2, None, None, None, None, "") and rows["b", 6] == (2, None, 12, None, None, "") and len(rows) == 6
    assert steps["b", "rename", "x", "u", None] == 4 and steps["b", "cast", "v", "v", "array"] == 2 and steps["b", "cast", "x", "u", "object"] == 1
    assert steps["b", "default", None, "w", None] == 4 and ("b", "default", None, "v", None) in steps


def test_unified_of_nothing(spark):
    assert unify(spark, []) == ([], {})
