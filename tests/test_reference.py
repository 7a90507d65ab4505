import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quernstone.functions import hashing, model, udfs
from quernstone.operators import layout, seqstats
from quernstone.operators import text as tx

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    import os

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(names, data):
    fix = lambda v: round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, type(None))) else str(v)
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(fix(r[k]) for k in order) for r in data), key=str)


FAST = ["word_counts", "vocab_top255", "vocab_wide", "phrase_counts", "kind_stats", "token_partition", "order2_entropy", "rans_table", "page_order_full", "layout_info", "hoist_savings", "trial_observe", "trial_levels", "method_registry", "adaptive_bits", "squash_table", "session_counts", "stream_best", "receipt_log", "run_against_parent", "vocab_gains", "vocab_overlap", "trial_extremes", "trial_global_best", "tune_rates", "logit_correction", "pinned_inputs", "runtime_floor", "ratio_report", "word_hashes", "size_literals", "trial_improvements", "trial_wall_median", "repeat_distance_k8", "column_above_agreement", "indirect_history", "line_offsets", "stream_hourly_final", "receipt_lines_out"]


@pytest.mark.parametrize("name", FAST)
def test_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hashes(spark):
    words = ["a", "word", "zebra", "x" * 30]
    xs = [0, 1, (1 << 64) - 1, 0x9E3779B97F4A7C15]
    with hashing.wrapping(spark):
        w = spark.createDataFrame([(x,) for x in words], "w string").select(hashing.fnv1a(F.col("w")).alias("h"))
        m = spark.createDataFrame([(hashing.wrap(x),) for x in xs], "x bigint").select(hashing.splitmix64(F.col("x")).alias("h"))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert [r.h for r in w.collect()] == [hashing.wrap(hashing.fnv1a_int(x)) for x in words]
    assert [r.h for r in m.collect()] == [hashing.wrap(hashing.splitmix64_int(x)) for x in xs]


def test_signatures_and_walk(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "A b, c"), (3, ""), (4, "zz yy"), (5, None)], "doc_id bigint, text string")
    sig = {r.doc_id: r.sig for r in layout.signatures(docs).collect()}

    def brute(words):
        hs = [hashing.fnv1a_int(w) for w in words]
        return [min((hashing.splitmix64_int(h ^ (k * hashing.GOLDEN & (1 << 64) - 1)) for h in hs), default=(1 << 64) - 1) - (1 << 63) for k in range(8)]

    assert sig == {1: brute("abc"), 2: brute("abc"), 3: brute([]), 4: brute(["zz", "yy"])}
    walked = {r.doc_id: r.place for r in layout.greedy_walk(layout.signatures(docs), block=100).collect()}
    assert sorted(walked.values()) == [0, 1, 2, 3] and abs(walked[1] - walked[2]) == 1
    d = spark.createDataFrame([([1, 3], [1, 0])], "a array<bigint>, b array<bigint>").select(layout.signature_distance(F.col("a"), F.col("b")))
    assert d.first()[0] == 2


def test_rank_all_is_total(spark):
    rnd = random.Random(2)
    data = [(i, rnd.choice("abc")) for i in range(200)]
    got = layout.rank_all(spark.createDataFrame(data, "i int, k string"), ["k", "i"]).collect()
    assert [r.i for r in sorted(got, key=lambda r: r.place)] == [i for i, _ in sorted(data, key=lambda x: (x[1], x[0]))]
    assert sorted(r.place for r in got) == list(range(200))


def test_shuffle_is_a_permutation():
    assert sorted(layout.xorshift_shuffle(50, 7)) == list(range(50)) != list(layout.xorshift_shuffle(50, 7))


def test_adaptive_folds(spark):
    bits = [1, 0, 0, 1, 1, 1, 0]
    p = 32768
    for b in bits:
        p = max(1, min(65535, p + ((65535 * b - p) >> 4)))
    h = spark.createDataFrame([(bits,)], "b array<int>").select(seqstats.adaptive_probability(F.col("b"), 4).alias("p"), seqstats.bit_history(F.col("b"), 3).alias("h")).first()
    assert h.p == p and (h.h.n0, h.h.n1) == (3, 3)


def test_stretch_table(spark):
    assert [r.logit for r in seqstats.stretch_table(spark).orderBy("p").collect()] == model.STRETCH


def test_full_pattern_partitions(spark):
    rnd = random.Random(5)
    parts = ["<", "<a>", "&", "&amp;", "&#;", "&#x;", "{{", "[[", "a", "9", " ", "\n", "é", "http://x", "ftp://", "!", "\t", "<!--", "-->"]
    data = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))) for i in range(150)]
    t = tx.tokens(spark.createDataFrame(data, "doc_id int, text string")).orderBy("doc_id", "seq").collect()
    joined = {}
    for r in t:
        assert len(joined.get(r.doc_id, "")) == r.start
        joined[r.doc_id] = joined.get(r.doc_id, "") + r.token
    assert joined == dict(data)


def test_registered_functions(spark):
    names = udfs.register(spark)
    assert "hoist_encode" in names
    got = spark.sql("SELECT hoist_decode(hoist_encode(CAST('<page> x' AS BINARY))) AS b, unarchive(archive(CAST('abc' AS BINARY))) AS a").first()
    assert bytes(got.b) == b"<page> x" and bytes(got.a) == b"abc"
    assert [r.kind for r in spark.sql("SELECT s.kind FROM (SELECT 'ab {{c}}' AS t) d, LATERAL segment(d.t) s ORDER BY s.seq").collect()] == ["word", "spaces", "template"]


def test_mlp_against_numpy(spark):
    rng = np.random.default_rng(1)
    w1, b1, w2, f = rng.integers(-99, 99, (3, 12)).tolist(), [5, -6, 7], [99, -80, 33], rng.integers(-32, 32, 12).tolist()
    z = np.clip((np.array(w1) @ np.array(f) + b1) >> 8, -127, 127)
    want = int(np.clip((int(z @ np.array(w2)) + 4) >> 8, -1024, 1024))
    assert spark.createDataFrame([(f,)], "f array<int>").select(seqstats.mlp_forward(F.col("f"), w1, b1, w2, 4)).first()[0] == want


def test_mutation_is_seeded_and_wraps():
    from quernstone.operators import experiments as ex

    now, seed, seen = 51, 1, set()
    for _ in range(200):
        step, seed = ex.mutate(now, seed)
        assert step >> 4 == now >> 4 and 0 <= step < 256 and step != now  # one axis: the low half
        seen.add(step)
        now = step
    assert len(seen) == 16 and ex.mutate(51, 1) == ex.mutate(51, 1)
    assert any(ex.mutate(51, s, axes=2)[0] >> 4 != 3 for s in range(20))
    assert ex.schedule("coord", {1, 2}) == [0, *range(3, 16)] and len(ex.schedule("full", set())) == 256
    assert len(ex.schedule("fuzz", set(), budget=5)) == 5 and 51 not in ex.schedule("guided", {51}, best=51)


def test_write_ordered_refuses_what_it_cannot_undo(spark, tmp_path):
    page = lambda i, t: f"<page><title>{t}</title><id>{i}</id></page>"
    good = spark.createDataFrame([(1, page(1, "b")), (2, page(5, "a")), (3, "x")], "doc_id bigint, text string")
    layout.write_ordered(layout.pages(good), "title", str(tmp_path / "o"))
    assert [r.pos for r in spark.read.parquet(str(tmp_path / "o")).orderBy("place").collect()] == [2, 1]
    bad = spark.createDataFrame([(1, page(9, "b")), (2, page(3, "a"))], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        layout.write_ordered(layout.pages(bad), "title", str(tmp_path / "p"))


def test_page_split_tiles(spark):
    texts = ["h<page>a</page> <page>b</page>t", "<page>a</page>", "<page>open", "none"]
    s = {r.doc_id: r for r in layout.split_stream(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert (s[0].header, s[0].pages, s[0].tail, s[0].tiles) == ("h", ["<page>a</page>", " <page>b</page>"], "t", True)
    assert s[1].tiles and not s[2].tiles and 3 not in s


def test_boilerplate(spark):
    docs = spark.createDataFrame([(1, "{{A|x}} [[Category:B]] one"), (2, "[[category:b]] {{a}} two"), (3, "x")], "doc_id bigint, text string")
    sig = {r.doc_id: r.sig for r in layout.boilerplate_signatures(docs).collect()}
    assert sig[1] == sig[2] != sig[3] == [(1 << 63) - 1] * 8


def test_streams_match_batch(spark, tmp_path):
    from quernstone.streaming import receipts as st

    base = spark.read.parquet(f"{DATA}/phase9_tune.parquet")
    for k in range(3):  # three files, the last repeating the first
        base.filter(F.col("log_pos") % 2 == k % 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "phase9_tune.parquet"))
    got = st.drain(st.first_receipts(st.read_table(spark, str(tmp_path), "phase9_tune").select("id", "archive_sha256", "arrived_at")))
    assert got.count() == base.select("id", "archive_sha256").distinct().count()
