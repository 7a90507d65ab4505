from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import coder, jvm, model
from quernstone.operators import experiments as ex
from quernstone.plans import coding

TEXT = b"<title>The Nations</title> running runs The THE\ntHe station stations;\n &amp; [[link]] {{t}} http://x.y aaaa aaaa\x00\x7f\xff " * 6
BASE = coder.for_method(model.ACCEPTED_METHOD)


@pytest.mark.parametrize(
    "configs",
    [
        [BASE, BASE.tuned(4), replace(BASE, off="o3"), replace(BASE, word=False, pair=False), replace(BASE, shift=-1), replace(BASE, moved=(("o16", 2),))],
        [coder.Config(orders=(1, 12), matches=((12, 0), (6, 2)), scale=3, apm_rates=(5, 6, 7))],
        [coder.Config(orders=(2,), word=False, matches=())],
    ],
)
def test_the_jvm_prices_as_the_coder_does(spark, configs):
    streams = [b"", b"x", TEXT[:90], b"ab\n" * 171, TEXT[7:540]]  # some longer than the experts go ahead
    rows = spark.createDataFrame([(k, bytearray(s)) for k, s in enumerate(streams)], "k int, data binary")
    got = {r.k: r.bits for r in rows.select("k", jvm.swept(spark, F.col("data"), configs).alias("bits")).collect()}
    assert jvm.covers(configs)
    assert np.allclose([got[k] for k in range(len(streams))], coder.sweep(streams, configs), rtol=0, atol=1e-8)


def test_what_the_jvm_lacks_is_left_to_the_coder(spark, monkeypatch):
    few = spark.createDataFrame([(k, f"gates of {k}") for k in range(3)], "log_pos bigint, text string")
    monkeypatch.setattr(coding, "_receipts", lambda *_: few)
    c = coder.for_method(65)
    assert not jvm.covers([c]) and not jvm.covers([BASE, BASE.tuned(51)])
    got = {r.name: r.n_bytes for r in coding._sizes(spark, "", {"a": c}).collect()}
    assert got["a"] == pytest.approx(sum(x.sum() for x in coder.costs([f"gates of {k}".encode() for k in range(3)], c)) / 8)


def _no_python(df) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "quernstone_sweep" in plan and "MapInPandas" not in plan


def test_the_points_of_rate_sweep_are_priced_in_the_jvm(spark, monkeypatch):
    few = spark.createDataFrame([(k, f"é gates of {k}") for k in range(3)], "log_pos bigint, text string")
    monkeypatch.setattr(coding, "_receipts", lambda *_: few)
    points = coding.rate_points(BASE.tuned(model.ACCEPTED_TUNE))
    sizes = coding._sizes(spark, "", points)
    assert _no_python(sizes) and {r.name for r in sizes.collect()} == set(points)
    monkeypatch.setattr(coding, "_receipts", lambda *_: few.limit(0))
    assert coding.rate_sweep(spark, "").collect() == []


def test_tune_trials_are_priced_in_the_jvm(spark, monkeypatch):
    texts = [f"opt-{k}/gate-{k} lowers the score of gate-{k - 1}" for k in range(3)]
    monkeypatch.setattr(coding, "_receipts", lambda *_: spark.createDataFrame(list(enumerate(texts)), "log_pos bigint, text string"))
    trials = coding.tune_trials(spark, "")
    size = {r.tune: r.archive_bytes for r in trials.collect()}
    bits = coder.sweep([t.encode() for t in texts], [BASE.tuned(t) for t in sorted(size)]).sum(0)
    assert _no_python(trials) and [size[t] for t in sorted(size)] == np.ceil(bits / 8).tolist() and len(size) == 16


def test_tunes_mix_side_by_side_with_the_same_numbers(spark):
    """All tunes of tune_trials have the same experts: the mixers go over a stream once for each vector of tunes."""
    tunes = [BASE.tuned(t) for t in ex.schedule("coord", set())]
    mixed = [*tunes[:13], replace(BASE, off="o2"), *tunes[13:], *(replace(BASE, mixer_rate=r) for r in (1, 5, 255))]
    rng = np.random.default_rng(7)
    streams = [TEXT[:217], b"\x00" * 700, bytes(rng.integers(0, 256, 513, np.uint8)), b"ab" * 200 + bytes(rng.integers(97, 99, 800, np.uint8))]
    rows = spark.createDataFrame([(k, bytearray(s)) for k, s in enumerate(streams)], "k int, data binary")
    got = {r.k: r.bits for r in rows.select("k", jvm.swept(spark, F.col("data"), mixed).alias("bits")).collect()}
    assert np.allclose([got[k] for k in range(len(streams))], coder.sweep(streams, mixed), rtol=0, atol=1e-8)
    mixes = spark.sparkContext._jvm.quernstone.Sweep.mixes
    assert mixes(jvm._spec(tunes)) <= 4 and mixes(jvm._spec(mixed)) <= 6 and mixes(jvm._spec([BASE, replace(BASE, off="o2")])) == 2
