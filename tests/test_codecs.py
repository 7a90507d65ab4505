import random
import re
from dataclasses import replace

import numpy as np
import pytest

from quernstone.functions import codecs, coder, markup, model, pages
from quernstone.functions.registry import NAMES, ORDERS
from quernstone.plans import coding

TEXT = b"<page><title>The Nations</title> running runs The THE tHe station stations; &amp; [[link]] {{t}} http://x.y aaaa aaaa\x00\x01\x7f " * 6


def samples():
    rnd = random.Random(3)
    parts = [b"a", b"the ", b"The ", b"WORD ", b"wOrd", b"\0", b"\1", b"\2", b"\3", b"<page>", b"&amp;", b"running ", b"nation", b" ", b"\x7f", b"\xff", b"abcabc", b"aaaa", b"\n"]
    yield from (b"", b"a", TEXT, bytes(range(256)) * 4, b"a" * 700, bytes(rnd.randrange(256) for _ in range(400)))
    for _ in range(25):
        yield b"".join(rnd.choice(parts) for _ in range(rnd.randint(0, 120)))


@pytest.mark.parametrize("name", codecs.TRANSFORMS)
def test_round_trip(name):
    encode, decode = codecs.TRANSFORMS[name]
    for x in samples():
        assert decode(encode(x)) == x
        decode(x)  # total on anything


def test_long_words_are_not_entries():
    data = (b"x" * 300 + b" ") * 5
    assert codecs.untokenize(codecs.tokenize(data)) == data


def test_controls_differ():
    assert codecs.case_fold(TEXT) != codecs.case_mark(TEXT)
    assert codecs.tokenize(TEXT) != codecs.tokenize(TEXT, reverse=True)
    assert len(codecs.grammar(TEXT)) < len(TEXT)


def test_blocked_words_keep_ids():
    vocab = [b"running", b"stations"]
    assert codecs.untokenize(codecs.tokenize(TEXT, vocab, blocked=[b"running"])) == TEXT


def test_wide_vocabulary_counts_kept_words():
    from collections import Counter

    counts = Counter({b"w%c%c%c" % (97 + i // 26, 97 + i % 26, 120): 3 for i in range(600)})
    kept = codecs.wide_vocabulary(counts)
    assert len(kept) == 254  # three-byte ids no longer save anything on four letters


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 1 << 31])
def test_varint(n):
    assert codecs.read_varint(codecs.varint(n), 0) == (n, len(codecs.varint(n)))


def test_segments_partition():
    rnd = random.Random(8)
    parts = ["<", "</a>", "<b/>", "<!--", "-->", "&", "&amp;", "&#;", ";", "{{", "}}", "{", "[[", "]]", "{|", "|}", "a", "Z9", " ", "\n", "é", "日", "http://x", "ftp://", "<?", "?>", "!", "|", "\x01"]
    for _ in range(800):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        got = markup.segment(s)
        assert "".join(s[a : a + n] for _, a, n in got) == s and all(n for _, _, n in got)
    kinds = {k: s for k, a, n in markup.segment("{{a{{b}}}}[[x]]{|t|}<b>w 1") for s in ["{{a{{b}}}}[[x]]{|t|}<b>w 1"[a : a + n]]}
    assert kinds["template"] == "{{a{{b}}}}" and kinds["link"] == "[[x]]" and kinds["table"] == "{|t|}"
    assert markup.segment("{{open")[0] == ("punct", 0, 2)


SMALL = [b"", b"a", b"The gates kept THE gates.\n|| The gates", b"gate gate gate gates gate'", bytes(range(0, 256, 7))]


@pytest.mark.parametrize("method", range(95))
def test_archive_of_every_method(method):
    tune = method * 7 % 256 & 0x3F
    made = model.archives(SMALL, method, tune)
    assert model.unarchives(made) == SMALL
    assert [model.header(a)[:2] for a in made] == [(NAMES[method], tune)] * len(SMALL)


def test_archive_edges():
    assert model.header(b"nothing at all!") is None and model.unarchive(b"QRN2\xff" + b"\0" * 20) is None
    assert model.unarchives([model.archive(b"ab", 0, 0), b"no", model.archive(b"cd", 15, 3)]) == [b"ab", None, b"cd"]
    assert len(model.archive(TEXT[:150] * 3)) < 225


def test_a_code_depends_on_its_stream_alone():
    c = coder.for_method(65).tuned(0)
    streams = [TEXT[k : k + 20 + 3 * k] for k in range(0, 12, 3)]
    together = coder.encode(streams, c)
    assert together == [coder.encode([s], c)[0] for s in streams]
    assert coder.decode(together, [len(s) for s in streams], c) == streams


def test_methods_differ():
    data = b"The gates kept THE gates of the gate.\n" * 2
    assert len({model.archive(data, m, 0)[7:] for m in (0, 1, 5, 8, 11, 15, 16, 19, 26, 33, 35, 38, 44, 51, 54, 56, 59, 65, 67)}) >= 17  # few words are worth an entry here


def test_pages_are_reordered_and_come_back():
    page = lambda i, t, c: f"<page><title>{t}</title><id>{i}</id>{{{{b{i % 2}}}}} words {t} [[Category:{c}]]</page>\n".encode()
    data = b"<head>\n" + page(1, "Beta", "z") + page(2, "Alpha", "y") + page(10, "Gamma", "x") + b"</tail>\n"
    assert re.findall(rb"<id>(\d+)", pages.reorder(data, "title")) == [b"2", b"1", b"10"]
    assert re.findall(rb"<id>(\d+)", pages.reorder(data, "category")) == [b"10", b"2", b"1"]
    for how in ORDERS:
        assert pages.restore(pages.reorder(data, how)) == data
    assert pages.reorder(b"<page><id>9</id></page><page><id>3</id></page>", "title") is None and pages.reorder(b"x", "title") is None
    for m in (73, 84):
        made = model.archive(data, m, 0)
        assert made[6] == 1 and model.unarchive(made) == data


def test_range_coder_ideal_bits():
    c = coder.Config()
    code, bits = coder.encode([TEXT[:200]], c)[0], coder.costs([TEXT[:200]], c)[0].sum()
    assert bits / 8 <= len(code) <= bits / 8 + 16


def test_word_gains():
    gains = model.word_gains([b"lanternfish swim " * 4 + b"q"], coder.Config())[0]
    assert set(gains) == {b"lanternfish", b"swim", b"q"}


def test_rans():
    freq, cum = model.rans_table([TEXT.count(i) for i in range(256)])
    assert sum(freq) == 4096 and model.rans_decode(model.rans_encode(TEXT, freq, cum), len(TEXT), freq, cum) == TEXT
    assert sum(model.rans_table([0] * 7)[0]) == 4096


def test_images_last_marker_wins():
    image = model.append_image(model.append_image(b"program", b"one"), b"two")
    assert model.extract_image(image) == b"two" and model.extract_image(b"none") is None


def test_corrector_learns_and_serializes():
    rows = [([32 if k % 2 else -32] * 12, 2048, k % 2) for k in range(600)]
    *w, loss, smooth = model.train_corrector(rows)
    assert loss < 0.9 and 0.9 < smooth < 1 and model.read_weights(model.weights_bytes(*w)) == tuple(w)
    assert model.read_weights(b"QNET\x01\x00") is None


def test_stretch_inverts_squash():
    assert all(coder.squash(model.STRETCH[p]) >= p for p in range(1, 4095))
    assert model.front_ranks("abba") == [-1, -1, 0, 1]
    assert sum(model.match_states(b"abcdefgh" * 20)) > 100 and model.ring_hits(b"abcdefgh" * 20) > 100


def test_configurations_are_priced_together():
    c = coder.for_method(model.ACCEPTED_METHOD)
    configs = [c, replace(c, off="o3"), replace(c, word=False, pair=False), replace(c, mixer_rate=96), replace(c, shift=-1), replace(c, moved=(("o16", 2),))]
    streams = [TEXT[:90], b"", TEXT[40:170], b"x", b"gates\n gates\n gates"]
    got = coder.sweep(streams, configs)
    assert got.shape == (5, 6) and len(set(got[0])) == 6 and not got[1].any()
    for k, x in enumerate(configs):
        assert np.allclose(got[:, k], [bits.sum() for bits in coder.costs(streams, x)], rtol=0, atol=1e-8)


def test_other_configurations_are_priced_one_by_one():
    configs = [coder.for_method(65), coder.for_method(54).tuned(51)]
    got = coder.sweep([TEXT[:30]], configs)
    assert got.shape == (1, 2) and got[0, 1] == coder.costs([TEXT[:30]], configs[1])[0].sum()


def test_each_task_prices_its_streams_by_all_configurations_at_once(spark, monkeypatch):
    c = coder.for_method(model.ACCEPTED_METHOD)
    few = spark.createDataFrame([(k, f"gates of candidate {k}") for k in range(5)], "log_pos bigint, text string")
    monkeypatch.setattr(coding, "_receipts", lambda *_: few)
    got = {r.name: r.n_bytes for r in coding._sizes(spark, "", {"a": c, "b": replace(c, mixer_rate=64), "again": c}).collect()}
    texts = [r.text.encode() for r in few.collect()]
    assert got["a"] == got["again"] == pytest.approx(sum(x.sum() for x in coder.costs(texts, c)) / 8) != got["b"]


def test_blocks_are_coded_with_shared_state(monkeypatch):
    c, streams = coder.Config(), [TEXT[k : 2 * k + 9] for k in range(0, 60, 7)]
    codes = coder.encode(streams, c)
    with monkeypatch.context() as m:
        m.setattr(coder, "Predictors", None)  # one state for each configuration isn't needed
        m.setattr(coder, "SHARED_BATCH", 3)
        assert coder.encode(streams, c) == codes and coder.decode(codes, [len(s) for s in streams], c) == streams
    monkeypatch.setattr(coder, "_plain", lambda c: False)
    assert coder.encode(streams, c) == codes



def test_rate_sweep_combines_the_best_points(spark, monkeypatch):
    base = coder.for_method(model.ACCEPTED_METHOD).tuned(model.ACCEPTED_TUNE)
    texts = [f"opt-{k}/gate-{k} lowers the score of gate-{k - 1}" for k in range(3)]
    monkeypatch.setattr(coding, "_receipts", lambda *_: spark.createDataFrame(list(enumerate(texts)), "log_pos bigint, text string"))
    r = {x.setting: x for x in coding.rate_sweep(spark, "").collect()}
    points = coding.rate_points(base)
    assert set(r) == {*points, "best lr+shift", "best rates"} and {"shift-2", "shift+2", "o2=2", "o16=1", "o16=5"} <= set(r) and "o2=1" not in r
    of = {n: c for n, c in points.items() if n == "base" or n[0] == "o"}
    size = dict(zip(of, coder.sweep([t.encode() for t in texts], list(of.values())).sum(0) / 8, strict=True))
    assert all(r[n].n_bytes == round(float(x), 1) for n, x in size.items())
    picks = [min((n for n in size if n.startswith(f"o{o}=")), key=size.get) for o in base.orders]
    picks = [n for n in picks if size[n] < size["base"] - 1e-6]
    both = replace(base, moved=tuple(m for n in picks for m in points[n].moved))
    together = sum(x.sum() for x in coder.costs([t.encode() for t in texts], both)) / 8 - size["base"]
    gains = sum(size[n] - size["base"] for n in picks)
    assert picks and r["best rates"].rates == ",".join(str(x) for _, x in both.experts())
    assert (r["best rates"].change, r["best rates"].sum_of_gains, r["best rates"].interaction) == tuple(round(float(x), 1) for x in (together, gains, together - gains))
    assert r["base"].change == 0 and r["best lr+shift"].interaction is not None and r["lr8"].n_bytes == r["base"].n_bytes
