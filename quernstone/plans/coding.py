"""Queries over invertible transforms, the sequential coder and vocabularies priced by cost."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import codecs, coder, jvm, markup, model, udfs
from quernstone.functions.registry import NAMES
from quernstone.operators import experiments as ex
from quernstone.operators import text as tx
from quernstone.operators import vocab
from quernstone.operators.experiments import MIXER_RATES
from quernstone.plans.corpus import _VOCAB
from quernstone.session import spread
from quernstone.sources.tables import table

_Q: dict = {}
_SQL: dict[str, str] = {}
_SLOW = {"grammar", "grammar_mtf", "grammar_repeats", "grammar_ranked", "grammar_inline"}


def _query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _roundtrip(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    def run(data: bytes) -> list[tuple]:
        out = []
        for name in names:
            e, u = codecs.TRANSFORMS[name]
            code = e(data)
            out.append((name, len(data), len(code), u(code) == data))
        return out

    r = udfs.per_text(table(spark, d, "documents"), run, "transform string, n_in bigint, n_out bigint, exact boolean")
    return r.groupBy("transform").agg(F.count("*").alias("texts"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.bool_and("exact").alias("exact"))


@_query()
def codec_roundtrip(spark, d):
    """Bytes before and after every transform of single symbols, words and factors, and whether all texts come back."""
    return _roundtrip(spark, d, [n for n in codecs.TRANSFORMS if n not in _SLOW])


@_query()
def grammar_roundtrip(spark, d):
    """The same for the pair grammars."""
    return _roundtrip(spark, d, sorted(_SLOW))


@_query()
def baseline_sizes(spark, d):
    """Bytes of general-purpose compressors on every text."""
    r = udfs.per_text(table(spark, d, "documents"), lambda x: [(n, len(x), len(f(x))) for n, f in udfs.BASELINES.items()], "compressor string, n_in bigint, n_out bigint")
    return r.groupBy("compressor").agg(F.count("*").alias("texts"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


@_query()
def transform_delta(spark, d):
    """What each transform changes in the size of a general-purpose code of every text."""
    import zlib

    def run(data: bytes) -> list[tuple]:
        plain = len(zlib.compress(data, 9))
        return [(n, plain, len(zlib.compress(codecs.TRANSFORMS[n][0](data), 9))) for n in ("hoist", "case", "case_mark", "token", "token_reverse", "stem")]

    r = udfs.per_text(table(spark, d, "documents"), run, "transform string, plain bigint, coded bigint")
    return r.groupBy("transform").agg(F.sum("plain").alias("plain"), F.sum("coded").alias("coded"), (F.sum("coded") - F.sum("plain")).alias("delta"))


@_query()
def blocked_words(spark, d):
    """Words whose price doesn't pay stay in the vocabulary but aren't used: sizes and round trip."""

    def run(data: bytes) -> list[tuple]:
        vocab_ = codecs.vocabulary(codecs._words_of(data))
        code = codecs.tokenize(data, vocab_, blocked=vocab_[1::2])
        return [(len(vocab_), len(data), len(code), codecs.untokenize(code) == data)]

    r = udfs.per_text(table(spark, d, "documents"), run, "entries int, n_in bigint, n_out bigint, exact boolean")
    return r.groupBy("exact").agg(F.count("*").alias("texts"), F.sum("entries").alias("entries"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


@_query()
def segment_kinds(spark, d):
    """Tokens and characters by kind, with balanced templates, links and tables as one token each."""

    def run(data: bytes) -> list[tuple]:
        n: dict[str, list[int]] = {}
        for kind, _, size in markup.segment(data.decode()):
            c = n.setdefault(kind, [0, 0])
            c[0] += 1
            c[1] += size
        return [(k, *v) for k, v in n.items()]

    r = udfs.per_text(table(spark, d, "documents"), run, "kind string, n bigint, n_chars bigint")
    return r.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars"))


@_query()
def match_profile(spark, d):
    """Bytes by match state, bytes a ring of four repeat distances predicts, and summed
    move-to-front ranks of repeated words, of every text."""

    def run(data: bytes) -> list[tuple]:
        s = model.match_states(data)
        ranks = [r for r in model.front_ranks(w.decode() for w in codecs._WORD.findall(data)) if r >= 0]
        return [(*(s.count(k) for k in range(4)), model.ring_hits(data), len(ranks), sum(ranks))]

    return udfs.per_text(table(spark, d, "documents"), run, "none int, short int, medium int, long int, ring int, repeated int, ranks bigint")


#: Streams that a task hands to the coder at once.
STREAMS = 2_048


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    """log_pos and text of every gate of candidates: the streams that the coder's queries code."""
    return spread(table(spark, d, "phase6_receipts").select("log_pos", F.concat_ws(" ", "id", "hypothesis", "parent", "corpus", "attribution", "decision", "notes").alias("text")))


def _dealt(streams: DataFrame, least: int = 128) -> DataFrame:
    """The streams in parts of like size, up to four for each core as the last part takes long, but with no less streams
    than advance together well."""
    cores = streams.sparkSession.sparkContext.defaultParallelism
    n = streams.count() // least
    n -= n % cores if n > cores else 0
    return streams.repartition(max(1, min(n, max(4 * cores, streams.rdd.getNumPartitions()))), "log_pos")


def _coded(streams: DataFrame, f: Callable[[list, list[bytes]], list[tuple]], schema: str) -> DataFrame:
    """Rows f(keys, texts) of the texts (key, text), a bounded number of them at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), STREAMS):
                part = b.iloc[at : at + STREAMS]
                yield pd.DataFrame(f(part.iloc[:, 0].tolist(), [t.encode() for t in part.iloc[:, 1]]), columns=names)

    return streams.mapInPandas(run, schema)


@_query()
def model_roundtrip(spark, d):
    """Every receipt as an archive of the method that its position names in turn: sizes, what the
    stages made of it, and whether it comes back."""

    def run(keys: list, texts: list[bytes]) -> list[tuple]:
        out, groups = [], {}
        for k, t in zip(keys, texts, strict=True):
            groups.setdefault(k % len(NAMES), []).append((k, t))
        for method, rows in groups.items():
            own = [t for _, t in rows]
            made = model.archives(own, method, model.ACCEPTED_TUNE)
            back = model.unarchives(made)
            out += [(k, NAMES[method], len(t), model.header(m)[2], len(m), b == t) for (k, t), m, b in zip(rows, made, back, strict=True)]
        return out

    by_method = _receipts(spark, d).repartition(spark.sparkContext.defaultParallelism * 4, F.pmod("log_pos", F.lit(len(NAMES))))
    return _coded(by_method, run, "log_pos bigint, method string, n_in int, n_stages int, n_out int, exact boolean")


@_query()
def archive_report(spark, d):
    """All receipts by the accepted method and tune: the report line of a bench."""

    def run(keys: list, texts: list[bytes]) -> list[tuple]:
        made = model.archives(texts)
        return [(len(t), len(m), b == t) for t, m, b in zip(texts, made, model.unarchives(made), strict=True)]

    r = _coded(_receipts(spark, d), run, "n_in int, n_out int, exact boolean").agg(F.count("*").alias("streams"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.bool_and("exact").alias("exact"))
    return r.select("streams", "n_in", "n_out", F.round(F.col("n_in") / F.col("n_out"), 4).alias("ratio"), F.round(F.lit(8.0) * F.col("n_out") / F.col("n_in"), 4).alias("bits_per_byte"), "exact")


@_query()
def block_probe(spark, d):
    """The receipts coded in 1, 2 and 4 blocks each: what independent blocks cost, and how many coding steps are
    left of the longest block."""

    def run(keys: list, texts: list[bytes]) -> list[tuple]:
        out = []
        for blocks in (1, 2, 4):
            cut = [[t[len(t) * i // blocks : len(t) * (i + 1) // blocks] for i in range(blocks)] for t in texts]
            flat = [p for c in cut for p in c]
            codes = coder.encode(flat, coder.Config())
            same = coder.decode(codes, [len(p) for p in flat], coder.Config()) == flat
            out.append((blocks, sum(map(len, texts)), sum(map(len, codes)), sum(max(map(len, c)) for c in cut), same))
        return out

    r = _coded(_dealt(_receipts(spark, d), coder.SHARED_BATCH), run, "blocks int, n_in bigint, n_out bigint, longest bigint, exact boolean")
    r = r.groupBy("blocks").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.sum("longest").alias("longest"), F.bool_and("exact").alias("exact"))
    whole = r.filter("blocks = 1").select(F.col("n_out").alias("_whole"), F.lit(True).alias("_k"))
    r = r.withColumn("_k", F.lit(True)).join(F.broadcast(whole), "_k")
    return r.select("blocks", "n_in", "n_out", F.round(100.0 * (F.col("n_out") - F.col("_whole")) / F.col("_whole"), 3).alias("cost_percent"), F.round(F.col("n_in") / F.col("longest"), 3).alias("speedup"), "exact")


def _sizes(spark: SparkSession, d: str, configs: dict[str, coder.Config]) -> DataFrame:
    """name and ideal bytes of all receipts by each configuration; every task prices its receipts by all of them at once,
    in the JVM, or in Python if they ask for more than is there."""
    once = list(dict.fromkeys(configs.values()))
    streams = _dealt(_receipts(spark, d))
    if jvm.covers(once):
        priced = streams.select(jvm.swept(spark, F.col("text").cast("binary"), once).alias("bits"))
        sums = priced.agg(F.count("*").alias("n"), *[F.sum(F.get("bits", F.lit(k))).alias(f"s{k}") for k in range(len(once))])
        each = F.array(*[F.struct(F.lit(name).alias("name"), (F.col(f"s{once.index(c)}") / 8).alias("n_bytes")) for name, c in configs.items()])
        return sums.filter("n > 0").select(F.inline(each))

    def run(keys: list, texts: list[bytes]) -> list[tuple]:
        bits = dict(zip(once, coder.sweep(texts, once).sum(0).tolist(), strict=True))
        return [(name, bits[c]) for name, c in configs.items()]

    return _coded(streams, run, "name string, bits double").groupBy("name").agg((F.sum("bits") / 8).alias("n_bytes"))


@_query()
def expert_marginals(spark, d):
    """Ideal bytes without each expert of the accepted configuration, whether it is to keep, and its rank by
    what it saves; without both word experts for the ablation."""
    full = coder.for_method(model.ACCEPTED_METHOD)
    configs = {"": full, **{n: replace(full, off=n) for n, _ in full.experts()}, "word+pair": replace(full, word=False, pair=False)}
    s = _sizes(spark, d, configs).withColumn("_k", F.lit(True))
    base = s.filter("name = ''").select(F.col("n_bytes").alias("_base"), "_k")
    r = s.filter("name != ''").join(F.broadcast(base), "_k").withColumn("saves", F.col("n_bytes") - F.col("_base"))
    place = F.row_number().over(Window.orderBy("saves", "name"))  # one row per expert
    return r.select(F.col("name").alias("expert"), F.round("_base", 1).alias("with_it"), F.round("n_bytes", 1).alias("without_it"), F.when(F.col("saves") > 0, "KEEP").otherwise("PRUNE").alias("verdict"), place.alias("place"))


@_query()
def rate_sweep(spark, d):
    """Ideal bytes by learning rate, by a shift of all adaptation rates, and by every other rate of each single order
    expert, at the accepted method and tune; then of the best learning rate with the best shift, and of the best
    rates of all order experts together, against the sums of their single gains: the rest is interaction."""
    base = coder.for_method(model.ACCEPTED_METHOD).tuned(model.ACCEPTED_TUNE)
    configs = rate_points(base)
    got = {r.name: r.n_bytes for r in _sizes(spark, d, configs).collect()}  # a number for each point
    if not got:
        return spark.createDataFrame([], RATE_POINTS)
    none = got["base"]

    def best(names: list[str]) -> str:
        """The first of the best points, or base if none is better."""
        return min(["base", *names], key=lambda n: got[n])

    lr, shift = (best([n for n in configs if n.startswith(x)]) for x in ("lr", "shift"))
    picks = [n for o in base.orders if (n := best([x for x in configs if x.startswith(f"o{o}=")])) != "base"]
    together = {
        "best lr+shift": (replace(base, mixer_rate=configs[lr].mixer_rate, shift=configs[shift].shift), [lr, shift]),
        "best rates": (replace(base, moved=tuple(m for n in picks for m in configs[n].moved)), picks),
    }
    summed = {n: sum(got[x] - none for x in of) for n, (_, of) in together.items()}
    got |= {r.name: r.n_bytes for r in _sizes(spark, d, {n: c for n, (c, _) in together.items()}).collect()}
    rows, place = [], {n: 1 + sum(x < got[n] for x in got.values()) for n in got}
    for n, x in got.items():
        apart = (round(summed[n], 1), round(x - none - summed[n], 1)) if n in summed else (None, None)
        rates = ",".join(str(r) for _, r in (together[n][0] if n in together else configs[n]).experts())
        rows.append((n, round(x, 1), place[n], rates, round(x - none, 1), "BETTER" if x < none else "base" if n == "base" else "worse", *apart))
    return spark.createDataFrame(rows, RATE_POINTS)


RATE_POINTS = "setting string, n_bytes double, place int, rates string, change double, verdict string, sum_of_gains double, interaction double"


def rate_points(base: coder.Config, deltas: tuple[int, ...] = (-2, -1, 1, 2)) -> dict[str, coder.Config]:
    """The points of a sweep: base; learning rates; shifts of all experts; the rates that a shift gives each order
    expert alone. Rates stay within 1 and 12; shifts that change none are left out."""
    points = {"base": base, **{f"lr{x}": replace(base, mixer_rate=x) for x in MIXER_RATES}}
    points |= {f"shift{x:+d}": c for x in deltas if (c := replace(base, shift=x)).experts() != base.experts()}
    for name, rate in base.experts()[: len(base.orders)]:
        for x in deltas:
            now = min(12, max(1, rate + x))
            if now != rate:
                points[f"{name}={now}"] = replace(base, moved=((name, now - rate),))
    return points


@_query()
def tune_trials(spark, d):
    """Trials of the tunes that a coordinate search asks for, run over all receipts, with the frontier."""
    base = coder.for_method(model.ACCEPTED_METHOD)
    tunes = ex.schedule("coord", set())
    s = _sizes(spark, d, {str(t): base.tuned(t) for t in tunes})
    best = F.min("archive_bytes").over(Window.partitionBy())  # one row per tune
    s = s.select(F.lit(NAMES[model.ACCEPTED_METHOD]).alias("method"), F.col("name").cast("int").alias("tune"), F.ceil("n_bytes").alias("archive_bytes"))
    return s.withColumn("frontier", F.col("archive_bytes") == best)


@_query()
def coded_word_prices(spark, d):
    """Words by the bits that the coder spends on their occurrences in all receipts, with the gain of
    an entry: references of two bytes and a definition at the mean price of a byte."""
    c = coder.for_method(54)

    def run(keys: list, texts: list[bytes]) -> list[tuple]:
        spent: dict[bytes, list] = {}
        for t, cost in zip(texts, coder.costs(texts, c), strict=True):
            upto = np.concatenate([[0.0], np.cumsum(cost)])
            for m in re.finditer(rb"[A-Za-z]+", t):
                s = spent.setdefault(m[0], [0, 0.0])
                s[0] += 1
                s[1] += upto[m.end()] - upto[m.start()]
            s = spent.setdefault(b"", [0, 0.0])
            s[0] += len(t)
            s[1] += upto[-1]
        return [(w.decode(), n, bits) for w, (n, bits) in spent.items()]

    w = _coded(_receipts(spark, d), run, "word string, cnt bigint, bits double").groupBy("word").agg(F.sum("cnt").alias("cnt"), F.sum("bits").alias("bits"))
    mean = w.filter("word = ''").select((F.col("bits") / F.col("cnt")).alias("_mean"), F.lit(True).alias("_k"))
    r = w.filter("word != ''").withColumn("_k", F.lit(True)).join(F.broadcast(mean), "_k")
    gain = F.col("bits") - F.col("_mean") * (2 * F.col("cnt") + F.length("word") + 1)
    return r.select("word", "cnt", F.round("bits", 2).alias("bits"), F.round(gain, 2).alias("gain"), (gain > 0).alias("pays"))


#: Receipts that the corrector is trained on, at most: those with the smallest hashes of log_pos.
TRAINING_STREAMS = 64


@_query()
def corrector_training(spark, d):
    """Loss of the learned corrector over the coding events of a bounded sample of receipts, before and after
    training, its smoothed end, and the ideal bytes of those receipts with and without it."""
    texts = [r.text.encode() for r in _receipts(spark, d).orderBy(F.xxhash64("log_pos")).limit(TRAINING_STREAMS).collect()]
    base = coder.for_method(54)

    def run(seed: int) -> tuple:
        events: list = []

        def watch(m, p, bit) -> None:
            f = m.features()
            events.extend((f[k].tolist(), int(p[k]), int(bit[k])) for k in range(0, m.a, 8))

        plain_bytes = sum(x.sum() for x in coder.costs(texts, base, watch)) / 8
        *w, loss, smooth = model.train_corrector(events, seed=seed)
        plain = model.train_corrector(events, rate=0.0, seed=seed)[-2]
        with_it = sum(x.sum() for x in coder.costs(texts, replace(base, corrector=tuple(w)))) / 8
        return seed, round(plain, 5), round(loss, 5), round(smooth, 5), round(plain_bytes, 1), round(with_it, 1), model.read_weights(model.weights_bytes(*w)) == tuple(w)

    return _grid(spark, [(1,), (2,)], "seed int", run, "seed int, before double, after double, smoothed double, plain_bytes double, corrected_bytes double, exact boolean")


def _grid(spark: SparkSession, rows: list[tuple], schema: str, f, out: str) -> DataFrame:
    """f(row) for every row of a small grid, a task each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame([f(*r)], columns=[x.split()[0] for x in out.split(", ")])

    grid = spark.createDataFrame(rows, schema)
    return grid.repartition(min(len(rows), spark.sparkContext.defaultParallelism)).mapInPandas(run, out)


_WIDE = """WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), c AS (SELECT word, count(*) AS cnt, length(word) AS n FROM w GROUP BY word HAVING count(*) >= 2 AND length(word) >= 3),
a AS (SELECT word, cnt, n FROM c WHERE cnt * (n - 2) - (n + 1) > 0 ORDER BY cnt DESC, word LIMIT 254), z AS (SELECT min(cnt) AS cnt, max(word) FILTER (cnt = (SELECT min(cnt) FROM a)) AS word FROM a),
b AS (SELECT c.word, c.cnt FROM c, z WHERE (SELECT count(*) FROM a) = 254 AND (c.cnt < z.cnt OR c.cnt = z.cnt AND c.word > z.word) AND c.cnt * (n - 3) - (n + 1) > 0)
SELECT row_number() OVER (ORDER BY cnt DESC, word) AS id, word, cnt FROM (SELECT word, cnt FROM a UNION ALL SELECT word, cnt FROM b) QUALIFY id <= 65534"""


@_query(_WIDE)
def vocab_wide(spark, d):
    """The vocabulary of two- and three-byte ids. The id's length depends on how many words were
    kept before, but only up to the 254th: the first 254 by the short code, then all after the
    last of them by the long one."""
    n = F.length("word")
    c = tx.word_counts(table(spark, d, "documents")).filter((F.col("cnt") >= 2) & (n >= 3))
    order = [F.desc("cnt"), F.col("word")]
    first = c.filter(F.col("cnt") * (n - 2) - (n + 1) > 0).orderBy(*order).limit(254)
    rows = first.collect()  # at most 254
    if len(rows) == 254:
        last = rows[-1]
        after = (F.col("cnt") < last.cnt) | ((F.col("cnt") == last.cnt) & (F.col("word") > last.word))
        rest = c.filter(after & (F.col("cnt") * (n - 3) - (n + 1) > 0))
        first = spark.createDataFrame(rows, c.schema).unionByName(rest).orderBy(*order).limit(65_534)
    return first.select(F.row_number().over(Window.orderBy(*order)).alias("id"), "word", "cnt")


@_query(_VOCAB + ", o AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), f AS (SELECT word, count(*) AS cnt FROM o GROUP BY word), s AS (SELECT word, cnt, coalesce("
        + ", ".join(f"CASE WHEN length(word) >= {len(s) + 2} AND ends_with(word, '{s}') THEN '{s}' END" for s in sorted(tx.SUFFIXES, key=lambda s: -len(s)))
        + ") AS suffix FROM f) SELECT CASE WHEN v.id IS NOT NULL THEN 'word' WHEN b.id IS NOT NULL THEN 'affix' ELSE 'literal' END AS coded, count(*) AS forms, sum(s.cnt)::BIGINT AS uses FROM s LEFT JOIN v ON v.word = s.word LEFT JOIN v b ON b.word = s.word[:length(s.word) - length(s.suffix)] GROUP BY 1")
def affix_lookup(spark, d):
    """Words by how they are coded: an entry, an entry with a known suffix, or letters."""
    c = tx.word_counts(table(spark, d, "documents"))
    v = F.broadcast(vocab.vocabulary(c).select("id", "word"))
    s = c.withColumn("suffix", tx.longest_suffix(F.col("word"))).withColumn("base", F.expr("substring(word, 1, length(word) - length(suffix))"))
    hit = s.join(v.withColumnRenamed("id", "whole"), "word", "left").join(v.select(F.col("id").alias("part"), F.col("word").alias("base")), "base", "left")
    coded = F.when(F.col("whole").isNotNull(), "word").when(F.col("part").isNotNull(), "affix").otherwise("literal")
    return hit.groupBy(coded.alias("coded")).agg(F.count("*").alias("forms"), F.sum("cnt").alias("uses"))


_PRICE = """WITH o AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), f AS (SELECT word, count(*) AS cnt FROM o GROUP BY word),
l AS (SELECT word, cnt, string_split(' ' || word, '') AS l FROM f), p AS (SELECT word, cnt, l[i] AS a, l[i + 1] AS b FROM l, LATERAL (SELECT unnest(range(1, len(l))) AS i)),
n AS (SELECT a, b, sum(cnt) AS n FROM p GROUP BY a, b), t AS (SELECT a, sum(n) AS t FROM n GROUP BY a), c AS (SELECT a, b, log2(t / n) AS bits FROM n JOIN t USING (a)),
w AS (SELECT word, cnt, sum(bits) AS bits FROM p JOIN c USING (a, b) GROUP BY word, cnt), m AS (SELECT sum(cnt * bits) / sum(cnt * length(word)) AS per FROM w)
SELECT word, cnt, round(cnt * bits, 3) AS literal_bits, round(cnt * 2 * per, 3) AS token_bits, round((length(word) + 1) * per, 3) AS def_bits FROM w, m WHERE cnt * bits - cnt * 2 * per - (length(word) + 1) * per > 0.001 ORDER BY cnt * bits - cnt * 2 * per - (length(word) + 1) * per DESC, word LIMIT 255"""


@_query(_PRICE)
def vocab_priced(spark, d):
    """The vocabulary by gain in bits: letters priced by an order-1 model over words, a reference and
    a definition at the mean bits per byte."""
    g = priced(tx.word_counts(table(spark, d, "documents"))).filter("gain > 0.001").orderBy(F.desc("gain"), "word").limit(255)
    return g.select("word", "cnt", *[F.round(c, 3).alias(c) for c in ("literal_bits", "token_bits", "def_bits")])


def priced(c: DataFrame) -> DataFrame:
    """word, cnt, literal_bits, token_bits, def_bits, gain of all words of counts."""
    chars = c.select("word", "cnt", F.split(F.concat(F.lit(" "), "word"), "").alias("l"))
    pair = F.transform(F.sequence(F.lit(0), F.size("l") - 2), lambda i: F.struct(F.get("l", i).alias("a"), F.get("l", i + 1).alias("b")))
    p = chars.select("word", "cnt", F.explode(pair).alias("p")).select("word", "cnt", "p.a", "p.b")
    n = p.groupBy("a", "b").agg(F.sum("cnt").alias("n"))  # at most 53 x 52 pairs
    cost = n.join(n.groupBy("a").agg(F.sum("n").alias("t")), "a").select("a", "b", F.log2(F.col("t") / F.col("n")).alias("bits"))
    w = p.join(F.broadcast(cost), ["a", "b"]).groupBy("word", "cnt").agg(F.sum("bits").alias("bits"))
    mean = w.agg((F.sum(F.col("cnt") * F.col("bits")) / F.sum(F.col("cnt") * F.length("word"))).alias("per")).collect()[0].per or 0.0
    literal, token, entry = F.col("cnt") * F.col("bits"), F.col("cnt") * 2 * F.lit(mean), (F.length("word") + 1) * F.lit(mean)
    return w.select("word", "cnt", literal.alias("literal_bits"), token.alias("token_bits"), entry.alias("def_bits"), (literal - token - entry).alias("gain"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
