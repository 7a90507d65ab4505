"""Queries that compare runs, join vocabularies with prices, render reports, and write and read logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import codecs, hashing
from quernstone.functions.numbers import digits
from quernstone.operators import experiments as ex
from quernstone.operators import seqstats, vocab
from quernstone.operators import text as tx
from quernstone.plans.coding import _PRICE, priced
from quernstone.plans.corpus import _HOIST, _VOCAB
from quernstone.plans.trials import _T
from quernstone.session import per_text, shared_dir
from quernstone.sources import logs
from quernstone.sources.tables import table

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


_FIELDS = ", ".join(f"coalesce({c}, '') AS {c}" for c in logs.FIELDS if c != "score_total")


@_query(f"SELECT log_pos, {_FIELDS}, coalesce((TRY_CAST(compressor_bytes AS BIGINT) + TRY_CAST(archive_bytes AS BIGINT))::VARCHAR, score_total, '') AS score_total, coalesce(phase, '') AS phase, coalesce(bits_per_byte, '') AS bits_per_byte FROM phase6_receipts")
def receipt_log(spark, d):
    """All gates appended to a log of JSON lines in two steps and read back, beside a log that isn't there."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    t = table(spark, d, "phase6_receipts").withColumn("x", F.create_map(F.lit("log_pos"), F.col("log_pos").cast("string"), F.lit("phase"), F.col("phase"), F.lit("bits_per_byte"), F.col("bits_per_byte")))
    logs.append(t.filter("log_pos % 2 = 0"), path, F.col("x"))
    logs.append(t.filter("log_pos % 2 != 0"), path, F.col("x"))
    r = logs.read(spark, path, path + "-absent")
    return r.select(F.col("extras")["log_pos"].cast("bigint").alias("log_pos"), *logs.FIELDS, F.col("extras")["phase"].alias("phase"), F.col("extras")["bits_per_byte"].alias("bits_per_byte"))


_RUNS = _T.replace("exact = 'true', false) AS exact, log_pos", "exact = 'true', false) AS exact, log_pos, nullif(lower(trim(parent, ' ' || chr(9) || chr(10) || chr(13))), '') AS parent") + """, b AS (SELECT method, corpus, tune, min(archive_bytes) AS bytes FROM t GROUP BY ALL), c AS (SELECT method, parent, corpus, tune, min(archive_bytes) AS bytes FROM t WHERE parent IS NOT NULL GROUP BY ALL)
"""


@_query(_RUNS + "SELECT c.method, c.parent, c.corpus, c.tune, c.bytes, b.bytes AS parent_bytes, c.bytes - b.bytes AS delta, round(100.0 * (c.bytes - b.bytes) / b.bytes, 4) AS percent, CASE WHEN c.bytes < b.bytes THEN 'smaller' WHEN c.bytes > b.bytes THEN 'larger' ELSE 'equal' END AS change FROM c JOIN b ON b.method = c.parent AND b.corpus = c.corpus AND b.tune = c.tune WHERE b.bytes > 0")
def run_against_parent(spark, d):
    """The best trial of each method against the best of the parent that it names, at the same corpus
    and tune: a join of the trials with themselves, both sides aggregated first."""
    r = table(spark, d, "phase9_tune")
    return ex.against_runs(ex.trials(r, keep=("parent",)))


_ALL = _PRICE.split("SELECT word, cnt, round")[0]
_GAIN = ", g AS (SELECT word, cnt, cnt * bits - cnt * 2 * per - (length(word) + 1) * per AS gain FROM w, m)"
_SHIPPED = ", " + _VOCAB.replace("WITH w AS", "vw AS").replace("FROM w GROUP BY word)", "FROM vw GROUP BY word)").replace("c AS (", "vc AS (").replace("AS gain FROM c", "AS saved FROM vc")


@_query(_ALL + _GAIN + _SHIPPED + "SELECT v.id, v.word, v.cnt, round(coalesce(g.gain, 0), 3) AS gain, coalesce(g.gain, 0) > 0 AS pays FROM v LEFT JOIN g USING (word)")
def vocab_gains(spark, d):
    """The entries of the vocabulary by count with their gain in bits, 0 for words without a price."""
    c = tx.word_counts(table(spark, d, "documents"))
    v = vocab.vocabulary(c).select("id", "word", "cnt")
    gain = F.coalesce("gain", F.lit(0.0))
    return priced(c).select("word", "gain").join(F.broadcast(v), "word", "right").select("id", "word", "cnt", F.round(gain, 3).alias("gain"), (gain > 0).alias("pays"))


@_query(_ALL + _GAIN + _SHIPPED + """, r AS (SELECT word, gain FROM g WHERE gain > 0.001 ORDER BY gain DESC, word LIMIT 255)
SELECT (SELECT count(*) FROM v) AS shipped, (SELECT count(*) FROM r) AS repriced, (SELECT count(*) FROM (SELECT word FROM v INTERSECT SELECT word FROM r)) AS overlap, (SELECT round(coalesce(sum(gain), 0), 1) FROM v JOIN g USING (word)) AS shipped_gain,
(SELECT round(coalesce(sum(gain), 0), 1) FROM r) AS repriced_gain, (SELECT count(*) FROM v JOIN g USING (word) WHERE gain <= 0) AS not_paying""")
def vocab_overlap(spark, d):
    """The vocabulary by count against that by gain: entries in both, summed gains, entries that don't pay."""
    c = tx.word_counts(table(spark, d, "documents"))
    g = priced(c).select("word", "gain")
    v = vocab.vocabulary(c).select("word")
    r = g.filter("gain > 0.001").orderBy(F.desc("gain"), "word").limit(255)
    common = v.intersect(r.select("word")).agg(F.count("*").alias("overlap"))
    total = lambda x, name: x.agg(F.round(F.coalesce(F.sum("gain"), F.lit(0.0)), 1).alias(f"{name}_gain"), F.count("*").alias(name), F.count_if(F.col("gain") <= 0).alias("not_paying"))
    s, p = total(g.join(F.broadcast(v), "word"), "shipped"), total(r, "repriced").drop("not_paying")
    one = F.lit(1)
    return common.withColumn("_k", one).join(s.withColumn("_k", one), "_k").join(p.withColumn("_k", one), "_k").drop("_k")


@_query(_T + """, k AS (SELECT corpus, method, tune, archive_bytes, log_pos, row_number() OVER (PARTITION BY corpus ORDER BY archive_bytes, log_pos) AS best, row_number() OVER (PARTITION BY corpus ORDER BY archive_bytes DESC, log_pos) AS worst FROM t)
SELECT corpus, 'best' AS side, best AS place, method, tune, archive_bytes, log_pos FROM k WHERE best <= 5 UNION ALL SELECT corpus, 'worst', worst, method, tune, archive_bytes, log_pos FROM k WHERE worst <= 5""")
def trial_extremes(spark, d):
    """A report of the five best and the five worst trials of every corpus."""
    from quernstone.operators.topn import top_n

    t = ex.trials(table(spark, d, "phase9_tune")).select("corpus", "method", "tune", "archive_bytes", "log_pos").withColumn("_down", -F.col("archive_bytes"))
    sides = [top_n(t, "corpus", [by, "log_pos"], 5).withColumn("side", F.lit(side)) for side, by in (("best", "archive_bytes"), ("worst", "_down"))]
    return sides[0].unionByName(sides[1]).select("corpus", "side", F.col("place").cast("bigint").alias("place"), "method", "tune", "archive_bytes", "log_pos")


@_query(_T + ", b AS (SELECT min(archive_bytes) AS a, arg_min(tune, (archive_bytes, tune)) AS tune FROM t), n AS (SELECT min(archive_bytes) AS a, arg_min(tune, (archive_bytes, tune)) AS tune FROM t WHERE method = '') SELECT 'all' AS scope, coalesce(a, 0) AS archive_bytes, coalesce(tune, 0) AS tune FROM b UNION ALL SELECT 'none', coalesce(a, 0), coalesce(tune, 0) FROM n")
def trial_global_best(spark, d):
    """The best trial of all, and of no trials: (0, 0)."""
    t = ex.trials(table(spark, d, "phase9_tune"))
    best = lambda x, scope: ex.global_best(x).select(F.lit(scope).alias("scope"), "archive_bytes", "tune")
    return best(t, "all").unionByName(best(t.filter("method = ''"), "none"))


@_query(_T + f"SELECT DISTINCT tune, {str(ex.MIXER_RATES)}[(tune & 15) + 1] AS mixer_rate, {[list(r) for r in ex.APM_RATES]}[(tune >> 4) + 1] AS apm FROM t".replace("SELECT DISTINCT", ", x AS (SELECT DISTINCT") + ") SELECT tune, mixer_rate, apm[1] AS apm1, apm[2] AS apm2, apm[3] AS apm3 FROM x")
def tune_rates(spark, d):
    """Learning rate and calibration rates of every tune that was tried, by a join with the tunes' dimension."""
    tunes = ex.trials(table(spark, d, "phase9_tune")).select("tune").distinct()
    return tunes.join(F.broadcast(ex.tune_dimension(spark)), "tune")


@_query("WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, j::INT AS j, greatest(least(round(x * 256), 32767), -32768)::INT AS q FROM e")
def quantized_weights(spark, d):
    """Weights as multiples of 1/256, halves away from zero, clamped to 16 bits."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "x"))
    return e.select("vec_id", "j", seqstats.quantize(F.col("x").cast("double")).alias("q"))


_CURVE = "s AS (SELECT d, CASE WHEN d > 2047 THEN 4095 WHEN d < -2047 THEN 0 ELSE (t[((d + 2176) >> 7)] * (128 - (d & 127)) + t[least(((d + 2176) >> 7) + 1, 33)] * (d & 127) + 64) >> 7 END AS p FROM (SELECT range::INT AS d FROM range(-4095, 4096)), (SELECT " + str(seqstats.SQUASH) + " AS t)), st AS (SELECT q.range::INT AS p, coalesce(min(s.d), 2047)::INT AS d FROM range(4096) q LEFT JOIN s ON s.p >= q.range AND s.d BETWEEN -2047 AND 2047 GROUP BY 1)"
_SQL["stretch_table"] = f"WITH {_CURVE} SELECT p, d AS logit FROM st"


@_query(f"WITH {_CURVE}, g AS (SELECT st.p, st.d, c.range::INT * 128 AS corr FROM st, range(-8, 9) c WHERE st.p % 16 = 0) SELECT g.p, g.corr, s.p AS corrected FROM g JOIN s ON s.d = g.d + g.corr")
def logit_correction(spark, d):
    """Probabilities after a correction of their logits."""
    p = seqstats.stretch_table(spark).filter("p % 16 = 0").withColumn("corr", F.explode(F.array(*[F.lit(128 * k) for k in range(-8, 9)])))
    return p.select("p", "corr", seqstats.squash(F.col("logit") + F.col("corr")).alias("corrected"))


@_query("""WITH pin AS (SELECT corpus, arg_min(input_sha256, log_pos) AS pinned FROM phase9_tune WHERE corpus IS NOT NULL AND input_sha256 != '' AND regexp_full_match(input_sha256, '[0-9a-f]{64}') GROUP BY corpus HAVING count(*) >= 3)
SELECT log_pos, CASE WHEN p.pinned IS NOT NULL THEN coalesce(lower(trim(input_sha256)) = p.pinned, false) END AS verified FROM tune53 t LEFT JOIN pin p ON p.corpus = t.corpus""")
def pinned_inputs(spark, d):
    """Whether each gate's input has the digest pinned for its corpus: that of the first of at least three
    trials on it; null for corpora without one."""
    t = table(spark, d, "phase9_tune").filter("corpus IS NOT NULL").filter(F.col("input_sha256").rlike("^[0-9a-f]{64}$"))
    pin = t.groupBy("corpus").agg(F.min_by("input_sha256", "log_pos").alias("pinned"), F.count("*").alias("n")).filter("n >= 3")
    g = table(spark, d, "tune53").select("log_pos", "corpus", "input_sha256")
    same = F.coalesce(F.lower(F.trim("input_sha256")) == F.col("pinned"), F.lit(False))
    return g.join(pin, "corpus", "left").select("log_pos", F.when(F.col("pinned").isNotNull(), same).alias("verified"))


@_query("""WITH r AS (SELECT log_pos, TRY_CAST(peak_rss_bytes AS BIGINT) AS b, TRY_CAST(wall_seconds AS DOUBLE) AS w FROM phase6_receipts WHERE regexp_full_match(peak_rss_bytes, '[0-9]+'))
SELECT log_pos, CASE WHEN 8589934592 - b >= 536870912 THEN 'continue' WHEN coalesce(w, 0) >= 600 THEN 'abort' ELSE 'sleep' END AS action FROM r WHERE b IS NOT NULL""")
def runtime_floor(spark, d):
    """What a run does that leaves so much of 8 GiB: goes on above the floor of 512 MiB, else waits, or
    gives up once it has waited 600 seconds."""
    r = table(spark, d, "phase6_receipts").select("log_pos", digits(F.col("peak_rss_bytes")).alias("b"), F.col("wall_seconds").try_cast("double").alias("w")).filter("b IS NOT NULL")
    return r.select("log_pos", ex.floor_action(F.lit(8 << 30) - F.col("b"), F.lit(512 << 20), F.coalesce("w", F.lit(0.0))).alias("action"))


_A = "WITH a AS (SELECT log_pos, TRY_CAST(archive_bytes AS BIGINT) AS a, TRY_CAST(wall_seconds AS DOUBLE) AS w, TRY_CAST(split_part(id, '/', 3) AS BIGINT) AS n FROM phase6_receipts WHERE regexp_full_match(archive_bytes, '[0-9]+')) "


@_query(_A + """SELECT log_pos, a + 125056 AS self_extracting, a + 375168 AS separate, a + 250112 AS shared, round(1e9 / (a + 125056), 4) AS ratio, round(8.0 * (a + 125056) / 1e9, 4) AS bits_per_byte, CASE WHEN a >= 1073741824 THEN printf('%.2f GB', a / 1073741824.0) WHEN a >= 1048576 THEN printf('%.1f MB', a / 1048576.0) WHEN a >= 1024 THEN printf('%.1f KB', a / 1024.0) ELSE a || ' B' END AS size,
CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(((s % 3600) // 60)::VARCHAR, 2, '0') || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' WHEN s >= 60 THEN (s // 60) || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS clock FROM (SELECT *, floor(greatest(coalesce(w, 0), 0))::BIGINT AS s FROM a WHERE a IS NOT NULL)""")
def ratio_report(spark, d):
    """The report line of every gate: totals in the three forms, ratio and bits per byte of the canonical
    10^9 bytes, and sizes and times as people read them."""
    a, program = F.col("a"), 125_056
    r = table(spark, d, "phase6_receipts").select("log_pos", digits(F.col("archive_bytes")).alias("a"), F.col("wall_seconds").try_cast("double").alias("w")).filter("a IS NOT NULL")
    return r.select(
        "log_pos", *[F.try_add(a, F.lit(k * program)).alias(c) for k, c in ((1, "self_extracting"), (3, "separate"), (2, "shared"))], F.round(F.lit(1e9) / (a.cast("double") + program), 4).alias("ratio"),
        F.round(F.lit(8.0) * (a.cast("double") + program) / 1e9, 4).alias("bits_per_byte"), ex.human_bytes(a).alias("size"), ex.clock(F.col("w")).alias("clock"),
    )


_U, _M = "18446744073709551616::UHUGEINT", "{}::UHUGEINT"
_MIX = "list_reduce(list_prepend({}::UHUGEINT, b), lambda h, x: {})"
_FNV = _MIX.format(0xCBF29CE484222325, f"(xor(h, x) * {0x100000001B3}::UHUGEINT) % {_U}")
_CTX = _MIX.format(hashing.GOLDEN, f"(xor(h, x) * {hashing.GOLDEN}::UHUGEINT) % {_U}")
_FOLD = _MIX.format(0, f"xor((h * {hashing.GOLDEN}::UHUGEINT) % {_U}, x | 256::UHUGEINT)")


def _split_mix(x: str) -> str:
    z = f"(({x} + {hashing.GOLDEN}::UHUGEINT) % {_U})"
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = f"((xor({z}, {z} >> {shift}) * {by}::UHUGEINT) % {_U})"
    return f"xor({z}, {z} >> 31)"


@_query(f"WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents), b AS (SELECT word, [('0x' || x)::INT::UHUGEINT for x in regexp_extract_all(hex(encode(word)), '..')] AS b FROM w), h AS (SELECT word, {_FNV} AS f, {_CTX} >> 32 AS c, {_FOLD} AS o FROM b) SELECT word, f::VARCHAR AS fnv1a, c::BIGINT AS context, o::VARCHAR AS fold, ({_split_mix('f')})::VARCHAR AS mixed FROM h")
def word_hashes(spark, d):
    """The hashes of every word: FNV-1a, the context hash, the running word hash, and splitmix64 of the first."""
    w = tx.words(table(spark, d, "documents")).select(F.lower("word").alias("word")).distinct().withColumn("b", F.encode("word", "UTF-8"))
    with hashing.wrapping(spark):
        h = w.select("word", hashing.fnv1a(F.col("word")).alias("f"), hashing.context_hash(F.col("b")).alias("context"), hashing.word_fold(F.col("b")).alias("o"))
        return h.select("word", hashing.unsigned_text(F.col("f")).alias("fnv1a"), "context", hashing.unsigned_text(F.col("o")).alias("fold"), hashing.unsigned_text(hashing.splitmix64(F.col("f"))).alias("mixed"))


def _signature_sql(words: str) -> str:
    """Places by eight minima of mixed hashes of each document's words; the largest value where it has none."""
    top = "18446744073709551615::UHUGEINT"
    mixed = ", ".join(f"min({_split_mix(f'xor(f, {i * hashing.GOLDEN & (1 << 64) - 1}::UHUGEINT)')}) AS s{i}" for i in range(8))
    order = ", ".join(f"coalesce(s{i}, {top})" for i in range(8))
    return f"""WITH w AS ({words}), u AS (SELECT word, {_FNV} AS f FROM (SELECT word, [('0x' || x)::INT::UHUGEINT for x in regexp_extract_all(hex(encode(word)), '..')] AS b FROM (SELECT DISTINCT word FROM w))),
m AS (SELECT doc_id, {mixed} FROM w JOIN u USING (word) GROUP BY doc_id) SELECT d.doc_id, row_number() OVER (ORDER BY {order}, d.doc_id) - 1 AS place FROM documents d LEFT JOIN m USING (doc_id) WHERE d.text IS NOT NULL"""


_SQL["minhash_order"] = _signature_sql("SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents WHERE text IS NOT NULL")
_SQL["boilerplate_order"] = _signature_sql(
    r"SELECT DISTINCT doc_id, lower(word) AS word FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '(?i)\{\{([^|}\n]+)|\[\[((?:category|file|image):[^|\]\n]*)', 1), regexp_extract_all(text, '(?i)\{\{([^|}\n]+)|\[\[((?:category|file|image):[^|\]\n]*)', 2))) AS word FROM documents WHERE text IS NOT NULL) WHERE word != ''"
)

_CLASSED = "len(list_filter(w, lambda x: NOT regexp_full_match(x, '[a-z]+'))) + len(regexp_extract_all(text, '[\\x00-\\x03]'))"
_STEMMED = "coalesce(list_sum([2 - length(CASE " + " ".join(f"WHEN length(x) >= {len(s) + 2} AND ends_with(x, '{s}') THEN '{s}'" for s in sorted(tx.SUFFIXES, key=lambda s: -len(s))) + " ELSE 'ab' END) for x in w]), 0) + len(regexp_extract_all(text, '[\\x00-\\x02]'))"


@_query(f"""WITH t AS (SELECT text, strlen(text) AS n, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT n, n - (coalesce(list_sum([strlen(x) - 1 for x in regexp_extract_all(text, '({_HOIST})', 1)]), 0) - len(regexp_extract_all(text, '[\\x00-\\x1F\\x7F]'))) AS hoist, n + 256 AS permute, n + {_CLASSED} AS cased, n + {_STEMMED} AS stem FROM t)
SELECT transform, sum(n)::BIGINT AS n_in, sum(n_out)::BIGINT AS n_out FROM (SELECT n, unnest(['hoist', 'permute', 'permute_random', 'case', 'case_mark', 'stem']) AS transform, unnest([hoist, permute, permute, cased, cased, stem]) AS n_out FROM s) GROUP BY transform""")
def transform_sizes(spark, d):
    """Bytes before and after the transforms of symbols and words, by coding every text."""
    names = ["hoist", "permute", "permute_random", "case", "case_mark", "stem"]
    r = per_text(table(spark, d, "documents"), lambda x: [(n, len(x), len(codecs.TRANSFORMS[n][0](x))) for n in names], "transform string, n_in bigint, n_out bigint")
    return r.groupBy("transform").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
