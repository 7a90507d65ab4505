"""Queries over experiment receipts: trials, frontiers, axes, comparisons, scores, logs, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.numbers import digits
from quernstone.operators import experiments as ex
from quernstone.operators import seqstats
from quernstone.plans import methods
from quernstone.sources.logs import FIELDS
from quernstone.sources.tables import table

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str | None, sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = (lambda spark, d: f(table(spark, d, name))) if name else f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


_T = """WITH r AS (SELECT method, corpus, input_sha256 AS corpus_sha, CASE WHEN regexp_full_match(tune, '[0-9]+') THEN TRY_CAST(tune AS BIGINT) END AS tune, CASE WHEN regexp_full_match(archive_bytes, '[0-9]+') THEN TRY_CAST(archive_bytes AS BIGINT) END AS archive_bytes,
floor(coalesce(TRY_CAST(wall_seconds AS DOUBLE), 0) * 1000)::BIGINT AS wall_ms, coalesce(exact = 'true', false) AS exact, log_pos FROM phase9_tune WHERE attribution = 'search/tune'),
t AS (SELECT * FROM r WHERE tune BETWEEN 0 AND 255 AND archive_bytes IS NOT NULL)
"""
_BEST = _T + """, b AS (SELECT method, corpus, tune, archive_bytes, log_pos FROM (SELECT *, row_number() OVER (PARTITION BY method, corpus, tune ORDER BY archive_bytes, log_pos) AS rn FROM t) WHERE rn = 1)
"""


@_query("phase9_tune", _T + "SELECT * FROM t")
def trials(t):
    return ex.trials(t)


@_query("phase9_tune", _BEST + "SELECT * FROM b")
def trial_best(t):
    return ex.best_per_tune(ex.trials(t))


@_query("phase9_tune", _BEST + "SELECT method, corpus, tune, archive_bytes FROM (SELECT *, rank() OVER (PARTITION BY method, corpus ORDER BY archive_bytes) AS k FROM b) WHERE k = 1 AND corpus IS NOT NULL")
def trial_frontier(t):
    return ex.frontier(ex.trials(t))


_LEVELS = _T + """, h AS (SELECT method, archive_bytes, 'lr' AS axis, tune & 15 AS level FROM t UNION ALL SELECT method, archive_bytes, 'scale', tune >> 4 FROM t),
g AS (SELECT method, axis, level, count(*) AS n, sum(archive_bytes)::BIGINT AS total FROM h GROUP BY ALL)
"""


@_query("phase9_tune", _LEVELS + "SELECT e.method, e.axis, e.level, coalesce(g.n, 0) AS n, g.total FROM (SELECT DISTINCT method, axis, range AS level FROM t, (VALUES ('lr'), ('scale')) x(axis), range(16)) e LEFT JOIN g USING (method, axis, level)")
def trial_levels(t):
    return ex.levels(ex.trials(t))


@_query("phase9_tune", _LEVELS + """, m AS (SELECT *, total / n AS mean FROM g), p AS (SELECT method, axis, arg_min(level, (mean, level)) AS best, round(max(mean) - min(mean), 3) AS spread FROM m GROUP BY method, axis),
o AS (SELECT method, min(archive_bytes) AS best_bytes, arg_min(tune, (archive_bytes, tune)) AS best_tune FROM t GROUP BY method)
SELECT o.method, l.best AS lr_best, l.spread AS lr_spread, s.best AS scale_best, s.spread AS scale_spread, o.best_bytes, o.best_tune, s.best * 16 + l.best = o.best_tune AS consistent FROM o JOIN p l ON l.method = o.method AND l.axis = 'lr' JOIN p s ON s.method = o.method AND s.axis = 'scale'""")
def trial_observe(t):
    return ex.observe(ex.trials(t))


@_query("phase9_tune", _T + "SELECT p.method, p.corpus_sha, p.tune FROM (SELECT DISTINCT method, corpus_sha, range AS tune FROM t, range(16)) p ANTI JOIN t USING (method, corpus_sha, tune)")
def trial_untried(t):
    return ex.untried(ex.trials(t), list(range(16)))


@_query("phase9_tune", _T + "SELECT DISTINCT method, corpus_sha, tune FROM t")
def trial_tried(t):
    return ex.trials(t).select("method", "corpus_sha", "tune").distinct()


@_query("phase9_tune", _T + "SELECT * FROM (SELECT method, tune, archive_bytes, log_pos FROM t ORDER BY archive_bytes, log_pos LIMIT 8)")
def trial_top8(t):
    """A report of the eight best trials."""
    return ex.trials(t).orderBy("archive_bytes", "log_pos").limit(8).select("method", "tune", "archive_bytes", "log_pos")


@_query("phase9_tune", _T + "SELECT DISTINCT tune, [12, 4, 6, 8, 10, 16, 20, 24, 32, 40, 48, 64, 96, 128, 192, 256][(tune & 15) + 1] AS mixer_rate, least(tune >> 4, 3) AS scale, (tune >> 4) * 16 + (tune + 15) % 16 AS lower, (tune >> 4) * 16 + (tune + 1) % 16 AS upper FROM t")
def tune_parts(t):
    return ex.trials(t).select("tune").distinct().select("tune", *ex.tune_parts(F.col("tune")))


@_query("phase9_tune", _T + "SELECT method, median AS wall_ms FROM (SELECT method, list_sort(list(wall_ms))[count(*) // 2 + 1] AS median FROM t GROUP BY method)")
def trial_wall_median(t):
    return ex.upper_median(ex.trials(t), "method", "wall_ms", "wall_ms")


@_query("phase9_tune", _T + ", o AS (SELECT method, tune, archive_bytes, archive_bytes < coalesce(min(archive_bytes) OVER (PARTITION BY method, corpus ORDER BY log_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9223372036854775807) AS better FROM t) SELECT method, count(*) AS n, count(*) FILTER (better) AS improvements FROM o GROUP BY method")
def trial_improvements(t):
    """Trials that improved on all before them with their method and corpus."""
    return ex.improvements(ex.trials(t)).groupBy("method").agg(F.count("*").alias("n"), F.count_if("better").alias("improvements"))


_DELTA = """WITH g AS (SELECT log_pos, id, TRY_CAST(archive_bytes AS BIGINT) AS bytes, TRY_CAST(parent_archive_bytes AS BIGINT) AS parent_bytes FROM tune53 WHERE regexp_full_match(archive_bytes, '[0-9]+') AND regexp_full_match(parent_archive_bytes, '[0-9]+') AND bytes IS NOT NULL AND parent_bytes IS NOT NULL)
"""


@_query("tune53", _DELTA + "SELECT *, bytes - parent_bytes AS delta, CASE WHEN bytes < parent_bytes THEN 'smaller' WHEN bytes > parent_bytes THEN 'larger' ELSE 'equal' END AS change FROM g")
def candidate_vs_parent(t):
    return ex.against_parent(t)


@_query("phase6_receipts", "SELECT log_pos, a AS self_extracting, a + 250112 AS separate, round(8.0 * a / n, 6) AS bits_per_byte FROM (SELECT log_pos, archive_bytes::BIGINT + 125056 AS a, split_part(id, '/', 3)::BIGINT AS n FROM phase6_receipts WHERE regexp_full_match(archive_bytes, '[0-9]+') AND regexp_full_match(split_part(id, '/', 3), '[0-9]+'))")
def score_forms(t):
    """Totals with the program once or with two further copies, and bits per input byte; the program
    has 125,056 bytes."""
    program = 125_056
    n = F.get(F.split("id", "/"), F.lit(2))
    r = t.select("log_pos", F.try_add(digits(F.col("archive_bytes")), F.lit(program)).alias("a"), digits(n).alias("n")).filter("a IS NOT NULL AND n IS NOT NULL")
    return r.select("log_pos", F.col("a").alias("self_extracting"), F.try_add(F.col("a"), F.lit(2 * program)).alias("separate"), F.round(F.lit(8.0) * F.col("a") / F.col("n"), 6).alias("bits_per_byte"))


_CONF = """WITH i AS (SELECT DISTINCT split_part(id, '/', 3)::BIGINT AS n FROM phase6_receipts WHERE regexp_full_match(split_part(id, '/', 3), '[0-9]+')),
b AS (SELECT n, CASE WHEN n <= 2000000 THEN 18 WHEN n <= 20000000 THEN 20 WHEN n <= 200000000 THEN 22 ELSE 24 END AS bits FROM i),
m AS (SELECT n, bits, (2 * ((1::BIGINT << least(bits, 20)) + 9 * (1::BIGINT << bits) + 2 * (1::BIGINT << least(bits, 22))) + 4 * (1::BIGINT << bits) + 132 * (4096 + 65536))::BIGINT AS model FROM b)
"""


@_query("phase6_receipts", _CONF + "SELECT n, bits, model AS model_bytes, 2 * n + n // 3 + 1048576 + model AS encode_bytes, 3 * n + model AS decode_bytes, 2 * n + n // 3 + 1048576 + model <= 8589934592 AS fits FROM m")
def memory_projection(t):
    """Projected memory of the base configuration by input size, and whether it fits 8 GiB."""
    sizes = t.select(digits(F.get(F.split("id", "/"), F.lit(2))).alias("n")).filter("n IS NOT NULL").distinct()
    return methods.projection(sizes)


@_query(None, "SELECT d AS logit, p FROM (SELECT range::INT AS d FROM range(-2100, 2101)) CROSS JOIN (SELECT " + str(seqstats.SQUASH) + " AS t), LATERAL (SELECT CASE WHEN d > 2047 THEN 4095 WHEN d < -2047 THEN 0 ELSE (t[((d + 2176) >> 7)] * (128 - (d & 127)) + t[least(((d + 2176) >> 7) + 1, 33)] * (d & 127) + 64) >> 7 END AS p)")
def squash_table(spark, d):
    x = spark.range(-2100, 2101).select(F.col("id").cast("int").alias("logit"))
    return x.withColumn("p", seqstats.squash(F.col("logit")))


@_query(None)
def stretch_table(spark, d):
    return seqstats.stretch_table(spark)


@_query("embeddings", """WITH f AS (SELECT vec_id, [greatest(least(floor(x * 64)::INT, 31), -32) for x in embedding[1:12]] AS f FROM embeddings),
w AS (SELECT vec_id, f, j FROM f, range(4) r(j)), z AS (SELECT vec_id, j, (list_sum([f[i] * (((j * 12 + i - 1) * 37) % 256 - 128) for i in range(1, 13)]) + j * 16 - 24)::INT AS z FROM w),
o AS (SELECT vec_id, sum((j * 91 - 130) * greatest(least(z >> 8, 127), -127))::INT + 5 AS o FROM z GROUP BY vec_id) SELECT vec_id, greatest(least(o >> 8, 1024), -1024) AS corr FROM o""")
def mlp_forward(t):
    """Twelve clamped features through a fixed integer network."""
    f = F.transform(F.slice("embedding", 1, 12), lambda x: F.greatest(F.least(F.floor(x * 64).cast("int"), F.lit(31)), F.lit(-32)))
    w1 = [[((j * 12 + i) * 37) % 256 - 128 for i in range(12)] for j in range(4)]
    return t.select("vec_id", seqstats.mlp_forward(f, w1, [j * 16 - 24 for j in range(4)], [j * 91 - 130 for j in range(4)], 5).alias("corr"))


_BITS = "SELECT user_id, list(CASE WHEN value > 50 THEN 1 ELSE 0 END ORDER BY ts, event_id) AS bits FROM events GROUP BY user_id"


@_query("events", f"WITH b AS ({_BITS}), p AS (SELECT user_id, len(bits) AS n, list_reduce(list_prepend(32768::BIGINT, [x::BIGINT for x in bits]), lambda p, x: least(greatest(p + ((x * 65535 - p) >> 4), 1), 65535)) AS p, least(len(bits) - list_sum(bits), 15) AS n0, least(list_sum(bits), 15) AS n1 FROM b) SELECT user_id, n, p::INT AS p, n0::INT AS n0, n1::INT AS n1 FROM p")
def adaptive_bits(t):
    """Adaptive probability and saturating history of each user's sequence of high and low values."""
    bit = F.when(F.col("value") > 50, 1).otherwise(0)
    seq = t.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", bit.alias("bit")))).alias("s")).select("user_id", F.transform("s", lambda x: x["bit"]).alias("bits"))
    h = seqstats.bit_history(F.col("bits"))
    return seq.select("user_id", F.size("bits").alias("n"), seqstats.adaptive_probability(F.col("bits"), 4).alias("p"), h["n0"].alias("n0"), h["n1"].alias("n1"))


@_query("receipt_lines", """SELECT log_name, count(*) AS n, count(id) AS with_id, count(DISTINCT id) AS ids, count(*) FILTER (contains(line, 'second pass')) AS matching FROM (SELECT log_name, line, nullif(regexp_extract(line, '"id":"([^"]*)"', 1), '') AS id FROM receipt_lines) GROUP BY log_name""")
def log_scan(t):
    """Literal field extraction from raw lines, and lines that contain a text."""
    r = t.select("log_name", "line", F.nullif(F.regexp_extract("line", '"id":"([^"]*)"', 1), F.lit("")).alias("id"))
    return r.groupBy("log_name").agg(F.count("*").alias("n"), F.count("id").alias("with_id"), F.countDistinct("id").alias("ids"), F.count_if(F.col("line").contains("second pass")).alias("matching"))


_ESC = "replace(replace(replace(replace(replace(coalesce({0}, ''), '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_OUT = [c for c in FIELDS if c != "score_total"] + ["phase", "bits_per_byte", "parent_archive_bytes", "parent_exact"]


@_query("phase6_receipts", "SELECT log_pos, '{' || " + " || ',' || ".join(f"'\"{c}\":\"' || {_ESC.format(c)} || '\"'" for c in _OUT) + " || '}' AS line FROM phase6_receipts")
def receipt_lines_out(t):
    """Receipts as JSON lines with all values as text; nulls are empty."""
    return t.select("log_pos", F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in _OUT])).alias("line"))


@_query(None, "SELECT source, count(*) AS n FROM (SELECT 'phase9_tune' AS source FROM phase9_tune UNION ALL SELECT 'tune53' FROM tune53 UNION ALL SELECT 'phase6_receipts' FROM phase6_receipts) GROUP BY source")
def receipt_union(spark, d):
    """All receipts of the three logs in one table with missing columns as nulls."""
    parts = [table(spark, d, t).withColumn("source", F.lit(t)) for t in ("phase9_tune", "tune53", "phase6_receipts")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"))


@_query("events", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM s GROUP BY user_id""")
def session_counts(t):
    """Sessions of events less than 30 minutes apart, by user."""
    s = t.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@_query("events", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def hourly_windows(t):
    w = t.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "cents")


@_query(None, """WITH l AS (SELECT log_pos, field, s || u AS literal, s, u FROM (SELECT log_pos, unnest(['archive_bytes', 'peak_rss_bytes']) AS field, unnest([archive_bytes, peak_rss_bytes]) AS s FROM phase9_tune), (SELECT unnest(['', 'K', 'M', 'GiB']) AS u) WHERE s IS NOT NULL)
SELECT log_pos, field, literal, CASE WHEN regexp_full_match(s, '\\s*[0-9]+') THEN TRY_CAST(TRY_CAST(trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS HUGEINT) * CASE u WHEN '' THEN 1 WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 ELSE 1073741824 END AS BIGINT)
WHEN u = '' AND regexp_full_match(s, '\\s*[0-9]+\\s*') THEN TRY_CAST(trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS BIGINT) END AS bytes FROM l WHERE NOT regexp_full_match(s, '\\s*[0-9]+\\s+') OR u = ''""")
def size_literals(spark, d):
    """Sizes of the trials read as size literals, as they are and with units set behind them."""
    t = table(spark, d, "phase9_tune").select("log_pos", F.explode(F.create_map(F.lit("archive_bytes"), "archive_bytes", F.lit("peak_rss_bytes"), "peak_rss_bytes")).alias("field", "s")).filter("s IS NOT NULL")
    t = t.select("log_pos", "field", "s", F.explode(F.array(*[F.lit(u) for u in ("", "K", "M", "GiB")])).alias("u")).filter("u = '' OR s NOT RLIKE '^\\\\s*[0-9]+\\\\s+$'")
    literal = F.concat("s", "u")
    return t.select("log_pos", "field", literal.alias("literal"), ex.size_literal(literal).alias("bytes"))


@_query(None, None)
def method_registry(spark, d):
    return methods.registry(spark)


_SQL["method_registry"] = methods.REGISTRY_SQL


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
