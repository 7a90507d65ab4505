"""Analysis of experiment receipts: trials, frontiers, axis effects, untried settings, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.hashing import splitmix64_int
from quernstone.functions.numbers import digits, name_key

#: Learning rates of the low half of a tune.
MIXER_RATES = [12, 4, 6, 8, 10, 16, 20, 24, 32, 40, 48, 64, 96, 128, 192, 256]
#: Adaptation rates of the experts of the accepted configuration.
ACCEPTED_RATES = [2, 2, 1, 2, 2, 2, 2, 3, 3, 3, 2, 3, 4, 5]
#: Calibration rates of the high half of a tune.
APM_RATES = [(7, 7, 7), (6, 6, 6), (5, 5, 5), (8, 8, 8), (6, 6, 5), (6, 5, 6), (5, 6, 6), (6, 6, 7), (6, 7, 6), (7, 6, 6), (5, 5, 6), (5, 6, 5), (6, 5, 5), (4, 5, 5), (5, 4, 5), (5, 5, 4)]
#: The largest table scale that the high half of a tune may ask for.
MAX_SCALE = 3


def trials(receipts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """method, corpus, corpus_sha, tune, archive_bytes, wall_ms, exact, log_pos of search receipts:
    those attributed to the search with a readable tune in 0..255 and size; others are dropped.
    wall_ms truncates and defaults to 0, exact to false."""
    r = receipts.filter("attribution = 'search/tune'").select(
        "method", "corpus", F.col("input_sha256").alias("corpus_sha"), digits(F.col("tune")).alias("tune"), digits(F.col("archive_bytes")).alias("archive_bytes"),
        F.floor(F.coalesce(F.col("wall_seconds").try_cast("double"), F.lit(0.0)) * 1000).cast("bigint").alias("wall_ms"), F.coalesce(F.col("exact") == "true", F.lit(False)).alias("exact"), "log_pos", *keep,
    )
    return r.filter("tune BETWEEN 0 AND 255 AND archive_bytes IS NOT NULL").withColumn("tune", F.col("tune").cast("int"))


def best_per_tune(t: DataFrame) -> DataFrame:
    """The smallest archive of each (method, corpus, tune); the first in the log wins ties."""
    best = t.groupBy("method", "corpus", "tune").agg(F.min(F.struct("archive_bytes", "log_pos")).alias("b"))
    return best.select("method", "corpus", "tune", "b.archive_bytes", "b.log_pos")


def frontier(t: DataFrame) -> DataFrame:
    """All tunes tied at the smallest archive of their (method, corpus)."""
    best = best_per_tune(t)
    least = best.groupBy("method", "corpus").agg(F.min("archive_bytes").alias("least"))
    return best.join(least, ["method", "corpus"]).filter("archive_bytes = least").select("method", "corpus", "tune", "archive_bytes")


def levels(t: DataFrame) -> DataFrame:
    """method, axis, level, n, total: trials and bytes of each level of both halves of the tune,
    over all trials; levels without trials have n 0."""
    half = F.explode(F.array(F.struct(F.lit("lr").alias("axis"), F.col("tune").bitwiseAND(15).alias("level")), F.struct(F.lit("scale").alias("axis"), F.shiftright("tune", 4).alias("level"))))
    got = t.select("method", "archive_bytes", half.alias("h")).groupBy("method", "h.axis", "h.level").agg(F.count("*").alias("n"), F.try_sum("archive_bytes").alias("total"))
    every = t.select("method").distinct().select("method", F.explode(F.array(F.lit("lr"), F.lit("scale"))).alias("axis")).select("method", "axis", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("level"))
    return every.join(got, ["method", "axis", "level"], "left").select("method", "axis", "level", F.coalesce("n", F.lit(0)).alias("n"), "total")


def observe(t: DataFrame) -> DataFrame:
    """Per method: the best level of each axis by mean (lowest on ties), the spread of the means
    (0 below two levels), the best trial, and whether the best levels make up the best tune."""
    m = levels(t).filter("n > 0").withColumn("mean", F.col("total") / F.col("n"))
    per = m.groupBy("method", "axis").agg(F.min_by("level", F.struct("mean", "level")).alias("best"), F.round(F.max("mean") - F.min("mean"), 3).alias("spread"))
    wide = per.groupBy("method").agg(*[F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{a}_{c}") for a in ("lr", "scale") for c in ("best", "spread")])
    top = t.groupBy("method").agg(F.min(F.struct("archive_bytes", "tune")).alias("b")).select("method", F.col("b.archive_bytes").alias("best_bytes"), F.col("b.tune").alias("best_tune"))
    return wide.join(top, "method").withColumn("consistent", F.col("scale_best") * 16 + F.col("lr_best") == F.col("best_tune"))


def untried(t: DataFrame, plan: list[int]) -> DataFrame:
    """Settings of `plan` (at most 256) not yet tried for a (method, corpus_sha)."""
    pairs = t.select("method", "corpus_sha").distinct()
    wanted = pairs.select("method", "corpus_sha", F.explode(F.array(*[F.lit(x) for x in plan])).alias("tune"))
    return wanted.join(t.select("method", "corpus_sha", "tune").distinct(), ["method", "corpus_sha", "tune"], "left_anti")


def against_parent(gates: DataFrame) -> DataFrame:
    """Gates with their archive change against the parent, and a decision by its sign."""
    g = gates.select("log_pos", "id", digits(F.col("archive_bytes")).alias("bytes"), digits(F.col("parent_archive_bytes")).alias("parent_bytes")).filter("bytes IS NOT NULL AND parent_bytes IS NOT NULL")
    delta = F.col("bytes") - F.col("parent_bytes")
    return g.select("log_pos", "id", "bytes", "parent_bytes", delta.alias("delta"), F.when(delta < 0, "smaller").when(delta > 0, "larger").otherwise("equal").alias("change"))


def against_runs(t: DataFrame) -> DataFrame:
    """The smallest archive of each (method, parent, corpus, tune) against that of the parent method
    at the same corpus and tune, with the change in bytes and percent; runs without one are left out."""
    base = t.groupBy("method", "corpus", "tune").agg(F.min("archive_bytes").alias("parent_bytes")).filter("parent_bytes > 0").withColumnRenamed("method", "parent")
    own = t.withColumn("parent", name_key(F.col("parent"))).filter("parent IS NOT NULL").groupBy("method", "parent", "corpus", "tune").agg(F.min("archive_bytes").alias("bytes"))
    delta = F.col("bytes") - F.col("parent_bytes")
    j = own.join(base, ["parent", "corpus", "tune"])
    return j.select("method", "parent", "corpus", "tune", "bytes", "parent_bytes", delta.alias("delta"), F.round(F.lit(100.0) * delta / F.col("parent_bytes"), 4).alias("percent"), F.when(delta < 0, "smaller").when(delta > 0, "larger").otherwise("equal").alias("change"))


def global_best(t: DataFrame) -> DataFrame:
    """One row: the smallest archive and its tune (the smallest on ties); (0, 0) without trials."""
    b = t.agg(F.min(F.struct("archive_bytes", "tune")).alias("b"))
    return b.select(F.coalesce("b.archive_bytes", F.lit(0).cast("bigint")).alias("archive_bytes"), F.coalesce("b.tune", F.lit(0)).alias("tune"))


def tune_dimension(spark: SparkSession) -> DataFrame:
    """All 256 tunes with their learning rate and calibration rates."""
    return spark.createDataFrame([(t, MIXER_RATES[t & 15], *APM_RATES[t >> 4]) for t in range(256)], "tune int, mixer_rate int, apm1 int, apm2 int, apm3 int")


def floor_action(available: Column, floor: Column, waited: Column, patience: float = 600.0) -> Column:
    """continue while there is enough, else sleep, or abort once the patience is used up."""
    return F.when(available >= floor, "continue").when(waited >= patience, "abort").otherwise("sleep")


def tune_parts(tune: Column) -> list[Column]:
    """Learning rate, table scale, and the neighbours of a tune along its low half (wrapping)."""
    rates = F.array(*[F.lit(x) for x in MIXER_RATES])
    low, high = tune.bitwiseAND(15), F.shiftright(tune, 4)
    move = lambda d: (high * 16 + F.pmod(low + d, F.lit(16))).cast("int")
    return [F.get(rates, low).alias("mixer_rate"), F.least(high, F.lit(MAX_SCALE)).alias("scale"), move(-1).alias("lower"), move(1).alias("upper")]


def improvements(t: DataFrame, width: int = 65_536) -> DataFrame:
    """Trials with `better`: whether they beat all before them in the log with their method and corpus.
    Running minima within blocks of `width` log positions, and over the blocks, so that a corpus of
    any size is spread."""
    most = F.lit((1 << 63) - 1)
    b = t.withColumn("_block", F.floor(F.col("log_pos") / width))
    least = b.groupBy("method", "corpus", "_block").agg(F.min("archive_bytes").alias("_least"))
    before = Window.partitionBy("method", "corpus").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = least.select(F.col("method").alias("_m"), F.col("corpus").alias("_c"), F.col("_block").alias("_b"), F.coalesce(F.min("_least").over(before), most).alias("_carry"))
    within = Window.partitionBy("method", "corpus", "_block").orderBy("log_pos").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_own", F.coalesce(F.min("archive_bytes").over(within), most))
    j = b.join(carry, F.col("method").eqNullSafe(F.col("_m")) & F.col("corpus").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    return j.select(*t.columns, (F.col("archive_bytes") < F.least("_own", "_carry")).alias("better"))


def upper_median(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """The element at n div 2 of the sorted values of each group: equal values are counted first, so
    windows run over distinct ones."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    ranked = counts.withColumns({"_upto": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    return ranked.filter("_upto > _n div 2 AND _upto - _c <= _n div 2").select(by, F.col(value).alias(out))


def size_literal(c: Column) -> Column:
    """Bytes of a size literal: digits with K, M, G (with or without iB); null if it isn't one or
    exceeds 64 bits with sign."""
    part = lambda k: F.regexp_extract(c, r"^\s*([0-9]+)\s*([KMG]?)(iB)?\s*$", k)
    unit = F.when(part(2) == "K", 1 << 10).when(part(2) == "M", 1 << 20).when(part(2) == "G", 1 << 30).otherwise(1)
    return (part(1).try_cast("decimal(27,0)") * unit.cast("decimal(10,0)")).try_cast("bigint")


def human_bytes(b: Column) -> Column:
    """Bytes in the largest fitting unit, halves rounded to even."""
    out = F.concat(b.cast("string"), F.lit(" B"))
    for unit, size, places in (("KB", 1 << 10, 1), ("MB", 1 << 20, 1), ("GB", 1 << 30, 2)):
        out = F.when(b >= size, F.format_string(f"%.{places}f {unit}", F.bround(b / F.lit(float(size)), places))).otherwise(out)
    return out


def clock(seconds: Column) -> Column:
    """Whole seconds as s, m and s, or h, m and s; none, negative and unreadable ones as 0s."""
    s = F.floor(F.greatest(F.coalesce(F.when(~F.isnan(seconds), seconds), F.lit(0.0)), F.lit(0.0)))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s >= 3600, F.concat(h.cast("string"), F.lit("h"), two(m), F.lit("m"), two(r), F.lit("s"))).when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m"), two(r), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def mutate(tune: int, seed: int, axes: int = 1) -> tuple[int, int]:
    """A seeded step along one half of a tune (the low one, with two axes either), by 1, 1, 2 or 4
    levels, wrapping at 16; and the next seed."""
    s = splitmix64_int(seed)
    shift = 4 * ((s >> 32) % axes)
    by = (1, 1, 2, 4)[s >> 24 & 3] * (-1 if s & 1 else 1)
    level = ((tune >> shift & 15) + by) % 16
    return tune & ~(15 << shift) & 255 | level << shift, s


def schedule(kind: str, tried: set[int], *, best: int = 0, seed: int = 1, budget: int = 16) -> list[int]:
    """The next settings to try: `full` all 256, `coord` the 16 levels of the low half, `fuzz` a
    seeded walk, `guided` steps from the best one; those already tried are left out."""
    if kind in ("full", "coord"):
        plan = list(range(256 if kind == "full" else 16))
    else:
        plan, now = [], best
        for _ in range(8 * budget):
            now, seed = mutate(now if kind == "fuzz" else best, seed)
            if now not in plan:
                plan.append(now)
            if len(plan) == budget:
                break
    return [t for t in plan if t not in tried]
