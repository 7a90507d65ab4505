"""Statistics of symbol sequences: contexts, entropies, repeats, columns, adaptive folds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import text as tx
from quernstone.session import per_text, spread


def contexts(documents: DataFrame, order: int, gap: int = 0) -> DataFrame:
    """ctx, sym: each character with the `order` characters that end `gap` before it, shorter at
    the start of a text. Built on arrays of characters: no shuffle, no repeated substrings."""
    c = tx.texts(documents).filter("text != ''").select(F.split("text", "").alias("c"))
    before = lambda i: F.concat(*[F.coalesce(F.get("c", F.when(i - gap - k >= 0, i - gap - k)), F.lit("")) for k in range(order, 0, -1)]) if order else F.lit("")
    each = F.transform(F.sequence(F.lit(0), F.size("c") - 1), lambda i: F.struct(before(i).alias("ctx"), F.get("c", i).alias("sym")))
    return c.select(F.explode(each).alias("e")).select("e.ctx", "e.sym")


def context_counts(documents: DataFrame, order: int, gap: int = 0) -> DataFrame:
    return contexts(documents, order, gap).groupBy("ctx", "sym").agg(F.count("*").alias("n"))


def entropy(counts: DataFrame) -> DataFrame:
    """One row: contexts, pairs, total and ideal bits of the symbols given their contexts."""
    of = counts.groupBy("ctx").agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    bits = F.sum(F.col("t") * F.log2("t") - F.col("s"))
    return of.agg(F.count("*").alias("contexts"), F.sum("k").alias("pairs"), F.sum("t").alias("total"), F.round(bits, 2).alias("bits"))


def escapes(counts: DataFrame) -> DataFrame:
    """ctx, total, symbols, escape: of each context the probability of a new symbol by the number of
    distinct ones against all uses."""
    of = counts.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("symbols"))
    return of.withColumn("escape", F.col("symbols") / (F.col("symbols") + F.col("total")))


def _per_batch(documents: DataFrame, f: Callable[[list[str]], list[tuple]], schema: str) -> DataFrame:
    """Rows f(texts) of the texts of each Arrow batch, whole: what f has counted already is not shuffled."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(f(b["text"].tolist()), columns=names)

    return spread(tx.texts(documents).filter("text != ''").select("text")).mapInPandas(run, schema)


def indirect(documents: DataFrame, order: int = 2) -> DataFrame:
    """ctx, last, sym, n: how often a symbol follows when the context's two latest symbols were
    `last` (within a text). Each text is walked once, in place; only counts are shuffled."""

    def count(texts: list[str]) -> list[tuple]:
        n: Counter = Counter()
        for t in texts:
            last: dict[str, str] = {}
            for i in range(order, len(t)):
                ctx = t[i - order : i]
                before = last.get(ctx, "")
                n[ctx, before, t[i]] += 1
                last[ctx] = (before + t[i])[-2:]
        return [(*k, v) for k, v in n.items()]

    return _per_batch(documents, count, "ctx string, last string, sym string, n bigint").groupBy("ctx", "last", "sym").agg(F.sum("n").alias("n"))


def word_positions(documents: DataFrame) -> DataFrame:
    """doc_id, pos, word, before: words of letters and apostrophes in lower case, with the word
    before each."""
    t = tx.texts(documents).select("doc_id", F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z']+"), F.lit(0)), F.lower).alias("w"))
    each = F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("word"), F.coalesce(F.get("w", F.when(i > 0, i - 1)), F.lit("")).alias("before")))
    return t.select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.pos", "e.word", "e.before")


def novelty(documents: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, novelty: the number of distinct (context, symbol) events of each text."""
    c = tx.texts(documents).select("doc_id", F.split("text", "").alias("c"), "text")
    before = lambda i: F.concat(*[F.coalesce(F.get("c", F.when(i - k >= 0, i - k)), F.lit("")) for k in range(order, 0, -1)])
    each = F.transform(F.sequence(F.lit(0), F.size("c") - 1), lambda i: F.concat(before(i), F.lit("\t"), F.get("c", i)))
    return c.select("doc_id", F.when(F.col("text") == "", 0).otherwise(F.size(F.array_distinct(each))).alias("novelty"))


def repeats(documents: DataFrame, k: int = 8) -> DataFrame:
    """doc_id, pos, distance: positions whose `k` preceding characters occurred before in the same
    text, with the distance to the latest occurrence. Each text is walked once, in place: no shuffle."""
    return per_text(tx.texts(documents), lambda data: _repeats(data.decode(), k), "pos int, distance int")


def _repeats(t: str, k: int) -> list[tuple[int, int]]:
    seen, out = {}, []
    for i in range(k, len(t) + 1):
        ctx = t[i - k : i]
        if ctx in seen:
            out.append((i, i - seen[ctx]))
        seen[ctx] = i
    return out


def repeat_summary(documents: DataFrame, k: int = 8) -> DataFrame:
    """doc_id, repeats, total_distance, nearest of the texts that have repeats."""

    def run(data: bytes) -> list[tuple]:
        d = [x for _, x in _repeats(data.decode(), k)]
        return [(len(d), sum(d), min(d))] if d else []

    return per_text(tx.texts(documents), run, "repeats bigint, total_distance bigint, nearest int")


def column_agreement(documents: DataFrame) -> DataFrame:
    """col, n, with_above, agreeing: characters by column, those with a character at the same column of
    the line before, and those that equal it. Lines are compared in place; only counts are shuffled."""

    def count(texts: list[str]) -> list[tuple]:
        n, above, same = (np.zeros(64, np.int64) for _ in range(3))
        for t in texts:
            before = np.zeros(0, np.uint32)
            for line in t.split("\n"):
                now = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
                if len(now) > len(n):
                    n, above, same = (np.pad(x, (0, 2 * len(now) - len(x))) for x in (n, above, same))
                m = min(len(now), len(before))
                n[: len(now)] += 1
                above[:m] += 1
                same[:m] += now[:m] == before[:m]
                before = now
        return [(c, int(n[c]), int(above[c]), int(same[c])) for c in np.flatnonzero(n)]

    r = _per_batch(documents, count, "col int, n bigint, with_above bigint, agreeing bigint")
    return r.groupBy("col").agg(*[F.sum(c).alias(c) for c in ("n", "with_above", "agreeing")])


def normalized_frequencies(counts: DataFrame, symbol: str, bits: int = 12) -> DataFrame:
    """symbol, cnt, freq, cum: counts scaled to a sum of 2^bits, each present symbol at least 1,
    the residue to the largest frequency (the last one on ties). For alphabets of bounded size."""
    scale = 1 << bits
    every = Window.partitionBy()
    f = counts.withColumn("freq", F.greatest(F.floor(F.col("cnt") * scale / F.sum("cnt").over(every)), F.lit(1)).cast("int"))
    top = F.row_number().over(Window.orderBy(F.desc("freq"), F.desc(symbol))) == 1
    f = f.withColumn("freq", F.col("freq") + F.when(top, F.lit(scale) - F.sum("freq").over(every)).otherwise(0))
    before = Window.orderBy(symbol).rowsBetween(Window.unboundedPreceding, -1)
    return f.select(symbol, "cnt", F.col("freq").cast("int").alias("freq"), F.coalesce(F.sum("freq").over(before), F.lit(0)).cast("int").alias("cum"))


def adaptive_probability(bits: Column, rate: int, start: int = 32768) -> Column:
    """The 16-bit probability after an ordered array of bits: p += (target - p) >> rate, kept
    within [1, 65535]."""
    step = lambda p, b: F.least(F.greatest(p + F.shiftright(F.when(b == 1, 65535).otherwise(0) - p, rate), F.lit(1)), F.lit(65535))
    return F.aggregate(bits, F.lit(start), step)


def bit_history(bits: Column, top: int = 15) -> Column:
    """Saturating counts of zeros and ones."""
    ones = F.aggregate(bits, F.lit(0), lambda a, b: a + b)
    return F.struct(F.least(F.size(bits) - ones, F.lit(top)).alias("n0"), F.least(ones, F.lit(top)).alias("n1"))


#: The logistic curve at steps of 128.
SQUASH = [1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785, 3901, 3975, 4024, 4050, 4068, 4079, 4085, 4089, 4092, 4093, 4094]


def squash(d: Column) -> Column:
    """Logit in [-2047, 2047] to a 12-bit probability, by interpolation between the fixed points."""
    table = F.array(*[F.lit(x) for x in SQUASH])
    w, i = d.bitwiseAND(127), F.shiftright(d, 7) + 17
    inner = F.shiftright(F.get(table, i - 1) * (128 - w) + F.get(table, F.least(i, F.lit(32))) * w + 64, 7)
    return F.when(d > 2047, 4095).when(d < -2047, 0).otherwise(inner)


def stretch_table(spark) -> DataFrame:
    """p, logit for all 4096 probabilities: the smallest logit whose squash reaches p."""
    d = spark.range(-2047, 2048).select(F.col("id").cast("int").alias("d")).withColumn("p", squash(F.col("d")))
    p = spark.range(4096).select(F.col("id").cast("int").alias("p"))
    first = d.groupBy("p").agg(F.min("d").alias("d"))
    up = p.join(first, "p", "left").withColumn("logit", F.min("d").over(Window.orderBy("p").rowsBetween(0, Window.unboundedFollowing)))
    return up.select("p", F.coalesce("logit", F.lit(2047)).alias("logit"))


def mlp_forward(features: Column, w1: list[list[int]], b1: list[int], w2: list[int], b2: int) -> Column:
    """Integer network of one hidden layer: (z >> 8) clamped to +-127, the sum >> 8 to +-1024."""
    out = F.lit(b2)
    for row, bias, w in zip(w1, b1, w2, strict=True):
        z = F.aggregate(F.zip_with(features, F.array(*[F.lit(x) for x in row]), lambda a, b: a * b), F.lit(bias), lambda a, x: a + x)
        out = out + F.lit(w) * F.least(F.greatest(F.shiftright(z, 8), F.lit(-127)), F.lit(127))
    return F.least(F.greatest(F.shiftright(out, 8), F.lit(-1024)), F.lit(1024))


def quantize(x: Column, scale: int = 256, top: int = 32767) -> Column:
    """x as a whole multiple of 1 / scale, halves away from zero, clamped."""
    return F.greatest(F.least(F.round(x * scale), F.lit(float(top))), F.lit(-float(top) - 1)).cast("int")
