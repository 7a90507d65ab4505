"""Vocabularies: admission, ranking, pair merges, savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import text as tx

#: Entries of the small vocabulary, whose ids fit one byte.
TOP = 255


def gain(cnt: Column, n: Column) -> Column:
    """Bytes saved by a one-byte id: every use but two bytes, minus the entry."""
    return cnt * (n - 2) - (n + 1)


def vocabulary(counts: DataFrame, word: str = "word", top: int = TOP) -> DataFrame:
    """id, word, cnt, gain: words of three letters or more that occur twice or more and save
    bytes, by count, ties by word. The cut is a top-k, so only its rows meet in one task."""
    n = F.length(word)
    ok = counts.withColumn("gain", gain(F.col("cnt"), n)).filter((n >= 3) & (F.col("cnt") >= 2) & (F.col("gain") > 0))
    best = ok.orderBy(F.desc("cnt"), word).limit(top)
    return best.select(F.row_number().over(Window.orderBy(F.desc("cnt"), word)).alias("id"), F.col(word).alias("word"), "cnt", "gain")


def reverse_ids(vocab: DataFrame) -> DataFrame:
    last = F.max("id").over(Window.partitionBy())  # a vocabulary has a bounded number of rows
    return vocab.withColumn("id", last + 1 - F.col("id"))


def front_coding(vocab: DataFrame) -> DataFrame:
    """word, shared, rest: the letters shared with the entry before it in word order."""
    before = F.coalesce(F.lag("word").over(Window.orderBy("word")), F.lit(""))
    v = vocab.select("word", before.alias("before"))
    same = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i) == F.substring("before", F.lit(1), i))
    return v.select("word", F.size(same).alias("shared")).withColumn("rest", F.expr("substring(word, shared + 1)"))


def first_use(documents: DataFrame, vocab: DataFrame) -> DataFrame:
    """For each entry the document and word position where it first occurs."""
    uses = tx.words(documents).join(F.broadcast(vocab.select("id", "word")), "word")
    return uses.groupBy("id", "word").agg(F.min(F.struct("doc_id", "pos")).alias("f")).select("id", "word", F.col("f.doc_id").alias("doc_id"), F.col("f.pos").alias("pos"))


def pair_counts(documents: DataFrame) -> DataFrame:
    """a, b, cnt: neighbouring characters of all texts."""
    c = tx.texts(documents).filter("length(text) > 1").select(F.split("text", "").alias("c"))
    pair = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(F.get("c", i).alias("a"), F.get("c", i + 1).alias("b")))
    return c.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("cnt"))


def type_pair_counts(counts: DataFrame) -> DataFrame:
    """a, b, cnt over distinct words weighted by their counts: one round of byte-pair merging."""
    c = counts.filter("length(word) > 1").select("cnt", F.split("word", "").alias("c"))
    pair = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(F.get("c", i).alias("a"), F.get("c", i + 1).alias("b")))
    return c.select("cnt", F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.sum("cnt").alias("cnt"))


def hoist_saving(text: Column) -> Column:
    """Bytes that the structural hoist saves: one byte for each fixed string, longest first, minus
    an escape for every reserved byte."""
    quoted = "|".join("\\Q" + s + "\\E" for s in sorted(tx.HOISTED, key=lambda s: (-len(s), s)))
    hits = F.regexp_extract_all(text, F.lit(f"({quoted})"), F.lit(1))
    saved = F.aggregate(hits, F.lit(0), lambda a, x: a + F.octet_length(x) - 1)
    return saved - F.regexp_count(text, F.lit(r"[\x00-\x1F\x7F]"))


def token_savings(documents: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per document the bytes saved when vocabulary words become two-byte references."""
    uses = tx.words(documents).join(F.broadcast(vocab.select("word")), "word")
    return uses.groupBy("doc_id").agg(F.count("*").alias("uses"), F.sum(F.length("word") - 2).alias("saved"))
