"""Pages of a dump: metadata, orders, restoration, similarity signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import hashing
from quernstone.session import TASK_ROWS, stage

#: Namespaces of titles, in rank order; articles rank 0.
NAMESPACES = ["Template", "Category", "Wikipedia", "Image", "User", "Help", "Portal", "MediaWiki", "Talk", "Media", "Special"]


def names(text: Column, pattern: str) -> Column:
    """Sorted distinct lower-case names that a pattern's group 1 finds."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower)))


CATEGORY = r"(?i)\[\[category:([^|\]\n]*)"
TEMPLATE = r"\{\{([^|}\n]*)"


def pages(documents: DataFrame) -> DataFrame:
    """pos, page_id, title, categories, templates, first_category, first_template, n_bytes, text of every
    text with a page wrapper; pos is the document id."""
    p = documents.filter(F.col("text").contains("<page>")).select(F.col("doc_id").alias("pos"), "text")
    return p.select(
        "pos",
        F.regexp_extract("text", "<id>([0-9]+)</id>", 1).try_cast("bigint").alias("page_id"),
        F.regexp_extract("text", "<title>([^<]*)</title>", 1).alias("title"),
        names(F.col("text"), CATEGORY).alias("categories"),
        names(F.col("text"), TEMPLATE).alias("templates"),
        F.lower(F.regexp_extract("text", CATEGORY, 1)).alias("first_category"),
        F.lower(F.regexp_extract("text", TEMPLATE, 1)).alias("first_template"),
        F.octet_length("text").alias("n_bytes"),
        "text",
    )


def namespace(title: Column) -> Column:
    prefix = F.lower(F.substring_index(title, ":", 1))
    rank = F.lit(0)
    for k, n in reversed(list(enumerate(NAMESPACES, 1))):
        rank = F.when(title.contains(":") & (prefix == n.lower()), k).otherwise(rank)
    return rank


def order_keys(order: str) -> list[Column]:
    """Sort keys of a page order; every one ends in pos, so it is total."""
    c, sets = F.col, lambda x: F.array_join(x, "\0")
    keys = {
        "identity": [],
        "title": [c("title")],
        "size": [c("n_bytes"), c("page_id")],
        "namespace": [namespace(c("title")), c("title")],
        "category": [c("first_category"), c("title")],
        "template": [c("first_template"), c("title")],
        "category_set": [sets("categories"), c("title")],
        "full": [sets("categories"), sets("templates"), c("title")],
        "full_novelty": [sets("categories"), sets("templates"), c("novelty"), c("title")],
        "shuffle": [F.sha2(c("pos").cast("string"), 256)],
    }
    return [*keys[order], c("pos")]


def ordered(pages_: DataFrame, order: str) -> DataFrame:
    """pos and place (from 0) of every page in an order. The sort is a range shuffle; places come
    from counts of its ranges, so that no task holds all pages."""
    keys = [k.alias(f"_k{i}") for i, k in enumerate(order_keys(order))]
    return rank_all(pages_.select("pos", *keys), [f"_k{i}" for i in range(len(keys))]).select("pos", "place")


def rank_all(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with `place`, their rank from 0 in a total order, by range partitions and prefix sums."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
    ranged = stage(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    rn = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return ranged.withColumn("_rn", rn).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_rn") - 1).drop("_part", "_rn", "_before")


def permutation_bytes(spark: SparkSession, n: int) -> int:
    """Bytes of an explicit permutation of n pages: ceil(sum of log2 i, / 8), summed in parallel."""
    bits = spark.range(2, max(2, n) + 1).agg(F.sum(F.log2(F.col("id").cast("double")))).first()[0] or 0.0
    return -int(-bits // 8)


def signatures(documents: DataFrame, k: int = 8) -> DataFrame:
    """doc_id and k unsigned 64-bit minima (as signed numbers with the top bit flipped, so that
    they sort as unsigned) over the text's lower-case ASCII words; all largest without words."""
    w = documents.filter("text IS NOT NULL").select("doc_id", F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)).alias("w"))
    return _signatures(w, k)


def _signatures(w: DataFrame, k: int) -> DataFrame:
    one = w.select("doc_id", F.explode_outer("w").alias("word"))
    with hashing.wrapping(w.sparkSession):
        hashed = one.select("doc_id", hashing.fnv1a(F.col("word")).alias("h"))
        mixed = [F.min(hashing.unsigned_order(hashing.splitmix64(F.col("h").bitwiseXOR(F.lit(hashing.wrap(i * hashing.GOLDEN)))))).alias(f"s{i}") for i in range(k)]
        sig = hashed.groupBy("doc_id").agg(*mixed)
    return sig.select("doc_id", F.array(*[F.coalesce(f"s{i}", F.lit((1 << 63) - 1)) for i in range(k)]).alias("sig"))


BOILERPLATE = r"(?i)\{\{([^|}\n]+)|\[\[((?:category|file|image):[^|\]\n]*)"


def boilerplate_signatures(documents: DataFrame, k: int = 8) -> DataFrame:
    """Signatures over the names of templates, categories, files and images instead of words."""
    hits = F.concat(F.regexp_extract_all("text", F.lit(BOILERPLATE), F.lit(1)), F.regexp_extract_all("text", F.lit(BOILERPLATE), F.lit(2)))
    named = documents.filter("text IS NOT NULL").select("doc_id", F.array_distinct(F.transform(F.filter(hits, lambda x: x != ""), lambda x: F.lower(x))).alias("w"))
    return _signatures(named, k)


def split_stream(documents: DataFrame) -> DataFrame:
    """doc_id, header, pages, tail of every text with pages, and whether they tile the text: what
    lies between two pages belongs to the second."""
    p = documents.filter(F.col("text").contains("<page>")).select("doc_id", "text")
    head = F.substring_index("text", "<page>", 1)
    inner = F.expr("substring(text, length(substring_index(text, '<page>', 1)) + 1)")
    s = p.withColumns({"header": head, "pages": F.regexp_extract_all(inner, F.lit(r"([\s\S]*?</page>)"), F.lit(1))})
    used = F.length("header") + F.aggregate("pages", F.lit(0), lambda a, x: a + F.length(x))
    s = s.withColumn("used", used).withColumn("tail", F.expr("substring(text, used + 1)"))
    whole = F.concat("header", F.array_join("pages", ""), "tail") == F.col("text")
    return s.select("doc_id", "header", "pages", "tail", (whole & (F.size("pages") > 0)).alias("tiles"))


def write_ordered(pages_: DataFrame, order: str, path: str) -> None:
    """Write pages with their places in an order, after checking that sorting by page id restores
    the original order; refuses if it doesn't."""
    restored = rank_all(pages_.select("pos", F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("k")), ["k", "pos"]).select("pos", F.col("place").alias("back"))
    original = rank_all(pages_.select("pos"), ["pos"]).select("pos", F.col("place").alias("was"))
    if not restored.join(original, "pos").filter("back != was").isEmpty():
        raise ValueError("page ids do not ascend: the order could not be undone")
    pages_.join(ordered(pages_, order), "pos").repartitionByRange("place").sortWithinPartitions("place").write.parquet(path)


def signature_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def greedy_walk(sigs: DataFrame, window: int = 64, block: int = 4096) -> DataFrame:
    """doc_id, place: a greedy nearest-neighbour walk over signature order, looking `window` ahead;
    the first minimum wins. Ranges of about `block` documents are walked independently."""
    ranked = rank_all(sigs.select("doc_id", "sig"), ["sig", "doc_id"]).withColumn("block", F.floor(F.col("place") / block))

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        sig = np.array(g["sig"].tolist(), np.int64).view(np.uint64).reshape(len(g), -1)
        left, out, now = list(range(len(g))), [], None
        while left:
            head = left[:window]
            pick = 0 if now is None else int(np.argmin(np.bitwise_count(sig[head] ^ sig[now]).sum(axis=1)))
            now = left.pop(pick)
            out.append(now)
        return pd.DataFrame({"doc_id": g["doc_id"].to_numpy()[out], "place": int(g["place"].iloc[0]) + np.arange(len(g))})

    kind = sigs.schema["doc_id"].dataType.simpleString()
    return ranked.groupBy("block").applyInPandas(walk, f"doc_id {kind}, place bigint")


def xorshift_shuffle(n: int, seed: int) -> Iterator[int]:
    """A deterministic Fisher-Yates order of range(n), the negative control of the orders."""
    p, s, mask = list(range(n)), seed | 1, (1 << 64) - 1
    for i in range(n - 1, 0, -1):
        s ^= s << 13 & mask
        s ^= s >> 7
        s ^= s << 17 & mask
        j = s % (i + 1)
        p[i], p[j] = p[j], p[i]
    yield from p
