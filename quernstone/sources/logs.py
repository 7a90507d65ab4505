"""Receipt logs: files of JSON lines, with named fields and any extras, all values text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The named fields of a receipt, in order.
FIELDS = [
    "id", "hypothesis", "parent", "revision", "compiler", "corpus", "input_sha256", "archive_sha256", "decoded_sha256", "exact", "compressor_bytes", "archive_bytes", "score_total", "wall_seconds", "cpu_seconds", "peak_rss_bytes", "temp_disk_bytes", "environment", "attribution", "decision", "notes",
]


def lines(receipts: DataFrame, extras: Column | None = None) -> DataFrame:
    """One JSON object per receipt as `value`: the named fields in order, nulls as empty text, then
    the extras (a map) by name without those that have a named field's name. score_total is the sum
    of compressor_bytes and archive_bytes where both are numbers, else as given."""
    whole = lambda c: F.col(c).try_cast("bigint").cast("decimal(20,0)")
    total = whole("compressor_bytes") + whole("archive_bytes")
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS}
    named["score_total"] = F.coalesce(total.cast("string"), named["score_total"])
    own = F.create_map(*[x for c, v in named.items() for x in (F.lit(c), v)])
    if extras is not None:
        sorted_ = F.array_sort(F.map_entries(F.map_filter(F.coalesce(extras, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(FIELDS))))
        own = F.map_from_entries(F.concat(F.map_entries(own), F.transform(sorted_, lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("")).alias("value")))))
    return receipts.select(F.to_json(own).alias("value"))


def append(receipts: DataFrame, path: str, extras: Column | None = None) -> None:
    """Append the receipts to the log at `path`; other writers' lines stay."""
    lines(receipts, extras).write.mode("append").text(path)


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """The lines of all logs as `value`; a path that doesn't exist is an empty log."""
    conf, there = spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        there += [p] if found else []
    return spark.read.text(there) if there else spark.createDataFrame([], "value string")


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """The receipts of all logs: the named fields as text (null where a line lacks one) and the other
    fields as a map `extras`. Lines that hold no JSON object are left out."""
    fields = F.from_json("value", "map<string,string>")
    rows = scan(spark, *paths).filter(F.col("value").rlike(r"^\s*\{")).select(fields.alias("f")).filter("f IS NOT NULL")
    return rows.select(*[F.element_at("f", c).alias(c) for c in FIELDS], F.map_filter("f", lambda k, _: ~k.isin(FIELDS)).alias("extras"))


def containing(scanned: DataFrame, text: str) -> DataFrame:
    return scanned.filter(F.col("value").contains(text))
