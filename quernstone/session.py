"""Session helpers: staging of intermediate tables, size-checked broadcasts, heavy keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side with narrow rows is broadcast; beyond it the operators shuffle.
BROADCAST_ROWS = 200_000
#: A key is heavy when it holds more than this share of all rows: at most 1 / share keys are.
HEAVY_SHARE = 1 / 500
#: Rows that one task should at most hold of one key or range.
TASK_ROWS = 1_000_000

_local_dirs: list[str] = []
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the one named by spark.checkpoint.dir; a local one only where
    that is unset and the master is local."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dirs:
        _local_dirs.append(tempfile.mkdtemp(prefix="quernstone-"))
    return "file://" + _local_dirs[0]


def stage(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, and the
    data outlives any executor. Compressed file sizes say little about rows in memory, so the table
    carries a merge hint: it is broadcast only where a caller has checked its size and says so."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def stage_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """stage(df), and aggregates over its rows (0 where null) that the writing tasks take along."""
    seen = Observation()
    out = stage(df.observe(seen, F.count("*").alias("rows"), *[c.alias(k) for k, c in counts.items()]))
    got = seen.get
    return out, {k: got.get(k) or 0 for k in ("rows", *counts)}


def release(spark: SparkSession) -> None:
    """Delete the staged tables of this session; call it once results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for item in [x for x in _staged if x[0] is spark]:
        path = jvm.org.apache.hadoop.fs.Path(item[1])
        path.getFileSystem(conf).delete(path, True)
        _staged.remove(item)


@atexit.register
def _clean() -> None:
    for d in _local_dirs:
        shutil.rmtree(d, ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """df with at least as many partitions as cores, for work that takes long per row; tables of
    many partitions, as all large ones are, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `limit` rows, counting no further than that."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most `limit` rows."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def heavy_keys(counts: DataFrame, n: str = "n", share: float = HEAVY_SHARE, least: int = 10_000) -> DataFrame:
    """Of `counts` (key columns and the exact row count n), the keys with more than `share` of all
    rows and more than `least` rows: a local table of at most 1 / share rows. Nulls are keys too."""
    seen = Observation()
    top = counts.observe(seen, F.sum(n).alias("total")).orderBy(F.desc(n)).limit(int(1 / share) + 1).collect()
    total = (seen.get["total"] if top else 0) or 0
    rows = [r for r in top if r[n] > max(least, total * share)]
    return counts.sparkSession.createDataFrame(rows, counts.schema)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def per_text(documents: DataFrame, f: Callable[[bytes], list[tuple]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, *f(text)) of every non-null text, whole, through Arrow."""
    source = spread(documents.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text)))
    names = [key, *(x.split()[0] for x in schema.split(", "))]
    types = [None, *({"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in f(t.encode())]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field(0).type if t is None else t) for c, t in zip(cols, types, strict=True)], names=names)

    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, {schema}")
