"""Arrow functions over the Python kernels, and their registration for SQL."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from quernstone.functions import codecs, markup, model
from quernstone.session import per_text  # noqa: F401

try:
    import zstandard
except ImportError:  # an optional baseline
    zstandard = None

BASELINES: dict[str, Callable[[bytes], bytes]] = {"zlib": lambda d: zlib.compress(d, 9), "bz2": lambda d: bz2.compress(d, 9), "lzma": lambda d: lzma.compress(d, preset=6)}
if zstandard:
    BASELINES["zstd"] = lambda d: zstandard.ZstdCompressor(level=19).compress(d)


def bytes_udf(f: Callable[[bytes], bytes | None]):
    """A kernel as a vectorized binary function; null in, null out."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda d: None if d is None else f(bytes(d)))

    return run


def segment_udtf() -> UserDefinedTableFunction:
    return F.udtf(markup.Segment, returnType="seq int, kind string, start int, len int")


def register(spark: SparkSession) -> list[str]:
    """Register `<transform>_encode`, `<transform>_decode`, `archive`, `unarchive` and the table
    function `segment`; returns the names."""
    names = []
    for name, (e, d) in codecs.TRANSFORMS.items():
        for side, f in (("encode", e), ("decode", d)):
            spark.udf.register(f"{name}_{side}", bytes_udf(f))
            names.append(f"{name}_{side}")
    spark.udf.register("archive", bytes_udf(model.archive))
    spark.udf.register("unarchive", bytes_udf(model.unarchive))
    spark.udtf.register("segment", segment_udtf())
    return [*names, "archive", "unarchive", "segment"]
