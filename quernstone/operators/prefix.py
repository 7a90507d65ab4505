"""Running totals along numbered rows, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import BROADCAST_ROWS

#: Numbers of a block.
WIDTH = 65_536


def running(df: DataFrame, pos: str, top: int, *, total: Column | None = None, last: Column | None = None, width: int = WIDTH, before: bool = False) -> DataFrame:
    """df with `total_`, the sum of `total` over rows with at most the row's number (with `before`,
    a smaller one), and `last_`, the latest value of `last` that isn't null among the same rows.

    pos: a column of whole numbers in 0..top, each on a bounded number of rows. Rows are windowed
    in blocks of `width` numbers, blocks again in blocks, so no window holds more than one block;
    the number of levels follows from `top`. Null totals count as 0; the first rows without
    anything before them get 0 and null. An empty table gives no rows.
    """
    total = F.lit(0) if total is None else total
    last = F.lit(None).cast("string") if last is None else last
    rows = df.withColumns({"_add": F.coalesce(total, F.lit(0)), "_new": last, "_block": F.floor(F.col(pos) / width)})
    w = Window.partitionBy("_block").orderBy(pos).rangeBetween(Window.unboundedPreceding, -1 if before else 0)
    rows = rows.withColumns({"total_": F.coalesce(F.sum("_add").over(w), F.lit(0)), "last_": F.last("_new", True).over(w)})
    blocks = top // width + 1
    if blocks > 1:
        sums = rows.groupBy("_block").agg(F.sum("_add").alias("_s"), F.max_by("_new", F.when(F.col("_new").isNotNull(), F.col(pos))).alias("_l"))
        sums = running(sums.withColumnRenamed("_block", "_of"), "_of", blocks - 1, total=F.col("_s"), last=F.col("_l"), width=width, before=True)
        sums = sums.select(F.col("_of").alias("_block"), F.col("total_").alias("_t0"), F.col("last_").alias("_l0"))
        rows = rows.join(F.broadcast(sums) if blocks <= BROADCAST_ROWS else sums, "_block")
        rows = rows.withColumns({"total_": F.col("total_") + F.col("_t0"), "last_": F.coalesce("last_", "_l0")})
    return rows.select(*df.columns, "total_", "last_")
