"""The first N rows of every group, with a total order, however large the groups are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import HEAVY_SHARE, heavy_keys


def top_n(df: DataFrame, group: str, order: list[str], n: int, place: str = "place", *, heavy_share: float = HEAVY_SHARE, heavy_rows: int = 10_000, buckets: int = 32, task_rows: int = 100_000) -> DataFrame:
    """The first `n` rows of each value of `group` by the columns `order`, ascending, nulls last,
    with `place` counting from 1. For descending order pass negated columns.

    Exact counts split the groups. Light groups take an ordinary window. Each heavy group (more
    than `heavy_share` of all rows; at most 1 / share of them) is cut into ranges of the first
    order column at its quantiles; the exact count of each range tells which ranges can hold the
    first `n`, and only those are sorted: salted by hash into parts of about `task_rows` rows, the
    first `n` of each part, then the first `n` of these. No range is larger than its ties, and
    ties are spread by the salt.

    `order` should be total; rows equal in all its columns take either place. A null group is a
    group. Empty tables give no rows. Columns named like `place` are replaced.
    """
    order_by = [F.col(c).asc_nulls_last() for c in order]
    df = df.drop(place)

    def first(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order_by)
        return rows.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= n)

    heavy = heavy_keys(df.groupBy(group).agg(F.count("*").alias("_n")), "_n", heavy_share, heavy_rows).select(F.col(group).alias("_g"))
    if heavy.isEmpty():
        return first(df, group)
    heavy = F.broadcast(heavy)
    is_heavy = F.col(group).eqNullSafe(F.col("_g"))
    light = first(df.join(heavy, is_heavy, "left_anti"), group)
    hot, score = df.join(heavy, is_heavy, "left_semi"), F.col(order[0]).cast("double")
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = hot.groupBy(F.col(group).alias("_g")).agg(F.percentile_approx(score, cuts, 10_000).alias("_bounds"))
    bounds = df.sparkSession.createDataFrame(bounds.collect(), bounds.schema)  # one row per heavy group
    ranged = hot.join(F.broadcast(bounds), is_heavy).withColumn("_range", F.when(score.isNull(), buckets).otherwise(F.size(F.filter("_bounds", lambda b: b < score))))
    ranged = ranged.drop("_g", "_bounds")
    sizes = ranged.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_rows"))
    sizes = df.sparkSession.createDataFrame(sizes.collect(), sizes.schema)  # at most heavy groups x (buckets + 1)
    w = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    needed = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0))).filter(F.col("_before") < n)
    needed = needed.select("_g", "_r", F.ceil(F.col("_rows") / task_rows).alias("_parts"))
    salted = ranged.join(F.broadcast(needed), is_heavy & (F.col("_range") == F.col("_r")))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_parts")))
    hot = first(first(salted, group, "_range", "_salt").drop(place), group)
    return light.unionByName(hot.select(light.columns))
