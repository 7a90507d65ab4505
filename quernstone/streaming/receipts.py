"""Structured Streaming: receipt logs with replay and dedup, windows over events, keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.operators import experiments
from quernstone.session import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and read what it wrote. Complete and update results
    are the last one of each batch, upserted by the batch's writer."""
    spark = stream.sparkSession
    out, log = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and type; windows are final once the watermark has passed them."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))


def first_receipts(receipts: DataFrame, within: str | None = None) -> DataFrame:
    """The first receipt of each (id, archive_sha256) of an append-only log; replays drop out. A replay may
    come at any time, so the state keeps one key per distinct receipt, and grows with them alone;
    with `within`, keys are forgotten once the watermark has passed them by so much."""
    if within is None:
        return receipts.dropDuplicates(["id", "archive_sha256"])
    r = receipts.withColumn("arrived_at", F.col("arrived_at").cast("timestamp")).withWatermark("arrived_at", within)
    return r.dropDuplicatesWithinWatermark(["id", "archive_sha256"])


def best_per_method(receipts: DataFrame) -> DataFrame:
    """The smallest archive of each method so far, with keyed state; a row whenever it improves."""
    trials = experiments.trials(receipts).select("method", "archive_bytes")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        best = min([int(b["archive_bytes"].min()) for b in batches] + ([before] if before is not None else []))
        if before is None or best < before:
            state.update((best,))
            yield pd.DataFrame({"method": [key[0]], "best": [best]})

    return trials.groupBy("method").applyInPandasWithState(update, "method string, best bigint", "best bigint", "update", GroupStateTimeout.NoTimeout)
