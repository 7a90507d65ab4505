"""Filling containers of fixed capacity with items, by conflict-constrained best fit."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import bpe

#: Tokens of a container.
CAPACITY = 2_048
#: Items packed together in one task: the memory bound of a task, and large enough that the last,
#: partly filled containers of a shard don't count.
SHARD_ITEMS = 20_000


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, sources_apart: bool = False) -> list[list[tuple[int, int, int]]]:
    """For each item its pieces (bin, offset in the item, size); bins count from 0.

    Items are placed from large to small into the tightest bin that holds no item of their
    duplicate cluster and, with `sources_apart`, none of their source; without it, a bin without
    their source is preferred among those equally tight, which costs no space. Bins are kept by
    residual; a bit set of the residuals in use gives the next larger one, and the search goes on
    until a compatible bin is found, else a bin is opened. Each bin carries bitmaps of its sources
    and clusters. An item larger than the capacity fills
    bins of its own and only its rest is placed. A class of more members than the least number of
    bins can't be kept apart: it is dealt out over as few parts as that number allows, and a bin
    takes at most one member of each part, so that the members spread evenly. Null sources and
    clusters are no classes. Items of size 0 go to the fullest bin.
    """
    least = max(1, -(-sum((s - 1) % capacity + 1 for s in sizes if s) // capacity))  # of the rests

    def bits(values: list) -> list[int]:
        count = Counter(v for v, s in zip(values, sizes, strict=True) if s and v is not None and v == v)
        first, parts, seen = {}, {v: -(-n // least) for v, n in count.items() if n > 1}, Counter()
        at = 0
        for v, n in parts.items():
            first[v], at = at, at + n
        out = []
        for k in sorted(range(len(values)), key=lambda k: (-sizes[k], k)):
            v = values[k]
            out.append((k, 1 << first[v] + seen[v] % parts[v] if v in first and sizes[k] else 0))
            seen[v] += 1
        return [b for _, b in sorted(out)]

    source_bits, cluster_bits = bits(sources), bits(clusters)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    in_source: list[int] = []
    in_cluster: list[int] = []
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0

    def put(bin_: int, residual: int) -> None:
        nonlocal used
        by_residual[residual].append(bin_)
        used |= 1 << residual

    rests = []
    for k, size in enumerate(sizes):
        at = 0
        while size - at > capacity:
            out[k].append((len(in_source), at, capacity))
            put(len(in_source), 0)
            in_source.append(source_bits[k])
            in_cluster.append(cluster_bits[k])
            at += capacity
        rests.append((size - at, k, at))
    rests.sort(key=lambda r: (-r[0], r[1]))
    for size, k, at in rests:
        s, c = source_bits[k], cluster_bits[k]
        found, ahead = None, used >> size
        residual = size - 1
        while ahead:
            step = (ahead & -ahead).bit_length()
            residual += step
            ahead >>= step
            bins, pick = by_residual[residual], -1
            for j in range(len(bins) - 1, -1, -1):
                if not size or not in_cluster[bins[j]] & c:
                    apart = not in_source[bins[j]] & s
                    if apart or not size or not sources_apart and pick < 0:
                        pick = j
                    if apart or not size:
                        break
            if pick >= 0:
                found = bins.pop(pick)
                if not bins:
                    used &= ~(1 << residual)
                break
        if found is None:
            found, residual = len(in_source), capacity
            in_source.append(0)
            in_cluster.append(0)
        in_source[found] |= s
        in_cluster[found] |= c
        put(found, residual - size)
        out[k].append((found, at, size))
    return out


def pack(items: DataFrame, key: str, size: str, source: str | None = None, cluster: str | None = None, *, capacity: int = CAPACITY, sources_apart: bool = False, shard_items: int = SHARD_ITEMS, n_items: int | None = None) -> DataFrame:
    """key, part, container, start, size: the container of every item, or of each part of an item
    larger than `capacity` (part counts from 0, start is the part's offset in the item).

    Items are spread by the hash of their key over as many shards as keep about `shard_items`
    items each; a shard is packed by best_fit in one task, so that no task grows with the data and
    nothing but narrow rows is shuffled once. Containers are unique: shard * 2^32 + number. Keys
    should be unique; a null key is one of them. A null size counts as 0; negative sizes too. An
    empty table gives no rows.
    """
    rows = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size"), (F.col(source) if source else F.lit(None)).cast("string").alias("source"), (F.col(cluster) if cluster else F.lit(None)).cast("string").alias("cluster"))
    n = items.count() if n_items is None else n_items
    shards = max(1, -(-n // shard_items))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "size"], kind="stable")
        placed = best_fit([int(x) for x in group["size"]], group["source"].tolist(), group["cluster"].tolist(), capacity, sources_apart)
        count = [len(p) for p in placed]
        flat = np.array([x for p in placed for x in p], np.int64).reshape(-1, 3)
        part = np.array([k for c in count for k in range(c)], np.int32)
        keys = group["key"].repeat(count).reset_index(drop=True)
        shard = int(group["shard"].iloc[0])
        return pd.DataFrame({"key": keys, "part": part, "container": flat[:, 0] + (shard << 32), "start": flat[:, 1], "size": flat[:, 2]})

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.groupBy("shard").applyInPandas(run, f"key {kind}, part int, container bigint, start bigint, size bigint")
    return out.withColumnRenamed("key", key)


def pack_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, capacity: int = CAPACITY, sources_apart: bool = False, vocabulary: str = "byte_bpe_50k", folder: str = bpe.TOKENIZERS) -> DataFrame:
    """Containers for documents sized in tokens; copies of a text are kept apart (or, if
    they are more than the containers, spread evenly), documents of one source too with `sources_apart`. Columns: key, part, container, start, size in tokens."""
    marked = documents.select(key, text, F.col(source).alias("source_"), F.xxhash64(F.nullif(text, F.lit(""))).alias("hash_"))
    marked = marked.withColumn("cluster_", F.when(F.length(text) > 0, F.col("hash_"))).drop("hash_")
    sized = bpe.count_tokens(marked, key, text, keep=("source_", "cluster_"), vocabulary=vocabulary, folder=folder)
    return pack(sized, key, "n_tokens", "source_", "cluster_", capacity=capacity, sources_apart=sources_apart, n_items=documents.count())


def fill(containers: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """One row: number of containers, their tokens, and the share of unused space."""
    total = containers.agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("tokens"))
    return total.select("containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused"))
