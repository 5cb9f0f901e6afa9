"""Problem 7: items placed in containers of fixed capacity by the sum-of-squares rule.

Items larger than the capacity are cut into full containers and one remainder; no other item is
cut. Items are dealt to shards by a hash; each shard (about ``shard_items`` items, ids and sizes
only) is packed in one task, in hash order, so no task grows with the corpus. A shard's open
containers are counted by residual gap. An item goes where the sum of the squared counts becomes
smallest: with N(g) open containers of gap g, putting size s into gap g changes the sum by
2 * (N(g - s) - N(g)) + 2, a new container by 2 * N(C - s) + 1, and full containers count for
nothing. The tightest gap wins among equals. A shard leaves about one container's worth unused.

Defined cases: null or negative sizes count as 0; items of size 0 go to container 0 of their shard;
equal ids stay separate items; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
SHARD_ITEMS = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in the order given; sizes from 1 to ``capacity``."""
    counts = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap, 1 to capacity - 1
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    n_bins = 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        held = counts[s:capacity]
        change = np.where(held > 0, 2 * (counts[: capacity - s] - held) + 2, never)
        if len(change):
            change[0] = -2 * held[0] + 1 if held[0] else never
            k = int(np.argmin(change))
            old = int(change[k])
        else:
            k, old = 0, never
        fresh = 2 * int(counts[capacity - s]) + 1 if s < capacity else 0
        if old != never and old <= fresh:
            gap = s + k
            b = by_gap[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, n_bins
            n_bins += 1
        out[i] = b
        gap -= s
        if gap:
            by_gap[gap].append(b)
            counts[gap] += 1
    return out


def _pack_shard(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "_key", "part"], kind="stable").reset_index(drop=True)
        size = pdf["size"].to_numpy()
        bins = np.zeros(len(pdf), dtype=np.int64)
        some = size > 0
        bins[some] = sum_of_squares(size[some], capacity)
        pdf["container"] = (pdf["_shard"].to_numpy() << 32) + bins
        pdf["offset"] = pdf.groupby("container")["size"].cumsum() - pdf["size"]
        return pdf

    return run


def pack(items: DataFrame, id_col: str, size_col: str, n_items: int, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per placed piece: id, part, n_parts, start (units before the piece), size, container, offset.

    ``n_items`` is about the number of rows of ``items``; it sets the number of shards only.
    """
    shards = max(1, -(-n_items // shard_items))
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long")
    n_parts = F.greatest(F.ceil(F.col("_size") / capacity), F.lit(1)).cast("int")
    parts = items.select(F.col(id_col), size.alias("_size")).withColumn("n_parts", n_parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    start = F.col("part").cast("long") * capacity
    parts = parts.select(
        id_col, "part", "n_parts", start.alias("start"), F.least(F.col("_size") - start, F.lit(capacity)).cast("long").alias("size"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"),
    )
    parts = parts.withColumn("_order", F.xxhash64(id_col, "part", "size")).withColumn("_shard", F.pmod(F.xxhash64(F.lit(1), "_order"), F.lit(shards)).cast("long"))
    out = T.StructType([*parts.schema, T.StructField("container", T.LongType()), T.StructField("offset", T.LongType())])
    placed = parts.groupBy("_shard").applyInPandas(_pack_shard(capacity), out)
    return placed.select(id_col, "part", "n_parts", "start", "size", "container", "offset")
