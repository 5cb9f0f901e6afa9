"""Deterministic samples, folds, top-k and filters on component size.

'Random' means a hash of the key and a seed, so that every run and every executor agrees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborgrid.plans import grouped_rank, take_smallest


def random_key(key: str, seed: int = 1) -> Column:
    """63-bit hash of a key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 1)


def kfold(df: DataFrame, key: str, k: int, by: Sequence[str] = (), seed: int | None = 1) -> DataFrame:
    """Fold 0..k-1 of each row, balanced within each stratum; by key order if ``seed`` is None."""
    if seed is None:  # whole numbers from 0; shifted to fill the range of the ranking's buckets
        top = df.agg(F.max(key)).first()[0] or 1
        by_key = F.shiftleft(F.col(key).cast("long"), 62 - int(top).bit_length())
        return grouped_rank(df, list(by), by_key, [key], "_r").withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")
    return grouped_rank(df, list(by), random_key(key, seed), [key], "_r").withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def stratified(df: DataFrame, key: str, per_stratum: int, by: Sequence[str], seed: int = 1) -> DataFrame:
    """``per_stratum`` rows of each stratum (balanced subsampling), those with the smallest hashes."""
    return take_smallest(df.withColumn("_q", F.lit(per_stratum)), list(by), random_key(key, seed), "_q", [key]).drop("_q")


def proportional(df: DataFrame, key: str, share: float, by: Sequence[str], seed: int = 1) -> DataFrame:
    """ceil(share * n) rows of each stratum."""
    n = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) * share).alias("_q"))
    return take_smallest(df.join(n, list(by)), list(by), random_key(key, seed), "_q", [key]).drop("_q")


def top_groups(df: DataFrame, group: str, k: int, largest: bool = True) -> DataFrame:
    """The k largest (smallest) groups, named 1..k; the smallest name first among equals."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("area"))
    first = n.orderBy(F.desc("area") if largest else F.asc("area"), group).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("area") if largest else F.asc("area"), group)))  # k rows


def groups_in_area(df: DataFrame, group: str, least: int = 0, most: int | None = None) -> DataFrame:
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("area"))
    return n.where((F.col("area") >= least) & (F.lit(True) if most is None else F.col("area") <= most))


def grid_points(df: DataFrame, step: int, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels on a regular grid, half a step from the border."""
    return df.where((F.col(x) % step == step // 2) & (F.col(y) % step == step // 2))


def nearest_to_root(df: DataFrame, cluster: str, dist: str, key: str, k: int) -> DataFrame:
    """The k rows of each cluster nearest to its root (a row limit applies before the shuffle)."""
    w = Window.partitionBy(cluster).orderBy(dist, key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def active_selection(df: DataFrame, cluster: str, dist: str, key: str, truth_of_root: str, pred: str, k: int) -> DataFrame:
    """Per cluster the k samples to label next: first those whose prediction differs from their root's
    label, nearest first, then the farthest of the others."""
    differs = F.coalesce(F.col(pred) != F.col(truth_of_root), F.lit(False))
    w = Window.partitionBy(cluster).orderBy(F.when(differs, 0).otherwise(1), F.when(differs, F.col(dist)).otherwise(-F.col(dist)), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
