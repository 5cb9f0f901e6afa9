"""Ranks and smallest-k within groups, without bringing a whole group into one task.

``row_number() over (partition by g order by k)`` sorts all rows of a hot group in one task. Here
the key is a hash spread evenly over the 63-bit range, so each group is cut into buckets by the
key's leading bits; bucket counts (aggregated before the shuffle) give every bucket's offset, and
only rows of one bucket meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 10


def _bucketed(df: DataFrame, key: Column, bits: int) -> DataFrame:
    return df.withColumn("_key", key.cast("long")).withColumn(
        "_bucket", F.when(F.col("_key") < 0, F.lit(-1)).otherwise(F.shiftrightunsigned("_key", 63 - bits)).cast("int")
    )


def _offsets(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows per (group, bucket) and how many rows of the group lie in lower buckets."""
    w = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    return counts.withColumn("_before", F.coalesce(F.sum("_in").over(w), F.lit(0)))


def _null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner join on ``cols`` where nulls meet nulls; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols], *[c for c in right.columns if c not in cols])
    cond = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in cols]
    return left.join(renamed, cond).drop(*[f"_r_{c}" for c in cols])


def grouped_rank(df: DataFrame, group: Sequence[str], key: Column, ties: Sequence[str], out: str = "rank", bits: int = BUCKET_BITS) -> DataFrame:
    """Rank (from 1) of each row in its group by ``key`` (63-bit hash, negatives first), then ``ties``."""
    b = _bucketed(df, key, bits)
    w = Window.partitionBy(*group, "_bucket").orderBy("_key", *ties)
    joined = _null_safe(b, _offsets(b, group).drop("_in"), [*group, "_bucket"])
    return joined.withColumn(out, (F.row_number().over(w) + F.col("_before")).cast("long")).drop("_key", "_bucket", "_before")


def take_smallest(df: DataFrame, group: Sequence[str], key: Column, quota: str, ties: Sequence[str], bits: int = BUCKET_BITS) -> DataFrame:
    """The ``quota`` rows (a column, equal within the group) of each group with the smallest keys.

    Buckets wholly above the quota are dropped before any sort, so the sort sees about ``quota``
    rows a group. Exact: ties at the border are broken by ``ties``. Rows with a null quota are dropped.
    """
    b = _bucketed(df.where(F.col(quota) > 0), key, bits)
    joined = _null_safe(b, _offsets(b, group).drop("_in"), [*group, "_bucket"]).where(F.col("_before") < F.col(quota))
    w = Window.partitionBy(*group, "_bucket").orderBy("_key", *ties)
    picked = joined.withColumn("_rn", F.row_number().over(w) + F.col("_before")).where(F.col("_rn") <= F.col(quota))
    return picked.drop("_key", "_bucket", "_before", "_rn")
