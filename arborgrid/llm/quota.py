"""Problem 5: a sample whose category shares match given targets.

Per pool the integer quotas come from the largest remainder: one factor scales all target shares so
that they, held between floor (``min_n``) and cap (what there is), add up to the sample's size; so what
a full or short category leaves over goes to the others in proportion to their targets. Whole parts
are given first, the rest by the largest remainder. Then each category's quota of samples with the
smallest random keys (a hash of the sample and a seed) is taken; only rows near the border are
ranked (plans.ranking). A report names the categories whose pool does not suffice.

A pool's targets (one row a category) are allocated in one task, some thousand targets of whole pools
at a time; samples are counted before any shuffle and never brought together by pool.

Defined cases: samples without category, pool or key are not drawn; a sample that occurs several
times counts once a category, and belongs to its smallest category if its rows differ; target rows
that repeat a category: the largest values hold; null or negative targets, floors and sizes count as
0; categories without a target get their floor only; floors have priority over the size (the report's
``over_size``); equal remainders go to the smaller category; an empty table gives quotas of 0 and a
shortfall for each target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborgrid.plans import take_smallest

SEED = 20231
#: About so many targets are allocated in one task.
TASK_TARGETS = 20_000


def allocate(pct: np.ndarray, floor: np.ndarray, available: np.ndarray, size: int) -> np.ndarray:
    """Quotas of one pool: floors and caps kept, sum = size where floors and caps allow it."""
    low, high = np.minimum(floor, available).astype(float), available.astype(float)
    high = np.where(pct > 0, high, low)
    if low.sum() >= size or high.sum() <= size:
        return (low if low.sum() >= size else high).astype(np.int64)
    # the sum of clip(pct * factor, low, high) grows with the factor and is linear between breaks
    some = pct > 0
    breaks = np.unique(np.concatenate([low[some] / pct[some], high[some] / pct[some]]))
    at = lambda f: float(np.clip(pct * f, low, high).sum())
    i, j = 0, len(breaks) - 1
    while i < j:
        m = (i + j) // 2
        i, j = (m + 1, j) if at(breaks[m]) < size else (i, m)
    above, below = breaks[i], breaks[i - 1] if i else 0.0
    free = some & (low <= pct * below + 1e-9) & (high >= pct * above - 1e-9)
    slope = pct[free].sum()
    factor = above - (at(above) - size) / slope if slope > 0 else above
    ideal = np.round(np.clip(pct * factor, low, high), 9)
    quota = np.floor(ideal)
    order = np.lexsort((np.arange(len(pct)), quota - ideal))
    order = order[(quota < high)[order]][: int(size - quota.sum())]
    quota[order] += 1
    return quota.astype(np.int64)


def _allocator(keys: list[str], cat: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, cat], kind="stable").reset_index(drop=True)
        pct, floor, there, size = (pdf[c].to_numpy() for c in ("target_pct", "min_n", "available", "sample_size"))
        quota, total = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for rows in pdf.groupby(keys, sort=False).indices.values():
            total[rows] = size[rows].max()
            quota[rows] = allocate(pct[rows].astype(float), floor[rows], there[rows], int(total[rows[0]]))
            total[rows] = max(int(quota[rows].sum()) - int(total[rows[0]]), 0)
        return pdf.assign(quota=quota, over_size=total)

    return run


def quotas(samples: DataFrame, targets: DataFrame, pool_cols: list[str], cat: str) -> DataFrame:
    """Targets with ``available``, ``quota``, ``over_size`` (by how much the pool's floors exceed its
    size), ``wanted`` (exact share), ``short`` (share or floor not to be had), ``missing`` (how many
    samples that takes) and ``unmet`` (how far the quota lies below whole share and floor)."""
    counts = samples.groupBy(*pool_cols, cat).agg(F.count(F.lit(1)).alias("available"))
    zero = F.lit(0)
    goal = targets.where(" AND ".join(f"{c} IS NOT NULL" for c in [*pool_cols, cat])).groupBy(*pool_cols, cat)
    goal = goal.agg(*[F.greatest(F.coalesce(F.max(c), zero), zero).cast("long").alias(c) for c in ("target_pct", "min_n", "sample_size")])
    joined = goal.join(counts, [*pool_cols, cat], "left").withColumn("available", F.coalesce("available", zero).cast("long"))
    out = T.StructType([*joined.schema, T.StructField("quota", T.LongType()), T.StructField("over_size", T.LongType())])
    tasks = max(8, -(-targets.count() // TASK_TARGETS))
    dealt = joined.withColumn("_task", F.pmod(F.xxhash64(*pool_cols), F.lit(tasks)))
    allot = _allocator(pool_cols, cat)
    allotted = dealt.groupBy("_task").applyInPandas(lambda pdf: allot(pdf.drop(columns="_task")), out)
    # in hundredths, so that the comparison is between whole numbers
    share = F.col("target_pct") * F.col("sample_size")
    short = (F.col("available") * 100 < share) | (F.col("available") < F.col("min_n"))
    need = F.greatest(F.ceil(share / 100), F.col("min_n"))
    return allotted.withColumn("wanted", share / 100.0).withColumn("short", short).withColumn("missing", F.greatest(need - F.col("available"), zero).cast("long")).withColumn(
        "unmet", F.greatest(F.greatest(F.floor(share / 100), F.col("min_n")) - F.col("quota"), zero).cast("long")
    )


def draw(samples: DataFrame, quota: DataFrame, pool_cols: list[str], cat: str, key: str, seed: int = SEED) -> DataFrame:
    """The rows of ``samples`` that are drawn."""
    keys = [*pool_cols, cat]
    offered = samples.join(quota.select(*keys, "quota"), keys)
    random = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys, key), 1)
    return take_smallest(offered, keys, random, "quota", [key]).drop("quota")


def split_samples(split: DataFrame) -> DataFrame:
    """Samples of split: an ids, its pool, its class true_labels if above 0."""
    rows = split.where("ids IS NOT NULL AND pool IS NOT NULL AND true_labels > 0")
    rows = rows.groupBy("ids").agg(F.min(F.struct(F.col("true_labels").cast("int").alias("class"), "pool")).alias("s"))
    return rows.select(F.lit("split").alias("tbl"), "s.pool", "s.class", F.col("ids").alias("sample"))


def file_samples(files: DataFrame) -> DataFrame:
    """Samples of ift_filenames: the numbers <class>_<sample> in the last part of the path, per pool."""
    last = F.regexp_extract(F.trim(F.regexp_replace("filename", r"\s+$", "")), r"([^/\\]*)$", 1)
    numbers = F.regexp_extract(last, r"^\s*([0-9]{1,9})_[0-9]{1,18}(?:[_.]|$)", 1), F.regexp_extract(last, r"^\s*[0-9]{1,9}_([0-9]{1,18})(?:[_.]|$)", 1)
    rows = files.where("filename IS NOT NULL AND pool IS NOT NULL").select("pool", *[F.nullif(n, F.lit("")).cast(t).alias(c) for n, t, c in zip(numbers, ("int", "long"), ("class", "sample"))])
    rows = rows.where("class IS NOT NULL AND sample IS NOT NULL").groupBy("pool", "sample").agg(F.min("class").alias("class"))
    return rows.select(F.lit("ift_filenames").alias("tbl"), "pool", "class", "sample")
