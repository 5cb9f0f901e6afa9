"""Fixed-width histograms and what is read from them.

Bin = floor(v / ((max_val + 1) / nbins)). Values below 0 or beyond the last bin and null values
are outside the histogram. Empty bins are present with n = 0. An empty table gives no rows when
grouped, and nbins rows of zeros when not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, nbins: int, max_val: float, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Counts (``n``) and shares per group and bin; ``by`` may be empty."""
    width = (max_val + 1.0) / nbins
    binned = df.select(*by, F.floor(F.col(value) / F.lit(width)).cast("int").alias("bin"))
    counts = binned.where(F.col("bin").between(0, nbins - 1)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"), F.sum("n").alias("_t"))
    bins = packed.select(*by, "_m", "_t", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"))
    n = F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).cast("long")
    return bins.select(*by, "bin", n.alias("n"), F.round(n / F.greatest(F.coalesce("_t", F.lit(0)), F.lit(1)), digits).alias("share"))


def cumulative(hist: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Running sum of ``n`` over the bins, and its share of the total."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.greatest(F.sum("n").over(part), F.lit(1))
    return hist.select(*by, "bin", "n", F.sum("n").over(run).alias("cum"), F.round(F.sum("n").over(run) / total, digits).alias("cdf"))


def summary(hist: DataFrame, by: Sequence[str] = (), exclude_zero: bool = False) -> DataFrame:
    """Mode (first largest bin), mean, lower weighted median, first arg-min of each histogram."""
    h = hist.where(F.col("bin") > 0) if exclude_zero else hist
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_c", F.sum("n").over(run)).withColumn("_t", F.sum("n").over(part))
    return h.groupBy(*by).agg(
        F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("mode"),
        F.round(F.sum(F.col("bin") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("mean"),
        F.min(F.when(F.col("_c") * 2 >= F.col("_t"), F.col("bin"))).alias("median"),
        F.min_by("bin", F.struct(F.col("n"), F.col("bin"))).alias("argmin"),
    )
