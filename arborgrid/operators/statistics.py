"""Moments, entropies and normalisations by group.

All moments divide by n (population). Nulls are left out. Groups without values give null
moments; divisions by an empty range or a zero deviation give 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborgrid.functions import arith


def describe(df: DataFrame, value: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """n, sum, mean, min, max, var, std, median and the mean of the values that are not 0."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.round(F.sum(v), digits).alias("sum"), F.round(F.avg(v), digits).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.round(F.var_pop(v), digits).alias("var"), F.round(F.stddev_pop(v), digits).alias("std"), F.round(F.median(v), digits).alias("median"),
        F.round(F.coalesce(F.avg(F.when(v != 0, v)), F.lit(0.0)), digits).alias("mean_nonzero"),
    )


def arg_extremes(df: DataFrame, value: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Key of the first smallest and first largest value."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(key, F.struct(value, key)).alias("argmin"), F.min_by(key, F.struct(-F.col(value), F.col(key))).alias("argmax"))


def association(df: DataFrame, x: str, y: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Covariance, Pearson r, 1 - |r| and the maximal information compression index of two columns."""
    vx, vy, r = F.var_pop(x), F.var_pop(y), F.corr(x, y)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    mici = vx + vy - F.sqrt(F.greatest((vx + vy) ** 2 - vx * vy * 4 * (1 - r * r), F.lit(0.0)))
    return both.groupBy(*by).agg(F.round(F.covar_pop(x, y), digits).alias("cov"), F.round(r, digits).alias("r"), F.round(1 - F.abs(r), digits).alias("r_distance"), F.round(mici, digits).alias("mici"))


def regression(df: DataFrame, x: str, y: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.regr_slope(y, x), digits).alias("slope"), F.round(F.regr_intercept(y, x), digits).alias("intercept"), F.round(F.regr_r2(y, x), digits).alias("r2"))


def weighted_median(df: DataFrame, value: str, weight: str, by: Sequence[str]) -> DataFrame:
    """First value (ascending) whose cumulative weight reaches half. Equal values are merged first,
    so the running sum sees a row a distinct value."""
    merged = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    part = Window.partitionBy(*by)
    run = F.sum("_w").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    reached = merged.withColumn("_run", run).withColumn("_all", F.sum("_w").over(part)).where(F.col("_run") * 2 >= F.col("_all"))
    return reached.groupBy(*by).agg(F.min(value).alias("weighted_median"))


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str], digits: int = 6) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), digits).alias("weighted_mean"))


def _entropy(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """-sum p ln p from counts n, as ln N - sum(n ln n) / N, so no total has to meet the rows."""
    n = F.col("n")
    return counts.groupBy(*by).agg((F.ln(F.sum("n")) - F.sum(n * F.ln(n)) / F.sum("n")).alias("h"))


def entropy(df: DataFrame, value: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Shannon entropy in nats."""
    return _entropy(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), by).select(*by, F.round("h", digits).alias("entropy"))


def mutual_information(df: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    """Entropies of two columns, their joint entropy and (Hx + Hy) / Hxy, in one row."""
    joint = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    hx = _entropy(joint.groupBy(x).agg(F.sum("n").alias("n")), [])
    hy = _entropy(joint.groupBy(y).agg(F.sum("n").alias("n")), [])
    one = hx.select(F.col("h").alias("hx")).join(hy.select(F.col("h").alias("hy"))).join(_entropy(joint, []).select(F.col("h").alias("hxy")))  # one row each
    nmi = F.when(F.col("hxy") > 0, (F.col("hx") + F.col("hy")) / F.col("hxy"))
    return one.select(*[F.round(c, digits).alias(c) for c in ("hx", "hy", "hxy")], F.round(nmi, digits).alias("nmi"))


def kl_divergence(df: DataFrame, category: str, p: Column, q: Column, digits: int = 6) -> DataFrame:
    """sum P ln(P / Q) of two count columns by category, each normalised to 1; terms with P = 0 are 0.
    Null (infinite) where some Q is 0 under a P that is not."""
    g = df.groupBy(category).agg(F.sum(p).alias("p"), F.sum(q).alias("q"))
    t = g.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    rows = g.join(F.broadcast(t))  # one row
    pp, qq = F.col("p") / F.col("tp"), F.col("q") / F.col("tq")
    return rows.agg(F.round(F.sum(F.when(pp > 0, pp * F.ln(pp / qq)).otherwise(0.0)), digits).alias("kl"))


def group_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"), F.min(value).alias("_min"), F.max(value).alias("_max"))


def normalize(df: DataFrame, value: str, by: Sequence[str], how: str = "zscore", top: float = 1.0, digits: int = 6) -> DataFrame:
    """``df`` with a column ``scaled``: zscore, minmax (to 0..top) or max. Group figures are aggregated
    before the shuffle and joined back, so a hot group is never sorted into one task."""
    v = F.col(value)
    stats = group_stats(df, value, by)
    scaled = {
        "zscore": arith.zscore(v, F.col("_mean"), F.col("_std")),
        "minmax": arith.unit_range(v, F.col("_min"), F.col("_max"), top),
        "max": F.when(F.col("_max") != 0, v / F.col("_max") * top).otherwise(0.0),
    }[how]
    return df.join(stats, list(by)).withColumn("scaled", F.round(scaled, digits)).drop("_mean", "_std", "_min", "_max")


def otsu(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Threshold t of an integer column that maximises the variance between {v <= t} and {v > t}."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    s = counts.select(
        *by, value, F.sum("n").over(run).alias("w0"), F.sum(F.col(value) * F.col("n")).over(run).alias("s0"), F.sum("n").over(part).alias("w"), F.sum(F.col(value) * F.col("n")).over(part).alias("s")
    )
    w1 = F.col("w") - F.col("w0")
    between = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1, F.lit(2))).otherwise(0.0)
    return s.withColumn("_b", F.round(between / F.col("w") / F.col("w"), 9)).groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_b"), F.col(value))).alias("threshold"))


def percentile_threshold(df: DataFrame, value: str, share: float, by: Sequence[str] = ()) -> DataFrame:
    """Least value whose cumulative share reaches ``share``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = F.sum("n").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    s = counts.select(*by, value, run.alias("c"), F.sum("n").over(part).alias("t"))
    return s.where(F.col("c") >= F.col("t") * share).groupBy(*by).agg(F.min(value).alias("threshold"))


def equalize(df: DataFrame, value: str, top: int, by: Sequence[str] = ()) -> DataFrame:
    """Lookup value -> equalised value 0..top by cumulative counts (all rows of one value stay together)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("n").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(*by, value, "n", F.least(F.floor(before * (top + 1) / F.sum("n").over(part)), F.lit(top)).cast("int").alias("equalized"))


def match_histogram(source: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """Lookup value -> least target value whose CDF reaches the source's. Distinct values only meet."""

    def cdf(df: DataFrame, name: str) -> DataFrame:
        c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias(name)).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy(F.lit(0))
        return c.select(name, (F.sum("n").over(w.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)).alias("f"))

    both = cdf(source, "v").select("v", "f", F.lit(1).alias("side"), F.lit(None).cast("double").alias("t")).unionByName(
        cdf(target, "t").select(F.lit(None).cast("double").alias("v"), "f", F.lit(0).alias("side"), F.col("t").cast("double")), allowMissingColumns=True
    )
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("f"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    # walking down the CDF: the last target seen at or above f, which is the least one
    seen = both.withColumn("m", F.min("t").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f"), F.asc("side")).rowsBetween(Window.unboundedPreceding, 0)))
    del w
    return seen.where("side = 1").select(F.col("v").alias(value), F.col("m").alias("matched"))


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean and population variance of each group, as ``merged`` takes them."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"))


def merged(a: DataFrame, b: DataFrame, by: Sequence[str], remove: bool = False) -> DataFrame:
    """Moments of the groups of ``a`` with those of ``b`` added (or taken away), without the values. A group
    that is left empty has a null mean and variance."""
    met = a.join(b.select(*by, *[F.col(c).alias(f"_{c}") for c in ("n", "mean", "var")]), list(by), "left" if remove else "full")
    n, m, v, k, l, w = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("n", "mean", "var", "_n", "_mean", "_var"))
    s = -1.0 if remove else 1.0
    total = n + k * s
    mean = (n * m + k * l * s) / total
    var = (n * (v + m * m) + k * (w + l * l) * s) / total - mean * mean
    return met.select(*by, total.cast("long").alias("n"), F.when(total > 0, mean).alias("mean"), F.when(total > 0, F.greatest(var, F.lit(0.0))).alias("var"))
