"""Classification, clustering, segmentation and saliency metrics as aggregates.

A confusion table (truth, pred, n) is built first, before any other shuffle, so every metric
works on a row per pair of classes. Rows with null truth or prediction are left out. Empty
denominators: precision, recall and accuracy 1, F 0; kappa uses 1 - pe + 1e-7.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    both = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    return both.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def per_class(conf: DataFrame) -> DataFrame:
    """tp, fp, fn, tn of each class that occurs."""
    flat = conf.select(F.explode(F.array(
        F.struct(F.col("truth").alias("class"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")),
    )).alias("r")).select("r.*")
    c = flat.groupBy("class").agg(*[F.sum(x).alias(x) for x in ("tp", "t", "p")])
    total = conf.agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(total)).select("class", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), (F.col("total") - F.col("t") - F.col("p") + F.col("tp")).alias("tn"), F.col("t").alias("n"))


def rates(counts: DataFrame, keep: Sequence[str] = (), beta: float = 1.0, digits: int = 6) -> DataFrame:
    """precision, recall, accuracy, F_beta, MCC and 1 - (fp / N + fn / P) / 2 from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    b = beta * beta
    mcc = _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0.0)
    return counts.select(
        *keep,
        F.round(_ratio(tp, tp + fp, 1.0), digits).alias("precision"), F.round(_ratio(tp, tp + fn, 1.0), digits).alias("recall"),
        F.round(_ratio(tp + tn, tp + tn + fp + fn, 1.0), digits).alias("accuracy"), F.round(_ratio(tp * (1 + b), tp * (1 + b) + fn * b + fp, 0.0), digits).alias("fscore"),
        F.round(mcc, digits).alias("mcc"), F.round(1 - (_ratio(fp, fp + tn, 0.0) + _ratio(fn, fn + tp, 0.0)) / 2, digits).alias("weighted_accuracy"),
    )


def summary(df: DataFrame, truth: str, pred: str, digits: int = 6) -> DataFrame:
    """One row: hit share, kappa, macro F (over classes present), mean recall, recall weighted by
    1 - share of the class, optimum-path accuracy, 1 - max of the mean error rates."""
    conf = confusion(df, truth, pred)
    pc = per_class(conf)
    tp, fp, fn, n = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "n"))
    total = (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("double")
    f = _ratio(tp * 2, tp * 2 + fp + fn, 0.0)
    recall = F.when(n > 0, tp / n)
    err_fp, err_fn = F.when(n > 0, _ratio(fp, total - n, 0.0)), F.when(n > 0, fn / n)
    a = pc.agg(
        (F.sum(tp) / F.max(total)).alias("po"), (F.sum((tp + fp) * n) / F.max(total) / F.max(total)).alias("pe"), F.avg(f).alias("macro_f"), F.avg(recall).alias("mean_recall"),
        (F.sum(recall * (1 - n / total)) / F.sum(F.when(n > 0, 1 - n / total))).alias("skewed"), (1 - F.sum(err_fp + err_fn) / (2 * F.count(recall))).alias("path_accuracy"),
        (1 - F.greatest(F.avg(err_fp), F.avg(err_fn))).alias("worst_accuracy"),
    )
    kappa = (F.col("po") - F.col("pe")) / (1 - F.col("pe") + 1e-7)
    return a.select(F.round("po", digits).alias("true_positives"), F.round(kappa, digits).alias("kappa"), *[F.round(c, digits).alias(c) for c in ("macro_f", "mean_recall", "skewed", "path_accuracy", "worst_accuracy")])


METRICS = {"fscore": "macro_f", "true_positives": "true_positives", "kappa": "kappa", "skewed_true_positives": "skewed", "normalized_accuracy": "mean_recall", "weighted_accuracy": "worst_accuracy", "path_accuracy": "path_accuracy"}


def metric(name: str, df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One metric by name, in a column ``value``."""
    return summary(df, truth, pred).select(F.col(METRICS[name]).alias("value"))


def far_frr(df: DataFrame, score: str, genuine: str, threshold: float, digits: int = 6) -> DataFrame:
    """False acceptance, false rejection and their mean at a score threshold."""
    yes = F.col(score) >= threshold
    far, frr = F.avg(F.when(~F.col(genuine), yes.cast("double"))), F.avg(F.when(F.col(genuine), (~yes).cast("double")))
    return df.agg(F.round(far, digits).alias("far"), F.round(frr, digits).alias("frr"), F.round((far + frr) / 2, digits).alias("err"))


def purity(df: DataFrame, group: str, truth: str, digits: int = 6) -> DataFrame:
    """Size and share of the commonest class of each group."""
    c = df.groupBy(group, truth).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(group).agg(F.sum("n").alias("size"), F.round(F.max("n") / F.sum("n"), digits).alias("purity"))


def overlap(df: DataFrame, a: str, b: str, labels: bool = False, digits: int = 6) -> DataFrame:
    """Dice, Jaccard and the general balanced coefficient of two aligned masks (or of each label > 0)."""
    if labels:
        flat = confusion(df.select(F.coalesce(a, F.lit(0)).alias("a"), F.coalesce(b, F.lit(0)).alias("b")), "a", "b")
        c = per_class(flat).where(F.col("class") > 0)
        keep = ["class"]
    else:
        x, y = F.coalesce(F.col(a), F.lit(0)) != 0, F.coalesce(F.col(b), F.lit(0)) != 0
        c = df.agg(*[F.count_if(e).alias(n) for e, n in ((x & y, "tp"), (~x & y, "fp"), (x & ~y, "fn"), (~x & ~y, "tn"))])
        keep = []
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    n = tp + fn
    gbc = F.when((fn < n) & (fp < n), (n - fp) * (n - fn) / (n * n)).otherwise(0.0)
    return c.select(*keep, F.round(_ratio(2 * tp, 2 * tp + fp + fn, 1.0), digits).alias("dice"), F.round(_ratio(tp, tp + fp + fn, 1.0), digits).alias("jaccard"), F.round(gbc, digits).alias("gbc"))


def superpixel_quality(df: DataFrame, superpixel: str, label: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Achievable segmentation accuracy and under-segmentation error per image."""
    c = df.groupBy(*by, superpixel, label).agg(F.count(F.lit(1)).alias("n"))
    s = c.groupBy(*by, superpixel).agg(F.max("n").alias("best"), F.sum("n").alias("size"), F.sum(F.least(F.col("n"), F.lit(0) + F.col("n"))).alias("_n"), F.collect_list("n").alias("ns"))
    leak = F.aggregate("ns", F.lit(0).cast("long"), lambda t, n: t + F.least(n, F.col("size") - n))
    return s.groupBy(*by).agg(F.round(F.sum("best") / F.sum("size"), digits).alias("asa"), F.round(F.sum(leak) / F.sum("size"), digits).alias("under_segmentation"))


def mean_absolute_error(df: DataFrame, saliency: Column, truth: Column, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg(F.abs(saliency - truth)), digits).alias("mae"), F.round(F.sqrt(F.sum((saliency - truth) ** 2)), digits).alias("euclidean"))


def e_measure(df: DataFrame, saliency: str, truth: str, by: Sequence[str], digits: int = 6) -> DataFrame:
    """Enhanced alignment of a saliency map (0..1), binarised at twice its mean, with a 0/1 truth."""
    w = df.groupBy(*by).agg(F.least(F.avg(saliency) * 2, F.lit(1.0)).alias("_t"))
    b = df.join(w, list(by)).select(*by, F.when(F.col(saliency) >= F.col("_t"), 1.0).otherwise(0.0).alias("p"), F.col(truth).cast("double").alias("g"))
    m = b.groupBy(*by).agg(F.avg("p").alias("mp"), F.avg("g").alias("mg"))
    ap, ag = F.col("p") - F.col("mp"), F.col("g") - F.col("mg")
    align = 2 * ap * ag / (ap * ap + ag * ag + 2.220446049250313e-16)
    cell = F.when(F.col("mg") == 0, 1 - F.col("p")).when(F.col("mg") == 1, F.col("p")).otherwise((align + 1) ** 2 / 4)
    return b.join(m, list(by)).groupBy(*by).agg(F.round(F.avg(cell), digits).alias("e_measure"))


def s_object(df: DataFrame, saliency: str, truth: str, by: Sequence[str], digits: int = 6) -> DataFrame:
    """Object-aware structure: 2 m / (m^2 + 1 + std) on the foreground, the same on the inverted
    background, weighted by the foreground's share."""
    s, g = F.col(saliency), F.col(truth)
    a = df.groupBy(*by).agg(
        F.avg(F.when(g == 1, s)).alias("mf"), F.stddev_pop(F.when(g == 1, s)).alias("sf"), F.avg(F.when(g == 0, 1 - s)).alias("mb"), F.stddev_pop(F.when(g == 0, 1 - s)).alias("sb"), F.avg(g.cast("double")).alias("mu")
    )

    def score(m: str, d: str) -> Column:
        return F.coalesce(2 * F.col(m) / (F.col(m) ** 2 + 1 + F.col(d)), F.lit(0.0))

    return a.select(*by, F.round(F.col("mu") * score("mf", "sf") + (1 - F.col("mu")) * score("mb", "sb"), digits).alias("s_object"))


def saliency_pr(df: DataFrame, saliency: str, truth: str, step: int = 5, digits: int = 6) -> DataFrame:
    """Precision and recall of a 0..255 map at thresholds 0, step, ... 255 (> threshold). The table is
    reduced to counts by value first."""
    c = df.where(F.col(saliency).isNotNull()).groupBy(F.col(saliency).cast("int").alias("v")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("q"))
    t = c.select("v", "p", "q", F.explode(F.sequence(F.lit(0), F.lit(255), F.lit(step))).alias("threshold"))
    over = F.col("v") > F.col("threshold")
    a = t.groupBy("threshold").agg(F.sum(F.when(over, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("q")).otherwise(0)).alias("fp"), F.sum("p").alias("all"))
    return a.select("threshold", F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), digits).alias("precision"), F.round(_ratio(F.col("tp"), F.col("all"), 1.0), digits).alias("recall"))


def best_row(scores: DataFrame, i: str, score: str) -> DataFrame:
    """Row of a score matrix (i, j, score) with the best sum, the smallest i among equals."""
    s = scores.groupBy(i).agg(F.round(F.sum(score), 6).alias("total"))
    return s.agg(F.max_by(F.struct(i, "total"), F.struct(F.col("total"), -F.col(i))).alias("b")).select("b.*")


def running_detection(per_image: DataFrame, group: str, image: str, digits: int = 6) -> DataFrame:
    """Cumulative precision, recall and F2 over images in order; per_image has found, missed, wrong."""
    w = Window.partitionBy(group).orderBy(image).rowsBetween(Window.unboundedPreceding, 0)
    c = per_image.select(group, image, *[F.sum(x).over(w).alias(x) for x in ("found", "missed", "wrong")])
    tp, fn, fp = (F.col(x).cast("double") for x in ("found", "missed", "wrong"))
    return c.select(group, image, F.round(_ratio(tp, tp + fp, 1.0), digits).alias("precision"), F.round(_ratio(tp, tp + fn, 1.0), digits).alias("recall"), F.round(_ratio(tp * 5, tp * 5 + fn * 4 + fp, 0.0), digits).alias("f2"))


def average_precision(curve: DataFrame, group: str, digits: int = 6) -> DataFrame:
    """Trapezoid under precision over recall, points sorted by recall, from (0, 1)."""
    pts = curve.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("recall", (-F.col("precision")).alias("np")))).alias("pts"))
    first = F.struct(F.lit(0.0).alias("r"), F.lit(1.0).alias("p"), F.lit(0.0).alias("a"))
    area = F.aggregate("pts", first, lambda s, p: F.struct(p["recall"].alias("r"), (-p["np"]).alias("p"), (s["a"] + (p["recall"] - s["r"]) * (s["p"] - p["np"]) / 2).alias("a")), lambda s: s["a"])
    return pts.select(group, F.round(area, digits).alias("ap"))
