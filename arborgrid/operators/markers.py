"""Convolutional features learned from markers, forward passes and adaptive decoders.

Training looks at marker pixels only: patches about them are clustered per marker, then per layer,
and the centroids become kernels. Up to a counted bound of centroids the last clustering runs at
the driver, beyond it on the cluster; all centroids are used either way. Inference runs image by
image in numpy.

Pixels: image_id, x, y and bands (array<double>); markers: image_id, x, y, marker, label.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborgrid.operators import grid, learning
from arborgrid.plans import Scratch

SEED = 3425
#: Centroids that are clustered at the driver.
MAX_PATCHES = 200_000


@dataclass
class Layer:
    """A convolution with its marker statistics, and pooling."""

    kernel_size: tuple[int, int] = (3, 3)
    dilation: int = 1
    kernels_per_marker: int = 5
    out_channels: int = 8
    pool_size: tuple[int, int] = (3, 3)
    pool_stride: int = 1
    pool_type: str = "max_pool"
    kernels: np.ndarray | None = field(default=None, repr=False)
    mean: np.ndarray | None = field(default=None, repr=False)
    std: np.ndarray | None = field(default=None, repr=False)


def marker_statistics(pixels: DataFrame, markers: DataFrame, stdev_factor: float = 0.01) -> DataFrame:
    """Mean and population deviation (+ stdev_factor) of each band over marker pixels."""
    m = pixels.join(markers.select("image_id", "x", "y").distinct(), ["image_id", "x", "y"], "left_semi")
    b = m.select(F.posexplode("bands").alias("band", "v")).groupBy("band")
    return b.agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + stdev_factor).alias("std"))


def stack(pdf: pd.DataFrame) -> np.ndarray:
    """(height, width, bands) of one image; missing pixels are 0."""
    b = np.stack(pdf["bands"].to_numpy()).astype(float)
    a = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1, b.shape[1]))
    a[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = b
    return a


def shifts(size: tuple[int, int], dilation: int) -> list[tuple[int, int]]:
    return [((i - size[0] // 2) * dilation, (j - size[1] // 2) * dilation) for i in range(size[0]) for j in range(size[1])]


def patches_of(a: np.ndarray, ys: np.ndarray, xs: np.ndarray, size: tuple[int, int], dilation: int = 1) -> np.ndarray:
    """(n, kernel * bands) neighbourhoods, 0 outside the image."""
    r = max(size) // 2 * dilation + 1
    p = np.pad(a, ((r, r), (r, r), (0, 0)))
    return np.stack([p[ys + r + dy, xs + r + dx] for dy, dx in shifts(size, dilation)], 1).reshape(len(ys), -1)


def kmeans(x: np.ndarray, k: int, seed: int = SEED, rounds: int = 100) -> np.ndarray:
    """Centroids; the samples themselves if there are at most k."""
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        lab = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1) if len(x) * k < 2_000_000 else np.concatenate([((s[:, None] - c[None]) ** 2).sum(2).argmin(1) for s in np.array_split(x, 1 + len(x) * k // 2_000_000)])
        new = np.stack([x[lab == i].mean(0) if (lab == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c


def unit_kernels(c: np.ndarray) -> np.ndarray:
    """Centroids of unit length; those shorter than 0.001 are dropped."""
    n = np.linalg.norm(c, axis=1)
    return c[n > 0.001] / n[n > 0.001, None]


def apply_layer(a: np.ndarray, layer: Layer) -> np.ndarray:
    """Normalise, convolve (reflected border), clip at 0, pool."""
    a = (a - layer.mean) / layer.std
    r = max(layer.kernel_size) // 2 * layer.dilation
    p = np.pad(a, ((r, r), (r, r), (0, 0)), mode="reflect" if min(a.shape[:2]) > r else "edge")
    h, w, b = a.shape
    out = np.zeros((h, w, len(layer.kernels)))
    for i, (dy, dx) in enumerate(shifts(layer.kernel_size, layer.dilation)):
        out += p[r + dy : r + dy + h, r + dx : r + dx + w] @ layer.kernels[:, i * b : (i + 1) * b].T
    out = np.maximum(out, 0)
    q = max(layer.pool_size) // 2
    best = layer.pool_type == "max_pool"
    p = np.pad(out, ((q, q), (q, q), (0, 0)), constant_values=-np.inf if best else 0)
    views = np.stack([p[q + dy : q + dy + h, q + dx : q + dx + w] for dy, dx in shifts(layer.pool_size, 1)])
    pooled = views.max(0) if best else views.mean(0)
    return pooled[:: layer.pool_stride, :: layer.pool_stride]


def fit(pixels: DataFrame, markers: DataFrame, layers: Sequence[Layer], stdev_factor: float = 0.01, max_patches: int = MAX_PATCHES) -> list[Layer]:
    """Learn the kernels layer by layer. Marked images only are read; each layer's patches are
    clustered per image and marker on the cluster, then the centroids (kernels a marker) together."""
    scratch = Scratch(pixels.sparkSession, "markers")
    joined = pixels.join(markers.select("image_id").distinct(), "image_id", "left_semi")
    done: list[Layer] = []
    for layer in layers:
        moments = _moments(list(done))
        groups = joined.groupBy("image_id").cogroup(markers.groupBy("image_id"))
        m = groups.applyInPandas(moments, "n long, s array<double>, q array<double>").toPandas()  # a row a marked image
        if len(m) == 0:
            return done
        n = m["n"].sum()
        mean = np.sum(np.stack(m["s"].to_numpy()), 0) / n
        std = np.sqrt(np.maximum(np.sum(np.stack(m["q"].to_numpy()), 0) / n - mean**2, 0)) + stdev_factor
        c = scratch.put(groups.applyInPandas(_candidates(list(done), layer, mean, std), "image_id long, marker long, patch int, c array<double>"))
        if c.count() <= max_patches:
            centres = kmeans(np.stack(c.orderBy("image_id", "marker", "patch").toPandas()["c"].to_numpy()), layer.out_channels)
        else:
            first = c.orderBy(F.xxhash64(F.lit(SEED), "image_id", "marker", "patch"), "image_id", "marker", "patch").limit(layer.out_channels).collect()
            centres = np.asarray(learning.kmeans(c, "patch", "c", layer.out_channels, initial=[r["c"] for r in first])[1])
        kernels = unit_kernels(centres)
        done = [*done, Layer(layer.kernel_size, layer.dilation, layer.kernels_per_marker, len(kernels), layer.pool_size, layer.pool_stride, layer.pool_type, kernels, mean, std)]
    return done


def _features(px: pd.DataFrame, mk: pd.DataFrame, before: Sequence[Layer]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The image after the layers so far, and where its markers lie in it."""
    a = stack(px)
    y, x = mk["y"].to_numpy(), mk["x"].to_numpy()
    for layer in before:
        a = apply_layer(a, layer)
        y, x = y // layer.pool_stride, x // layer.pool_stride
    return a, np.minimum(y, a.shape[0] - 1), np.minimum(x, a.shape[1] - 1)


def _moments(before: Sequence[Layer]):
    def run(px: pd.DataFrame, mk: pd.DataFrame) -> pd.DataFrame:
        if len(px) == 0 or len(mk) == 0:
            return pd.DataFrame({"n": pd.Series([], dtype="int64"), "s": [], "q": []})
        a, y, x = _features(px, mk, before)
        v = a[y, x]
        return pd.DataFrame({"n": [len(v)], "s": [v.sum(0).tolist()], "q": [(v * v).sum(0).tolist()]})

    return run


def _candidates(before: Sequence[Layer], layer: Layer, mean: np.ndarray, std: np.ndarray):
    def run(px: pd.DataFrame, mk: pd.DataFrame) -> pd.DataFrame:
        if len(px) == 0 or len(mk) == 0:
            return pd.DataFrame({"image_id": [], "marker": [], "patch": [], "c": []}).astype({"image_id": "int64", "marker": "int64", "patch": "int32"})
        a, y, x = _features(px, mk, before)
        a = (a - mean) / std
        out = []
        for k in np.unique(mk["marker"].to_numpy()):
            rows = np.flatnonzero(mk["marker"].to_numpy() == k)
            centres = kmeans(patches_of(a, y[rows], x[rows], layer.kernel_size, layer.dilation), layer.kernels_per_marker)
            out += [(px["image_id"].iloc[0], int(k), i, c.tolist()) for i, c in enumerate(centres)]
        return pd.DataFrame(out, columns=["image_id", "marker", "patch", "c"])

    return run


def forward(pixels: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    """(image_id, x, y, bands) of the last layer."""
    ls = list(layers)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = stack(pdf)
        for layer in ls:
            a = apply_layer(a, layer)
        y, x = np.divmod(np.arange(a.shape[0] * a.shape[1]), a.shape[1])
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "x": x.astype("int32"), "y": y.astype("int32"), "bands": list(np.round(a.reshape(len(x), -1), 6))})

    return pixels.groupBy("image_id").applyInPandas(run, "image_id long, x int, y int, bands array<double>")


def vanilla_decoder(features: DataFrame, high_share: float = 0.2, low_share: float = 0.1) -> DataFrame:
    """(image_id, x, y, saliency 0..255). A band whose mean is at least t + var and whose bright share
    exceeds ``high_share`` weighs -1, one whose mean is at most t - var and bright share is below
    ``low_share`` weighs +1, others 0, where t and var are mean and variance of the bands' means."""
    flat = features.select("image_id", "x", "y", F.posexplode("bands").alias("band", "v"))
    means = flat.groupBy("image_id", "band").agg(F.avg("v").alias("m"))
    t = means.groupBy("image_id").agg(F.avg("m").alias("t"), F.var_pop("m").alias("s2"))
    share = flat.join(means, ["image_id", "band"]).groupBy("image_id", "band").agg(F.first("m").alias("m"), F.avg((F.col("v") > F.col("m")).cast("double")).alias("fg"))
    w = share.join(t, "image_id").select("image_id", "band", F.when((F.col("m") >= F.col("t") + F.col("s2")) & (F.col("fg") > high_share), -1.0).when((F.col("m") <= F.col("t") - F.col("s2")) & (F.col("fg") < low_share), 1.0).otherwise(0.0).alias("w"))
    s = flat.join(w, ["image_id", "band"]).groupBy("image_id", "x", "y").agg(F.greatest(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("s"))
    r = s.groupBy("image_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return s.join(r, "image_id").select("image_id", "x", "y", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).otherwise(0.0), 6).alias("saliency"))


def marker_decoder(features: DataFrame, markers: DataFrame, background: int = 0) -> DataFrame:
    """(image_id, x, y, saliency): bands weigh +1 where their mean over object markers exceeds that over
    background markers, else -1; the weighted sum is clipped at 0 and scaled to 0..255."""
    m = features.join(markers.select("image_id", "x", "y", "label").distinct(), ["image_id", "x", "y"]).select("label", F.posexplode("bands").alias("band", "v"))
    w = m.groupBy("band").agg(F.signum(F.coalesce(F.avg(F.when(F.col("label") != background, F.col("v"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(F.col("label") == background, F.col("v"))), F.lit(0.0))).alias("w"))
    weights = {r["band"]: r["w"] for r in w.collect()}  # a row a band
    arr = F.array(*[F.lit(float(weights.get(i, 0.0))) for i in range(max(weights, default=-1) + 1)] or [F.lit(0.0)])
    s = features.select("image_id", "x", "y", F.greatest(F.aggregate(F.zip_with("bands", arr, lambda v, k: F.coalesce(v * k, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b), F.lit(0.0)).alias("s"))
    r = s.groupBy("image_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return s.join(r, "image_id").select("image_id", "x", "y", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).otherwise(0.0), 6).alias("saliency"))


def band_sums(features: DataFrame, labels: Sequence[int]) -> DataFrame:
    """Bands divided by their maximum in each image, and sums of them and of their squares over the bands
    labelled 1 (f, f2) and 0 (b, b2)."""
    peaks = features.select("image_id", F.posexplode("bands").alias("band", "v")).groupBy("image_id", "band").agg(F.max("v").alias("m"))
    peaks = peaks.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "m"))), lambda e: e["m"]).alias("_m"))  # a number a band
    scaled = F.zip_with("bands", "_m", lambda v, m: F.when(m > 0, v / m).otherwise(0.0))
    sides = {n: F.array(*[F.lit(1.0 if x == k else 0.0) for x in labels]) for n, k in (("f", 1), ("b", 0))}
    total = lambda f, side: F.aggregate(F.zip_with("bands", side, f), F.lit(0.0), lambda s, x: s + x)
    out = features.join(peaks, "image_id").withColumn("bands", scaled)
    return out.select("image_id", "x", "y", "bands", *[total(lambda v, k: v * k, s).alias(n) for n, s in sides.items()], *[total(lambda v, k: v * v * k, s).alias(f"{n}2") for n, s in sides.items()])


def _scaled_saliency(raw: DataFrame) -> DataFrame:
    r = raw.groupBy("image_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).otherwise(0.0)
    return raw.join(r, "image_id").select("image_id", "x", "y", F.round(v, 6).alias("saliency"))


def disc_decoder(features: DataFrame, labels: Sequence[int], by_probability: bool = False, radius: float = 1.5) -> DataFrame:
    """(image_id, x, y, saliency 0..255) of bands labelled 1 (object) or 0 (background).

    Around each pixel the bands of either side are averaged over a disc, places outside the image
    counting as 0. By means, object bands count where their mean is the greater, background bands
    against them where it is the smaller. By probability, each band counts (or counts against) where
    its value is likelier under the normal distribution of its own side.
    """
    disc = grid.circular(radius)
    one, zero = max(sum(x == 1 for x in labels), 0) * len(disc), max(sum(x == 0 for x in labels), 0) * len(disc)
    base = band_sums(features, labels)
    sums = grid.neighbourhood(base, disc, ["f", "b", "f2", "b2"], *[F.sum(c).alias(f"_{c}") for c in ("f", "b", "f2", "b2")])
    met = base.join(sums, ["image_id", "x", "y"])
    m1, m0 = F.col("_f") / max(one, 1), F.col("_b") / max(zero, 1)
    if not by_probability:
        s = F.when(m1 > m0, F.col("f")).otherwise(0.0) - F.when(m1 < m0, F.col("b")).otherwise(0.0)
    else:
        v1, v0 = F.col("_f2") / max(one, 1) - m1 * m1, F.col("_b2") / max(zero, 1) - m0 * m0
        v1, v0 = F.when(v1 < 1e-7, 1.0).otherwise(v1), F.when(v0 < 1e-7, 1.0).otherwise(v0)
        p = lambda x, m, v: F.exp(-((x - m) ** 2) / (2 * v))
        side = F.array(*[F.lit(int(x)) for x in labels])
        part = F.zip_with("bands", side, lambda x, k: F.when((k == 1) & (p(x, m1, v1) > p(x, m0, v0)), x).when((k == 0) & (p(x, m1, v1) < p(x, m0, v0)), -x).otherwise(0.0))
        s = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    return _scaled_saliency(met.select("image_id", "x", "y", F.greatest(s, F.lit(0.0)).alias("s")))
