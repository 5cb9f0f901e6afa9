"""Image and region descriptors, patches, boundaries and label smoothing.

Pixels have image_id, x, y and value or label columns; see operators.grid for neighbourhoods.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborgrid.operators import grid
from arborgrid.operators.forests import Image, per_image


def quantize(v: Column, bins: int, top: int = 255) -> Column:
    return F.least(F.floor(v * bins / (top + 1)), F.lit(bins - 1)).cast("int")


def log_bucket(share: Column) -> Column:
    """Shares of 0..1 compressed to 0..9: 0 for none, else 9 + floor(log2(share)) kept from 1."""
    return F.when(share <= 0, 0).otherwise(F.greatest(F.lit(1), 9 + F.floor(F.log2(share)))).cast("int")


def border_interior(pixels: DataFrame, value: str, bins: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Histograms of quantised values of border pixels (a 4-neighbour of another value, or the image's
    edge) and of interior ones, shares of the larger of the two compressed by log2."""
    q = pixels.withColumn("_q", quantize(F.col(value), bins))
    extra = [c for c in by if c not in grid.KEY]
    g = grid.neighbourhood(q, grid.circular(1.0), ["_q", *extra], F.max(F.when(F.col("k") == 0, F.col("_q"))).alias("bin"), (F.min("_q") != F.max("_q")).alias("_d"), F.count(F.lit(1)).alias("_n"),
        *[F.max(F.when(F.col("k") == 0, F.col(c))).alias(c) for c in extra])
    g = g.withColumn("border", F.col("_d") | (F.col("_n") < 5))
    n = g.groupBy(*by, "bin").agg(F.count_if("border").alias("border"), F.count_if(~F.col("border")).alias("interior"))
    top = n.groupBy(*by).agg(F.greatest(F.max("border"), F.max("interior")).alias("_t"))
    return n.join(top, list(by)).select(*by, "bin", log_bucket(F.col("border") / F.col("_t")).alias("border"), log_bucket(F.col("interior") / F.col("_t")).alias("interior"))


def oriented_gradients(pixels: DataFrame, value: str, cell: int = 8, bins: int = 9) -> DataFrame:
    """Histogram of gradient directions (0..180 degrees) a cell, each pixel's magnitude shared by the two
    nearest bins; in unit length a cell. (image_id, cx, cy, hog)"""
    off = grid.rectangular(3, 3)
    g = grid.neighbourhood(pixels, off, [value], *[F.max(F.when(F.col("k") == off.index(o), F.col(value))).alias(n) for n, o in (("l", (-1, 0)), ("r", (1, 0)), ("u", (0, -1)), ("d", (0, 1)), ("c", (0, 0)))])
    gx, gy = F.coalesce("r", "c") - F.coalesce("l", "c"), F.coalesce("d", "c") - F.coalesce("u", "c")
    m, t = F.sqrt(gx * gx + gy * gy), F.pmod(F.degrees(F.atan2(gy, gx)), F.lit(180.0)) * bins / 180.0 - 0.5
    low = F.floor(t)
    share = F.explode(F.array(F.struct(F.pmod(low, F.lit(bins)).cast("int").alias("b"), (m * (1 - (t - low))).alias("w")), F.struct(F.pmod(low + 1, F.lit(bins)).cast("int").alias("b"), (m * (t - low)).alias("w"))))
    c = g.select("image_id", F.floor(F.col("x") / cell).cast("int").alias("cx"), F.floor(F.col("y") / cell).cast("int").alias("cy"), share.alias("s")).groupBy("image_id", "cx", "cy", "s.b").agg(F.sum("s.w").alias("w"))
    p = c.groupBy("image_id", "cx", "cy").agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("_m"), F.sqrt(F.sum(F.col("w") * F.col("w")) + 1e-12).alias("_n"))
    hog = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.round(F.coalesce(F.try_element_at("_m", i), F.lit(0.0)) / F.col("_n"), 6))
    return p.select("image_id", "cx", "cy", hog.alias("hog"))


def patches(pixels: DataFrame, value: str, offsets: Sequence[tuple[int, int]], at: DataFrame | None = None) -> DataFrame:
    """(image_id, x, y, patch): values about each pixel (or each pixel of ``at``) in the order of the
    displacements, 0 outside the image."""
    g = grid.neighbourhood(pixels, offsets, [value], F.map_from_entries(F.collect_list(F.struct("k", F.col(value).alias("v")))).alias("_m"))
    g = g.select(*grid.KEY, F.transform(F.sequence(F.lit(0), F.lit(len(offsets) - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0))).alias("patch"))
    return g if at is None else g.join(at.select(*grid.KEY).distinct(), list(grid.KEY), "left_semi")


def majority_vote(df: DataFrame, region: Sequence[str], label: str) -> DataFrame:
    """Commonest label of each region, the smallest among equals."""
    n = df.groupBy(*region, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*region).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("vote"))


def smooth_labels(pixels: DataFrame, label: str, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """Each pixel takes the commonest label of its neighbourhood, the smallest among equals."""
    g = grid.neighbourhood(pixels, offsets, [label], F.collect_list(label).alias("_v"))  # as many as displacements
    counted = F.transform(F.array_distinct("_v"), lambda u: F.struct(F.size(F.filter("_v", lambda w: w == u)).alias("n"), (-u).alias("u")))
    return g.select(*grid.KEY, (-F.array_max(counted)["u"]).alias("smoothed"))


def diffuse(pixels: DataFrame, value: str, weight: str, rounds: int, scratch) -> DataFrame:
    """Soft labels spread: each round a pixel takes the mean of its 4-neighbours and itself, weighted by
    exp(-(difference of ``weight``) ^ 2 / 2 * 20 ^ 2)."""
    off = grid.circular(1.0)
    for _ in range(rounds):
        g = grid.neighbourhood(pixels, off, [value, weight], F.max(F.when(F.col("k") == 0, F.col(weight))).alias(weight), F.collect_list(F.struct(F.col(value).alias("v"), F.col(weight).alias("w"))).alias("_n"))
        k = F.transform("_n", lambda n: F.struct(n["v"].alias("v"), F.exp(-((n["w"] - F.col(weight)) ** 2) / 800.0).alias("k")))
        top, bottom = (F.aggregate(k, F.lit(0.0), f) for f in (lambda s, e: s + e["v"] * e["k"], lambda s, e: s + e["k"]))
        pixels = scratch.put(g.select(*grid.KEY, weight, F.round(top / bottom, 9).alias(value)))
    return pixels


def surface_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, asd, assd): mean distance from the border of mask a to that of b, and the mean of both
    directions. Both have image_id, x, y and v (0 or 1) on the same pixels. Border: a pixel of the mask
    with a 4-neighbour off it. Images where a border is missing are left out."""

    def edge(p: DataFrame) -> DataFrame:
        g = grid.neighbourhood(p, grid.circular(1.0), ["v"], F.max(F.when(F.col("k") == 0, F.col("v"))).alias("_c"), F.min("v").alias("_lo"), F.count(F.lit(1)).alias("_n"))
        return g.select(*grid.KEY, ((F.col("_c") == 1) & ((F.col("_lo") == 0) | (F.col("_n") < 5))).alias("e"))

    ea, eb = edge(a), edge(b)

    def one(frm: DataFrame, to: DataFrame) -> DataFrame:
        d = grid.distance_transform(to, F.col("e"))
        return frm.where("e").join(d, list(grid.KEY)).groupBy("image_id").agg(F.avg(F.sqrt("d2")).alias("m"))

    ab, ba = one(ea, eb).withColumnRenamed("m", "ab"), one(eb, ea).withColumnRenamed("m", "ba")
    return ab.join(ba, "image_id").where("ab IS NOT NULL AND ba IS NOT NULL").select("image_id", F.round("ab", 6).alias("asd"), F.round((F.col("ab") + F.col("ba")) / 2, 6).alias("assd"))


def boundary_recall(pixels: DataFrame, superpixel: str, label: str, reach: int = 1) -> DataFrame:
    """Share of the true borders that have a superpixel border within ``reach`` pixels, per image."""
    t = grid.border(pixels, label).select(*grid.KEY)
    s = grid.border(pixels, superpixel).select(*grid.KEY, F.lit(1).alias("v"))
    near = grid.box(pixels.select(*grid.KEY).join(s, list(grid.KEY), "left").select(*grid.KEY, F.coalesce("v", F.lit(0)).alias("v")), "v", reach, "max")
    return t.join(near, list(grid.KEY)).groupBy("image_id").agg(F.round(F.avg("v"), 6).alias("boundary_recall"))


def topology_points(skeleton: DataFrame) -> DataFrame:
    """End points (one neighbour) and junctions (three or more) of skeleton pixels (image_id, x, y)."""
    g = grid.neighbourhood(skeleton.withColumn("_one", F.lit(1)), grid.circular(1.5), ["_one"], F.count(F.lit(1)).alias("n"))
    return g.select(*grid.KEY, F.when(F.col("n") == 2, "end").when(F.col("n") >= 4, "junction").alias("kind")).where("kind IS NOT NULL")


def skeleton(pixels: DataFrame, mask: str) -> DataFrame:
    """Thinning of each image's mask until it is one pixel wide (two alternating passes a round)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf)
        a = np.zeros((img.y.max() + 3, img.x.max() + 3), dtype=bool)
        a[img.y + 1, img.x + 1] = img.values(mask) != 0
        moved = True
        while moved:
            moved = False
            for turn in (0, 1):
                p = [np.roll(a, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]  # N, NE, E, SE, S, SW, W, NW
                n = sum(q.astype(int) for q in p)
                steps = sum((~p[i] & p[(i + 1) % 8]).astype(int) for i in range(8))
                north, east, south, west = p[0], p[2], p[4], p[6]
                first, second = (north & east & south, east & south & west) if turn == 0 else (north & east & west, north & south & west)
                gone = a & (n >= 2) & (n <= 6) & (steps == 1) & ~first & ~second
                if gone.any():
                    a &= ~gone
                    moved = True
        return img.out(skeleton=a[img.y + 1, img.x + 1].astype("int32"))

    return per_image(pixels, run, "skeleton int")


def _hull(pdf: pd.DataFrame) -> pd.DataFrame:
    """The corners of the convex hull of the points (x, y)."""
    pts = sorted(set(zip(pdf["x"], pdf["y"])))
    corners = []
    for run in (pts, pts[::-1]):
        side = []
        for x, y in run:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (y - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (x - side[-2][0]):
                side.pop()
            side.append((x, y))
        corners += side
    return pdf.iloc[[0] * len(corners)].assign(x=[c[0] for c in corners], y=[c[1] for c in corners])


def furthest_pair(points: DataFrame, by: str) -> DataFrame:
    """Diameter of each group of points, exact: the ends of each row of points, the convex hulls of 16
    parts of a group, then the pairs of corners of the hull of these."""
    kind = points.schema[by].dataType.simpleString()
    ends = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(by, F.col("y").cast("double").alias("y")).agg(F.array(F.min("x").cast("double"), F.max("x").cast("double")).alias("x"))
    ends = ends.select(by, F.explode("x").alias("x"), "y")

    def diameter(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf)[["x", "y"]].to_numpy()
        d = max(float(((h[i : i + 500, None] - h[None]) ** 2).sum(2).max()) for i in range(0, len(h), 500))
        return pd.DataFrame({by: pdf[by].iloc[:1], "diameter": [d**0.5]})

    schema = f"`{by}` {kind}, x double, y double"
    parts = ends.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(16))).groupBy(by, "_part").applyInPandas(lambda pdf: _hull(pdf.drop(columns="_part")), schema)
    return parts.groupBy(by).applyInPandas(diameter, f"`{by}` {kind}, diameter double").select(by, F.round("diameter", 6).alias("diameter"))


def intensity_profile(pixels: DataFrame, value: str, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Values along a straight line of pixels: (image_id, step, value)."""
    n = max(abs(end[0] - start[0]), abs(end[1] - start[1]), 1)
    line = [(i, round(start[0] + (end[0] - start[0]) * i / n), round(start[1] + (end[1] - start[1]) * i / n)) for i in range(n + 1)]
    steps = pixels.sparkSession.createDataFrame(line, "step int, x int, y int")
    return pixels.join(F.broadcast(steps), ["x", "y"]).select("image_id", "step", value)  # a row a pixel of the line


def region_centres(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Member of each region nearest to its centroid, ties to the first in scan order."""
    c = pixels.groupBy(*by).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    d = (F.col("x") - F.col("_cx")) ** 2 + (F.col("y") - F.col("_cy")) ** 2
    return pixels.join(c, list(by)).groupBy(*by).agg(F.min_by(F.struct("x", "y"), F.struct(F.round(d, 9), "y", "x")).alias("c")).select(*by, "c.x", "c.y")


def local_threshold(pixels: DataFrame, value: str, offsets: Sequence[tuple[int, int]], share: float, above: bool = True) -> DataFrame:
    """1 where the value is above (below) ``share`` times the mean of its neighbourhood."""
    g = grid.neighbourhood(pixels, offsets, [value], F.avg(value).alias("_m"), F.max(F.when(F.col("k") == 0, F.col(value))).alias("_c"))
    hit = F.col("_c") > F.col("_m") * share if above else F.col("_c") < F.col("_m") * share
    return g.select(*grid.KEY, hit.cast("int").alias("selected"))


def mode_over_time(frames: DataFrame, value: str) -> DataFrame:
    """Per pixel of an image sequence: mean, commonest value and change over the frames (column t)."""
    w = Window.partitionBy("x", "y").orderBy("t")
    d = frames.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w)))
    return d.groupBy("x", "y").agg(F.round(F.avg(value), 6).alias("mean"), F.coalesce(F.sum("_d"), F.lit(0)).alias("change"), F.count(F.lit(1)).alias("frames"))
