"""Regions of label images: graphs of adjacent regions, their classification, morphology of masks,
holes, masks joined, and components of errors.

Pixels have image_id, x, y, a label or mask column and values; see operators.grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborgrid.operators import graphs, grid
from arborgrid.plans import Scratch

KEY = ("image_id", "x", "y")


def region_graph(pixels: DataFrame, region: str, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (image_id, region, area, mean of each value) and arcs (image_id, a, b, w): adjacent regions,
    w the Euclidean distance of their means."""
    nodes = pixels.groupBy("image_id", F.col(region).alias("region")).agg(F.count(F.lit(1)).alias("area"), *[F.avg(v).alias(v) for v in values])
    pairs = grid.region_adjacency(pixels.select(*KEY, region), region).select("image_id", "a", "b")
    left = nodes.select("image_id", F.col("region").alias("a"), *[F.col(v).alias(f"_a_{v}") for v in values])
    right = nodes.select("image_id", F.col("region").alias("b"), *[F.col(v).alias(f"_b_{v}") for v in values])
    d = sum(((F.col(f"_a_{v}") - F.col(f"_b_{v}")) ** 2 for v in values), F.lit(0.0))
    return nodes, pairs.join(left, ["image_id", "a"]).join(right, ["image_id", "b"]).select("image_id", "a", "b", F.sqrt(d).alias("w"))


def geodesic_weight(w: Column, beta: float = 1.0) -> Column:
    """Arc of the additive variant: 1 - exp(-w / 0.5), to a power."""
    return F.pow(1 - F.exp(-w / 0.5), F.lit(float(beta)))


def classify_regions(arcs: DataFrame, seeds: DataFrame, scratch: Scratch, additive: bool = False) -> DataFrame:
    """(image_id, region, label, cost): labels spread from seeds (image_id, region, label) over the graph of
    adjacent regions, by the least largest arc or, ``additive``, the least sum."""
    node = lambda c: F.shiftleft(F.col("image_id").cast("long"), 40) + F.col(c).cast("long")
    edges = arcs.select(node("a").alias("a"), node("b").alias("b"), "w")
    start = seeds.select(node("region").alias("id"), F.col("label").cast("int").alias("label"), F.lit(0.0).alias("cost"))
    f = graphs.path_forest(edges, start, scratch, graphs.fsum if additive else graphs.fmax)
    return f.select(F.shiftright("id", 40).alias("image_id"), F.col("id").bitwiseAND(F.lit((1 << 40) - 1)).alias("region"), "label", "cost")


def relabel(pixels: DataFrame, region: str) -> DataFrame:
    """Regions numbered 1.. in each image by name; region 0 (background) stays."""
    names = pixels.where(F.col(region) != 0).select("image_id", region).distinct()
    numbered = names.withColumn("_n", F.row_number().over(Window.partitionBy("image_id").orderBy(region)))  # a row a region
    return pixels.join(numbered, ["image_id", region], "left").withColumn(region, F.coalesce("_n", F.lit(0)).cast("int")).drop("_n")


def join_masks(masks: DataFrame, mask: str, intersection: bool = False) -> DataFrame:
    """Union (or intersection) over all images of masks on one domain: (x, y, mask)."""
    return masks.groupBy("x", "y").agg((F.min if intersection else F.max)(F.when(F.col(mask) != 0, 1).otherwise(0)).alias(mask))


def dilate_mask(pixels: DataFrame, mask: str, radius: float, out: str = "dilated") -> DataFrame:
    """1 within ``radius`` of a mask pixel, by the exact distance transform, whatever the radius."""
    d = grid.distance_transform(pixels, F.col(mask) != 0)
    return d.select(*KEY, F.coalesce(F.col("d2") <= radius * radius, F.lit(False)).cast("int").alias(out))


def erode_mask(pixels: DataFrame, mask: str, radius: float, out: str = "eroded") -> DataFrame:
    """0 within ``radius`` of a pixel off the mask; outside the image doesn't count."""
    d = grid.distance_transform(pixels, F.coalesce(F.col(mask), F.lit(0)) == 0)
    return d.select(*KEY, F.coalesce(F.col("d2") > radius * radius, F.lit(True)).cast("int").alias(out))


def open_mask(pixels: DataFrame, mask: str, radius: float, out: str = "opened") -> DataFrame:
    return dilate_mask(erode_mask(pixels, mask, radius, "_e"), "_e", radius, out)


def close_mask(pixels: DataFrame, mask: str, radius: float, out: str = "closed") -> DataFrame:
    return erode_mask(dilate_mask(pixels, mask, radius, "_d"), "_d", radius, out)


def fill_holes(pixels: DataFrame, mask: str, scratch: Scratch) -> DataFrame:
    """(image_id, x, y, filled): the mask and the background components that don't touch the image's edge."""
    off = graphs.grid_components(pixels.where(F.coalesce(F.col(mask), F.lit(0)) == 0), scratch)
    size = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    edge = F.col("x").isin(0) | F.col("y").isin(0) | (F.col("x") == F.col("mx")) | (F.col("y") == F.col("my"))
    open_ = off.join(size, "image_id").groupBy("root").agg(F.max(edge).alias("open"))
    holes = off.join(open_.where("NOT open"), "root").select(*KEY, F.lit(1).alias("_hole"))
    return pixels.select(*KEY, mask).join(holes, list(KEY), "left").select(*KEY, F.when(F.col(mask) != 0, 1).otherwise(F.coalesce("_hole", F.lit(0))).alias("filled"))


def error_components(pixels: DataFrame, label: str, truth: str, scratch: Scratch) -> DataFrame:
    """(image_id, root, area, rank): components of pixels with a wrong label, largest first in each image."""
    wrong = graphs.grid_components(pixels.where(F.col(label) != F.col(truth)), scratch)
    n = wrong.groupBy("image_id", "root").agg(F.count(F.lit(1)).alias("area"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "root")))  # a row a component


def robot_seeds(pixels: DataFrame, label: str, truth: str, scratch: Scratch, least: int = 1) -> DataFrame:
    """(image_id, x, y, label): in each component of errors of at least ``least`` pixels the pixel deepest
    inside it, first in scan order, with its true label."""
    wrong = scratch.put(graphs.grid_components(pixels.where(F.col(label) != F.col(truth)), scratch))
    deep = grid.distance_transform(pixels, F.col(label) == F.col(truth))
    met = wrong.join(deep, list(KEY)).join(pixels.select(*KEY, F.col(truth).alias("_t")), list(KEY))
    best = met.groupBy("image_id", "root").agg(F.count(F.lit(1)).alias("area"), F.min_by(F.struct("x", "y", F.col("_t").alias("label")), F.struct(-F.coalesce("d2", F.lit(0)), "y", "x")).alias("s"))
    return best.where(F.col("area") >= least).select("image_id", "s.*")


def top_hat(pixels: DataFrame, value: str, r: int = 1) -> DataFrame:
    """Value less its opening (``white``) and closing less value (``black``) by a (2r + 1) square."""
    o = grid.opening(pixels, value, r).withColumnRenamed(value, "_o")
    c = grid.closing(pixels, value, r).withColumnRenamed(value, "_c")
    met = pixels.select(*KEY, value).join(o, list(KEY)).join(c, list(KEY))
    return met.select(*KEY, (F.col(value) - F.col("_o")).alias("white"), (F.col("_c") - F.col(value)).alias("black"))
