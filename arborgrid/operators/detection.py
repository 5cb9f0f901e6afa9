"""Boxes of labelled regions and matching of detected with true boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborgrid.functions import boxes


def bounding_boxes(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Smallest box and pixel count of each group."""
    return df.groupBy(*by).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"), F.count(F.lit(1)).alias("area"))


def enclosing_box(bbs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return bbs.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def match(truth: DataFrame, found: DataFrame, image: str, cell: int = 64) -> DataFrame:
    """(image, true_id, found_id, iou) of the pairs that overlap.

    A range join by grid cells: each box is sent to the cells it touches, boxes meet by image and
    cell, and a pair is kept in the cell of its intersection's corner, so it comes out once. Boxes
    with a null corner meet nothing.
    """

    def cells(df: DataFrame, p: str) -> DataFrame:
        x = F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))
        d = df.where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 >= x0 AND y1 >= y0").withColumn("_cx", x)
        d = d.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
        return d.select(image, "_cx", "_cy", F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")])

    pairs = cells(truth, "true").join(cells(found, "found"), [image, "_cx", "_cy"])
    a, b = boxes.box("true_"), boxes.box("found_")
    home = (F.floor(F.greatest(a[0], b[0]) / cell) == F.col("_cx")) & (F.floor(F.greatest(a[1], b[1]) / cell) == F.col("_cy"))
    return pairs.where(home & (boxes.intersection(a, b) > 0)).select(image, "true_id", "found_id", F.round(boxes.iou(a, b), 6).alias("iou"))


def evaluate(truth: DataFrame, found: DataFrame, image: str, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold and image: true boxes met (IoU above it), missed, and detections that meet none.

    A detection is wrong only if it meets no true box, so the figure can't become negative.
    """
    pairs = match(truth, found, image)
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    hits = pairs.select(image, "true_id", "found_id", "iou", t).where(F.col("iou") > F.col("threshold"))
    met = hits.groupBy("threshold", image).agg(F.countDistinct("true_id").alias("found"), F.countDistinct("found_id").alias("good"))
    n = truth.groupBy(image).agg(F.count(F.lit(1)).alias("nt")).join(found.groupBy(image).agg(F.count(F.lit(1)).alias("nf")), image, "full")
    grid = n.select(image, F.coalesce("nt", F.lit(0)).alias("nt"), F.coalesce("nf", F.lit(0)).alias("nf"), t)
    j = grid.join(met, ["threshold", image], "left")
    f, g = F.coalesce("found", F.lit(0)), F.coalesce("good", F.lit(0))
    return j.select("threshold", image, f.alias("found"), (F.col("nt") - f).alias("missed"), (F.col("nf") - g).alias("wrong"))
