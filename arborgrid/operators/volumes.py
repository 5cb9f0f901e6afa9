"""Volumes as voxel tables (image_id, x, y, z, value columns), and sequences of them (t).

Slices, boxes, frames, shifts, resampling and neighbour differences are selections, moves of
coordinates and aggregates. Voxels outside a volume's table are absent; null values take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
Box = Sequence[tuple[int, int]]


def plane(voxels: DataFrame, axis: str, at: int) -> DataFrame:
    """The slice at a place of an axis, as an image: the two other axes, in order, become x and y."""
    u, v = (a for a in AXES if a != axis)
    rest = [c for c in voxels.columns if c not in AXES]
    return voxels.where(F.col(axis) == at).select(*rest, F.col(u).alias("x"), F.col(v).alias("y"))


def put_plane(voxels: DataFrame, image: DataFrame, axis: str, at: int, value: str) -> DataFrame:
    """``voxels`` with a slice's values taken from an image (image_id, x, y, value) where it has them."""
    u, v = (a for a in AXES if a != axis)
    new = image.select("image_id", F.col("x").alias(u), F.col("y").alias(v), F.lit(at).alias(axis), F.col(value).alias("_new"))
    return voxels.join(new, ["image_id", *AXES], "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def box(voxels: DataFrame, ranges: Box) -> DataFrame:
    """The voxels of a closed box, moved to start at 0."""
    inside = voxels
    for a, (lo, hi) in zip(AXES, ranges):
        inside = inside.where(F.col(a).between(lo, hi))
    return move(inside, [-lo for lo, _ in ranges])


def move(voxels: DataFrame, by: Sequence[int]) -> DataFrame:
    return voxels.withColumns({a: (F.col(a) + d).cast("int") for a, d in zip(AXES, by)})


def insert(voxels: DataFrame, part: DataFrame, at: Sequence[int], value: str) -> DataFrame:
    """``voxels`` with the values of a smaller volume laid over them from a corner on; what lies outside
    is dropped."""
    new = move(part, at).select("image_id", *AXES, F.col(value).alias("_new"))
    return voxels.join(new, ["image_id", *AXES], "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def extent(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("image_id").agg(*[F.max(a).alias(f"m{a}") for a in AXES])


def shift(voxels: DataFrame, by: Sequence[int]) -> DataFrame:
    """Moved, keeping the volume's extent: what leaves it is dropped."""
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(0, F.col(f"m{a}"))
    return move(voxels.join(extent(voxels), "image_id"), by).where(inside).drop(*[f"m{a}" for a in AXES])


def add_frame(voxels: DataFrame, width: int, fill: float, value: str) -> DataFrame:
    """A frame of ``width`` voxels of a value around each volume."""
    e = extent(voxels)
    cells = e.select("image_id", *[F.col(f"m{a}") for a in AXES])
    for a in AXES:
        cells = cells.withColumn(a, F.explode(F.sequence(F.lit(0), (F.col(f"m{a}") + 2 * width).cast("int"))))
    outside = F.lit(False)
    for a in AXES:
        outside = outside | (F.col(a) < width) | (F.col(a) > F.col(f"m{a}") + width)
    kind = voxels.schema[value].dataType
    frame = cells.where(outside).select("image_id", *AXES, F.lit(fill).cast(kind).alias(value))
    return move(voxels.select("image_id", *AXES, value), [width] * 3).unionByName(frame)


def remove_frame(voxels: DataFrame, width: int) -> DataFrame:
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(width, F.col(f"m{a}") - width)
    return move(voxels.join(extent(voxels), "image_id").where(inside).drop(*[f"m{a}" for a in AXES]), [-width] * 3)


def resample(voxels: DataFrame, value: str, scales: Sequence[float], nearest: bool = False, digits: int = 6) -> DataFrame:
    """Trilinear (or nearest) resampling to sizes floor(size * scale): a target place lies at
    place / scale in the source, held inside it. Axis by axis, each source voxel sends its weight to
    the targets within a step, so a pass is one aggregate."""
    out = voxels.select("image_id", *AXES, F.col(value).cast("double").alias(value))
    for a, s in zip(AXES, scales):
        if s == 1:
            continue
        others = [b for b in AXES if b != a]
        top = out.groupBy("image_id").agg(F.max(a).alias("_m"))
        p = out.join(top, "image_id")
        last = F.floor((F.col("_m") + 1) * s) - 1
        lo, hi = F.greatest(F.ceil((F.col(a) - 1) * s), F.lit(0)), F.when(F.col(a) == F.col("_m"), last).otherwise(F.least(F.floor((F.col(a) + 1) * s), last))
        p = p.where(lo <= hi).withColumn("_t", F.explode(F.sequence(lo, hi)))
        at = F.least(F.col("_t") / s, F.col("_m").cast("double"))
        w = F.when(F.floor(at + 0.5) == F.col(a), 1.0).otherwise(0.0) if nearest else F.greatest(1 - F.abs(at - F.col(a)), F.lit(0.0))
        p = p.withColumn("_w", w).where("_w > 0")
        out = p.groupBy("image_id", *others, F.col("_t").cast("int").alias(a)).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))
    return out.select("image_id", *AXES, F.round(value, digits).alias(value))


def reslice(voxels: DataFrame, m: Sequence[Sequence[float]], by: Sequence[float]) -> DataFrame:
    """Voxels moved by a 3 x 3 matrix and a shift, rounded; of voxels that fall together the one first in
    (z, y, x) order stays, and what leaves the extent is dropped."""
    target = [F.floor(sum((F.col(a) * float(k) for a, k in zip(AXES, row)), F.lit(float(t))) + 0.5).cast("int") for row, t in zip(m, by)]
    moved = voxels.join(extent(voxels), "image_id").withColumns({f"_t{a}": t for a, t in zip(AXES, target)})
    for a in AXES:
        moved = moved.where(F.col(f"_t{a}").between(0, F.col(f"m{a}")))
    rest = [c for c in voxels.columns if c not in ("image_id", *AXES)]
    g = moved.groupBy("image_id", *[f"_t{a}" for a in AXES]).agg(F.min_by(F.struct(*rest), F.struct("z", "y", "x")).alias("r"))
    return g.select("image_id", *[F.col(f"_t{a}").alias(a) for a in AXES], "r.*")


#: The six voxels that share a side, and the voxel itself.
SIX = ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def neighbourhood(voxels: DataFrame, value: str, *aggs: Column, offsets: Sequence[tuple[int, int, int]] = SIX) -> DataFrame:
    """Aggregates of ``k`` (number of the offset, 0 the voxel itself) and the value over neighbours."""
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), *[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o)]) for i, o in enumerate(offsets)]))
    sent = voxels.select("image_id", *AXES, value, table.alias("d")).select("image_id", *[(F.col(a) - F.col(f"d.d{a}")).cast("int").alias(a) for a in AXES], F.col("d.k").alias("k"), value)
    return sent.groupBy("image_id", *AXES).agg(F.max(F.col("k") == 0).alias("_here"), *aggs).where("_here").drop("_here")


def gradient(voxels: DataFrame, value: str) -> DataFrame:
    """Morphological gradient (largest less smallest value) over the six neighbours, and whether the voxel
    lies on the border (a neighbour is missing or differs)."""
    g = neighbourhood(voxels, value, (F.max(value) - F.min(value)).alias("gradient"), F.count(F.lit(1)).alias("_n"))
    return g.select("image_id", *AXES, "gradient", ((F.col("gradient") != 0) | (F.col("_n") < len(SIX))).alias("border"))


def over_time(frames: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Of every frame (image_id, t): least and greatest value, and voxels whose value lies in a closed range."""
    return frames.groupBy("image_id", "t").agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count_if(F.col(value).between(low, high)).alias("inside"), F.count(F.lit(1)).alias("voxels"))


def normalise_frames(frames: DataFrame, value: str, top: float, digits: int = 6) -> DataFrame:
    """Values of each sequence scaled to 0..top over all its frames."""
    r = frames.groupBy("image_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * top).otherwise(0.0)
    return frames.join(r, "image_id").withColumn(value, F.round(v, digits)).drop("_lo", "_hi")
