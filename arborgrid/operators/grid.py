"""Images as pixel tables (image, x, y, value columns) and operators on pixel neighbourhoods.

A neighbourhood operator sends each pixel's value to the pixels that have it as a neighbour
(``explode`` of the displacement set) and aggregates by target pixel: one shuffle, partial
aggregation before it, no self join. Displacements that would leave the table's pixels are
filtered after the aggregate, because only a pixel itself brings displacement 0. Box shaped
operators are split into a row pass and a column pass (bounded windows), whose cost does not
depend on the radius. Pixels outside the image take no part; null values neither.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("image_id", "x", "y")
Offsets = Sequence[tuple[int, int]]


def circular(radius: float) -> list[tuple[int, int]]:
    """Displacements within a radius, the centre first, then by distance, row, column."""
    r = int(radius)
    pts = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= radius * radius + 1e-9]
    return sorted(pts, key=lambda p: (p[0] ** 2 + p[1] ** 2, p[1], p[0]))


def rectangular(width: int, height: int) -> list[tuple[int, int]]:
    pts = [(dx, dy) for dy in range(-(height // 2), height // 2 + 1) for dx in range(-(width // 2), width // 2 + 1)]
    return sorted(pts, key=lambda p: (p[0] ** 2 + p[1] ** 2, p[1], p[0]))


def clockwise(radius: float = 1.5) -> list[tuple[int, int]]:
    """Neighbours in clockwise order from the right, without the centre."""
    return sorted([p for p in circular(radius) if p != (0, 0)], key=lambda p: math.atan2(p[1], p[0]) % (2 * math.pi))


def gaussian_kernel(radius: int, sigma: float) -> list[tuple[int, int, float]]:
    ks = [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))) for dx, dy in rectangular(2 * radius + 1, 2 * radius + 1)]
    total = sum(k[2] for k in ks)
    return [(dx, dy, w / total) for dx, dy, w in ks]


def sobel_kernels() -> tuple[list[tuple[int, int, float]], list[tuple[int, int, float]]]:
    gx = [(dx, dy, float(dx * (2 if dy == 0 else 1))) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx]
    return gx, [(dy, dx, w) for dx, dy, w in gx]


def spread(pixels: DataFrame, offsets: Offsets, cols: Sequence[str]) -> DataFrame:
    """(image_id, x, y, k, cols): the value of displacement ``k`` of pixel (x, y) where it exists."""
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(offsets)]))
    sent = pixels.select(*KEY, *cols, table.alias("d"))
    return sent.select("image_id", (F.col("x") - F.col("d.dx")).cast("int").alias("x"), (F.col("y") - F.col("d.dy")).cast("int").alias("y"), F.col("d.k").alias("k"), *cols)


def neighbourhood(pixels: DataFrame, offsets: Offsets, cols: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregate the neighbourhood of each pixel; ``offsets`` must hold (0, 0). The aggregates see
    ``k`` (index of the displacement) and ``cols``."""
    zero = list(offsets).index((0, 0))
    g = spread(pixels, offsets, cols).groupBy(*KEY).agg(F.max(F.col("k") == zero).alias("_here"), *aggs)
    return g.where("_here").drop("_here")


def correlate(pixels: DataFrame, kernel: Sequence[tuple[int, int, float]], value: str, out: str = "filtered", digits: int = 6) -> DataFrame:
    """Linear filter: sum of weight * neighbour; outside counts as 0."""
    full = list(kernel) if any(k[:2] == (0, 0) for k in kernel) else [*kernel, (0, 0, 0.0)]
    weights = F.array(*[F.lit(float(w)) for *_, w in full])
    return neighbourhood(pixels, [k[:2] for k in full], [value], F.round(F.sum(F.get(weights, F.col("k")) * F.col(value)), digits).alias(out))


def sobel(pixels: DataFrame, value: str) -> DataFrame:
    gx, gy = sobel_kernels()
    offsets = rectangular(3, 3)
    wx, wy = ({(dx, dy): w for dx, dy, w in k} for k in (gx, gy))
    ax, ay = (F.array(*[F.lit(w.get(o, 0.0)) for o in offsets]) for w in (wx, wy))
    g = neighbourhood(pixels, offsets, [value], F.sum(F.get(ax, F.col("k")) * F.col(value)).alias("gx"), F.sum(F.get(ay, F.col("k")) * F.col(value)).alias("gy"))
    return g.select(*KEY, F.round(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2), 6).alias("magnitude"))


def rank_filters(pixels: DataFrame, offsets: Offsets, value: str) -> DataFrame:
    """Mean, upper median and mode (smallest among equals) of each neighbourhood; only pixels inside
    the image count."""
    vs = F.sort_array(F.collect_list(value)).alias("_v")
    g = neighbourhood(pixels, offsets, [value], F.round(F.avg(value), 6).alias("mean"), vs)
    median = F.get("_v", F.floor(F.size("_v") / 2).cast("int"))
    counted = F.transform(F.array_distinct("_v"), lambda u: F.struct(F.size(F.filter("_v", lambda w: w == u)).alias("n"), (-u).alias("u")))
    return g.select(*KEY, "mean", median.alias("median"), (-F.array_max(counted)["u"]).alias("mode"))


def _pass(pixels: DataFrame, value: str, agg, r: int, along: str) -> Column:
    other = "y" if along == "x" else "x"
    return agg(value).over(Window.partitionBy("image_id", other).orderBy(along).rangeBetween(-r, r))


def box(pixels: DataFrame, value: str, r: int, how: str) -> DataFrame:
    """Minimum, maximum or sum over a (2r + 1) square, by a row and a column pass."""
    agg = {"min": F.min, "max": F.max, "sum": F.sum}[how]
    rows = pixels.select(*KEY, _pass(pixels, value, agg, r, "x").alias("_v"))
    return rows.select(*KEY, _pass(rows, "_v", agg, r, "y").alias(value))


def dilate(pixels: DataFrame, value: str, r: int = 1) -> DataFrame:
    return box(pixels, value, r, "max")


def erode(pixels: DataFrame, value: str, r: int = 1) -> DataFrame:
    return box(pixels, value, r, "min")


def opening(pixels: DataFrame, value: str, r: int = 1) -> DataFrame:
    return dilate(erode(pixels, value, r), value, r)


def closing(pixels: DataFrame, value: str, r: int = 1) -> DataFrame:
    return erode(dilate(pixels, value, r), value, r)


def alternating(pixels: DataFrame, value: str, r: int, open_first: bool = True) -> DataFrame:
    """Alternate sequential filter: opening then closing (or the reverse) of growing radius."""
    for i in range(1, r + 1):
        pixels = closing(opening(pixels, value, i), value, i) if open_first else opening(closing(pixels, value, i), value, i)
    return pixels


def flat_morphology(pixels: DataFrame, offsets: Offsets, value: str) -> DataFrame:
    """Dilation, erosion and morphological gradient by any displacement set."""
    return neighbourhood(pixels, offsets, [value], F.max(value).alias("dilated"), F.min(value).alias("eroded"), (F.max(value) - F.min(value)).alias("gradient"))


def local_binary_pattern(pixels: DataFrame, value: str, radius: float = 1.5) -> DataFrame:
    """Bit i is set where the i-th clockwise neighbour exists and is greater than the centre."""
    offsets = [(0, 0), *clockwise(radius)]
    g = neighbourhood(pixels, offsets, [value], F.max(F.when(F.col("k") == 0, F.col(value))).alias("_c"), F.collect_list(F.when(F.col("k") > 0, F.struct("k", F.col(value).alias("v")))).alias("_n"))
    code = F.aggregate("_n", F.lit(0).cast("long"), lambda s, n: s + F.when(n["v"] > F.col("_c"), F.pow(F.lit(2.0), n["k"] - 1).cast("long")).otherwise(0))
    return g.select(*KEY, code.cast("int").alias("lbp"))


def integral(pixels: DataFrame, value: str) -> DataFrame:
    """Summed-area table: running sums along rows, then along columns."""
    w = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    rows = pixels.select(*KEY, F.sum(value).over(w).alias("_s"))
    w = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*KEY, F.sum("_s").over(w).alias("integral"))


def box_sums(table: DataFrame, r: int) -> DataFrame:
    """Sum over the (2r + 1) square about each pixel from a summed-area table, clipped to the image."""
    lim = table.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    t = table.join(lim, "image_id").select("*", *[F.least(F.col(c) + r, F.col(m)).alias(f"{c}1") for c, m in (("x", "mx"), ("y", "my"))], (F.col("x") - r - 1).alias("xa"), (F.col("y") - r - 1).alias("ya"))
    corners = F.explode(F.array(*[F.struct(F.col(a).cast("int").alias("cx"), F.col(b).cast("int").alias("cy"), F.lit(s).alias("s")) for a, b, s in (("x1", "y1", 1), ("xa", "y1", -1), ("x1", "ya", -1), ("xa", "ya", 1))]))
    asked = t.select(*KEY, corners.alias("c")).select(*KEY, "c.*")
    values = table.select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "integral")
    return asked.join(values, ["image_id", "cx", "cy"], "left").groupBy(*KEY).agg(F.sum(F.col("s") * F.coalesce("integral", F.lit(0))).alias("box_sum"))


def pool(pixels: DataFrame, value: str, size: int, stride: int | None = None) -> DataFrame:
    """Max and average pooling; windows at multiples of the stride, inside the image or clipped."""
    stride = stride or size
    if stride == size:
        return pixels.groupBy("image_id", F.floor(F.col("x") / size).cast("int").alias("x"), F.floor(F.col("y") / size).cast("int").alias("y")).agg(F.max(value).alias("max_pool"), F.round(F.avg(value), 6).alias("avg_pool"))
    offsets = [(dx, dy) for dy in range(size) for dx in range(size)]
    g = neighbourhood(pixels, offsets, [value], F.max(value).alias("max_pool"), F.round(F.avg(value), 6).alias("avg_pool"))
    return g.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0))


def border(pixels: DataFrame, label: str, offsets: Offsets | None = None) -> DataFrame:
    """Pixels with a neighbour of another label or outside the image."""
    offsets = offsets or circular(1.0)
    g = neighbourhood(pixels, offsets, [label], F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("k") == 0, F.col(label))).alias(label))
    return g.where((F.col("_lo") != F.col("_hi")) | (F.col("_n") < len(offsets))).select(*KEY, label)


def region_adjacency(pixels: DataFrame, label: str, offsets: Offsets | None = None) -> DataFrame:
    """Pairs of labels (a < b) that touch, and how many pixel sides they share."""
    half = [o for o in (offsets or circular(1.0)) if o > (0, 0)]
    sent = spread(pixels, [(0, 0), *half], [label])
    g = sent.groupBy(*KEY).agg(F.max(F.when(F.col("k") == 0, F.col(label))).alias("_c"), F.collect_list(F.when(F.col("k") > 0, F.col(label))).alias("_n")).where("_c IS NOT NULL")
    e = g.select("image_id", "_c", F.explode("_n").alias("_o")).where(F.col("_c") != F.col("_o"))
    return e.groupBy("image_id", F.least("_c", "_o").alias("a"), F.greatest("_c", "_o").alias("b")).agg(F.count(F.lit(1)).alias("sides"))


def grid_edges(pixels: DataFrame, value: str, offsets: Offsets | None = None) -> DataFrame:
    """(image_id, px, py, qx, qy, vp, vq) of neighbouring pixels, each pair once."""
    half = [o for o in (offsets or circular(1.0)) if o > (0, 0)]
    dx, dy = (F.array(*[F.lit(o[i]) for o in [(0, 0), *half]]) for i in (0, 1))
    g = spread(pixels, [(0, 0), *half], [value]).groupBy(*KEY).agg(F.max(F.when(F.col("k") == 0, F.col(value))).alias("vp"), F.collect_list(F.when(F.col("k") > 0, F.struct("k", F.col(value).alias("v")))).alias("_n"))
    e = g.where("vp IS NOT NULL").select(*KEY, "vp", F.explode("_n").alias("n"))
    return e.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") + F.get(dx, F.col("n.k"))).alias("qx"), (F.col("y") + F.get(dy, F.col("n.k"))).alias("qy"), "vp", F.col("n.v").alias("vq"))


def regional_extrema(pixels: DataFrame, value: str, scratch, offsets: Offsets | None = None) -> DataFrame:
    """Plateaus without a higher (lower) neighbour: pixels with is_max and is_min."""
    from arborgrid.operators.graphs import connected_components, pixel_id

    e = scratch.put(grid_edges(pixels, value, offsets).select(pixel_id("image_id", "px", "py").alias("a"), pixel_id("image_id", "qx", "qy").alias("b"), "vp", "vq"))
    roots = connected_components(e.where("vp = vq").select("a", "b"), scratch)
    ids = pixels.select(*KEY, pixel_id("image_id", "x", "y").alias("id")).join(roots, "id", "left").select(*KEY, "id", F.coalesce("root", "id").alias("root"))
    ids = scratch.put(ids)
    lesser = e.where("vp <> vq").select(F.when(F.col("vp") < F.col("vq"), F.col("a")).otherwise(F.col("b")).alias("id"), F.lit(True).alias("below"))
    greater = e.where("vp <> vq").select(F.when(F.col("vp") > F.col("vq"), F.col("a")).otherwise(F.col("b")).alias("id"), F.lit(True).alias("above"))
    flags = ids.join(lesser.distinct(), "id", "left").join(greater.distinct(), "id", "left").groupBy("root").agg(F.max("below").alias("below"), F.max("above").alias("above"))
    return ids.join(flags, "root").select(*KEY, F.col("below").isNull().alias("is_max"), F.col("above").isNull().alias("is_min"))


def distance_transform(pixels: DataFrame, is_seed: Column) -> DataFrame:
    """Exact squared Euclidean distance to the nearest seed of the image, in two passes: nearest seed
    along each column (windows), then the lower envelope over the row's columns. The second pass
    looks at one image row's columns per pixel, so it costs width a pixel and never meets all seeds."""
    up = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(0, Window.unboundedFollowing)
    seed_y = F.when(is_seed, F.col("y"))
    a, b = F.last(seed_y, True).over(up), F.first(seed_y, True).over(down)
    g = F.least(F.col("y") - a, b - F.col("y"))
    cols = pixels.select(*KEY, g.alias("g"))
    row = cols.groupBy("image_id", "y").agg(F.collect_list(F.when(F.col("g").isNotNull(), F.struct("x", "g"))).alias("c"), F.collect_list("x").alias("xs"))
    flat = row.select("image_id", "y", "c", F.explode("xs").alias("x"))
    d = F.array_min(F.transform("c", lambda s: (s["x"] - F.col("x")) * (s["x"] - F.col("x")) + s["g"] * s["g"]))
    return flat.select(*KEY, d.alias("d2"))


def projection(pixels: DataFrame, value: str, axis: str = "y") -> DataFrame:
    """Maximum, minimum and mean along an axis."""
    keep = "x" if axis == "y" else "y"
    return pixels.groupBy("image_id", keep).agg(F.max(value).alias("max"), F.min(value).alias("min"), F.round(F.avg(value), 6).alias("mean"))


def tiles(pixels: DataFrame, size: int) -> DataFrame:
    return pixels.withColumn("tile", (F.floor(F.col("y") / size) * 1000 + F.floor(F.col("x") / size)).cast("int"))


def resize(pixels: DataFrame, value: str, sx: float, sy: float) -> DataFrame:
    """Bilinear resampling of an image to (width * sx, height * sy): each source pixel sends its weight
    to the target pixels within one step (backward mapping written as a forward spread)."""
    ext = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    p = pixels.join(ext, "image_id")

    def targets(c: str, m: str, s: float) -> Column:
        lo, hi = F.ceil((F.col(c) - 1) * s), F.floor((F.col(c) + 1) * s)
        return F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.floor((F.col(m) + 1) * s) - 1)))

    p = p.where((F.floor((F.col("mx") + 1) * sx) > 0) & (F.floor((F.col("my") + 1) * sy) > 0))
    ok = [F.greatest(F.ceil((F.col(c) - 1) * s), F.lit(0)) <= F.least(F.floor((F.col(c) + 1) * s), F.floor((F.col(m) + 1) * s) - 1) for c, m, s in (("x", "mx", sx), ("y", "my", sy))]
    t = p.where(ok[0] & ok[1]).withColumn("tx", targets("x", "mx", sx)).withColumn("ty", targets("y", "my", sy))
    w = F.greatest(1 - F.abs(F.least(F.col("tx") / sx, F.col("mx")) - F.col("x")), F.lit(0.0)) * F.greatest(1 - F.abs(F.least(F.col("ty") / sy, F.col("my")) - F.col("y")), F.lit(0.0))
    g = t.withColumn("w", w).where("w > 0").groupBy("image_id", "tx", "ty").agg(F.round(F.sum(F.col("w") * F.col(value)) / F.sum("w"), 6).alias(value))
    return g.select("image_id", F.col("tx").cast("int").alias("x"), F.col("ty").cast("int").alias("y"), value)


def flip(pixels: DataFrame, axis: str) -> DataFrame:
    m = pixels.groupBy("image_id").agg(F.max(axis).alias("_m"))
    return pixels.join(m, "image_id").withColumn(axis, (F.col("_m") - F.col(axis)).cast("int")).drop("_m")


def affine_nearest(pixels: DataFrame, a: Sequence[float]) -> DataFrame:
    """Pixels moved by x' = a0 x + a1 y + a2, y' = a3 x + a4 y + a5, rounded; pixels that fall together
    keep the smallest source (row, column) and pixels outside the image's extent are dropped."""
    ext = pixels.groupBy("image_id").agg(F.max("x").alias("_mx"), F.max("y").alias("_my"))
    x, y = F.col("x"), F.col("y")
    moved = pixels.join(ext, "image_id").withColumn("_tx", F.floor(x * a[0] + y * a[1] + a[2] + 0.5).cast("int")).withColumn("_ty", F.floor(x * a[3] + y * a[4] + a[5] + 0.5).cast("int"))
    moved = moved.where(F.col("_tx").between(0, F.col("_mx")) & F.col("_ty").between(0, F.col("_my")))
    rest = [c for c in pixels.columns if c not in KEY]
    g = moved.groupBy("image_id", "_tx", "_ty").agg(F.min_by(F.struct(*rest), F.struct("y", "x")).alias("r"))
    return g.select("image_id", F.col("_tx").alias("x"), F.col("_ty").alias("y"), "r.*")
