"""Pixel operators. The embeddings table is read as a stack of 64 x 64 images: image vec_id div 64,
row vec_id mod 64, column the place in the vector, value 128 + 256 e clipped to 0..255."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborgrid.functions import color
from arborgrid.operators import detection, graphs, grid, metrics
from arborgrid.plans import Scratch
from arborgrid.registry import query
from arborgrid.tables import read

PX = """px AS (SELECT vec_id // 64 AS image_id, CAST(vec_id % 64 AS INT) AS y, CAST(i AS INT) AS x, label + 1 AS label, CAST(least(255, greatest(0, floor(128 + 256 * CAST(e AS DOUBLE)))) AS INT) AS v
  FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


def pixels(spark, folder):
    e = read(spark, folder, "embeddings").select("vec_id", (F.col("label") + 1).alias("label"), F.posexplode("embedding").alias("x", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 256 * F.col("e").cast("double")))).cast("int")
    return e.select(F.floor(F.col("vec_id") / 64).cast("long").alias("image_id"), F.col("x").cast("int").alias("x"), (F.col("vec_id") % 64).cast("int").alias("y"), "label", v.alias("v"))


def near(offsets) -> str:
    """SQL for the displacement set, as rows (k, dx, dy)."""
    return "o(k, dx, dy) AS (VALUES " + ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(offsets)) + ")"


NB = "nb AS (SELECT p.image_id, p.x, p.y, p.v AS c, p.label AS lc, o.k, q.v, q.label FROM px p, o JOIN px q ON q.image_id = p.image_id AND q.x = p.x + o.dx AND q.y = p.y + o.dy)"


def with_nb(offsets) -> str:
    return f"WITH {PX}, {near(offsets)}, {NB}"


@query("dilate_box", f"WITH {PX} SELECT p.image_id, p.x, p.y, max(q.v) AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY ALL")
def dilate_box(spark, folder):
    return grid.dilate(pixels(spark, folder), "v", 1)


@query("erode_box", f"WITH {PX} SELECT p.image_id, p.x, p.y, min(q.v) AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY ALL")
def erode_box(spark, folder):
    return grid.erode(pixels(spark, folder), "v", 1)


BOX = "SELECT p.image_id, p.x, p.y, {f}(q.v) AS v FROM {t} p JOIN {t} q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY ALL"


@query("open_close_box", f"WITH {PX}, e AS ({BOX.format(f='min', t='px')}), o AS ({BOX.format(f='max', t='e')}), d AS ({BOX.format(f='max', t='px')}), c AS ({BOX.format(f='min', t='d')}) SELECT o.image_id, o.x, o.y, o.v AS opened, c.v AS closed FROM o JOIN c USING (image_id, x, y)")
def open_close_box(spark, folder):
    p = pixels(spark, folder)
    return grid.opening(p, "v").withColumnRenamed("v", "opened").join(grid.closing(p, "v").withColumnRenamed("v", "closed"), ["image_id", "x", "y"])


DISC = grid.circular(1.5)


@query("morph_gradient", with_nb(grid.circular(2.0)) + " SELECT image_id, x, y, max(v) AS dilated, min(v) AS eroded, max(v) - min(v) AS gradient FROM nb GROUP BY ALL")
def morph_gradient(spark, folder):
    return grid.flat_morphology(pixels(spark, folder), grid.circular(2.0), "v")


@query("mean_median_mode_filter", with_nb(DISC) + ", s AS (SELECT image_id, x, y, round(avg(v), 6) AS mean, list_sort(list(v)) AS l FROM nb GROUP BY ALL), m AS (SELECT image_id, x, y, arg_min(v, (-n, v)) AS mode FROM (SELECT image_id, x, y, v, count(*) AS n FROM nb GROUP BY ALL) GROUP BY ALL) SELECT image_id, x, y, mean, l[len(l) // 2 + 1] AS median, mode FROM s JOIN m USING (image_id, x, y)")
def rank_filter(spark, folder):
    return grid.rank_filters(pixels(spark, folder), DISC, "v")


GAUSS = grid.gaussian_kernel(1, 1.0)


@query("gaussian_filter", f"WITH {PX}, o(k, dx, dy, w) AS (VALUES " + ", ".join(f"({i}, {a}, {b}, {w!r}::DOUBLE)" for i, (a, b, w) in enumerate(GAUSS)) + ") SELECT p.image_id, p.x, p.y, round(sum(o.w * q.v), 6) AS filtered FROM px p, o JOIN px q ON q.image_id = p.image_id AND q.x = p.x + o.dx AND q.y = p.y + o.dy GROUP BY ALL")
def gaussian_filter(spark, folder):
    return grid.correlate(pixels(spark, folder), GAUSS, "v")


@query("sobel_magnitude", f"WITH {PX}, o(dx, dy) AS (SELECT a, b FROM (VALUES (-1), (0), (1)) s(a), (VALUES (-1), (0), (1)) t(b)), g AS (SELECT p.image_id, p.x, p.y, sum(o.dx * (CASE WHEN o.dy = 0 THEN 2 ELSE 1 END) * q.v) AS gx, sum(o.dy * (CASE WHEN o.dx = 0 THEN 2 ELSE 1 END) * q.v) AS gy FROM px p, o JOIN px q ON q.image_id = p.image_id AND q.x = p.x + o.dx AND q.y = p.y + o.dy GROUP BY ALL) SELECT image_id, x, y, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM g")
def sobel_magnitude(spark, folder):
    return grid.sobel(pixels(spark, folder), "v")


LBP = [(0, 0), *grid.clockwise(1.5)]


@query("local_binary_pattern", with_nb(LBP) + " SELECT image_id, x, y, CAST(sum(CASE WHEN k > 0 AND v > c THEN 1 << (k - 1) ELSE 0 END) AS INT) AS lbp FROM nb GROUP BY ALL")
def local_binary_pattern(spark, folder):
    return grid.local_binary_pattern(pixels(spark, folder), "v")


@query("lbp_histogram", with_nb(LBP) + ", l AS (SELECT image_id, x, y, CAST(sum(CASE WHEN k > 0 AND v > c THEN 1 << (k - 1) ELSE 0 END) AS INT) AS lbp FROM nb GROUP BY ALL) SELECT image_id, lbp, count(*) AS n FROM l GROUP BY ALL")
def lbp_histogram(spark, folder):
    return grid.local_binary_pattern(pixels(spark, folder), "v").groupBy("image_id", "lbp").agg(F.count(F.lit(1)).alias("n"))


INTEGRAL = "i AS (SELECT image_id, x, y, sum(r) OVER (PARTITION BY image_id, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT image_id, x, y, sum(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS r FROM px))"


@query("integral_image", f"WITH {PX}, {INTEGRAL} SELECT image_id, x, y, CAST(s AS BIGINT) AS integral FROM i")
def integral_image(spark, folder):
    return grid.integral(pixels(spark, folder), "v")


@query("box_sums", f"WITH {PX} SELECT p.image_id, p.x, p.y, CAST(sum(q.v) AS BIGINT) AS box_sum FROM px p JOIN px q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2 GROUP BY ALL")
def box_sums(spark, folder):
    return grid.box_sums(grid.integral(pixels(spark, folder), "v"), 2)


@query("pooling", f"WITH {PX} SELECT image_id, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, max(v) AS max_pool, round(avg(v), 6) AS avg_pool FROM px GROUP BY ALL")
def pooling(spark, folder):
    return grid.pool(pixels(spark, folder), "v", 2)


@query("pooling_strided", with_nb([(dx, dy) for dy in range(3) for dx in range(3)]) + " SELECT image_id, x, y, max(v) AS max_pool, round(avg(v), 6) AS avg_pool FROM nb WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY ALL")
def pooling_strided(spark, folder):
    return grid.pool(pixels(spark, folder), "v", 3, 2)


@query("border_pixels", with_nb(grid.circular(1.0)) + " SELECT image_id, x, y, lc AS label FROM nb GROUP BY ALL HAVING count(*) < 5 OR min(label) <> max(label)")
def border_pixels(spark, folder):
    return grid.border(pixels(spark, folder), "label")


@query("region_adjacency", with_nb([(1, 0), (0, 1)]) + " SELECT image_id, least(lc, label) AS a, greatest(lc, label) AS b, count(*) AS sides FROM nb WHERE lc <> label GROUP BY ALL")
def region_adjacency(spark, folder):
    return grid.region_adjacency(pixels(spark, folder), "label")


@query("edt", f"WITH {PX}, s AS (SELECT image_id, x, y FROM px WHERE v > 220) SELECT p.image_id, p.x, p.y, min((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d2 FROM px p LEFT JOIN s USING (image_id) GROUP BY ALL".replace("LEFT JOIN s USING (image_id)", "LEFT JOIN s ON s.image_id = p.image_id"))
def edt(spark, folder):
    return grid.distance_transform(pixels(spark, folder), F.col("v") > 220)


@query("projection", f"WITH {PX} SELECT image_id, x, max(v) AS max, min(v) AS min, round(avg(v), 6) AS mean FROM px GROUP BY ALL")
def projection(spark, folder):
    return grid.projection(pixels(spark, folder), "v", "y")


@query("flip_image", f"WITH {PX}, m AS (SELECT image_id, max(y) AS m FROM px GROUP BY 1) SELECT image_id, x, CAST(m - y AS INT) AS y, v FROM px JOIN m USING (image_id)")
def flip_image(spark, folder):
    return grid.flip(pixels(spark, folder), "y").select("image_id", "x", "y", "v")


@query("rotate_image", f"WITH {PX}, e AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM px GROUP BY 1), t AS (SELECT image_id, CAST(floor(0.8 * x - 0.6 * y + 20 + 0.5) AS INT) AS tx, CAST(floor(0.6 * x + 0.8 * y - 5 + 0.5) AS INT) AS ty, y, x, v, mx, my FROM px JOIN e USING (image_id)) SELECT image_id, tx AS x, ty AS y, arg_min(v, (y, x)) AS v FROM t WHERE tx BETWEEN 0 AND mx AND ty BETWEEN 0 AND my GROUP BY ALL")
def rotate_image(spark, folder):
    return grid.affine_nearest(pixels(spark, folder).drop("label"), (0.8, -0.6, 20, 0.6, 0.8, -5))


@query("resize_image", f"""WITH {PX}, e AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM px GROUP BY 1),
  t AS (SELECT image_id, mx, my, tx, ty FROM (SELECT *, unnest(range(CAST(floor((mx + 1) * 1.5) AS BIGINT))) AS tx FROM e), unnest(range(CAST(floor((my + 1) * 0.5) AS BIGINT))) u(ty)),
  w AS (SELECT t.image_id, tx, ty, p.v, greatest(0, 1 - abs(least(tx / 1.5, mx) - p.x)) * greatest(0, 1 - abs(least(ty / 0.5, my) - p.y)) AS w FROM t JOIN px p ON p.image_id = t.image_id AND p.x BETWEEN floor(least(tx / 1.5, mx)) AND ceil(least(tx / 1.5, mx)) AND p.y BETWEEN floor(least(ty / 0.5, my)) AND ceil(least(ty / 0.5, my)))
  SELECT image_id, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, round(sum(w * v) / sum(w), 6) AS v FROM w WHERE w > 0 GROUP BY ALL""")
def resize_image(spark, folder):
    return grid.resize(pixels(spark, folder), "v", 1.5, 0.5)


@query("colorspaces", f"""WITH {PX}, c AS (SELECT image_id, x, y, CAST(v AS DOUBLE) AS r, CAST((v * 7 + x) % 256 AS DOUBLE) AS g, CAST((v + 3 * y) % 256 AS DOUBLE) AS b FROM px), h AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, 0.299 * r + 0.587 * g + 0.114 * b AS yy FROM c)
  SELECT image_id, x, y, round(yy, 4) AS luma, round((b - yy) / (2 * (1 - 0.114)) + 128, 4) AS cb, round((r - yy) / (2 * (1 - 0.299)) + 128, 4) AS cr,
  round(60 * CASE WHEN hi = lo THEN 0 WHEN hi = r THEN CASE WHEN g < b THEN (g - b) / (hi - lo) + 6 ELSE (g - b) / (hi - lo) END WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END, 4) AS hue,
  round(CASE WHEN hi > 0 THEN (hi - lo) / hi ELSE 0 END, 4) AS saturation, '#' || upper(lpad(to_hex(CAST(r AS BIGINT)), 2, '0') || lpad(to_hex(CAST(g AS BIGINT)), 2, '0') || lpad(to_hex(CAST(b AS BIGINT)), 2, '0')) AS hex FROM h""")
def colorspaces(spark, folder):
    p = pixels(spark, folder).select("image_id", "x", "y", F.col("v").cast("double").alias("r"), ((F.col("v") * 7 + F.col("x")) % 256).cast("double").alias("g"), ((F.col("v") + 3 * F.col("y")) % 256).cast("double").alias("b"))
    rgb = F.col("r"), F.col("g"), F.col("b")
    yy, cb, cr = color.rgb_to_ycbcr(*rgb)
    h, s, _ = color.rgb_to_hsv(*rgb)
    return p.select("image_id", "x", "y", F.round(yy, 4).alias("luma"), F.round(cb, 4).alias("cb"), F.round(cr, 4).alias("cr"), F.round(h, 4).alias("hue"), F.round(s, 4).alias("saturation"), color.rgb_to_hex(*rgb).alias("hex"))


@query("colorspace_lab", f"""WITH {PX}, c AS (SELECT image_id, x, y, v / 255.0 AS r, ((v * 7 + x) % 256) / 255.0 AS g, ((v + 3 * y) % 256) / 255.0 AS b FROM px),
  z AS (SELECT image_id, x, y, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456 AS cx, 0.212671 * r + 0.715160 * g + 0.072169 * b AS cy, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754 AS cz FROM c),
  f AS (SELECT image_id, x, y, cy, CASE WHEN cx > 0.008856 THEN cbrt(cx) ELSE 7.787 * cx + 16.0 / 116 END AS fx, CASE WHEN cy > 0.008856 THEN cbrt(cy) ELSE 7.787 * cy + 16.0 / 116 END AS fy, CASE WHEN cz > 0.008856 THEN cbrt(cz) ELSE 7.787 * cz + 16.0 / 116 END AS fz FROM z)
  SELECT image_id, x, y, round((CASE WHEN cy > 0.008856 THEN 116 * fy - 16 ELSE 903.3 * cy END) / 99.998337, 4) AS l, round((500 * (fx - fy) + 86.182236) / 184.440850, 4) AS a, round((200 * (fy - fz) + 107.867744) / 202.349426, 4) AS b FROM f""")
def colorspace_lab(spark, folder):
    v = F.col("v")
    L, a, b = color.rgb_to_lab_normalized(v, (v * 7 + F.col("x")) % 256, (v + 3 * F.col("y")) % 256)  # noqa: N806
    return pixels(spark, folder).select("image_id", "x", "y", F.round(L, 4).alias("l"), F.round(a, 4).alias("a"), F.round(b, 4).alias("b"))


@query("bbox_by_label", f"WITH {PX} SELECT image_id, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area FROM px WHERE v > 150 GROUP BY ALL")
def bbox_by_label(spark, folder):
    return detection.bounding_boxes(pixels(spark, folder).where("v > 150"), ["image_id", "label"])


BOXES = "t AS (SELECT image_id, label AS id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE v > 195 GROUP BY ALL), f AS (SELECT image_id, label AS id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE v < 58 GROUP BY ALL), j AS (SELECT t.image_id, t.id AS true_id, f.id AS found_id, greatest(least(t.x1, f.x1) - greatest(t.x0, f.x0) + 1, 0) * greatest(least(t.y1, f.y1) - greatest(t.y0, f.y0) + 1, 0) AS i, (t.x1 - t.x0 + 1) * (t.y1 - t.y0 + 1) + (f.x1 - f.x0 + 1) * (f.y1 - f.y0 + 1) AS s FROM t JOIN f ON f.image_id = t.image_id), m AS (SELECT image_id, true_id, found_id, round(i / (s - i), 6) AS iou FROM j WHERE i > 0)"


def _boxes(spark, folder):
    p = pixels(spark, folder)
    return [detection.bounding_boxes(p.where(c), ["image_id", "label"]).withColumnRenamed("label", "id") for c in ("v > 195", "v < 58")]


@query("iou_match", f"WITH {PX}, {BOXES} SELECT image_id, true_id, found_id, iou FROM m")
def iou_match(spark, folder):
    return detection.match(*_boxes(spark, folder), "image_id")


@query("detection_counts", f"WITH {PX}, {BOXES}, n AS (SELECT image_id, (SELECT count(*) FROM t WHERE t.image_id = i.image_id) AS nt, (SELECT count(*) FROM f WHERE f.image_id = i.image_id) AS nf FROM (SELECT image_id FROM t UNION SELECT image_id FROM f) i), th(threshold) AS (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)), h AS (SELECT threshold, image_id, count(DISTINCT true_id) AS found, count(DISTINCT found_id) AS good FROM m, th WHERE iou > threshold GROUP BY ALL) SELECT th.threshold, n.image_id, coalesce(found, 0) AS found, nt - coalesce(found, 0) AS missed, nf - coalesce(good, 0) AS wrong FROM n CROSS JOIN th LEFT JOIN h ON h.threshold = th.threshold AND h.image_id = n.image_id")
def detection_counts(spark, folder):
    return detection.evaluate(*_boxes(spark, folder), "image_id", (0.3, 0.5, 0.75))


PR = BOXES + """, n AS (SELECT image_id, (SELECT count(*) FROM t WHERE t.image_id = i.image_id) AS nt, (SELECT count(*) FROM f WHERE f.image_id = i.image_id) AS nf FROM (SELECT image_id FROM t UNION SELECT image_id FROM f) i),
  th(threshold, cut) AS (VALUES """ + ", ".join(f"({round(0.30 + 0.05 * i, 2)!r}::DOUBLE, {0.30 + 0.05 * i!r}::DOUBLE)" for i in range(14)) + """),
  h AS (SELECT threshold, image_id, count(DISTINCT true_id) AS found, count(DISTINCT found_id) AS good FROM m, th WHERE iou > cut GROUP BY ALL),
  c AS (SELECT th.threshold, n.image_id, coalesce(found, 0) AS found, nt - coalesce(found, 0) AS missed, nf - coalesce(good, 0) AS wrong FROM n CROSS JOIN th LEFT JOIN h ON h.threshold = th.threshold AND h.image_id = n.image_id),
  r AS (SELECT threshold, image_id, sum(found) OVER w AS tp, sum(missed) OVER w AS fn, sum(wrong) OVER w AS fp FROM c WINDOW w AS (PARTITION BY threshold ORDER BY image_id ROWS UNBOUNDED PRECEDING)),
  pr AS (SELECT threshold, image_id, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END, 6) AS recall, round(CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp) ELSE 0 END, 6) AS f2 FROM r)"""


@query("detection_pr", f"WITH {PX}, {PR} SELECT * FROM pr")
def detection_pr(spark, folder):
    """Cumulative precision, recall and F2 over images, at 14 thresholds."""
    counts = detection.evaluate(*_boxes(spark, folder), "image_id", [0.30 + 0.05 * i for i in range(14)])
    return metrics.running_detection(counts.withColumn("threshold", F.round("threshold", 2)), "threshold", "image_id")


@query("detection_ap", f"WITH {PX}, {PR}, q AS (SELECT threshold, recall, precision, lag(recall, 1, 0) OVER w AS r0, lag(precision, 1, 1) OVER w AS p0 FROM pr WINDOW w AS (PARTITION BY threshold ORDER BY recall, precision DESC)) SELECT threshold, round(sum((recall - r0) * (precision + p0) / 2), 6) AS ap FROM q GROUP BY 1")
def detection_ap(spark, folder):
    return metrics.average_precision(detection_pr(spark, folder), "threshold")


@query("dice_jaccard", f"WITH {PX}, m AS (SELECT v > 150 AS a, (v + x) % 256 > 150 AS b FROM px), c AS (SELECT count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn FROM m) SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS dice, round(tp / (tp + fp + fn), 6) AS jaccard, round(CASE WHEN fn < tp + fn AND fp < tp + fn THEN (tp + fn - fp) * tp / ((tp + fn) * (tp + fn)) ELSE 0 END, 6) AS gbc FROM c")
def dice_jaccard(spark, folder):
    p = pixels(spark, folder).select((F.col("v") > 150).cast("int").alias("a"), ((F.col("v") + F.col("x")) % 256 > 150).cast("int").alias("b"))
    return metrics.overlap(p, "a", "b")


@query("dice_by_label", f"WITH {PX}, m AS (SELECT label AS a, CASE WHEN v > 100 THEN label ELSE (label + x) % 11 END AS b FROM px), k AS (SELECT a AS class FROM m UNION SELECT b FROM m), c AS (SELECT class, count(*) FILTER (a = class AND b = class) AS tp, count(*) FILTER (a <> class AND b = class) AS fp, count(*) FILTER (a = class AND b <> class) AS fn FROM k, m WHERE class > 0 GROUP BY 1) SELECT class, round(2 * tp / (2 * tp + fp + fn), 6) AS dice, round(tp / (tp + fp + fn), 6) AS jaccard, round(CASE WHEN fn < tp + fn AND fp < tp + fn THEN (tp + fn - fp) * tp / ((tp + fn) * (tp + fn)) ELSE 0 END, 6) AS gbc FROM c")
def dice_by_label(spark, folder):
    p = pixels(spark, folder).select(F.col("label").alias("a"), F.when(F.col("v") > 100, F.col("label")).otherwise((F.col("label") + F.col("x")) % 11).alias("b"))
    return metrics.overlap(p, "a", "b", labels=True)


@query("superpixel_quality", f"WITH {PX}, c AS (SELECT image_id, y // 8 * 8 + x // 8 AS sp, label, count(*) AS n FROM px GROUP BY ALL), s AS (SELECT image_id, sp, max(n) AS best, sum(n) AS size FROM c GROUP BY ALL), l AS (SELECT c.image_id, sum(least(n, size - n)) AS leak FROM c JOIN s ON s.image_id = c.image_id AND s.sp = c.sp GROUP BY 1) SELECT s.image_id, round(sum(best) / sum(size), 6) AS asa, round(any_value(leak) / sum(size), 6) AS under_segmentation FROM s JOIN l ON l.image_id = s.image_id GROUP BY 1")
def superpixel_quality(spark, folder):
    p = pixels(spark, folder).withColumn("sp", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("int"))
    return metrics.superpixel_quality(p, "sp", "label", ["image_id"])


@query("saliency_errors", f"WITH {PX}, s AS (SELECT image_id, v / 255.0 AS s, CAST(label > 5 AS INT) AS g FROM px) SELECT image_id, round(avg(abs(s - g)), 6) AS mae, round(sqrt(sum((s - g) * (s - g))), 6) AS euclidean FROM s GROUP BY 1")
def saliency_errors(spark, folder):
    return metrics.mean_absolute_error(pixels(spark, folder), F.col("v") / 255.0, (F.col("label") > 5).cast("int"), ["image_id"])


@query("saliency_structure", f"WITH {PX}, s AS (SELECT image_id, v / 255.0 AS s, CAST(label > 5 AS INT) AS g FROM px), a AS (SELECT image_id, avg(s) FILTER (g = 1) AS mf, stddev_pop(s) FILTER (g = 1) AS sf, avg(1 - s) FILTER (g = 0) AS mb, stddev_pop(1 - s) FILTER (g = 0) AS sb, avg(g) AS mu FROM s GROUP BY 1) SELECT image_id, round(mu * coalesce(2 * mf / (mf * mf + 1 + sf), 0) + (1 - mu) * coalesce(2 * mb / (mb * mb + 1 + sb), 0), 6) AS s_object FROM a")
def saliency_structure(spark, folder):
    p = pixels(spark, folder).select("image_id", (F.col("v") / 255.0).alias("s"), (F.col("label") > 5).cast("int").alias("g"))
    return metrics.s_object(p, "s", "g", ["image_id"])


@query("saliency_alignment", f"WITH {PX}, s AS (SELECT image_id, v / 255.0 AS s, CAST(label > 5 AS DOUBLE) AS g FROM px), t AS (SELECT image_id, least(2 * avg(s), 1) AS t FROM s GROUP BY 1), b AS (SELECT s.image_id, CASE WHEN s >= t THEN 1.0 ELSE 0.0 END AS p, g FROM s JOIN t ON t.image_id = s.image_id), m AS (SELECT image_id, avg(p) AS mp, avg(g) AS mg FROM b GROUP BY 1) SELECT b.image_id, round(avg(CASE WHEN mg = 0 THEN 1 - p WHEN mg = 1 THEN p ELSE pow(2 * (p - mp) * (g - mg) / ((p - mp) * (p - mp) + (g - mg) * (g - mg) + 2.220446049250313e-16) + 1, 2) / 4 END), 6) AS e_measure FROM b JOIN m ON m.image_id = b.image_id GROUP BY 1")
def saliency_alignment(spark, folder):
    p = pixels(spark, folder).select("image_id", (F.col("v") / 255.0).alias("s"), (F.col("label") > 5).cast("int").alias("g"))
    return metrics.e_measure(p, "s", "g", ["image_id"])


@query("saliency_pr_curve", f"WITH {PX}, s AS (SELECT v, CAST(label > 5 AS INT) AS g FROM px), t AS (SELECT CAST(unnest(range(0, 256, 5)) AS INT) AS threshold), c AS (SELECT threshold, count(*) FILTER (v > threshold AND g = 1) AS tp, count(*) FILTER (v > threshold AND g = 0) AS fp, count(*) FILTER (g = 1) AS p FROM s, t GROUP BY 1) SELECT threshold, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END, 6) AS precision, round(CASE WHEN p > 0 THEN tp / p ELSE 1 END, 6) AS recall FROM c")
def saliency_pr_curve(spark, folder):
    return metrics.saliency_pr(pixels(spark, folder).select("v", (F.col("label") > 5).cast("int").alias("g")), "v", "g")


COMP = "e AS (SELECT p.image_id * 1099511627776 + p.y * 1048576 + p.x AS a, q.image_id * 1099511627776 + q.y * 1048576 + q.x AS b FROM px p JOIN px q ON q.image_id = p.image_id AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) WHERE p.v > 150 AND q.v > 150), n AS (SELECT image_id * 1099511627776 + y * 1048576 + x AS id FROM px WHERE v > 150), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, root) AS (SELECT id, id FROM n UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id WHERE r.root < g.b), c AS (SELECT id, min(root) AS root FROM r GROUP BY 1)"


def _components(spark, folder):
    return graphs.grid_components(pixels(spark, folder).where("v > 150"), Scratch(spark, "components"))


@query("label_components_grid", f"WITH RECURSIVE {PX}, {COMP} SELECT id, root FROM c")
def label_components_grid(spark, folder):
    return _components(spark, folder).select("id", "root")


@query("largest_components", f"WITH RECURSIVE {PX}, {COMP}, s AS (SELECT root, count(*) AS area FROM c GROUP BY 1) SELECT root, area, CAST(row_number() OVER (ORDER BY area DESC, root) AS INT) AS rank FROM s QUALIFY rank <= 5")
def largest_components(spark, folder):
    from arborgrid.operators import sampling

    return sampling.top_groups(_components(spark, folder), "root", 5)


@query(
    "regional_extrema",
    f"""WITH RECURSIVE {PX}, p AS (SELECT image_id * 1099511627776 + y * 1048576 + x AS id, * FROM px), o(dx, dy) AS (SELECT a, b FROM (VALUES (-1), (0), (1)) s(a), (VALUES (-1), (0), (1)) t(b) WHERE a <> 0 OR b <> 0),
    g AS (SELECT p.id AS a, q.id AS b, p.v AS va, q.v AS vb FROM p, o JOIN p q ON q.image_id = p.image_id AND q.x = p.x + o.dx AND q.y = p.y + o.dy),
    r(id, root) USING KEY (id) AS (SELECT id, id FROM p UNION SELECT g.b, min(r.root) FROM r JOIN g ON g.a = r.id AND g.va = g.vb JOIN recurring.r o ON o.id = g.b WHERE r.root < o.root GROUP BY g.b),
    f AS (SELECT root, bool_or(vb > va) AS above, bool_or(vb < va) AS below FROM g JOIN r ON r.id = g.a GROUP BY 1)
    SELECT p.image_id, p.x, p.y, NOT above AS is_max, NOT below AS is_min FROM p JOIN r USING (id) JOIN f USING (root)""",
)
def regional_extrema(spark, folder):
    return grid.regional_extrema(pixels(spark, folder), "v", Scratch(spark, "extrema"), grid.circular(1.5))
