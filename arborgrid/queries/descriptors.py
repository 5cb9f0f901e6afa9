"""Descriptors, patches, label smoothing, surfaces, searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborgrid.functions import arith
from arborgrid.operators import descriptors, grid, learning, metrics, search
from arborgrid.plans import Scratch
from arborgrid.queries.images import DISC, PX, pixels, with_nb
from arborgrid.registry import query
from arborgrid.tables import read

BUCKET = "CAST(CASE WHEN {a} <= 0 THEN 0 ELSE greatest(1, 9 + floor(log2({a}))) END AS INT)"


@query("border_interior", f"WITH {PX}, q AS (SELECT image_id, x, y, CAST(least(floor(v * 8 / 256.0), 7) AS INT) AS q FROM px), o(dx, dy) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)), g AS (SELECT p.image_id, p.x, p.y, p.q AS bin, (min(n.q) <> max(n.q) OR count(*) < 5) AS border FROM q p, o JOIN q n ON n.image_id = p.image_id AND n.x = p.x + o.dx AND n.y = p.y + o.dy GROUP BY ALL), c AS (SELECT image_id, bin, count(*) FILTER (border) AS b, count(*) FILTER (NOT border) AS i FROM g GROUP BY ALL), t AS (SELECT image_id, greatest(max(b), max(i)) AS t FROM c GROUP BY 1) SELECT c.image_id, bin, {BUCKET.format(a='(b / t)')} AS border, {BUCKET.format(a='(i / t)')} AS interior FROM c JOIN t ON t.image_id = c.image_id")
def border_interior(spark, folder):
    return descriptors.border_interior(pixels(spark, folder), "v", 8)


@query("oriented_gradients", f"""WITH {PX}, g AS (SELECT p.image_id, p.x, p.y, coalesce(r.v, p.v) - coalesce(l.v, p.v) AS gx, coalesce(d.v, p.v) - coalesce(u.v, p.v) AS gy FROM px p LEFT JOIN px r ON r.image_id = p.image_id AND r.x = p.x + 1 AND r.y = p.y LEFT JOIN px l ON l.image_id = p.image_id AND l.x = p.x - 1 AND l.y = p.y LEFT JOIN px d ON d.image_id = p.image_id AND d.x = p.x AND d.y = p.y + 1 LEFT JOIN px u ON u.image_id = p.image_id AND u.x = p.x AND u.y = p.y - 1),
  a AS (SELECT image_id, x // 8 AS cx, y // 8 AS cy, sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) AS m, degrees(atan2(gy, gx)) AS deg FROM g), t AS (SELECT image_id, cx, cy, m, (CASE WHEN deg < 0 THEN deg + 180 WHEN deg >= 180 THEN deg - 180 ELSE deg END) * 9 / 180.0::DOUBLE - 0.5 AS t FROM a),
  s AS (SELECT image_id, cx, cy, (CAST(floor(t) AS INT) + 9) % 9 AS b, m * (1 - (t - floor(t))) AS w FROM t UNION ALL SELECT image_id, cx, cy, (CAST(floor(t) AS INT) + 10) % 9, m * (t - floor(t)) FROM t), c AS (SELECT image_id, cx, cy, b, sum(w) AS w FROM s GROUP BY ALL), n AS (SELECT image_id, cx, cy, sqrt(sum(w * w) + 1e-12) AS n FROM c GROUP BY ALL), k AS (SELECT n.*, b FROM n, range(9) r(b))
  SELECT k.image_id, CAST(k.cx AS INT) AS cx, CAST(k.cy AS INT) AS cy, list(round(coalesce(w, 0) / n, 6) ORDER BY k.b) AS hog FROM k LEFT JOIN c ON c.image_id = k.image_id AND c.cx = k.cx AND c.cy = k.cy AND c.b = k.b GROUP BY ALL""")
def oriented_gradients(spark, folder):
    return descriptors.oriented_gradients(pixels(spark, folder), "v")


@query("patches", with_nb([(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]) + ", a AS (SELECT image_id, x, y, k FROM px, (SELECT unnest(range(5)) AS k)) SELECT a.image_id, a.x, a.y, list(coalesce(nb.v, 0) ORDER BY a.k) AS patch FROM a LEFT JOIN nb ON nb.image_id = a.image_id AND nb.x = a.x AND nb.y = a.y AND nb.k = a.k GROUP BY ALL")
def patches(spark, folder):
    return descriptors.patches(pixels(spark, folder), "v", [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)])


@query("majority_vote", f"WITH {PX}, n AS (SELECT image_id, y // 8 * 8 + x // 8 AS region, v // 32 AS l, count(*) AS n FROM px GROUP BY ALL) SELECT image_id, CAST(region AS INT) AS region, CAST(arg_min(l, (-n, l)) AS INT) AS vote FROM n GROUP BY ALL")
def majority_vote(spark, folder):
    p = pixels(spark, folder).select("image_id", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("int").alias("region"), F.floor(F.col("v") / 32).cast("int").alias("l"))
    return descriptors.majority_vote(p, ["image_id", "region"], "l")


@query("smooth_labels", with_nb(DISC) + ", c AS (SELECT image_id, x, y, v // 32 AS l, count(*) AS n FROM nb GROUP BY ALL) SELECT image_id, x, y, CAST(arg_min(l, (-n, l)) AS INT) AS smoothed FROM c GROUP BY ALL")
def smooth_labels(spark, folder):
    return descriptors.smooth_labels(pixels(spark, folder).withColumn("l", F.floor(F.col("v") / 32).cast("int")), "l", DISC)


@query("diffuse_labels")
def diffuse_labels(spark, folder):
    p = pixels(spark, folder).select("image_id", "x", "y", "v", (F.col("label") > 5).cast("double").alias("s"))
    return descriptors.diffuse(p, "s", "v", 3, Scratch(spark, "diffuse")).withColumn("s", F.round("s", 6))


EDGE = "SELECT p.image_id, p.x, p.y FROM px p LEFT JOIN px q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1 AND q.v > {t} WHERE p.v > {t} GROUP BY ALL HAVING count(q.v) < 4"


@query("surface_distance", f"""WITH {PX}, a AS ({EDGE.format(t=120)}), b AS ({EDGE.format(t=130)}),
  ab AS (SELECT image_id, avg(d) AS d FROM (SELECT a.image_id, a.x, a.y, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM a JOIN b ON a.image_id = b.image_id GROUP BY ALL) GROUP BY 1),
  ba AS (SELECT image_id, avg(d) AS d FROM (SELECT b.image_id, b.x, b.y, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM b JOIN a ON a.image_id = b.image_id GROUP BY ALL) GROUP BY 1)
  SELECT ab.image_id, round(ab.d, 6) AS asd, round((ab.d + ba.d) / 2, 6) AS assd FROM ab JOIN ba ON ab.image_id = ba.image_id""")
def surface_distance(spark, folder):
    p = pixels(spark, folder)
    a, b = (p.select("image_id", "x", "y", (F.col("v") > t).cast("int").alias("v")) for t in (120, 130))
    return descriptors.surface_distance(a, b)


BORDER = "SELECT p.image_id, p.x, p.y FROM q p LEFT JOIN q n ON n.image_id = p.image_id AND abs(n.x - p.x) + abs(n.y - p.y) = 1 AND n.{c} = p.{c} GROUP BY ALL HAVING count(n.x) < 4"


@query("boundary_recall", f"WITH {PX}, q AS (SELECT *, y // 8 * 8 + x // 8 AS sp FROM px), t AS ({BORDER.format(c='label')}), s AS ({BORDER.format(c='sp')}), m AS (SELECT t.image_id, t.x, t.y, count(s.x) > 0 AS hit FROM t LEFT JOIN s ON s.image_id = t.image_id AND abs(s.x - t.x) <= 1 AND abs(s.y - t.y) <= 1 GROUP BY ALL) SELECT image_id, round(avg(CAST(hit AS INT)), 6) AS boundary_recall FROM m GROUP BY 1")
def boundary_recall(spark, folder):
    p = pixels(spark, folder).withColumn("sp", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("int"))
    return descriptors.boundary_recall(p, "sp", "label")


@query("skeleton")
def skeleton(spark, folder):
    return descriptors.skeleton(pixels(spark, folder).withColumn("m", (F.col("v") > 110).cast("int")), "m")


@query("mask_points", f"WITH {PX}, m AS (SELECT * FROM px WHERE v > 170), n AS (SELECT p.image_id, p.x, p.y, count(*) AS n FROM m p JOIN m q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL) SELECT image_id, x, y, CASE WHEN n = 2 THEN 'end' ELSE 'junction' END AS kind FROM n WHERE n = 2 OR n >= 4")
def mask_points(spark, folder):
    """End points and junctions of a sparse mask."""
    return descriptors.topology_points(pixels(spark, folder).where("v > 170").select("image_id", "x", "y"))


@query("topology_points")
def topology_points(spark, folder):
    return descriptors.topology_points(skeleton(spark, folder).where("skeleton = 1").select("image_id", "x", "y"))


@query("furthest_pair", f"WITH {PX}, m AS (SELECT * FROM px WHERE v > 220) SELECT p.image_id, round(sqrt(max((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 6) AS diameter FROM m p JOIN m q ON q.image_id = p.image_id GROUP BY 1")
def furthest_pair(spark, folder):
    return descriptors.furthest_pair(pixels(spark, folder).where("v > 220"), "image_id")


@query("intensity_profile", f"WITH {PX} SELECT image_id, x AS step, v FROM px WHERE x = y")
def intensity_profile(spark, folder):
    return descriptors.intensity_profile(pixels(spark, folder), "v", (0, 0), (63, 63))


@query("region_centres", f"WITH {PX}, c AS (SELECT image_id, label, avg(x) AS cx, avg(y) AS cy FROM px GROUP BY ALL), m AS (SELECT p.image_id, p.label, arg_min((p.x, p.y), (round((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy), 9), p.y, p.x)) AS m FROM px p JOIN c ON c.image_id = p.image_id AND c.label = p.label GROUP BY ALL) SELECT image_id, label, m[1] AS x, m[2] AS y FROM m")
def region_centres(spark, folder):
    return descriptors.region_centres(pixels(spark, folder), ["image_id", "label"])


@query("local_threshold", with_nb(grid.circular(2.0)) + " SELECT image_id, x, y, CAST(c > 1.1 * avg(v) AS INT) AS selected FROM nb GROUP BY image_id, x, y, c")
def local_threshold(spark, folder):
    return descriptors.local_threshold(pixels(spark, folder), "v", grid.circular(2.0), 1.1)


@query("image_sequence", f"WITH {PX}, d AS (SELECT x, y, v, abs(v - lag(v) OVER (PARTITION BY x, y ORDER BY image_id)) AS d FROM px) SELECT x, y, round(avg(v), 6) AS mean, CAST(coalesce(sum(d), 0) AS BIGINT) AS change, count(*) AS frames FROM d GROUP BY ALL")
def image_sequence(spark, folder):
    return descriptors.mode_over_time(pixels(spark, folder).withColumnRenamed("image_id", "t"), "v")


@query("parameter_search", f"WITH {PX}, c AS (SELECT v, label > 5 AS t, count(*) AS n FROM px GROUP BY ALL), g AS (SELECT CAST(a AS DOUBLE) AS low, CAST(b AS DOUBLE) AS high FROM range(0, 256, 16) r(a), range(15, 256, 16) q(b)), s AS (SELECT low, high, CAST(sum(CASE WHEN (v BETWEEN low AND high) = t THEN n ELSE 0 END) AS BIGINT) AS fitness FROM c, g GROUP BY ALL) SELECT * FROM s ORDER BY fitness DESC, low, high LIMIT 1")
def parameter_search(spark, folder):
    """Threshold and stretch that agree best with the labels, by a full grid on aggregated counts."""
    counts = pixels(spark, folder).groupBy("v", (F.col("label") > 5).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    g = search.parameter_grid(spark, {"low": range(0, 256, 16), "high": range(15, 256, 16)})
    hit = arith.threshold(F.col("v"), F.col("low"), F.col("high")) == F.col("t").cast("int")
    scored = counts.join(F.broadcast(g)).groupBy("low", "high").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fitness"))  # 256 parameter rows
    return learning.grid_search(scored, "fitness")


@query("multi_scale_search")
def multi_scale_search(spark, folder):
    """Line through (quantity, price) found by hill climbing on the table's moments."""
    m = read(spark, folder, "lineitem").agg(*[F.avg(e).alias(n) for n, e in (("x", F.col("l_quantity")), ("y", F.col("l_extendedprice") / 1000), ("xx", F.col("l_quantity") ** 2), ("xy", F.col("l_quantity") * F.col("l_extendedprice") / 1000))]).first()
    loss = lambda p: -(p["a"] ** 2 * m["xx"] + p["b"] ** 2 + 2 * p["a"] * p["b"] * m["x"] - 2 * p["a"] * m["xy"] - 2 * p["b"] * m["y"])
    at, value = search.multi_scale({"a": 0.0, "b": 0.0}, [{"a": d, "b": d} for d in (1.0, 0.1, 0.01)], loss)
    return spark.createDataFrame([(round(at["a"], 4), round(at["b"], 4), round(value, 6))], "a double, b double, fitness double")


@query("tsne_projection")
def tsne_projection(spark, folder):
    return spark.createDataFrame(search.tsne(read(spark, folder, "embeddings"), "vec_id", "embedding"), "id long, x double, y double")


@query("cluster_hierarchy")
def cluster_hierarchy(spark, folder):
    """Two levels: ten clusters, and three clusters of their centres."""
    e = read(spark, folder, "embeddings")
    low, centres = learning.kmeans(e, "vec_id", "embedding", 10, max_iter=10)
    c = spark.createDataFrame([(i + 1, v) for i, v in enumerate(centres)], "low int, centre array<double>")
    top, _ = learning.kmeans(c, "low", "centre", 3, max_iter=10)
    return low.select("vec_id", F.col("cluster").alias("low")).join(F.broadcast(top.select("low", F.col("cluster").alias("top"))), "low")  # ten rows


@query("cross_validation")
def cross_validation(spark, folder):
    """Five-fold accuracy of nearest-neighbour classification."""
    from arborgrid.operators import neighbours, sampling

    e = sampling.kfold(read(spark, folder, "embeddings"), "vec_id", 5, ["label"])
    out = None
    for k in range(5):
        train, test = e.where(F.col("fold") != k), e.where(F.col("fold") == k)
        n = neighbours.nearest(test, train, "vec_id", "embedding", 5)
        pred = neighbours.classify(n, train.select(F.col("vec_id").alias("id"), "label")).withColumnRenamed("label", "pred").join(test.select(F.col("vec_id").alias("id"), "label"), "id")
        one = metrics.summary(pred, "label", "pred").select(F.lit(k).alias("fold"), "true_positives", "kappa", "path_accuracy")
        out = one if out is None else out.unionByName(one)
    return out
