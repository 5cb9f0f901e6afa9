"""Path-cost forests on images: order-dependent kernels, one image a task, and spectral filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborgrid.operators import forests, graphs, grid
from arborgrid.plans import Scratch
from arborgrid.queries.images import PX, pixels
from arborgrid.registry import query


def seeded(spark, folder):
    """Pixels with seeds 1, 2, 1, 2 on the corners (0,0), (63,0), (0,40), (63,40)."""
    x, y = F.col("x"), F.col("y")
    corner = F.when((x == 0) & (y == 0), 1).when((x == 63) & (y == 0), 2).when((x == 0) & (y == 40), 1).when((x == 63) & (y == 40), 2).otherwise(0)
    return pixels(spark, folder).withColumn("seed", corner)


SEEDED = f"WITH RECURSIVE {PX}, s AS (SELECT *, CASE WHEN (x = 0 AND y IN (0, 40)) THEN 1 WHEN (x = 63 AND y IN (0, 40)) THEN 2 ELSE 0 END AS seed FROM px)"
ARCS = "o(dx, dy) AS (SELECT a, b FROM (VALUES (-1), (0), (1)) s(a), (VALUES (-1), (0), (1)) t(b) WHERE a <> 0 OR b <> 0), g AS (SELECT p.image_id, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, q.v AS w FROM px p, o JOIN px q ON q.image_id = p.image_id AND q.x = p.x + o.dx AND q.y = p.y + o.dy)"


@query("watershed_cost", f"{SEEDED}, {ARCS}, r(image_id, x, y, cost) USING KEY (image_id, x, y) AS (SELECT image_id, x, y, 0::BIGINT FROM s WHERE seed > 0 UNION SELECT g.image_id, g.qx, g.qy, min(greatest(r.cost, g.w)) FROM r JOIN g ON g.image_id = r.image_id AND g.px = r.x AND g.py = r.y LEFT JOIN recurring.r o ON o.image_id = g.image_id AND o.x = g.qx AND o.y = g.qy WHERE greatest(r.cost, g.w) < coalesce(o.cost, 1000000) GROUP BY ALL) SELECT image_id, x, y, CAST(cost AS DOUBLE) AS cost FROM r")
def watershed_cost(spark, folder):
    """Cost map of the seeded watershed (its labels at ties depend on the order, its costs don't)."""
    return forests.watershed(seeded(spark, folder), "v", "seed").select("image_id", "x", "y", "cost")


@query("watershed")
def watershed(spark, folder):
    return forests.watershed(seeded(spark, folder), "v", "seed")


@query("water_cut_cost", f"{SEEDED}, {ARCS.replace('q.v AS w', 'abs(q.v - p.v) AS w')}, r(image_id, x, y, cost) USING KEY (image_id, x, y) AS (SELECT image_id, x, y, 0::BIGINT FROM s WHERE seed > 0 UNION SELECT g.image_id, g.qx, g.qy, min(greatest(r.cost, g.w)) FROM r JOIN g ON g.image_id = r.image_id AND g.px = r.x AND g.py = r.y LEFT JOIN recurring.r o ON o.image_id = g.image_id AND o.x = g.qx AND o.y = g.qy WHERE greatest(r.cost, g.w) < coalesce(o.cost, 1000000) GROUP BY ALL) SELECT image_id, x, y, CAST(cost AS DOUBLE) AS cost FROM r")
def water_cut_cost(spark, folder):
    """Cost map of the watershed by differences."""
    return forests.watershed(seeded(spark, folder), "v", "seed", by_difference=True).select("image_id", "x", "y", "cost")


@query("water_cut")
def water_cut(spark, folder):
    return forests.watershed(seeded(spark, folder), "v", "seed", by_difference=True)


@query("oriented_watershed")
def oriented_watershed(spark, folder):
    return forests.oriented_watershed(seeded(spark, folder), "v", "seed")


@query("dynamic_trees")
def dynamic_trees(spark, folder):
    return forests.dynamic_trees(seeded(spark, folder), "v", "seed", "root", 0.1)


@query("dynamic_objects")
def dynamic_objects(spark, folder):
    return forests.dynamic_trees(seeded(spark, folder), "v", "seed", "label")


REC = "m AS (SELECT image_id, x, y, v, v + 30 AS m FROM px), r(image_id, x, y, rec) USING KEY (image_id, x, y) AS (SELECT image_id, x, y, CAST(m AS BIGINT) FROM m UNION SELECT g.image_id, g.qx, g.qy, min(greatest(r.rec, g.w)) FROM r JOIN g ON g.image_id = r.image_id AND g.px = r.x AND g.py = r.y JOIN recurring.r o ON o.image_id = g.image_id AND o.x = g.qx AND o.y = g.qy WHERE greatest(r.rec, g.w) < o.rec GROUP BY ALL)"


@query("superior_reconstruction", f"WITH RECURSIVE {PX}, {ARCS}, {REC} SELECT image_id, x, y, CAST(rec AS DOUBLE) AS rec FROM r")
def superior_reconstruction(spark, folder):
    return forests.reconstruct(pixels(spark, folder).withColumn("m", F.col("v") + 30), "v", "m")


@query("inferior_reconstruction")
def inferior_reconstruction(spark, folder):
    return forests.reconstruct(pixels(spark, folder).withColumn("m", F.col("v") - 30), "v", "m", superior=False)


@query("area_open")
def area_open(spark, folder):
    return forests.attribute_open(pixels(spark, folder), "v", 10)


@query("area_close")
def area_close(spark, folder):
    return forests.attribute_open(pixels(spark, folder), "v", 10, close=True)


@query("volume_open")
def volume_open(spark, folder):
    return forests.attribute_open(pixels(spark, folder), "v", 200, volume=True)


@query("superpixels_slic")
def superpixels_slic(spark, folder):
    return forests.superpixels_slic(pixels(spark, folder), "v", 8)


@query("superpixels_seed_removal")
def superpixels_seed_removal(spark, folder):
    return forests.superpixels_forest(pixels(spark, folder), "v", 200, 20)


@query("superpixels_connected", f"WITH {PX} SELECT image_id, 20::BIGINT AS superpixels, 20::BIGINT AS pieces, count(*) AS area FROM px GROUP BY 1 HAVING count(*) = 4096")
def superpixels_connected(spark, folder):
    """Superpixels of each whole image after seed removal, and 4-connected pieces with one label: as many."""
    p = superpixels_seed_removal(spark, folder)
    apart = p.withColumn("image_id", F.col("image_id") * 1000 + F.col("superpixel"))  # a label an image
    pieces = graphs.grid_components(apart, Scratch(spark, "pieces")).groupBy(F.floor(F.col("image_id") / 1000).alias("image_id")).agg(F.countDistinct("root").alias("pieces"))
    n = p.groupBy("image_id").agg(F.countDistinct("superpixel").alias("superpixels"), F.count(F.lit(1)).alias("area"))
    return n.join(pieces, "image_id").where("area = 4096").select("image_id", "superpixels", "pieces", "area")


@query("superpixels_saliency")
def superpixels_saliency(spark, folder):
    p = pixels(spark, folder).withColumn("s", F.col("v") / 255.0)
    return forests.superpixels_forest(p, "v", 200, 20, dynamic=False, saliency="s")


@query("graph_cut")
def graph_cut(spark, folder):
    return forests.graph_cut(seeded(spark, folder), "v", "seed")


@query("mixture_cut")
def mixture_cut(spark, folder):
    return forests.mixture_cut(seeded(spark, folder), "v", "seed")


@query("close_basins")
def close_basins(spark, folder):
    return forests.close_basins(pixels(spark, folder), "v")


@query("close_basins_by_depth")
def close_basins_by_depth(spark, folder):
    return forests.close_basins(pixels(spark, folder), "v", 30)


@query("gray_watershed")
def gray_watershed(spark, folder):
    return forests.gray_watershed(pixels(spark, folder), "v", 30)


@query("superpixels_recentred")
def superpixels_recentred(spark, folder):
    return forests.superpixels_recentred(pixels(spark, folder), "v", 8)


@query("geodesic_length", f"{SEEDED}, i AS (SELECT * FROM s WHERE v > 100), o(dx, dy) AS (SELECT a, b FROM (VALUES (-1), (0), (1)) s(a), (VALUES (-1), (0), (1)) t(b) WHERE a <> 0 OR b <> 0), g AS (SELECT p.image_id, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, sqrt(o.dx * o.dx + o.dy * o.dy) AS w FROM i p, o JOIN i q ON q.image_id = p.image_id AND q.x = p.x + o.dx AND q.y = p.y + o.dy), r(image_id, x, y, cost) USING KEY (image_id, x, y) AS (SELECT image_id, x, y, 0::DOUBLE FROM i WHERE seed > 0 UNION SELECT g.image_id, g.qx, g.qy, min(r.cost + g.w) FROM r JOIN g ON g.image_id = r.image_id AND g.px = r.x AND g.py = r.y LEFT JOIN recurring.r o ON o.image_id = g.image_id AND o.x = g.qx AND o.y = g.qy WHERE r.cost + g.w < coalesce(o.cost, 1e300) - 1e-9 GROUP BY ALL) SELECT image_id, x, y, round(cost, 4) AS dist FROM r")
def geodesic_length(spark, folder):
    """Lengths of the shortest paths within the mask, where a seed reaches."""
    d = geodesic_distance(spark, folder).where("dist IS NOT NULL AND NOT isnan(dist)")
    return d.select("image_id", "x", "y", F.round("dist", 4).alias("dist"))


@query("geodesic_distance")
def geodesic_distance(spark, folder):
    return forests.geodesic_distance(seeded(spark, folder).withColumn("m", (F.col("v") > 100).cast("int")), "seed", "m")


@query("bilateral_filter", f"WITH {PX}, o(dx, dy) AS (VALUES " + ", ".join(f"({a}, {b})" for a, b in grid.circular(2.0)) + "), n AS (SELECT p.image_id, p.x, p.y, q.v, exp(-(o.dx * o.dx + o.dy * o.dy) / 8.0) * exp(-((p.v - q.v) * (p.v - q.v)) / 800.0) AS w FROM px p, o JOIN px q ON q.image_id = p.image_id AND q.x = p.x + o.dx AND q.y = p.y + o.dy) SELECT image_id, x, y, round(sum(w * v) / sum(w), 6) AS smoothed FROM n GROUP BY ALL")
def bilateral_filter(spark, folder):
    return forests.bilateral(pixels(spark, folder), "v", 2, 2.0, 20.0)


@query("spectrum_energy", f"WITH {PX} SELECT image_id, round(log10(count(*) * sum(CAST(v AS DOUBLE) * v)), 6) AS energy, round(CAST(sum(v) AS DOUBLE), 3) AS mean_term FROM px GROUP BY 1")
def spectrum_energy(spark, folder):
    """Sum of the squared magnitudes (by Parseval's law n times that of the values), and the term at 0."""
    s = spectrum(spark, folder)
    return s.groupBy("image_id").agg(F.round(F.log10(F.sum(F.col("magnitude") ** 2)), 6).alias("energy"), F.round(F.max(F.when((F.col("x") == 0) & (F.col("y") == 0), F.col("magnitude"))), 3).alias("mean_term"))


@query("spectrum")
def spectrum(spark, folder):
    return forests.spectrum(pixels(spark, folder), "v")


@query("region_merging")
def region_merging(spark, folder):
    p = pixels(spark, folder).withColumn("region", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8) + 1).cast("long"))
    return forests.region_merging(p, "v", "region", 6)


@query("forest_descendants", "WITH RECURSIVE r(id, root, depth) AS (SELECT o_orderkey, o_orderkey, 0::BIGINT FROM orders WHERE o_orderkey < 3 UNION ALL SELECT o.o_orderkey, r.root, r.depth + 1 FROM orders o JOIN r ON (o.o_orderkey // 3) = r.id AND o.o_orderkey >= 3) SELECT id, root, depth FROM r")
def forest_descendants(spark, folder):
    from arborgrid.tables import read

    o = F.col("o_orderkey")
    pred = read(spark, folder, "orders").select(o.alias("id"), F.when(o >= 3, F.floor(o / 3)).cast("long").alias("pred"))
    return graphs.forest_descendants(pred, Scratch(spark, "forest"))


@query("leaves_and_roots", "SELECT o_orderkey AS id, o_orderkey < 3 AS is_root, o_orderkey NOT IN (SELECT o_orderkey // 3 FROM orders WHERE o_orderkey >= 3) AS is_leaf FROM orders")
def leaves_and_roots(spark, folder):
    from arborgrid.tables import read

    o = F.col("o_orderkey")
    return graphs.leaves_and_roots(read(spark, folder, "orders").select(o.alias("id"), F.when(o >= 3, F.floor(o / 3)).cast("long").alias("pred")))
