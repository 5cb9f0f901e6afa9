"""Graphs of neighbours, clusters on them, scores of features, moments, tiles and colour tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborgrid.functions import boxes, color
from arborgrid.operators import detection, graphs, grid, learning, neighbours, statistics
from arborgrid.plans import Scratch
from arborgrid.queries.images import PX, pixels
from arborgrid.queries.learning import EDGES, NB, vectors
from arborgrid.registry import query
from arborgrid.tables import read


def _lists(spark, folder, k: int):
    e = vectors(spark, folder)
    return neighbours.nearest(e, e, "vec_id", "embedding", k, exclude_self=True)


@query("asymmetric_edges", f"WITH {NB.format(k=5)} SELECT a.id AS a, a.neighbour AS b FROM n a LEFT JOIN n b ON b.id = a.neighbour AND b.neighbour = a.id WHERE b.id IS NULL")
def asymmetric_edges(spark, folder):
    """Arcs of the 5-nearest lists without the way back."""
    return graphs.asymmetric_edges(_lists(spark, folder, 5).select(F.col("id").alias("a"), F.col("neighbour").alias("b")))


@query("degrees", EDGES + " SELECT a AS id, count(*) AS degree FROM g GROUP BY 1")
def degrees(spark, folder):
    return graphs.degrees(learning.knn_edges(vectors(spark, folder), "vec_id", "embedding", 5))


@query("normalised_cut", EDGES + ", w AS (SELECT x.label AS ca, y.label AS cb, 1 / w AS v FROM e JOIN embeddings x ON x.vec_id = e.a JOIN embeddings y ON y.vec_id = e.b), t AS (SELECT ca AS c, ca <> cb AS out, v FROM w UNION ALL SELECT cb, ca <> cb, v FROM w), c AS (SELECT c, sum(CASE WHEN out THEN v ELSE 0 END) / sum(v) AS s FROM t GROUP BY 1) SELECT round(sum(s), 6) AS cut FROM c")
def normalised_cut(spark, folder):
    """Of the labels on the 5-nearest graph."""
    e = vectors(spark, folder)
    labels = e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return spark.createDataFrame([(round(learning.normalised_cut(learning.knn_edges(e, "vec_id", "embedding", 5), labels), 6),)], "cut double")


@query("connected_knn_graph", "SELECT count(*) AS vertices, 1::BIGINT AS components, true AS holds_lists FROM embeddings")
def connected_knn_graph(spark, folder):
    """The graph of the 2 nearest made connected: vertices, components, and whether all lists are in it."""
    scratch = Scratch(spark, "connected")
    e = vectors(spark, folder)
    g = scratch.put(learning.connected_knn_graph(e, "vec_id", "embedding", 2, scratch))
    lost = learning.knn_edges(e, "vec_id", "embedding", 2).join(g, ["a", "b"], "left_anti").count()
    return graphs.connected_components(g, scratch).agg(F.count(F.lit(1)).alias("vertices"), F.countDistinct("root").alias("components")).withColumn("holds_lists", F.lit(lost == 0))


@query("iterated_path_forest")
def iterated_path_forest(spark, folder):
    scratch = Scratch(spark, "iterated")
    e = vectors(spark, folder)
    g = scratch.put(learning.connected_knn_graph(e, "vec_id", "embedding", 5, scratch))
    return learning.iterated_path_forest(e, "vec_id", "embedding", g, 4, scratch, rounds=3).withColumn("cost", F.round("cost", 6))


@query("best_k_clusters")
def best_k_clusters(spark, folder):
    """Density clusters with the number of neighbours, of three, that cuts least."""
    k, found = learning.best_k(vectors(spark, folder), "vec_id", "embedding", (5, 10, 20), Scratch(spark, "best"))
    return found.select("id", "cluster", F.lit(k).alias("k"))


@query("fisher_scores", "WITH f AS (SELECT label AS l, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings), c AS (SELECT place, l, count(*) AS n, avg(CAST(v AS DOUBLE)) AS m, var_pop(CAST(v AS DOUBLE)) AS s FROM f GROUP BY ALL), t AS (SELECT place, sum(n * m) / sum(n) AS t FROM c GROUP BY 1) SELECT CAST(c.place AS INT) AS place, round((sum(n * (m - t) * (m - t)) / sum(n)) / (sum(n * s) / sum(n)), 6) AS score FROM c JOIN t ON t.place = c.place GROUP BY c.place")
def fisher_scores(spark, folder):
    return learning.fisher_scores(vectors(spark, folder), "embedding", "label").withColumn("score", F.round("score", 6))


@query("neural_network")
def neural_network(spark, folder):
    e = vectors(spark, folder)
    return learning.predict(learning.neural_network(e, "embedding", "label"), e, "embedding").select("vec_id", "label", "pred")


@query("moments_removed", "SELECT l_suppkey, count(*) FILTER (l_quantity <= 40) AS n, round(avg(l_quantity) FILTER (l_quantity <= 40), 6) AS mean, round(var_pop(l_quantity) FILTER (l_quantity <= 40), 5) AS var FROM lineitem GROUP BY 1")
def moments_removed(spark, folder):
    """Moments of all rows less those of some, without reading the rest again."""
    l = read(spark, folder, "lineitem")
    out = statistics.merged(statistics.moments(l, ["l_suppkey"], "l_quantity"), statistics.moments(l.where("l_quantity > 40"), ["l_suppkey"], "l_quantity"), ["l_suppkey"], remove=True)
    return out.select("l_suppkey", "n", F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"))


@query("moments_merged", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 5) AS var FROM lineitem GROUP BY 1")
def moments_merged(spark, folder):
    l = read(spark, folder, "lineitem")
    a, b = (statistics.moments(l.where(c), ["l_returnflag"], "l_quantity") for c in ("l_linenumber <= 2", "l_linenumber > 2"))
    return statistics.merged(a, b, ["l_returnflag"]).select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"))


@query("array_extremes", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS largest, CAST(list_position(embedding, list_min(embedding)) - 1 AS INT) AS smallest FROM embeddings")
def array_extremes(spark, folder):
    """Place, from 0, of the first largest and the first smallest element."""
    e = vectors(spark, folder)
    place = lambda c: (F.array_position("embedding", c) - 1).cast("int")
    return e.select("vec_id", place(F.array_max("embedding")).alias("largest"), place(F.array_min("embedding")).alias("smallest"))


@query("tiles", f"WITH {PX} SELECT image_id, CAST(y // 16 * 1000 + x // 16 AS INT) AS tile, count(*) AS n, max(v) AS top FROM px GROUP BY ALL")
def tiles(spark, folder):
    return grid.tiles(pixels(spark, folder), 16).groupBy("image_id", "tile").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))


@query("box_algebra", f"WITH {PX}, b AS (SELECT image_id, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE v > 200 GROUP BY ALL) SELECT image_id, label, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x1 - x0 + 1) * (y1 - y0 + 1) AS area, CAST(greatest(floor(x0 - (x1 - x0) * 0.25), 0) AS INT) AS sx0, CAST(greatest(floor(y0 - (y1 - y0) * 0.25), 0) AS INT) AS sy0, CAST(least(ceil(x1 + (x1 - x0) * 0.25), 63) AS INT) AS sx1, CAST(least(ceil(y1 + (y1 - y0) * 0.25), 63) AS INT) AS sy1 FROM b")
def box_algebra(spark, folder):
    """Centres, areas, and boxes grown by half and clipped."""
    b = detection.bounding_boxes(pixels(spark, folder).where("v > 200"), ["image_id", "label"])
    box = boxes.box()
    (cx, cy), grown = boxes.centre(box), boxes.scale(box, 1.5, 64, 64)
    return b.select("image_id", "label", cx.alias("cx"), cy.alias("cy"), boxes.area(box).alias("area"), *[c.alias(n) for c, n in zip(grown, ("sx0", "sy0", "sx1", "sy1"))])


@query("colour_tables", f"WITH {PX}, t AS (SELECT DISTINCT v FROM px) SELECT v, CAST(v AS INT) AS gray, CAST(round(greatest(0, least(1, v / 255 * 3)) * 255) AS INT) AS hot_r, CAST(round(greatest(0, least(1, v / 255 * 3 - 1)) * 255) AS INT) AS hot_g, CAST(round(greatest(0, least(1, v / 255 * 3 - 2)) * 255) AS INT) AS hot_b FROM t")
def colour_tables(spark, folder):
    v = F.col("v")
    r, g, b = color.hot_table(v)
    return pixels(spark, folder).select("v").distinct().select("v", color.gray_table(v)[0].alias("gray"), r.alias("hot_r"), g.alias("hot_g"), b.alias("hot_b"))
