"""Linear algebra and tensors on the embeddings table, and pixel-wise functions without a query elsewhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from arborgrid.functions import arith, color
from arborgrid.operators import learning, matrices, search
from arborgrid.queries.images import PX, pixels
from arborgrid.registry import query
from arborgrid.tables import read

M = "m AS (SELECT vec_id AS i, CAST(p - 1 AS BIGINT) AS j, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings))"


def _matrix(spark, folder):
    e = read(spark, folder, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return e.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


@query("matrix_centred", f"WITH {M}, c AS (SELECT j, avg(v) AS a FROM m GROUP BY 1) SELECT i, m.j, round(v - a, 6) AS v FROM m JOIN c ON c.j = m.j")
def matrix_centred(spark, folder):
    return matrices.centred(_matrix(spark, folder)).withColumn("v", F.round("v", 6))


@query("matrix_unit_rows", f"WITH {M}, c AS (SELECT i, sqrt(sum(v * v)) AS a FROM m GROUP BY 1) SELECT m.i, j, round(v / a, 6) AS v FROM m JOIN c ON c.i = m.i")
def matrix_unit_rows(spark, folder):
    return matrices.unit_rows(_matrix(spark, folder)).withColumn("v", F.round("v", 6))


@query("matrix_with_vector", f"WITH {M} SELECT i, j, round(v * (j % 5), 6) + 0.0 AS product, round(CASE WHEN i % 7 <> 0 THEN v / (i % 7) END, 6) AS quotient FROM m")
def matrix_with_vector(spark, folder):
    """Columns times one vector; rows divided by another."""
    m = _matrix(spark, folder)
    across = spark.range(64).select(F.col("id").alias("k"), (F.col("id") % 5).cast("double").alias("v"))
    down = m.select(F.col("i").alias("k")).distinct().select("k", (F.col("k") % 7).cast("double").alias("v"))
    a = matrices.with_vector(m, across, "j", "*").withColumnRenamed("v", "product")
    return a.join(matrices.with_vector(m, down, "i", "/").withColumnRenamed("v", "quotient"), ["i", "j"]).select("i", "j", (F.round("product", 6) + F.lit(0.0)).alias("product"), F.round("quotient", 6).alias("quotient"))


@query("matrix_elementwise", f"WITH {M} SELECT a.i, a.j, round(a.v + b.v, 6) AS added, round(a.v * b.v, 6) AS product, round(greatest(least(a.v * 3, 0.5), -0.5), 6) AS clamped FROM m a JOIN m b ON b.i = a.i AND b.j = 63 - a.j")
def matrix_elementwise(spark, folder):
    a = _matrix(spark, folder)
    b = a.withColumn("j", 63 - F.col("j"))
    parts = [matrices.elementwise(a, b, "+"), matrices.elementwise(a, b, "*"), matrices.clamp(matrices.scalar(a, 3.0, "*"), -0.5, 0.5)]
    named = [p.select("i", "j", F.round("v", 6).alias(n)) for p, n in zip(parts, ("added", "product", "clamped"))]
    return named[0].join(named[1], ["i", "j"]).join(named[2], ["i", "j"])


@query("covariance_matrix", f"WITH {M}, c AS (SELECT i, m.j, v - avg(v) OVER (PARTITION BY m.j) AS v FROM m) SELECT CAST(a.j AS BIGINT) AS i, b.j, round(sum(a.v * b.v) / count(*), 6) AS v FROM c a JOIN c b ON b.i = a.i GROUP BY a.j, b.j")
def covariance_matrix(spark, folder):
    c = matrices.covariance(read(spark, folder, "embeddings"), "embedding")
    return matrices.sparse(spark, np.round(c, 6))


@query("matrix_inverse", "SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM range(8) a(i), range(8) b(j)")
def matrix_inverse(spark, folder):
    """The covariance of eight places times its inverse."""
    c = matrices.sparse(spark, matrices.covariance(read(spark, folder, "embeddings").select(F.slice("embedding", 1, 8).alias("e")), "e"))
    return matrices.multiply(c, matrices.inverse(c)).select("i", "j", (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query("determinant", "SELECT round(a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c), 4) AS determinant FROM (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_tax * 100) AS b, covar_pop(l_quantity, l_discount * 100) AS c, var_pop(l_tax * 100) AS d, covar_pop(l_tax * 100, l_discount * 100) AS e, var_pop(l_discount * 100) AS f FROM lineitem)")
def determinant(spark, folder):
    """Of the covariance of three columns."""
    v = read(spark, folder, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.col("l_tax") * 100, F.col("l_discount") * 100).alias("v"))
    return spark.createDataFrame([(round(matrices.determinant(matrices.sparse(spark, matrices.covariance(v, "v"))), 4),)], "determinant double")


@query("least_squares", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def least_squares(spark, folder):
    a, b = matrices.least_squares(read(spark, folder, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(a, 4), round(b, 3))], "slope double, intercept double")


@query("singular_values", "SELECT round(sqrt((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2), 4) AS first, round(sqrt((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2), 4) AS second FROM (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_linenumber) AS b, sum(l_linenumber * l_linenumber) AS c FROM lineitem)")
def singular_values(spark, folder):
    """Of the matrix of two columns of all rows."""
    rows = read(spark, folder, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")).alias("v"))
    s, _ = matrices.singular_values(rows, "v")
    return spark.createDataFrame([(round(float(s[0]), 4), round(float(s[1]), 4))], "first double, second double")


@query("matrix_reshape", f"WITH {M} SELECT i * 2 + j // 32 AS i, j % 32 AS j, round(v, 6) AS v FROM m WHERE i * 2 + j // 32 BETWEEN 10 AND 90")
def matrix_reshape(spark, folder):
    """Half rows as rows, of which some are taken out."""
    wide = matrices.reshape(_matrix(spark, folder), 64, 32)
    part = matrices.submatrix(wide, (10, 90), (0, 31))
    return part.select((F.col("i") + 10).alias("i"), "j", F.round("v", 6).alias("v"))


@query("tensor_contract", f"WITH {M} SELECT i AS t, j // 8 AS a, round(sum(v * (j % 8 + 1)), 6) AS v FROM m GROUP BY ALL")
def tensor_contract(spark, folder):
    """A tensor of three indices with a vector over the last."""
    t = _matrix(spark, folder).select(F.col("i").alias("t"), F.floor(F.col("j") / 8).cast("long").alias("a"), (F.col("j") % 8).alias("b"), "v")
    w = spark.range(8).select(F.col("id").alias("b"), (F.col("id") + 1).cast("double").alias("v"))
    return matrices.contract(t, w, ["b"]).withColumn("v", F.round("v", 6))


@query("mahalanobis", "WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, CAST(x[1] AS DOUBLE) - CAST(y[1] AS DOUBLE) AS a, CAST(x[2] AS DOUBLE) - CAST(y[2] AS DOUBLE) AS b FROM p) SELECT vec_id, round(2 * a * a + a * b + 3 * b * b, 6) AS d FROM d")
def mahalanobis(spark, folder):
    e = read(spark, folder, "embeddings").select("vec_id", F.slice("embedding", 1, 2).cast("array<double>").alias("x"))
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(y, "vec_id").select("vec_id", F.round(matrices.mahalanobis(F.col("x"), F.col("y"), np.array([[2.0, 0.5], [0.5, 3.0]])), 6).alias("d"))


@query("label_logic", f"WITH {PX}, l AS (SELECT image_id, x, y, CAST(v > 120 AS INT) * label AS a, CAST((v + x) % 256 > 120 AS INT) * label AS b, v FROM px) SELECT image_id, x, y, least(a, b) AS both, greatest(a, b) AS either, CAST(a <> b AS INT) AS differ, CASE WHEN a = b THEN a ELSE 0 END AS agreed, CASE WHEN a <> 0 THEN v ELSE 0 END AS masked, CASE WHEN a = 3 THEN v ELSE 0 END AS of_three, CAST(a > 0 AS INT) AS binary, 255 - v AS complement FROM l")
def label_logic(spark, folder):
    v, label = F.col("v"), F.col("label")
    l = pixels(spark, folder).select("image_id", "x", "y", "v", ((v > 120).cast("int") * label).alias("a"), (((v + F.col("x")) % 256 > 120).cast("int") * label).alias("b"))
    a, b = F.col("a"), F.col("b")
    return l.select("image_id", "x", "y", arith.label_and(a, b).alias("both"), arith.label_or(a, b).alias("either"), arith.label_xor(a, b).alias("differ"), arith.label_intersection(a, b).alias("agreed"),
        arith.mask(v, a).alias("masked"), arith.mask(v, a, 3).alias("of_three"), arith.binarize(a).alias("binary"), arith.complement(v, 255).alias("complement"))


@query("stretches", f"WITH {PX} SELECT image_id, x, y, round(CASE WHEN v < 78 THEN 0 WHEN v > 178 THEN 255 ELSE (v - 78) * 2.55 END, 4) AS window_level, round(255 * exp(-(v - 128.0) * (v - 128.0) / (2 * 400.0)), 4) AS gaussian, round(CASE WHEN v BETWEEN 50 AND 200 THEN 255 * (exp((v - 50) / 150.0) - 1) / (exp(1.0::DOUBLE) - 1) ELSE v END, 4) AS exponential FROM px")
def stretches(spark, folder):
    v = F.col("v").cast("double")
    parts = {"window_level": arith.window_level(v, 100, 128, 255), "gaussian": arith.gaussian_stretch(v, F.lit(128.0), F.lit(20.0), 255), "exponential": arith.exponential_stretch(v, 50, 200, 0, 255)}
    return pixels(spark, folder).select("image_id", "x", "y", *[F.round(c, 4).alias(n) for n, c in parts.items()])


@query("colour_round_trips", f"WITH {PX} SELECT image_id, x, y, v AS r, (v * 7 + x) % 256 AS g, (v + 3 * y) % 256 AS b, true AS ycbcr, true AS hsv, true AS lab, true AS hex FROM px")
def colour_round_trips(spark, folder):
    """Colours through four other spaces and back: no channel is off by as much as a half."""
    p = pixels(spark, folder).select("image_id", "x", "y", F.col("v").alias("r"), ((F.col("v") * 7 + F.col("x")) % 256).alias("g"), ((F.col("v") + 3 * F.col("y")) % 256).alias("b"))
    rgb = [F.col(c).cast("double") for c in "rgb"]

    def back(triple):
        ok = F.lit(True)
        for x, y in zip(rgb, triple):
            ok = ok & (F.abs(x - y) < 0.5)
        return ok

    trips = {"ycbcr": color.ycbcr_to_rgb(*color.rgb_to_ycbcr(*rgb)), "hsv": color.hsv_to_rgb(*color.rgb_to_hsv(*rgb)), "lab": color.lab_to_rgb(*color.rgb_to_lab(*rgb)), "hex": color.hex_to_rgb(color.rgb_to_hex(*rgb))}
    return p.select("image_id", "x", "y", "r", "g", "b", *[back(t).alias(n) for n, t in trips.items()])


@query("sql_distance", "SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sql_distance(spark, folder):
    """A function registered for SQL."""
    from arborgrid.functions import hooks

    hooks.register(spark)
    e = read(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(F.expr("vector_l2(a, b)"), 6).alias("d"))


@query("evaluated_grid", "SELECT a, b, -((a - 1) * (a - 1) + (b + 2) * (b + 2)) AS fitness FROM (SELECT CAST(unnest(range(-3, 4)) AS DOUBLE) AS a), (SELECT CAST(unnest(range(-3, 4)) AS DOUBLE) AS b) ORDER BY fitness DESC, a, b LIMIT 1")
def evaluated_grid(spark, folder):
    """Best point of a grid under a Python fitness function."""
    g = search.parameter_grid(spark, {"a": range(-3, 4), "b": range(-3, 4)})
    return learning.grid_search(search.evaluate(g, lambda p: -((p["a"] - 1) ** 2 + (p["b"] + 2) ** 2)), "fitness")
