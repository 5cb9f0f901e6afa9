"""Region graphs, masks, holes and components of errors on the pixels of queries.images."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborgrid.operators import grid, markers, regions
from arborgrid.plans import Scratch
from arborgrid.queries.images import PX, pixels
from arborgrid.registry import query

TILES = "q AS (SELECT *, y // 8 * 8 + x // 8 + 1 AS region FROM px), r AS (SELECT image_id, region, count(*) AS area, avg(v) AS v FROM q GROUP BY ALL), e AS (SELECT a.image_id, a.region AS a, b.region AS b, abs(a.v - b.v) AS w FROM r a JOIN r b ON b.image_id = a.image_id AND (b.region = a.region + 8 OR (b.region = a.region + 1 AND a.region % 8 <> 0)))"


def _tiles(spark, folder):
    return pixels(spark, folder).withColumn("region", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8) + 1).cast("long"))


@query("region_nodes", f"WITH {PX}, {TILES} SELECT image_id, region, area, round(v, 6) AS v FROM r")
def region_nodes(spark, folder):
    return regions.region_graph(_tiles(spark, folder), "region", ["v"])[0].withColumn("v", F.round("v", 6))


@query("region_graph", f"WITH {PX}, {TILES} SELECT image_id, a, b, round(w, 6) AS w FROM e")
def region_graph(spark, folder):
    return regions.region_graph(_tiles(spark, folder), "region", ["v"])[1].withColumn("w", F.round("w", 6))


SPREAD = "g AS (SELECT image_id, a, b, {w} AS w FROM e UNION ALL SELECT image_id, b, a, {w} FROM e), f(image_id, region, c) USING KEY (image_id, region) AS (SELECT image_id, region, (0.0::DOUBLE, CASE WHEN region = 1 THEN 1 ELSE 2 END, region) FROM r WHERE region IN (1, 8) UNION SELECT g.image_id, g.b, min(({add}, f.c[2], f.c[3])) FROM f JOIN g ON g.image_id = f.image_id AND g.a = f.region LEFT JOIN recurring.f o ON o.image_id = g.image_id AND o.region = g.b WHERE o.region IS NULL OR ({add}, f.c[2], f.c[3]) < o.c GROUP BY ALL)"


def _classified(spark, folder, additive: bool):
    scratch = Scratch(spark, "regions")
    arcs = scratch.put(regions.region_graph(_tiles(spark, folder), "region", ["v"])[1])
    if additive:
        arcs = arcs.withColumn("w", regions.geodesic_weight(F.col("w") / 10))
    seeds = _tiles(spark, folder).where("region IN (1, 8)").select("image_id", "region", F.when(F.col("region") == 1, 1).otherwise(2).alias("label")).distinct()
    return regions.classify_regions(arcs, seeds, scratch, additive).withColumn("cost", F.round("cost", 6))


@query("region_classification", f"WITH RECURSIVE {PX}, {TILES}, {SPREAD.format(w='w', add='greatest(f.c[1], g.w)')} SELECT image_id, region, round(c[1], 6) AS cost FROM f")
def region_classification(spark, folder):
    """Costs of labels of two corner tiles spread by the least largest arc."""
    return _classified(spark, folder, False).drop("label")


@query("region_classification_geodesic", f"WITH RECURSIVE {PX}, {TILES}, {SPREAD.format(w='(1 - exp(-w / 10 / 0.5))', add='(f.c[1] + g.w)')} SELECT image_id, region, c[2] AS label, round(c[1], 6) AS cost FROM f")
def region_classification_geodesic(spark, folder):
    """The same by sums of bounded arcs."""
    return _classified(spark, folder, True)


@query("relabel_regions", f"WITH {PX}, l AS (SELECT image_id, x, y, CASE WHEN v > 60 THEN label * 10 ELSE 0 END AS l FROM px), n AS (SELECT image_id, l, row_number() OVER (PARTITION BY image_id ORDER BY l) AS n FROM (SELECT DISTINCT image_id, l FROM l WHERE l > 0)) SELECT l.image_id, x, y, CAST(coalesce(n, 0) AS INT) AS l FROM l LEFT JOIN n ON n.image_id = l.image_id AND n.l = l.l")
def relabel_regions(spark, folder):
    l = pixels(spark, folder).select("image_id", "x", "y", F.when(F.col("v") > 60, F.col("label") * 10).otherwise(0).alias("l"))
    return regions.relabel(l, "l").select("image_id", "x", "y", "l")


@query("joint_masks", f"WITH {PX} SELECT x, y, max(CAST(v > 150 AS INT)) AS any_of, min(CAST(v > 60 AS INT)) AS all_of FROM px GROUP BY ALL")
def joint_masks(spark, folder):
    p = pixels(spark, folder)
    a = regions.join_masks(p.withColumn("m", (F.col("v") > 150).cast("int")), "m").withColumnRenamed("m", "any_of")
    return a.join(regions.join_masks(p.withColumn("m", (F.col("v") > 60).cast("int")), "m", True).withColumnRenamed("m", "all_of"), ["x", "y"])


STEP = "SELECT p.image_id, p.x, p.y, {f}(q.m) AS m FROM {t} p JOIN {t} q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2 WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 4 GROUP BY ALL"


@query("mask_morphology", f"WITH {PX}, b AS (SELECT image_id, x, y, CAST(v > 130 AS INT) AS m FROM px), di AS ({STEP.format(f='max', t='b')}), er AS ({STEP.format(f='min', t='b')}), op AS ({STEP.format(f='max', t='er')}), cl AS ({STEP.format(f='min', t='di')}) SELECT di.image_id, di.x, di.y, di.m AS dilated, er.m AS eroded, op.m AS opened, cl.m AS closed FROM di JOIN er USING (image_id, x, y) JOIN op USING (image_id, x, y) JOIN cl USING (image_id, x, y)")
def mask_morphology(spark, folder):
    """Disc of radius 2, by distance transforms."""
    p = pixels(spark, folder).select("image_id", "x", "y", (F.col("v") > 130).cast("int").alias("m"))
    out = regions.dilate_mask(p, "m", 2.0)
    for f in (regions.erode_mask, regions.open_mask, regions.close_mask):
        out = out.join(f(p, "m", 2.0), ["image_id", "x", "y"])
    return out


@query("fill_holes", f"""WITH RECURSIVE {PX}, b AS (SELECT *, (image_id * 4096 + y) * 4096 + x AS id FROM px WHERE v <= 110), g AS (SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1),
  r(id) AS (SELECT id FROM b WHERE x IN (0, 63) OR y = 0 OR (image_id, y) IN (SELECT (image_id, max(y)) FROM px GROUP BY image_id) UNION SELECT g.b FROM r JOIN g ON g.a = r.id) SELECT image_id, x, y, CAST(v > 110 OR (image_id * 4096 + y) * 4096 + x NOT IN (SELECT id FROM r) AS INT) AS filled FROM px""")
def fill_holes(spark, folder):
    p = pixels(spark, folder).select("image_id", "x", "y", (F.col("v") > 110).cast("int").alias("m"))
    return regions.fill_holes(p, "m", Scratch(spark, "holes"))


ERR = "w AS (SELECT *, image_id * 1099511627776 + y * 1048576 + x AS id FROM px WHERE (v > 120) <> (label > 5)), h AS (SELECT p.id AS a, q.id AS b FROM w p JOIN w q ON q.image_id = p.image_id AND q.x = p.x + 1 AND q.y = p.y UNION ALL SELECT p.id, q.id FROM w p JOIN w q ON q.image_id = p.image_id AND q.x = p.x AND q.y = p.y + 1), g AS MATERIALIZED (SELECT a, b FROM h UNION ALL SELECT b, a FROM h), r(id, root) USING KEY (id) AS (SELECT id, id FROM w UNION SELECT g.b, min(r.root) FROM r JOIN g ON g.a = r.id JOIN recurring.r o ON o.id = g.b WHERE r.root < o.root GROUP BY g.b)"


def _labelled(spark, folder):
    return pixels(spark, folder).select("image_id", "x", "y", (F.col("v") > 120).cast("int").alias("found"), (F.col("label") > 5).cast("int").alias("truth"))


@query("error_components", f"WITH RECURSIVE {PX}, {ERR}, n AS (SELECT image_id, root, count(*) AS area FROM r JOIN w ON w.id = r.id GROUP BY ALL) SELECT image_id, root, area, CAST(row_number() OVER (PARTITION BY image_id ORDER BY area DESC, root) AS INT) AS rank FROM n")
def error_components(spark, folder):
    return regions.error_components(_labelled(spark, folder), "found", "truth", Scratch(spark, "errors"))


@query("robot_seeds", f"WITH RECURSIVE {PX}, {ERR}, ok AS (SELECT * FROM px WHERE (v > 120) = (label > 5)), t AS (SELECT r.root, w.image_id, w.x, w.y, w.label, min((ok.x - w.x) * (ok.x - w.x) + (ok.y - w.y) * (ok.y - w.y)) AS d FROM r JOIN w ON w.id = r.id JOIN ok ON ok.image_id = w.image_id AND abs(ok.x - w.x) <= 8 AND abs(ok.y - w.y) <= 8 GROUP BY ALL), s AS (SELECT image_id, root, arg_min((x, y, label), (-d, y, x)) AS s, count(*) AS area FROM t GROUP BY ALL) SELECT image_id, s[1] AS x, s[2] AS y, CAST(s[3] > 5 AS INT) AS label FROM s WHERE area >= 5")
def robot_seeds(spark, folder):
    """One corrective seed in each component of five wrong pixels or more."""
    return regions.robot_seeds(_labelled(spark, folder), "found", "truth", Scratch(spark, "robot"), 5)


BOXED = "SELECT p.image_id, p.x, p.y, {f}(q.v) AS v FROM {t} p JOIN {t} q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY ALL"


@query("top_hat", f"WITH {PX}, e AS ({BOXED.format(f='min', t='px')}), o AS ({BOXED.format(f='max', t='e')}), d AS ({BOXED.format(f='max', t='px')}), c AS ({BOXED.format(f='min', t='d')}) SELECT p.image_id, p.x, p.y, p.v - o.v AS white, c.v - p.v AS black FROM px p JOIN o USING (image_id, x, y) JOIN c USING (image_id, x, y)")
def top_hat(spark, folder):
    return regions.top_hat(pixels(spark, folder).select("image_id", "x", "y", "v"), "v")


_BANDS = f"""WITH {PX}, u AS (SELECT image_id, x, y, CAST(v AS DOUBLE) AS a, CAST((v * 7 + x) % 256 AS DOUBLE) AS b, CAST((v + y * 3) % 256 AS DOUBLE) AS c FROM px), k AS (SELECT image_id, max(a) AS ma, max(b) AS mb, max(c) AS mc FROM u GROUP BY 1),
  n AS MATERIALIZED (SELECT u.image_id, x, y, a / ma AS a, b / mb AS b, c / mc AS c FROM u JOIN k ON k.image_id = u.image_id), d(dx, dy) AS (VALUES {", ".join(f"({a}, {b})" for a, b in grid.circular(1.5))}),
  w AS (SELECT p.image_id, p.x, p.y, p.a, p.b, p.c, sum(q.a + q.c) / 18 AS m1, sum(q.b) / 9 AS m0, sum(q.a * q.a + q.c * q.c) / 18 AS s1, sum(q.b * q.b) / 9 AS s0 FROM n p, d JOIN n q ON q.image_id = p.image_id AND q.x = p.x + d.dx AND q.y = p.y + d.dy GROUP BY ALL),
  v AS (SELECT *, CASE WHEN s1 - m1 * m1 < 1e-7 THEN 1 ELSE s1 - m1 * m1 END AS v1, CASE WHEN s0 - m0 * m0 < 1e-7 THEN 1 ELSE s0 - m0 * m0 END AS v0 FROM w)"""
_SCALED = ", z AS (SELECT image_id, min(s) AS lo, max(s) AS hi FROM s GROUP BY 1) SELECT s.image_id, x, y, round((s - lo) / (hi - lo) * 255, 6) AS saliency FROM s JOIN z ON z.image_id = s.image_id"


def _decoded(spark, folder, by_probability: bool):
    v = F.col("v").cast("double")
    bands = pixels(spark, folder).select("image_id", "x", "y", F.array(v, (v * 7 + F.col("x")) % 256, (v + F.col("y") * 3) % 256).alias("bands"))
    return markers.disc_decoder(bands, (1, 0, 1), by_probability)


@query("mean_decoder", _BANDS + ", s AS (SELECT image_id, x, y, greatest(CASE WHEN m1 > m0 THEN a + c ELSE 0 END - CASE WHEN m1 < m0 THEN b ELSE 0 END, 0) AS s FROM v)" + _SCALED)
def mean_decoder(spark, folder):
    """Three bands, the second of the background."""
    return _decoded(spark, folder, False)


def _like(x: str, m: str, v: str) -> str:
    return f"exp(-({x} - {m}) * ({x} - {m}) / (2 * {v}))"


@query("probability_decoder", _BANDS + ", s AS (SELECT image_id, x, y, greatest(" + " + ".join(f"CASE WHEN {_like(x, 'm1', 'v1')} > {_like(x, 'm0', 'v0')} THEN {x} ELSE 0 END" for x in "ac") + f" - CASE WHEN {_like('b', 'm1', 'v1')} < {_like('b', 'm0', 'v0')} THEN b ELSE 0 END, 0) AS s FROM v)" + _SCALED)
def probability_decoder(spark, folder):
    return _decoded(spark, folder, True)
