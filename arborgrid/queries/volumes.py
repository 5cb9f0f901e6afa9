"""Volumes: the embeddings table read as 8 x 8 x 16 volumes (image vec_id div 16, z vec_id mod 16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborgrid.operators import volumes
from arborgrid.registry import query
from arborgrid.tables import read

VX = """vx AS (SELECT vec_id // 16 AS image_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, CAST(vec_id % 16 AS INT) AS z, CAST(least(255, greatest(0, floor(128 + 256 * CAST(e AS DOUBLE)))) AS INT) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)), ext AS (SELECT image_id, max(x) AS mx, max(y) AS my, max(z) AS mz FROM vx GROUP BY 1)"""


def voxels(spark, folder):
    e = read(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 256 * F.col("e").cast("double")))).cast("int")
    return e.select(F.floor(F.col("vec_id") / 16).cast("long").alias("image_id"), (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("vec_id") % 16).cast("int").alias("z"), v.alias("v"))


@query("volume_slices", f"WITH {VX} SELECT image_id, 'x' AS axis, y AS x, z AS y, v FROM vx WHERE x = 3 UNION ALL SELECT image_id, 'y', x, z, v FROM vx WHERE y = 3 UNION ALL SELECT image_id, 'z', x, y, v FROM vx WHERE z = 3")
def volume_slices(spark, folder):
    v, out = voxels(spark, folder), None
    for a in volumes.AXES:
        one = volumes.plane(v, a, 3).select("image_id", F.lit(a).alias("axis"), "x", "y", "v")
        out = one if out is None else out.unionByName(one)
    return out


@query("volume_put_slice", f"WITH {VX} SELECT p.image_id, p.x, p.y, p.z, CASE WHEN p.z = 5 THEN q.v ELSE p.v END AS v FROM vx p LEFT JOIN vx q ON q.image_id = p.image_id AND q.x = p.x AND q.y = p.y AND q.z = 2 WHERE p.z <> 5 OR q.v IS NOT NULL")
def volume_put_slice(spark, folder):
    v = voxels(spark, folder)
    return volumes.put_plane(v, volumes.plane(v, "z", 2), "z", 5, "v").select("image_id", "x", "y", "z", "v")


@query("volume_box", f"WITH {VX} SELECT p.image_id, p.x, p.y, p.z, coalesce(q.v, p.v) AS v FROM vx p LEFT JOIN vx q ON q.image_id = p.image_id AND q.x BETWEEN 1 AND 4 AND q.y BETWEEN 2 AND 5 AND q.z BETWEEN 0 AND 3 AND p.x = q.x - 1 + 4 AND p.y = q.y - 2 + 3 AND p.z = q.z + 2")
def volume_box(spark, folder):
    """A box taken out and laid over the volume at another place."""
    v = voxels(spark, folder)
    return volumes.insert(v, volumes.box(v, [(1, 4), (2, 5), (0, 3)]), (4, 3, 2), "v").select("image_id", "x", "y", "z", "v")


@query("volume_frame", f"WITH {VX} SELECT e.image_id, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(c AS INT) AS z, coalesce(v, 7) AS v FROM ext e, range(10) r(a), range(10) s(b), range(18) t(c) LEFT JOIN vx p ON p.image_id = e.image_id AND p.x = a - 1 AND p.y = b - 1 AND p.z = c - 1 WHERE a <= mx + 2 AND b <= my + 2 AND c <= mz + 2")
def volume_frame(spark, folder):
    return volumes.add_frame(voxels(spark, folder), 1, 7, "v")


@query("volume_unframed", f"WITH {VX} SELECT p.image_id, x - 1 AS x, y - 1 AS y, z - 1 AS z, v FROM vx p JOIN ext e ON e.image_id = p.image_id WHERE x BETWEEN 1 AND mx - 1 AND y BETWEEN 1 AND my - 1 AND z BETWEEN 1 AND mz - 1")
def volume_unframed(spark, folder):
    return volumes.remove_frame(voxels(spark, folder), 1).select("image_id", "x", "y", "z", "v")


@query("volume_shift", f"WITH {VX} SELECT p.image_id, x + 2 AS x, y - 1 AS y, z + 3 AS z, v FROM vx p JOIN ext e ON e.image_id = p.image_id WHERE x + 2 <= mx AND y >= 1 AND z + 3 <= mz")
def volume_shift(spark, folder):
    return volumes.shift(voxels(spark, folder), (2, -1, 3)).select("image_id", "x", "y", "z", "v")


def _targets(axis: str, s: float, n: int) -> str:
    return f"t{axis} AS (SELECT image_id, CAST(a AS INT) AS t, least(a / {s}::DOUBLE, m{axis}) AS at FROM ext, range({n}) r(a) WHERE a < floor((m{axis} + 1) * {s}))"


@query("volume_resample", f"""WITH {VX}, {_targets('x', 1.5, 12)}, {_targets('y', 0.5, 4)}, {_targets('z', 2.0, 32)}
  SELECT p.image_id, tx.t AS x, ty.t AS y, tz.t AS z, round(sum((1 - abs(tx.at - p.x)) * (1 - abs(ty.at - p.y)) * (1 - abs(tz.at - p.z)) * v), 5) AS v FROM vx p JOIN tx ON tx.image_id = p.image_id AND abs(tx.at - p.x) < 1 JOIN ty ON ty.image_id = p.image_id AND abs(ty.at - p.y) < 1 JOIN tz ON tz.image_id = p.image_id AND abs(tz.at - p.z) < 1 GROUP BY ALL""")
def volume_resample(spark, folder):
    return volumes.resample(voxels(spark, folder), "v", (1.5, 0.5, 2.0), digits=5)


@query("volume_resample_nearest", f"WITH {VX}, {_targets('x', 1.5, 12)}, {_targets('y', 0.5, 4)}, {_targets('z', 2.0, 32)} SELECT p.image_id, tx.t AS x, ty.t AS y, tz.t AS z, CAST(v AS DOUBLE) AS v FROM vx p JOIN tx ON tx.image_id = p.image_id AND floor(tx.at + 0.5) = p.x JOIN ty ON ty.image_id = p.image_id AND floor(ty.at + 0.5) = p.y JOIN tz ON tz.image_id = p.image_id AND floor(tz.at + 0.5) = p.z")
def volume_resample_nearest(spark, folder):
    return volumes.resample(voxels(spark, folder), "v", (1.5, 0.5, 2.0), nearest=True)


@query("volume_reslice", f"WITH {VX}, t AS (SELECT p.image_id, CAST(floor(z + 0.5) AS INT) AS tx, CAST(floor(y + 0.5) AS INT) AS ty, CAST(floor(x + 1 + 0.5) AS INT) AS tz, x, y, z, v FROM vx p) SELECT t.image_id, tx AS x, ty AS y, tz AS z, arg_min(v, (z, y, x)) AS v FROM t JOIN ext e ON e.image_id = t.image_id WHERE tx BETWEEN 0 AND mx AND ty BETWEEN 0 AND my AND tz BETWEEN 0 AND mz GROUP BY ALL")
def volume_reslice(spark, folder):
    """Axes x and z exchanged, and a step along the new z."""
    return volumes.reslice(voxels(spark, folder), [[0, 0, 1], [0, 1, 0], [1, 0, 0]], (0, 0, 1))


@query("volume_gradient", f"WITH {VX} SELECT p.image_id, p.x, p.y, p.z, max(q.v) - min(q.v) AS gradient, (max(q.v) <> min(q.v) OR count(*) < 7) AS border FROM vx p JOIN vx q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) + abs(q.z - p.z) <= 1 GROUP BY ALL")
def volume_gradient(spark, folder):
    return volumes.gradient(voxels(spark, folder), "v")


def _frames(spark, folder):
    return voxels(spark, folder).select((F.col("image_id") % 4).alias("image_id"), F.floor(F.col("image_id") / 4).cast("long").alias("t"), "x", "y", "z", "v")


@query("frames_over_time", f"WITH {VX} SELECT image_id % 4 AS image_id, image_id // 4 AS t, min(v) AS least, max(v) AS most, count(*) FILTER (v BETWEEN 100 AND 150) AS inside, count(*) AS voxels FROM vx GROUP BY ALL")
def frames_over_time(spark, folder):
    """Volumes in turn as frames of four sequences."""
    return volumes.over_time(_frames(spark, folder), "v", 100, 150)


@query("frames_normalised", f"WITH {VX}, f AS (SELECT image_id % 4 AS image_id, image_id // 4 AS t, x, y, z, v FROM vx), r AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM f GROUP BY 1) SELECT f.image_id, t, x, y, z, round((v - lo) / (hi - lo) * 4095, 5) AS v FROM f JOIN r ON r.image_id = f.image_id")
def frames_normalised(spark, folder):
    return volumes.normalise_frames(_frames(spark, folder), "v", 4095, 5)
