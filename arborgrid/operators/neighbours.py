"""Exact nearest neighbours and argmin classification between vector tables, in bounded blocks.

Both sides are dealt to blocks by a hash; a task holds one block of queries and one of points
(``block`` rows each) and gives back at most k rows a query, so neither all pairs nor a whole
side ever exist anywhere. Cost is |queries| * |points| distance evaluations, in numpy.

Defined cases: null vectors and null ids take no part; equal distances go to the smaller id; a
vector is not its own neighbour when ids are equal and ``exclude_self``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 2048


def _side(df: DataFrame, id_col: str, vec_col: str, extra: list[str], blocks: int, other: int, query: bool, apart_col: str | None = None) -> DataFrame:
    own = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *[F.col(c).cast("double").alias(c) for c in extra], *([F.col(apart_col).cast("long").alias("_apart")] if apart_col else [])]
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    return rows.select(*cols, (own if query else every).alias("qb"), (every if query else own).alias("pb"))


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, from exact differences, in slices."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None]) ** 2).sum(2))
    return out


def _closest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, cost: np.ndarray | None, barred) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances (or costs) of the k best of ``y`` for each row of ``x``, by distance then id.

    Products of matrices choose candidates; their distances are then taken from exact differences. All
    that lie within rounding of the last candidate are kept, so the choice is exact.
    """
    centre = y.mean(0)
    xc, yc = x - centre, y - centre
    nx, ny = (xc * xc).sum(1), (yc * yc).sum(1)
    c2 = None if cost is None else np.where(cost > 0, cost, 0.0) ** 2
    places, dist = np.zeros((len(x), k), dtype=np.int64), np.full((len(x), k), np.inf)
    step = max(1, 4_000_000 // max(1, len(y)))
    for at in range(0, len(x), step):
        rows = slice(at, at + step)
        d = np.maximum(nx[rows, None] + ny[None] - 2 * (xc[rows] @ yc.T), 0.0)
        d = d if c2 is None else np.maximum(d, c2[None])
        no = barred(rows)
        if no is not None:
            d[no] = np.inf
        slack = 1e-10 * (nx[rows] + ny.max(initial=0.0) + 1e-300)
        some = min(2 * k + 8, len(y))
        near = np.argpartition(d, some - 1, axis=1)[:, :some] if some < len(y) else np.broadcast_to(np.arange(len(y)), d.shape)
        values = np.take_along_axis(d, near, 1)
        if some < len(y):
            kth = np.partition(values, min(k, some) - 1, axis=1)[:, min(k, some) - 1]
            tight = np.isfinite(kth) & (values.max(1) <= kth + slack)
        else:
            tight = np.zeros(len(d), dtype=bool)
        for group, cand in ((~tight, near[~tight]), *[(np.arange(len(d)) == r, np.flatnonzero(d[r] <= kth[r] + slack[r])[None]) for r in np.flatnonzero(tight)]):
            if not group.any():
                continue
            true = np.sqrt(((x[rows][group][:, None, :] - y[cand]) ** 2).sum(2))
            true = true if cost is None else np.maximum(true, cost[cand])
            true = np.where(np.isfinite(np.take_along_axis(d[group], cand, 1)), true, np.inf)
            order = np.lexsort((ids[cand], true), axis=1)[:, :k]
            where = np.flatnonzero(group) + at
            places[where, : order.shape[1]] = np.take_along_axis(cand, order, 1)
            dist[where, : order.shape[1]] = np.take_along_axis(true, order, 1)
    return places, dist


def nearest(queries: DataFrame, points: DataFrame, id_col: str, vec_col: str, k: int, cost_col: str | None = None, exclude_self: bool = False, block: int = BLOCK, n_queries: int | None = None, n_points: int | None = None, apart_col: str | None = None) -> DataFrame:
    """(id, neighbour, dist, rank) of the k nearest points; with ``cost_col`` the distance to a point is
    max(its cost, distance), as in path-cost classification; with ``apart_col``, a number both sides
    have, only points of another number are neighbours."""
    nq, np_ = n_queries or queries.count(), n_points or points.count()
    qb, pb = max(1, -(-nq // block)), max(1, -(-np_ // block))
    extra = [cost_col] if cost_col else []
    q = _side(queries, id_col, vec_col, [], qb, pb, True, apart_col)
    p = _side(points, id_col, vec_col, extra, pb, qb, False, apart_col)
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("neighbour", T.LongType()), T.StructField("dist", T.DoubleType())])

    def block_nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"id": [], "neighbour": [], "dist": []}).astype({"id": "int64", "neighbour": "int64"})
        ids, mine = right["id"].to_numpy(), left["id"].to_numpy()
        here, there = (side["_apart"].to_numpy() for side in (left, right)) if apart_col else (None, None)

        def barred(rows: slice):
            no = mine[rows, None] == ids[None] if exclude_self else None
            same = here[rows, None] == there[None] if apart_col else None
            return same if no is None else no if same is None else no | same

        places, dist = _closest(np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy()), ids, k, right[cost_col].to_numpy() if cost_col else None, barred)
        ok = np.isfinite(dist)
        return pd.DataFrame({"id": np.repeat(mine, ok.sum(1)), "neighbour": ids[places][ok], "dist": dist[ok]})

    met = q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInPandas(block_nearest, out)
    best = met.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "neighbour"))), 1, k).alias("n"))
    return best.select("id", F.posexplode("n").alias("pos", "n")).select("id", F.col("n.neighbour").alias("neighbour"), F.col("n.dist").alias("dist"), (F.col("pos") + 1).alias("rank"))


def classify(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label): majority of the neighbours' labels, ties to the smaller label."""
    met = neighbours.join(labels.select(F.col("id").alias("neighbour"), "label"), "neighbour")
    votes = met.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


def certainty(first: DataFrame) -> DataFrame:
    """From (id, label, cost: the least cost by class): label of the least cost and
    second / (first + second), 1 where there is one class only."""
    s = first.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("cost", "label"))), 1, 2).alias("s"))
    a, b = F.col("s")[0]["cost"], F.get("s", F.lit(1))["cost"]
    return s.select("id", F.col("s")[0]["label"].alias("label"), F.round(F.when(b.isNull(), 1.0).when(a + b > 0, b / (a + b)).otherwise(0.5), 6).alias("certainty"))
