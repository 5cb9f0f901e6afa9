"""Parameter search and small projections.

Fitness functions are Python callables of one parameter row; candidates of a round are spread over
the cluster and one best row comes back. A projection lays out every row: vectors stay on the
cluster, arcs to the nearest others and two coordinates a row reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborgrid.operators import neighbours

Fitness = Callable[[dict[str, float]], float]


def parameter_grid(spark: SparkSession, space: Mapping[str, Sequence[float]]) -> DataFrame:
    """One row a combination."""
    names = list(space)
    return spark.createDataFrame([tuple(float(v) for v in c) for c in product(*space.values())], ", ".join(f"{n} double" for n in names))


def random_parameters(spark: SparkSession, space: Mapping[str, tuple[float, float]], n: int, seed: int = 1) -> DataFrame:
    cols = [(F.rand(seed + i) * (hi - lo) + lo).alias(name) for i, (name, (lo, hi)) in enumerate(space.items())]
    return spark.range(n).select(*cols)


def evaluate(params: DataFrame, fitness: Fitness) -> DataFrame:
    """``params`` with a column ``fitness``."""
    names = params.columns

    def run(batches):
        for pdf in batches:
            yield pdf.assign(fitness=[float(fitness(dict(zip(names, row)))) for row in pdf[names].itertuples(index=False)])

    return params.mapInPandas(run, ", ".join(f"{n} double" for n in names) + ", fitness double")


def best(params: DataFrame, fitness: Fitness, largest: bool = True) -> dict[str, float]:
    """The best row; the smallest parameters among equals."""
    f = F.col("fitness") if largest else -F.col("fitness")
    r = evaluate(params, fitness).agg(F.min_by(F.struct(*params.columns, "fitness"), F.struct(-f, *params.columns)).alias("b")).first()["b"]
    return r.asDict() if r else {}


def multi_scale(start: Mapping[str, float], steps: Sequence[Mapping[str, float]], fitness: Fitness, largest: bool = True, rounds: int = 100) -> tuple[dict[str, float], float]:
    """Hill climbing with several step sizes: each round tries every step of every parameter in both
    directions, then the joined best moves of each scale, and moves while that is an improvement."""
    sign = 1.0 if largest else -1.0
    at = dict(start)
    value = sign * fitness(at)
    for _ in range(rounds):
        moves = []
        for scale in steps:
            joint = dict(at)
            for name, d in scale.items():
                tried = [(sign * fitness(at | {name: at[name] + s * d}), s) for s in (1, -1)]
                v, s = max(tried)
                moves.append((v, at | {name: at[name] + s * d}))
                if v > value:
                    joint[name] += s * d
            moves.append((sign * fitness(joint), joint))
        v, new = max(moves, key=lambda m: m[0])
        if v <= value:
            break
        value, at = v, new
    return at, sign * value


def _affinities(rows: DataFrame, id_col: str, vec_col: str, perplexity: float, n: int) -> DataFrame:
    """(id, near, p): shares of the 3 * ``perplexity`` nearest others whose entropy is that of ``perplexity``."""
    met = neighbours.nearest(rows, rows, id_col, vec_col, max(1, int(3 * perplexity)), exclude_self=True, n_queries=n, n_points=n)
    lists = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "dist"))).alias("n"))

    @F.pandas_udf("array<double>")
    def shares(dist: pd.Series) -> pd.Series:
        out = []
        for v in dist:
            d = np.asarray(v, dtype=float) ** 2
            d -= d.min()
            lo, hi, beta = 0.0, np.inf, 1.0
            for _ in range(100):
                e = np.exp(-d * beta)
                q = e / e.sum()
                h = -(q * np.log(np.maximum(q, 1e-300))).sum()
                if abs(h - np.log(perplexity)) < 1e-5:
                    break
                if h > np.log(perplexity):
                    lo, beta = beta, beta * 2 if hi == np.inf else (beta + hi) / 2
                else:
                    hi, beta = beta, (beta + lo) / 2
            out.append(q)
        return pd.Series(out)

    return lists.select("id", F.col("n.neighbour").alias("near"), shares(F.col("n.dist")).alias("p"))


class Repulsion:
    """Sums over all points of d / (1 + d^2)^2 at each point, and of 1 / (1 + d^2) over all pairs.

    Up to ``exact`` points all pairs are taken, in slices. Beyond that points are spread to a grid by
    cubic interpolation, the grid is convolved by FFT, and the sums are read back by the same weights:
    n + g log g work for g nodes, sums within about 2 %.
    """

    STEP = 1 / 3

    def __init__(self, exact: int = 5000):
        self.exact, self.nodes, self.kernels = exact, 0, None

    def __call__(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        push, total = (self._pairs if len(y) <= self.exact else self._grid)(y)
        return push, max(total - len(y), 1e-12)

    def _pairs(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        push, total, sq = np.empty_like(y), 0.0, (y * y).sum(1)
        for i in range(0, len(y), 500):
            w = 1 / (1 + np.maximum(sq[i : i + 500, None] + sq[None] - 2 * y[i : i + 500] @ y.T, 0))
            total += float(w.sum())
            w *= w
            push[i : i + 500] = y[i : i + 500] * w.sum(1)[:, None] - w @ y
        return push, total

    def _fit(self, nodes: int) -> None:
        if nodes != self.nodes:
            i = np.arange(2 * nodes)
            d = np.where(i < nodes, i, i - 2 * nodes) * self.STEP
            w = 1 / (1 + d[:, None] ** 2 + d[None] ** 2)
            self.nodes, self.kernels = nodes, [np.fft.rfft2(k) for k in (w, w * w * d[:, None], w * w * d[None])]

    def _grid(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        u = (y - y.min(0)) / self.STEP
        base = np.floor(u).astype(int)
        t = u - base
        w = np.stack([-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6])
        self._fit(-(-(int(base.max()) + 4) // 16) * 16)
        m = self.nodes
        at = [((base[:, 0] + i) * m + base[:, 1] + j, w[i, :, 0] * w[j, :, 1]) for i in range(4) for j in range(4)]
        grid = np.zeros(m * m)
        for k, s in at:
            grid += np.bincount(k, s, m * m)
        f = np.fft.rfft2(grid.reshape(m, m), (2 * m, 2 * m))
        total, gx, gy = (np.fft.irfft2(f * k, (2 * m, 2 * m))[:m, :m].ravel() for k in self.kernels)
        read = lambda g: sum(g[k] * s for k, s in at)
        # a point's pair with itself counts 1, not what interpolation makes of it
        i, j = np.divmod(np.arange(16), 4)
        own = 1 / (1 + ((i[:, None] - i[None]) ** 2 + (j[:, None] - j[None]) ** 2) * self.STEP**2)
        s = np.stack([s for _, s in at], 1)
        return np.stack([read(gx), read(gy)], 1), float(read(total).sum() - ((s @ own) * s).sum()) + len(y)


def tsne(df: DataFrame, id_col: str, vec_col: str, perplexity: float = 20.0, rounds: int = 1000, seed: int = 1) -> pd.DataFrame:
    """(id, x, y) of every row with an id and a vector.

    Neighbours and affinities are found on the cluster in blocks; the arcs (about 6 * ``perplexity`` a
    row) and two numbers a row are held at the driver, where the rounds run. The perplexity falls to
    a third of the other rows where there are too few.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(id_col, vec_col)
    ids = np.sort(rows.select(F.col(id_col).cast("long").alias("id")).toPandas()["id"].to_numpy(dtype="int64"))
    n = len(ids)
    if n < 2:
        return pd.DataFrame({"id": ids, "x": np.zeros(n), "y": np.zeros(n)})
    p = _affinities(rows, id_col, vec_col, max(1.0, min(perplexity, (n - 1) / 3)), n).toPandas()
    a = np.searchsorted(ids, np.repeat(p["id"].to_numpy(), p["near"].str.len()))
    b, share = np.searchsorted(ids, np.concatenate(p["near"].to_list())), np.concatenate(p["p"].to_list())
    key, back = np.unique(np.concatenate([a * n + b, b * n + a]), return_inverse=True)
    share = np.bincount(back, np.concatenate([share, share]))
    share /= share.sum()
    a, b = key // n, key % n
    rng, repulsion = np.random.default_rng(seed), Repulsion()
    y, v, gains = rng.normal(0, 1e-4, (n, 2)), np.zeros((n, 2)), np.ones((n, 2))
    for t in range(rounds):
        d = y[a] - y[b]
        w = share * (12 if t < rounds // 10 else 1) / (1 + (d * d).sum(1))
        push, total = repulsion(y)
        g = np.stack([np.bincount(a, w * d[:, i], n) for i in (0, 1)], 1) - push / total
        gains = np.maximum(np.where(np.sign(g) != np.sign(v), gains + 0.2, gains * 0.8), 0.01)
        v = (0.5 if t < rounds // 4 else 0.8) * v - 200 * gains * g
        y = y + v
        y -= y.mean(0)
    return pd.DataFrame({"id": ids, "x": y[:, 0], "y": y[:, 1]})
