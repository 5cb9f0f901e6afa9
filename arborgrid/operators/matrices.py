"""Matrices as (i, j, v) tables; absent elements are 0."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product by a join on the inner index and partial sums."""
    left = a.select("i", F.col("j").alias("_k"), F.col("v").alias("_a"))
    right = b.select(F.col("i").alias("_k"), "j", F.col("v").alias("_b"))
    return left.join(right, "_k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def chain(*ms: DataFrame) -> DataFrame:
    out = ms[0]
    for m in ms[1:]:
        out = multiply(out, m)
    return out


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def elementwise(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """+, -, * or / of aligned elements; absent ones are 0, division by 0 gives null."""
    j = a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), ["i", "j"], "full")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    v = {"+": x + y, "-": x - y, "*": x * y, "/": F.when(y != 0, x / y)}[op]
    return j.select("i", "j", v.alias("v"))


def scalar(a: DataFrame, s: float, op: str) -> DataFrame:
    v = F.col("v")
    return a.withColumn("v", {"+": v + s, "-": v - s, "*": v * s, "/": v / s, "^": F.pow(v, F.lit(float(s)))}[op])


def clamp(a: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    v = F.col("v")
    v = v if low is None else F.greatest(v, F.lit(low))
    return a.withColumn("v", v if high is None else F.least(v, F.lit(high)))


def reduce(a: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """Sum, mean, maximum and minimum of each row (``i``) or column (``j``) over the elements present."""
    return a.groupBy(by).agg(F.sum("v").alias("sum"), F.round(F.avg("v"), digits).alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"))


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


# 3-D transforms as literal coefficients on Columns


def rotation(axis: str, degrees: float) -> list[list[float]]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return {"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis]


def transform_point(m: Sequence[Sequence[float]], p: Sequence[Column], shift: Sequence[float] = (0, 0, 0)) -> list[Column]:
    return [sum((p[k] * float(row[k]) for k in range(3)), F.lit(float(t))) for row, t in zip(m, shift)]


def plane_distance(normal: Sequence[float], point: Sequence[float], p: Sequence[Column]) -> Column:
    """Signed distance of p to the plane through ``point``."""
    n = math.sqrt(sum(v * v for v in normal)) or 1.0
    return sum(((c - float(q)) * (float(v) / n) for c, q, v in zip(p, point, normal)), F.lit(0.0))


# Row and column vectors, decompositions of small matrices, tensors

#: The most numbers of a dense matrix that is solved at the driver.
DENSE_CELLS = 4_000_000


def with_vector(a: DataFrame, vector: DataFrame, by: str, op: str) -> DataFrame:
    """+, -, * or / of every row (``by`` = 'j') or column (``by`` = 'i') with a vector (k, v); absent
    places of the vector are 0, division by 0 gives null."""
    met = a.join(vector.select(F.col("k").alias(by), F.col("v").alias("_b")), by, "left")
    x, y = F.col("v"), F.coalesce("_b", F.lit(0.0))
    return met.select("i", "j", {"+": x + y, "-": x - y, "*": x * y, "/": F.when(y != 0, x / y)}[op].alias("v"))


def centred(a: DataFrame) -> DataFrame:
    """Every column less its mean over the rows present."""
    mean = a.groupBy("j").agg(F.avg("v").alias("v"))
    return with_vector(a, mean.select(F.col("j").alias("k"), "v"), "j", "-")


def unit_rows(a: DataFrame) -> DataFrame:
    """Every row divided by its Euclidean length; rows of zeros stay."""
    n = a.groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))
    return with_vector(a, n.select(F.col("i").alias("k"), F.when(F.col("v") > 0, F.col("v")).otherwise(1.0).alias("v")), "i", "/")


def gram(rows: DataFrame, vec: str) -> np.ndarray:
    """Sum of the outer products of row vectors, padded to the longest: summed where batches are read;
    d x d numbers a partition are added up at the driver. The matrix of the column means of x is
    ``gram`` with a column of ones."""
    dim = rows.select(F.max(F.size(vec))).first()[0] or 0
    if dim * dim > DENSE_CELLS:
        raise ValueError(f"more than {DENSE_CELLS} products")

    def sums(batches):
        s = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = np.zeros((len(pdf), dim))
                for r, v in enumerate(pdf["v"]):
                    x[r, : len(v)] = v
                s += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(dim), dim), "j": np.tile(np.arange(dim), dim), "s": s.ravel()})

    parts = rows.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(sums, "i int, j int, s double")
    out = np.zeros((dim, dim))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    return out


def least_squares(rows: DataFrame, features: Sequence[str], target: str) -> list[float]:
    """Coefficients of ``features`` and an intercept, by the normal equations (pseudo-inverse)."""
    g = gram(rows.select(F.array(*[F.col(c).cast("double") for c in [*features, target]], F.lit(1.0)).alias("_v")), "_v")
    n = len(features)
    known = [*range(n), n + 1]
    return (np.linalg.pinv(g[np.ix_(known, known)]) @ g[known, n]).tolist()


def covariance(rows: DataFrame, vec: str) -> np.ndarray:
    """Covariance (divided by n) of the places of row vectors."""
    g = gram(rows.select(F.concat(F.array(F.lit(1.0)), F.col(vec).cast("array<double>")).alias("_v")), "_v")
    n = max(g[0, 0], 1.0)
    return g[1:, 1:] / n - np.outer(g[0, 1:], g[0, 1:]) / n / n


def singular_values(rows: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the matrix of row vectors, largest first, and right vectors in rows; signs:
    the largest element is positive."""
    values, vectors = np.linalg.eigh(gram(rows, vec))
    order = np.argsort(values)[::-1]
    right = vectors[:, order].T
    right *= np.sign(right[np.arange(len(right)), np.abs(right).argmax(1)])[:, None]
    return np.sqrt(np.maximum(values[order], 0.0)), right


def generalized_eigenvalues(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """w with a x = w b x for symmetric a and positive definite b, largest first."""
    half = np.linalg.inv(np.linalg.cholesky(b))
    return np.sort(np.linalg.eigvalsh(half @ a @ half.T))[::-1]


def dense(a: DataFrame) -> np.ndarray:
    """A small (i, j, v) table as an array; one of more than DENSE_CELLS numbers raises."""
    h, w = a.select(F.max("i"), F.max("j")).first()
    shape = (0, 0) if h is None else (int(h) + 1, int(w) + 1)
    if shape[0] * shape[1] > DENSE_CELLS:
        raise ValueError(f"more than {DENSE_CELLS} numbers")
    out = np.zeros(shape)
    for r in a.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def sparse(spark, m: np.ndarray) -> DataFrame:
    """(i, j, v) of all elements of a small array."""
    m = np.atleast_2d(np.asarray(m, float))
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")


def inverse(a: DataFrame) -> DataFrame:
    """Inverse of a small square matrix; a singular one raises."""
    return sparse(a.sparkSession, np.linalg.inv(dense(a)))


def pseudo_inverse(a: DataFrame) -> DataFrame:
    return sparse(a.sparkSession, np.linalg.pinv(dense(a)))


def determinant(a: DataFrame) -> float:
    return float(np.linalg.det(dense(a)))


def cofactors(m: np.ndarray) -> np.ndarray:
    """Matrix of the signed minors of a small matrix."""
    n = len(m)
    return np.array([[(-1) ** (i + j) * np.linalg.det(np.delete(np.delete(m, i, 0), j, 1)) for j in range(n)] for i in range(n)])


def align_with_z(v: Sequence[float]) -> np.ndarray:
    """Rotation that takes the direction of ``v`` to the z axis (its transpose takes z to ``v``)."""
    u = np.asarray(v, float) / (np.linalg.norm(v) or 1.0)
    axis, c = np.array([u[1], -u[0], 0.0]), u[2]
    s = np.linalg.norm(axis)
    if s < 1e-12:
        return np.diag([1.0, np.sign(c) or 1.0, np.sign(c) or 1.0])
    k = axis / s
    cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + s * cross + (1 - c) * (cross @ cross)


def diagonal(vector: DataFrame) -> DataFrame:
    """Matrix with the vector (k, v) on its diagonal."""
    return vector.select(F.col("k").alias("i"), F.col("k").alias("j"), "v")


def submatrix(a: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Elements of the closed ranges, counted from 0."""
    return a.where(F.col("i").between(*rows) & F.col("j").between(*cols)).select((F.col("i") - rows[0]).alias("i"), (F.col("j") - cols[0]).alias("j"), "v")


def reshape(a: DataFrame, width: int, new_width: int) -> DataFrame:
    """The same numbers in row order with another width."""
    at = F.col("i") * width + F.col("j")
    return a.select(F.floor(at / new_width).cast("long").alias("i"), (at % new_width).cast("long").alias("j"), "v")


def contract(a: DataFrame, b: DataFrame, over: Sequence[str]) -> DataFrame:
    """Tensors as tables of index columns and v: the sum of products over the indices both have."""
    left, right = [c for c in a.columns if c not in (*over, "v")], [c for c in b.columns if c not in (*over, "v")]
    if set(left) & set(right):
        raise ValueError(f"indices of both that are not summed: {sorted(set(left) & set(right))}")
    met = a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), list(over))
    return met.groupBy(*left, *right).agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def mahalanobis(a: Column, b: Column, m: np.ndarray) -> Column:
    """(a - b)' M (a - b) of two array columns, with a small matrix of literals."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in np.asarray(m, float)])
    along = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, d, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    return F.aggregate(F.zip_with(along, d, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
