"""Distances and kernels between two array columns of equal length (higher-order functions, JVM side).

Arrays of different lengths, or null elements, give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, f) -> Column:
    zipped = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(zipped, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def l1(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def l1_normalized(a: Column, b: Column) -> Column:
    return l1(a, b) / (F.size(a) + 1e-6)


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def l2_normalized(a: Column, b: Column) -> Column:
    return l2(a, b) / (F.size(a) + 1e-6)


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(_fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def chi_square(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / (x + y)).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0.5 - dot / 2, for vectors of unit length."""
    return 0.5 - dot(a, b) / 2


def cosine_normalized(a: Column, b: Column) -> Column:
    """As ``cosine`` with each length (plus 0.01) divided out."""
    return 0.5 - dot(a, b) / ((F.sqrt(dot(a, a)) + 0.01) * (F.sqrt(dot(b, b)) + 0.01)) / 2


def earth_movers(a: Column, b: Column) -> Column:
    """Sum of the absolute cumulative differences of two histograms.

    A signed sum, in which moves in both directions cancel, is ``earth_movers_signed``.
    """
    diffs = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    return F.aggregate(diffs, zero, lambda s, d: F.struct((s["run"] + d).alias("run"), (s["sum"] + F.abs(s["run"] + d)).alias("sum")), lambda s: s["sum"])


def earth_movers_signed(a: Column, b: Column) -> Column:
    diffs = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    return F.aggregate(diffs, zero, lambda s, d: F.struct((s["run"] + d).alias("run"), (s["sum"] + s["run"] + d).alias("sum")), lambda s: s["sum"])


def correlation_distance(a: Column, b: Column) -> Column:
    """1 - |Pearson r| (population moments); 1 where a side is constant."""
    n = F.size(a)
    ma, mb = _fold(a, a, lambda x, y: x) / n, _fold(b, b, lambda x, y: x) / n
    cov = dot(a, b) / n - ma * mb
    va, vb = dot(a, a) / n - ma * ma, dot(b, b) / n - mb * mb
    return 1.0 - F.when((va > 0) & (vb > 0), F.abs(cov / F.sqrt(va * vb))).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a / |a|; zero vectors stay as they are."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def kernel_linear(a: Column, b: Column) -> Column:
    return dot(a, b)


def kernel_polynomial(a: Column, b: Column, c: float = 1.0, degree: float = 2.0) -> Column:
    return F.pow(dot(a, b) + c, F.lit(float(degree)))


def kernel_gaussian(a: Column, b: Column, sigma: float = 1.0) -> Column:
    return F.exp(-squared_l2(a, b) / (2 * sigma * sigma))


def kernel_laplacian(a: Column, b: Column, sigma: float = 1.0) -> Column:
    return F.exp(-l2(a, b) / sigma)


def kernel_sigmoid(a: Column, b: Column, alpha: float = 1.0, c: float = 0.0) -> Column:
    return F.tanh(dot(a, b) * alpha + c)


def kernel_rational_quadratic(a: Column, b: Column, c: float = 1.0) -> Column:
    d = squared_l2(a, b)
    return 1 - d / (d + c)


def kernel_inverse_multiquadric(a: Column, b: Column, c: float = 1.0) -> Column:
    return 1.0 / F.sqrt(squared_l2(a, b) + c * c)


def kernel_wave(a: Column, b: Column, theta: float = 1.0) -> Column:
    d = l2(a, b)
    return F.when(d == 0, 1.0).otherwise(F.lit(theta) / d * F.sin(d / theta))


def kernel_log(a: Column, b: Column, degree: float = 2.0) -> Column:
    return -F.ln(F.pow(l2(a, b), F.lit(float(degree))) + 1)


def kernel_student(a: Column, b: Column, degree: float = 2.0) -> Column:
    return 1.0 / (1.0 + F.pow(l2(a, b), F.lit(float(degree))))


def kernel_chi_square(a: Column, b: Column) -> Column:
    return 1.0 - _fold(a, b, lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / ((x + y) * 0.5)).otherwise(0.0))


DISTANCES = {
    "l1": l1, "l1n": l1_normalized, "l2": l2, "l2n": l2_normalized, "sql2": squared_l2, "linf": chebyshev, "chi2": chi_square,
    "cosine": cosine, "cosine2": cosine_normalized, "emd": earth_movers, "emd_signed": earth_movers_signed, "corr": correlation_distance,
}
KERNELS = {
    "linear": kernel_linear, "polynomial": kernel_polynomial, "gaussian": kernel_gaussian, "laplacian": kernel_laplacian, "sigmoid": kernel_sigmoid,
    "rational": kernel_rational_quadratic, "inverse_multiquadric": kernel_inverse_multiquadric, "wave": kernel_wave, "log": kernel_log, "student": kernel_student, "chi2": kernel_chi_square,
}
