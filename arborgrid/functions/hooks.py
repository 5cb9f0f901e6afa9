"""User functions by name: scalar distances and table-valued samplers for SQL.

``register`` makes them callable from ``spark.sql``. Column factories (functions.distance) stay on the
JVM and are the faster way from Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Euclidean distance of two vectors in SQL; null where a side is null or the lengths differ.
VECTOR_L2 = """CREATE OR REPLACE TEMPORARY FUNCTION vector_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
RETURN CASE WHEN size(a) = size(b) THEN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0.0D, (s, d) -> s + d)) END"""


@F.pandas_udf(T.DoubleType())
def vector_mean(v: pd.Series) -> float:
    """Aggregate: mean of a column."""
    return float(v.mean())


@F.udtf(returnType=T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))
class GridSampler:
    """Rows of a regular grid: grid_sampler(width, height, step)."""

    def eval(self, width: int, height: int, step: int):
        if width is None or height is None or not step or step < 1:
            return
        for y in range(step // 2, height, step):
            for x in range(step // 2, width, step):
                yield x, y


def register(spark: SparkSession) -> None:
    spark.sql(VECTOR_L2)
    spark.udtf.register("grid_sampler", GridSampler)
