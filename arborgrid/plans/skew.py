"""Joins of many rows with a table of unique keys, where a key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many rows one key's rows fit a task, whatever their share.
TASK_ROWS = 1_000_000
#: A key with at least 1 / BIG_SHARE of the rows is big; there are BIG_SHARE of them at most.
BIG_SHARE = 200


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", task_rows: int | None = None, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, whose ``key`` is unique; ``how`` is inner or left.

    ``rows`` should be materialised: it is counted (unless ``total``, an upper bound, is known), and beyond ``task_rows`` its keys are counted too
    (aggregated before the shuffle). Rows of big keys meet the table's at most BIG_SHARE rows of
    those keys by a broadcast, the others by a shuffle. Null keys meet nothing; with ``left`` they
    are kept and never shuffled to one task.
    """
    limit = TASK_ROWS if task_rows is None else task_rows
    total = rows.count() if total is None else total
    if total <= limit:
        return rows.join(table, key, how)
    keyed = rows.where(F.col(key).isNotNull())
    big = [r[0] for r in keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(2, -(-total // BIG_SHARE))).select(key).collect()]  # BIG_SHARE rows at most
    if big:
        is_big = F.col(key).isin(big)
        out = keyed.where(is_big).join(F.broadcast(table.where(is_big)), key, how).unionByName(keyed.where(~is_big).join(table, key, how))
    else:
        out = keyed.join(table, key, how)
    if how == "left":
        out = out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    return out
