"""Set algebra on tables and arrays, labelled seeds, dictionaries and file sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborgrid.functions import text


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both; column counts must agree."""
    return union_all(a, b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    if len(a.columns) != len(b.columns):
        raise ValueError(f"{len(a.columns)} and {len(b.columns)} columns")
    return a.union(b)


def difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b`` (left anti join)."""
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def intersection(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key is in ``b`` (left semi join)."""
    return a.join(b.select(*on), list(on), "left_semi")


def translate(seeds: DataFrame, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """Moved seeds that stay inside the image."""
    return seeds.withColumn("x", F.col("x") + dx).withColumn("y", F.col("y") + dy).where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def label_counts(seeds: DataFrame, label: str) -> DataFrame:
    return seeds.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def merge_maps(a: Column, b: Column) -> Column:
    """Entries of both maps; a key in both keeps the second's value."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))), F.map_entries(b)))


def remove_key(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def dense(sparse: DataFrame, domain: DataFrame, on: Sequence[str], value: str, default: int = 0) -> DataFrame:
    """``value`` on every element of the domain, the default where ``sparse`` has none."""
    return domain.select(*on).join(sparse.select(*on, value), list(on), "left").withColumn(value, F.coalesce(value, F.lit(default)))


def file_table(df: DataFrame, path: str) -> DataFrame:
    """path, label, sample, suffix, ext of each file, from <label>_<sample>[_<suffix>].<ext>."""
    p = F.regexp_replace(F.regexp_replace(F.col(path), r"^\s+|\s+$", ""), r"\\", "/")
    return df.select(F.col(path).alias("path"), text.file_label(p).alias("label"), text.file_sample(p).alias("sample"), text.file_suffix(p).alias("suffix"), text.extension(p).alias("ext"))


def filter_by_basename(files: DataFrame, other: DataFrame, path: str) -> DataFrame:
    """Files whose base name occurs among the other set's (left semi join)."""
    return files.withColumn("_b", text.basename(F.col(path))).join(other.select(text.basename(F.col(path)).alias("_b")), "_b", "left_semi").drop("_b")


def components(edges: DataFrame, scratch) -> DataFrame:
    """(id, root) by union-find on the cluster: see operators.graphs.connected_components."""
    from arborgrid.operators.graphs import connected_components

    return connected_components(edges, scratch)
