"""Sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arborgrid.functions import architecture
from arborgrid.plans import checkpoint_dir
from arborgrid.queries.images import PX, pixels
from arborgrid.registry import query
from arborgrid.sources import images, tabular
from arborgrid.tables import read


def _folder(spark) -> str:
    """A new folder below the shared one, removed with the application."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/trip-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at)
    system.deleteOnExit(at)
    return path


@query("csv_round_trip", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def csv_round_trip(spark, folder):
    """All cells as texts; the header is found."""
    path = _folder(spark) + "/orders"
    tabular.write_csv(read(spark, folder, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderkey", "key"), path, ";")
    got = tabular.read_csv(spark, path, ";")
    return tabular.renamed(got, ["o_orderstatus", "o_orderkey", "o_orderpriority"])


@query("samples_from_csv", "SELECT label AS truelabel, [round(CAST(embedding[1] AS DOUBLE), 5), round(CAST(embedding[2] AS DOUBLE), 5), round(CAST(embedding[3] AS DOUBLE), 5)] AS feat FROM embeddings")
def samples_from_csv(spark, folder):
    """Vectors and labels as a table of samples."""
    path = _folder(spark) + "/samples"
    e = read(spark, folder, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(3)], "label")
    tabular.write_csv(e, path)
    return tabular.read_samples(spark, path).select("truelabel", F.transform("feat", lambda v: F.round(v, 5)).alias("feat"))


@query("numpy_round_trip", "SELECT label, count(*) AS n, 64::BIGINT AS width, round(sum(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE)))), 3) AS total FROM embeddings GROUP BY 1")
def numpy_round_trip(spark, folder):
    """A matrix of vectors for each label, as .npy files."""
    path = _folder(spark)
    e = read(spark, folder, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("embedding")).alias("data"))
    tabular.write_numpy(e.select(F.col("label").cast("string").alias("name"), F.array("n", F.lit(64)).alias("shape"), "data"), path).count()
    got = tabular.read_numpy(spark, path)
    total = F.aggregate("data", F.lit(0.0), lambda s, v: s + v)
    return got.select(F.regexp_extract("path", "([0-9]+)[.]npy$", 1).cast("long").alias("label"), F.get("shape", F.lit(0)).alias("n"), F.get("shape", F.lit(1)).alias("width"), F.round(total, 3).alias("total"))


@query("seeds_round_trip", f"WITH {PX} SELECT x, y, CAST(image_id AS INT) AS marker, CAST(label AS INT) AS label, 64 AS width, 64 AS height FROM px WHERE v > 215")
def seeds_round_trip(spark, folder):
    """Bright pixels as a marker file."""
    path = _folder(spark) + "/seeds"
    tabular.write_seeds(pixels(spark, folder).where("v > 215").select("x", "y", F.col("image_id").cast("int").alias("marker"), "label"), path, 64, 64)
    return tabular.read_seeds(spark, path).drop("path")


def _images(spark, folder, kind: str):
    path = _folder(spark)
    images.write_images(pixels(spark, folder).select("image_id", "x", "y", "v"), path, kind=kind).count()
    back = images.to_pixels(images.read_images(spark, path))
    return back.select(F.regexp_extract("path", "([0-9]+)[.][a-z]+$", 1).cast("long").alias("image_id"), "x", "y", F.col("v").cast("long").alias("v"))


@query("pixmap_round_trip", f"WITH {PX} SELECT image_id, x, y, CAST(v AS BIGINT) AS v FROM px")
def pixmap_round_trip(spark, folder):
    return _images(spark, folder, "pgm")


@query("png_round_trip", f"WITH {PX} SELECT image_id, x, y, CAST(v AS BIGINT) AS v FROM px")
def png_round_trip(spark, folder):
    return _images(spark, folder, "png")


@query("lines_replaced", "SELECT replace(o_orderpriority, 'MEDIUM', 'middle') AS line, count(*) AS n FROM orders GROUP BY 1")
def lines_replaced(spark, folder):
    """Gzipped lines with a literal replaced."""
    path = _folder(spark) + "/lines"
    read(spark, folder, "orders").select("o_orderpriority").write.text(path, compression="gzip")
    return tabular.replace_in_lines(spark, path, "MEDIUM", "middle").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("lines_found", "SELECT o_orderpriority AS line, count(*) AS n FROM orders WHERE contains(o_orderpriority, 'URG') GROUP BY 1")
def lines_found(spark, folder):
    path = _folder(spark) + "/lines"
    read(spark, folder, "orders").select("o_orderpriority").write.text(path)
    return tabular.read_lines(spark, path, "URG").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("architecture_round_trip", "SELECT * FROM (VALUES (1, 3, 32, 1, 1, [3, 3], [3, 3], 1, 'max_pool'), (2, 32, 64, 3, 5, [5, 5], [3, 3], 1, 'avg_pool')) t(layer, ninput_channels, noutput_channels, dilation, nkernels_per_marker, kernel_size, pool_size, pool_stride, pool_type)")
def architecture_round_trip(spark, folder):
    """Layers added, changed and removed, written as JSON and read back."""
    layers = architecture.add_layer([], architecture.create_layer((3, 3), 1, 1, 16, (3, 3), 1))
    layers = architecture.add_layer(layers, architecture.create_layer((5, 5), 3, 5, 64, (3, 3), 1, "avg_pool"))
    layers = architecture.remove_layer(architecture.add_layer(layers, architecture.create_layer()))
    layers = architecture.change_layer(layers, 0, {**layers[0], "noutput_channels": 32})
    path = _folder(spark) + "/network"
    spark.createDataFrame([(architecture.to_json(layers),)], "value string").coalesce(1).write.text(path)
    return tabular.read_architecture(spark, path).drop("stdev_factor")


@query("files_listed", "SELECT count(*) AS files, true AS all_have_bytes FROM (SELECT DISTINCT vec_id // 64 FROM embeddings)")
def files_listed(spark, folder):
    """Files of a folder by suffix, contents unread."""
    path = _folder(spark)
    images.write_images(pixels(spark, folder).select("image_id", "x", "y", "v"), path).count()
    return tabular.list_files(spark, path, suffix=".pgm").agg(F.count(F.lit(1)).alias("files"), F.bool_and(F.col("bytes") > 0).alias("all_have_bytes"))
