"""Marker-learned features, decoders, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arborgrid.operators import markers
from arborgrid.plans import checkpoint_dir
from arborgrid.queries.images import pixels
from arborgrid.registry import query
from arborgrid.streaming import forest
from arborgrid.tables import read


def _bands(spark, folder):
    """Each image with three bands: its value, and the value mixed with column and row."""
    v = F.col("v").cast("double")
    return pixels(spark, folder).select("image_id", "x", "y", F.array(v, (v * 7 + F.col("x")) % 256, (v + F.col("y") * 3) % 256).alias("bands"))


def _markers(spark, folder):
    """The brightest pixels of each image mark the object (1), the darkest the background (0)."""
    p = pixels(spark, folder)
    top = p.where("v > 215").select("image_id", "x", "y", F.lit(1).alias("marker"), F.lit(1).alias("label"))
    low = p.where("v < 40").select("image_id", "x", "y", F.lit(2).alias("marker"), F.lit(0).alias("label"))
    return top.unionByName(low)


def _layers(spark, folder):
    spec = [markers.Layer(kernels_per_marker=3, out_channels=6, pool_stride=2), markers.Layer(kernels_per_marker=3, out_channels=8, dilation=2, pool_type="avg_pool")]
    return markers.fit(_bands(spark, folder), _markers(spark, folder), spec)


@query("marker_statistics", "WITH px AS (SELECT vec_id // 64 AS image_id, vec_id % 64 AS y, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings), q AS (SELECT x, y, CAST(least(255, greatest(0, floor(128 + 256 * CAST(e AS DOUBLE)))) AS DOUBLE) AS v FROM px), m AS (SELECT * FROM q WHERE v > 215 OR v < 40), b AS (SELECT 0 AS band, v AS v FROM m UNION ALL SELECT 1, (v * 7 + x) % 256 FROM m UNION ALL SELECT 2, (v + 3 * y) % 256 FROM m) SELECT CAST(band AS INT) AS band, round(avg(v), 6) AS mean, round(stddev_pop(v) + 0.01, 6) AS std FROM b GROUP BY 1")
def marker_statistics(spark, folder):
    s = markers.marker_statistics(_bands(spark, folder), _markers(spark, folder))
    return s.select("band", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("marker_net_forward")
def marker_net_forward(spark, folder):
    return markers.forward(_bands(spark, folder), _layers(spark, folder))


@query("marker_net_adaptive_decoder")
def marker_net_adaptive_decoder(spark, folder):
    return markers.vanilla_decoder(markers.forward(_bands(spark, folder), _layers(spark, folder)))


@query("marker_net_marker_decoder")
def marker_net_marker_decoder(spark, folder):
    layers = _layers(spark, folder)
    s = layers[0].pool_stride
    m = _markers(spark, folder).withColumn("x", F.floor(F.col("x") / s).cast("int")).withColumn("y", F.floor(F.col("y") / s).cast("int"))
    return markers.marker_decoder(markers.forward(_bands(spark, folder), layers), m)


@query("stream_running_counts", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_running_counts(spark, folder):
    """Daily counts of the events table read as a stream until it is used up."""
    schema = read(spark, folder, "events").schema
    events = forest.batches_of_files(spark, f"{folder}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    name = "counts_" + uuid.uuid4().hex
    counts = forest.running_counts(events, "ts", "1 day", "36500 days", "event_type")
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}").start()
    q.awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))
