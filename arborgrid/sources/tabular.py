"""CSV with an inferred header, NumPy arrays, seed files, boxes, JSON dictionaries and file sets.

Readers parse on the cluster. Sinks write one file a partition, as Spark does; ``overwrite`` replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as a column name and as a number when a header is guessed.
HEADER_CELL = r"^[a-zA-Z]+.*$"
NUMBER_CELL = r"^[0-9]+(\.[0-9]+)?$"


def has_header(rows: list[list[str]]) -> bool:
    """The first row is a header if all its cells begin with a letter and a cell of the second is a number."""
    if len(rows) < 2 or not rows[0]:
        return False
    return all(re.match(HEADER_CELL, c) for c in rows[0]) and any(re.match(NUMBER_CELL, c) for c in rows[1])


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as strings; names from a header if there is one, else c0, c1, ... No quoting.

    With a header the first line of each file is one; later rows that equal it are data. A row with
    another number of cells than the first raises when it is read; empty lines are skipped.
    """
    head = [r[0].rstrip("\r\n").split(separator) for r in spark.read.text(path).limit(2).collect()]
    if not head:
        return spark.createDataFrame([], "c0 string")
    named = has_header(head)
    width = len(head[0])
    names = head[0] if named else [f"c{i}" for i in range(width)]
    schema = ", ".join(f"`{i}` string" for i in range(width)) + ", _bad string"
    rows = spark.read.csv(path, schema=schema, sep=separator, header=named, quote="", escape="", columnNameOfCorruptRecord="_bad", multiLine=False)
    width_ok = F.assert_true(F.col("_bad").isNull(), F.concat(F.lit(f"not {width} cells: "), "_bad"))
    cells = [F.coalesce(F.regexp_replace(F.col(f"`{i}`"), r"[\r\n]+$", ""), F.lit("")).alias(n) for i, n in enumerate(names)]
    return rows.where(width_ok.isNull()).select(*cells)


def read_samples(spark: SparkSession, path: str, separator: str = ",", label: str | int | None = -1) -> DataFrame:
    """Sample table of a CSV of numbers: (feat array<double>, truelabel int); ``label`` names or numbers
    the column of classes (None: there is none, and labels are 0). Cells that are no numbers are null."""
    rows = read_csv(spark, path, separator)
    at = None if label is None else label if isinstance(label, str) else rows.columns[label]
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    return rows.select(F.array(*[number(c) for c in rows.columns if c != at]).alias("feat"), (F.lit(0) if at is None else F.coalesce(number(at).cast("int"), F.lit(0))).alias("truelabel"))


def renamed(df: DataFrame, header: Sequence[str]) -> DataFrame:
    """The table with other column names; another number of names than columns raises ValueError."""
    if len(header) != len(df.columns):
        raise ValueError(f"{len(header)} names for {len(df.columns)} columns")
    return df.toDF(*header)


def write_csv(df: DataFrame, path: str, separator: str = ",", header: bool = True) -> None:
    if separator not in (",", ";"):
        raise ValueError("the separator must be ',' or ';'")
    df.write.mode("overwrite").csv(path, sep=separator, header=header)


def writer(folder: str):
    """A function (name, bytes) -> size that writes files below ``folder``: a path or an address."""
    from pyarrow import fs

    if folder.startswith("file:/"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    system.create_dir(root, recursive=True)

    def put(name: str, data: bytes) -> int:
        with system.open_output_stream(f"{root.rstrip('/')}/{name}") as f:
            f.write(data)
        return len(data)

    return put


def read_numpy(spark: SparkSession, path: str) -> DataFrame:
    """(path, dtype, shape, data) of each .npy file; data in C order as doubles."""
    import io

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = [np.load(io.BytesIO(b), allow_pickle=False) for b in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "dtype": [a.dtype.str for a in arrays], "shape": [list(a.shape) for a in arrays], "data": [np.ascontiguousarray(a).ravel().astype(float).tolist() for a in arrays]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, dtype string, shape array<long>, data array<double>")


def write_numpy(df: DataFrame, folder: str, name: str = "name", shape: str = "shape", data: str = "data", dtype: str = "<f4") -> DataFrame:
    """(name, bytes): writes <folder>/<name>.npy for each row from the executors, to a local path or any
    file system that pyarrow knows by its address (file, hdfs, s3, ...); all executors must share it.
    Lazy: an action on the result writes."""
    import io

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        put = writer(folder)
        for pdf in batches:
            sizes = []
            for n, s, d in zip(pdf[name], pdf[shape], pdf[data]):
                buffer = io.BytesIO()
                np.save(buffer, np.asarray(d, dtype=dtype).reshape([int(x) for x in s]))
                sizes.append(put(f"{n}.npy", buffer.getvalue()))
            yield pd.DataFrame({"name": pdf[name].astype(str), "bytes": sizes})

    return df.mapInPandas(save, "name string, bytes long")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Marker files: a line 'n width height', then lines 'x y marker label'.

    (path, width, height, x, y, marker, label); lines of other lengths are left out.
    """
    t = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("t"))
    head = t.where(F.size("t") == 3).groupBy("path").agg(F.max(F.col("t")[1].cast("int")).alias("width"), F.max(F.col("t")[2].cast("int")).alias("height"))
    rows = t.where(F.size("t") == 4).select("path", *[F.col("t")[i].cast("int").alias(n) for i, n in enumerate(("x", "y", "marker", "label"))])
    return rows.join(F.broadcast(head) if head.limit(10_001).count() <= 10_000 else head, "path", "left").select("path", "width", "height", "x", "y", "marker", "label")


def write_seeds(seeds: DataFrame, path: str, width: int, height: int) -> None:
    """One marker file (a text file in folder ``path``): the head line, then seeds by (marker, y, x)."""
    n = seeds.count()
    lines = seeds.orderBy("marker", "y", "x").select(F.concat_ws(" ", "x", "y", "marker", "label").alias("value"))
    head = seeds.sparkSession.createDataFrame([(f"{n} {width} {height}",)], "value string")
    head.unionByName(lines).coalesce(1).write.mode("overwrite").text(path)


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of Pascal-VOC annotations: (path, name, x0, y0, x1, y1), lower corner from 0."""
    schema = "name string, bndbox struct<xmin:int,ymin:int,xmax:int,ymax:int>"
    b = spark.read.format("xml").option("rowTag", "object").schema(schema).load(path)
    return b.select(F.input_file_name().alias("path"), "name", (F.col("bndbox.xmin") - 1).alias("x0"), (F.col("bndbox.ymin") - 1).alias("y0"), F.col("bndbox.xmax").alias("x1"), F.col("bndbox.ymax").alias("y1"))


def read_json_dict(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of JSON files, each one value of any type."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("value"))
    return t


def list_files(spark: SparkSession, folder: str, suffix: str | None = None, pattern: str | None = None) -> DataFrame:
    """(path, bytes, modified) of the files under a folder, by suffix or regular expression; contents
    are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        r = r.option("pathGlobFilter", f"*{suffix}")
    f = r.load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return f.where(F.col("path").rlike(pattern)) if pattern else f


def read_lines(spark: SparkSession, path: str, containing: str | None = None) -> DataFrame:
    """Lines of text files (gzip by extension), or those that contain a literal."""
    t = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))
    return t.where(F.contains("line", F.lit(containing))) if containing else t


def replace_in_lines(spark: SparkSession, path: str, old: str, new: str) -> DataFrame:
    """Lines of text files (gzip by extension) with every occurrence of a literal replaced: (path, line)."""
    return read_lines(spark, path).withColumn("line", F.replace("line", F.lit(old), F.lit(new)))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, content) of the members of zip files."""
    import io
    import zipfile

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, b in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(b)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            yield pd.DataFrame({"path": [p], "member": [m.filename], "content": [z.read(m)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "path string, member string, content binary")


def read_architecture(spark: SparkSession, path: str) -> DataFrame:
    """Layers of a network's JSON: layer, input and output channels, kernel, dilation, kernels a marker,
    pooling. The input channels of a layer are the output channels of the one before (first: 3)."""
    from pyspark.sql import Window

    v = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    n = F.try_variant_get("v", "$.nlayers", "int")
    flat = v.select(F.to_json("v").alias("j"), n.alias("n"), F.try_variant_get("v", "$.stdev_factor", "double").alias("stdev_factor"))
    flat = flat.select("stdev_factor", "j", F.explode(F.sequence(F.lit(1), "n")).alias("layer"))
    conv = "struct<kernel_size:array<int>,dilation_rate:array<int>,nkernels_per_marker:int,noutput_channels:int>"
    one = F.expr("get_json_object(j, concat('$.layer', layer))")
    layers = flat.select("stdev_factor", "layer", F.from_json(one, f"struct<conv:{conv},pooling:struct<size:array<int>,stride:int,type:string>>").alias("l"))
    before = F.lag("noutput_channels", 1, 3).over(Window.partitionBy(F.lit(0)).orderBy("layer"))  # a row a layer

    def plane(c: str):
        return F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(1)))

    out = layers.select("layer", "stdev_factor", plane("l.conv.kernel_size").alias("kernel_size"), F.get("l.conv.dilation_rate", F.lit(0)).alias("dilation"), F.col("l.conv.nkernels_per_marker").alias("nkernels_per_marker"),
        F.col("l.conv.noutput_channels").alias("noutput_channels"), plane("l.pooling.size").alias("pool_size"), F.col("l.pooling.stride").alias("pool_stride"), F.col("l.pooling.type").alias("pool_type"))
    return out.withColumn("ninput_channels", before)
