"""Where intermediate tables live, and when a side may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The setting is read from the session. Only when it is unset and the master is local does a
    fresh temporary folder take its place, so a cluster never writes to a machine-local path.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="arborgrid-")
    spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Parquet tables in the shared checkpoint folder that cut the lineage of iterative plans.

    A table written here survives the loss of executors, is columnar and compressed, and later
    plans read only the columns they need. ``drop`` removes tables that no later plan reads; what
    lazy results still read is removed when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str = "work"):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def put(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = f"{self.root}/t{self._n}"
        self._n += 1
        (df.coalesce(files) if files else df).write.parquet(path)
        if self._n == 1:  # the whole folder goes when the application ends
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._arborgrid_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "_arborgrid_path", None):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(t._arborgrid_path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows, else ``df`` itself.

    The count looks at ``rows + 1`` rows at most. Beyond the bound the join is left to a shuffle.
    Give it materialised or cheap tables: the count runs a job of its own.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
