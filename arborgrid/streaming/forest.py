"""Streams: seeds that come and go, and images that arrive.

``DifferentialForest`` keeps, per image, the seeds seen so far and cost, label and root of each
pixel. A batch of seed events changes the forest only where it must: trees of removed seeds are
taken down and regrown from the pixels around them, new seeds grow from their place, and all other
trees stay. Only pixels whose label or cost changed are sent. State is per image and is split in
rows, so an image's state is a map of row -> arrays and not one growing blob.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from arborgrid.operators.forests import Image

OUT = "image_id long, x int, y int, label long, cost double"


def regrow(near: np.ndarray, v: np.ndarray, cost: np.ndarray, label: np.ndarray, root: np.ndarray, removed: set[int], added: dict[int, int]) -> int:
    """Change a watershed forest in place: trees whose root is in ``removed`` go, seeds ``added`` (pixel ->
    label) come. Returns how many pixels were visited.

    Costs are those of a fresh watershed. A pixel keeps its root where an equal cost is offered, which
    is as good: the old root's way to it still exists.
    """
    gone = np.isin(root, list(removed)) if removed else np.zeros(len(root), dtype=bool)
    cost[gone], label[gone], root[gone] = np.inf, 0, -1
    heap = []
    if gone.any():
        around = near[gone].ravel()
        around = np.unique(around[around >= 0])
        heap = [(cost[p], p) for p in around.tolist() if not gone[p] and np.isfinite(cost[p])]
    for p, name in added.items():
        cost[p], label[p], root[p] = 0.0, name, p
        heap.append((0.0, p))
    heapq.heapify(heap)
    visited = 0
    while heap:
        c, p = heapq.heappop(heap)
        if c > cost[p]:
            continue
        visited += 1
        for q in near[p].tolist():
            if q >= 0:
                o = max(c, v[q])
                if o < cost[q]:
                    cost[q], label[q], root[q] = o, label[p], root[p]
                    heapq.heappush(heap, (o, q))
    return visited


class DifferentialForest(StatefulProcessor):
    """Initial state: the image's pixels (image_id, x, y, v). Events: image_id, x, y, label (0 removes)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "y int", "x array<int>, v array<double>, label array<long>, cost array<double>, root array<long>")
        self.seeds = handle.getMapState("seeds", "x int, y int", "label long")

    def handleInitialState(self, key, initial: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for y, g in initial.sort_values("x").groupby("y"):
            n = len(g)
            self.rows.updateValue((int(y),), (g["x"].astype(int).tolist(), g["v"].astype(float).tolist(), [0] * n, [-1.0] * n, [-1] * n))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events: dict[tuple[int, int], int] = {}
        for pdf in rows:
            for x, y, label in zip(pdf["x"].tolist(), pdf["y"].tolist(), pdf["label"].tolist()):
                events[(int(x), int(y))] = int(label)
        parts = [pd.DataFrame({"image_id": key[0], "x": v[0], "y": k[0], "v": v[1], "label": v[2], "cost": v[3], "root": v[4]}) for k, v in self.rows.iterator()]
        if not parts:
            return
        img = Image(pd.concat(parts))
        at = {p: i for i, p in enumerate(zip(img.x.tolist(), img.y.tolist()))}
        removed: set[int] = set()
        added: dict[int, int] = {}
        for place, label in events.items():
            before = self.seeds.getValue(place)[0] if self.seeds.containsKey(place) else 0
            if label == before:
                continue
            if label:
                self.seeds.updateValue(place, (label,))
            else:
                self.seeds.removeKey(place)
            if place in at:
                if before:
                    removed.add(at[place])
                if label:
                    added[at[place]] = label
        old = img.pdf["label"].to_numpy(np.int64), img.pdf["cost"].to_numpy(float)
        name = (img.y << 32) + img.x  # a root's name in the state: its place
        stored = img.pdf["root"].to_numpy(np.int64)
        order = np.argsort(name)
        root = np.where(stored >= 0, order[np.minimum(np.searchsorted(name[order], stored), len(order) - 1)], -1)
        label, cost = old[0].copy(), np.where(old[1] < 0, np.inf, old[1])
        v = img.values("v")
        regrow(img.near, v, cost, label, root, removed, added)
        cost = np.where(np.isfinite(cost), cost, -1.0)
        named = np.where(root >= 0, name[root], -1)
        moved = (label != old[0]) | (cost != old[1])
        for y in np.unique(img.y[moved | (named != stored)]).tolist():
            r = img.y == y
            self.rows.updateValue((int(y),), (img.x[r].tolist(), v[r].tolist(), label[r].tolist(), cost[r].tolist(), named[r].tolist()))
        if moved.any():
            yield pd.DataFrame({"image_id": key[0], "x": img.x[moved].astype("int32"), "y": img.y[moved].astype("int32"), "label": label[moved], "cost": cost[moved]})

    def close(self) -> None:
        pass


def differential_forest(events: DataFrame, pixels: DataFrame) -> DataFrame:
    """Changed pixels (image_id, x, y, label, cost) per micro-batch. ``events`` is a stream; needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    return events.groupBy("image_id").transformWithStateInPandas(DifferentialForest(), outputStructType=OUT, outputMode="Update", timeMode="None", initialState=pixels.groupBy("image_id"))


def running_counts(events: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts a tumbling window and key, with a watermark for late rows."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def batches_of_files(spark, folder: str, schema, per_trigger: int = 16) -> DataFrame:
    """A folder of parquet files as a stream of bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
