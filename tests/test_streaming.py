import time

import numpy as np
from pyspark.sql import functions as F

from arborgrid.operators import forests
from arborgrid.streaming import forest


def test_differential_forest_equals_a_fresh_watershed(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        a = np.random.default_rng(0).integers(0, 9, (6, 7))
        rows = [(0, x, y, float(a[y, x])) for y in range(6) for x in range(7)]
        pixels = spark.createDataFrame(rows, "image_id long, x int, y int, v double")
        src = str(tmp_path / "seeds")
        schema = "image_id long, x int, y int, label long"
        spark.createDataFrame([(0, 0, 0, 1), (0, 6, 5, 2)], schema).coalesce(1).write.parquet(src)
        events = forest.batches_of_files(spark, src, schema)
        changed = forest.differential_forest(events, pixels)
        q = changed.writeStream.format("memory").queryName("changed_pixels").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r["x"], r["y"]): r["cost"] for r in spark.table("changed_pixels").collect()}
        seeded = pixels.withColumn("seed", F.when((F.col("x") == 0) & (F.col("y") == 0), 1).when((F.col("x") == 6) & (F.col("y") == 5), 2).otherwise(0))
        assert got == {(r["x"], r["y"]): r["cost"] for r in forests.watershed(seeded, "v", "seed").collect()}
    finally:
        spark.conf.unset(provider)


def test_regrowing_equals_a_fresh_watershed_and_visits_less():
    rng = np.random.default_rng(1)
    h, w = 24, 30
    v = rng.integers(0, 50, h * w).astype(float)
    at = np.full((h + 2, w + 2), -1)
    at[1:-1, 1:-1] = np.arange(h * w).reshape(h, w)
    near = np.stack([at[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx].ravel() for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy], 1)

    def fresh(seeds):
        start, label = np.full(h * w, np.inf), np.zeros(h * w, dtype=np.int64)
        for p, name in seeds.items():
            start[p], label[p] = 0.0, name
        return forests.grow(near, start, label, lambda p, q, c: max(c, v[q]))[0]

    seeds, cost, label, root = {}, np.full(h * w, np.inf), np.zeros(h * w, dtype=np.int64), np.full(h * w, -1)
    seen = []
    for step in range(40):
        add = {int(p): int(rng.integers(1, 4)) for p in rng.choice(h * w, 12 if step == 0 else 1, replace=False)}
        gone = {int(p) for p in rng.choice(sorted(seeds), 1)} if step % 2 and len(seeds) > 3 else set()
        gone |= set(add) & set(seeds)
        for p in gone:
            del seeds[p]
        seeds |= add
        seen.append(forest.regrow(near, v, cost, label, root, gone, add))
        assert (cost == fresh(seeds)).all()
        assert all(root[p] in seeds and label[p] == seeds[root[p]] for p in range(h * w))
    assert np.median(seen[1:]) < h * w / 3
    forest.regrow(near, v, cost, label, root, set(seeds), {})
    assert not np.isfinite(cost).any() and (label == 0).all()


def test_seeds_that_go_give_their_pixels_back(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        pixels = spark.createDataFrame([(0, x, 0, float(abs(x - 3))) for x in range(7)], "image_id long, x int, y int, v double")
        src, schema = str(tmp_path / "seeds"), "image_id long, x int, y int, label long"
        for batch in ([(0, 0, 0, 1), (0, 6, 0, 2)], [(0, 6, 0, 0)], [(0, 0, 0, 0)]):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
            time.sleep(1.1)  # files are taken by their age
        changed, got = forest.differential_forest(forest.batches_of_files(spark, src, schema, 1), pixels), []
        q = changed.writeStream.foreachBatch(lambda df, _: got.append({r["label"] for r in df.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert [g for g in got if g] == [{1, 2}, {1}, {0}]
    finally:
        spark.conf.unset(provider)
