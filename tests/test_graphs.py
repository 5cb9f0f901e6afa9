import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborgrid import registry
from arborgrid.operators import forests, graphs, grid, learning, neighbours
from arborgrid.plans import Scratch


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(2)
    es = {(min(a, b), max(a, b)): rng.randint(1, 9) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(110)) if a != b}
    return es, spark.createDataFrame([(a, b, float(w)) for (a, b), w in es.items()], "a long, b long, w double")


def roots_of(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark, net):
    es, df = net
    dirty = df.select("a", "b").unionByName(spark.createDataFrame([(None, 1), (500, 500), (1, 1)], "a long, b long"))
    got = {r["id"]: r["root"] for r in graphs.connected_components(dirty, Scratch(spark)).collect()}
    assert got == roots_of(es) | {500: 500} | ({1: roots_of(es).get(1, 1)})
    assert graphs.connected_components(df.select("a", "b").limit(0), Scratch(spark)).count() == 0


def test_spanning_forest(spark, net):
    es, df = net
    got = {(r["a"], r["b"]): r["w"] for r in graphs.minimum_spanning_forest(df, Scratch(spark)).collect()}
    up, want = {}, {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for (a, b), w in sorted(es.items(), key=lambda e: (e[1], e[0])):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want[(a, b)] = float(w)
    assert got == want


@pytest.mark.parametrize("cost,add", [(graphs.fmax, max), (graphs.fsum, lambda a, b: a + b)])
def test_path_forest(spark, net, cost, add):
    es, df = net
    seeds = spark.createDataFrame([(0, 1, 0.0), (7, 2, 0.0)], "id long, label int, cost double")
    got = {r["id"]: (r["cost"], r["label"], r["root"]) for r in graphs.path_forest(df, seeds, Scratch(spark), cost).collect()}
    adj = {}
    for (a, b), w in es.items():
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    best, heap = {}, [(0.0, 1, 0, 0), (0.0, 2, 7, 7)]
    while heap:
        c, lab, root, p = heapq.heappop(heap)
        if p in best:
            continue
        best[p] = (c, lab, root)
        for q, w in adj.get(p, []):
            heapq.heappush(heap, (float(add(c, w)), lab, root, q))
    assert got == best


def test_descendants_and_leaves(spark):
    pred = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None)], "id long, pred long")
    assert {tuple(r) for r in graphs.forest_descendants(pred, Scratch(spark)).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (9, 9, 0)}
    assert {tuple(r) for r in graphs.leaves_and_roots(pred).collect()} == {(1, True, False), (2, False, False), (3, False, False), (4, False, True), (9, True, True)}


def image(spark, a, seeds=None):
    rows = [(0, x, y, int(v), int((seeds or {}).get((x, y), 0))) for y, r in enumerate(a) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, v int, seed int")


def test_watershed_costs_equal_the_relaxed_ones(spark):
    a = np.random.default_rng(0).integers(0, 9, (7, 9))
    p = image(spark, a, {(0, 0): 1, (8, 6): 2})
    got = {(r["x"], r["y"]): r["cost"] for r in forests.watershed(p, "v", "seed").collect()}
    cost = np.full(a.shape, 1e9)
    cost[0, 0] = cost[6, 8] = 0
    for _ in range(80):
        for y in range(7):
            for x in range(9):
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if 0 <= y + dy < 7 and 0 <= x + dx < 9:
                            cost[y, x] = min(cost[y, x], max(cost[y + dy, x + dx], a[y, x]))
    assert got == {(x, y): cost[y, x] for y in range(7) for x in range(9)}


def test_graph_cut_separates_two_halves(spark):
    a = np.zeros((6, 8), dtype=int)
    a[:, 4:] = 200
    got = forests.graph_cut(image(spark, a, {(0, 0): 1, (7, 5): 2}), "v", "seed").toPandas()
    assert (got[got.x < 4].label == 1).all() and (got[got.x >= 4].label == 0).all()


def test_area_opening_removes_small_peaks(spark):
    a = np.zeros((8, 8), dtype=int)
    a[1, 1] = 9
    a[4:7, 4:7] = 5
    got = forests.attribute_open(image(spark, a), "v", 4).toPandas()
    assert got[(got.x == 1) & (got.y == 1)].filtered.item() == 0 and (got[got.x.between(4, 6) & got.y.between(4, 6)].filtered == 5).all()


def test_superpixels_are_connected_and_few(spark):
    a = np.random.default_rng(3).integers(0, 255, (24, 24))
    got = forests.superpixels_forest(image(spark, a), "v", 40, 5).toPandas()
    assert got.superpixel.nunique() == 5 and len(got) == 576
    assert len(forests.superpixels_slic(image(spark, a), "v", 8).collect()) == 576


def test_dynamic_trees_split_by_mean(spark):
    a = np.repeat([[10, 12, 11, 13, 90, 92, 91, 90]], 4, axis=0)
    got = forests.dynamic_trees(image(spark, a, {(0, 0): 1, (7, 3): 2}), "v", "seed").toPandas()
    assert (got[got.x < 4].label == 1).all() and (got[got.x >= 4].label == 2).all()


def test_distance_transform_and_missing_seeds(spark):
    p = image(spark, np.eye(6, dtype=int))
    got = {(r["x"], r["y"]): r["d2"] for r in grid.distance_transform(p, F.col("v") == 1).collect()}
    assert got == {(x, y): min((x - k) ** 2 + (y - k) ** 2 for k in range(6)) for x in range(6) for y in range(6)}
    assert {r["d2"] for r in grid.distance_transform(p, F.lit(False)).collect()} == {None}


def test_empty_images(spark):
    p = image(spark, np.zeros((2, 2), dtype=int)).limit(0)
    assert forests.watershed(p, "v", "seed").count() == 0 and grid.dilate(p, "v").count() == 0 and grid.border(p, "v").count() == 0


def test_neighbours_in_blocks(spark):
    x = np.random.default_rng(5).integers(0, 4, (90, 3)).astype(float)
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(900, None)], "id long, vec array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.nearest(df, df, "id", "vec", 3, exclude_self=True, block=20).collect()}
    for i in range(90):
        want = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(90) if j != i)[:3]
        assert [got[(i, r)] for r in (1, 2, 3)] == [j for _, j in want]


def test_kmeans_and_path_forest_find_blobs(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (8, 0), (0, 8))])
    df = spark.createDataFrame([(i, list(map(float, v)), i // 40) for i, v in enumerate(x)], "id long, vec array<double>, label int")
    a, centres = learning.kmeans(df, "id", "vec", 3, initial=[x[0].tolist(), x[50].tolist(), x[100].tolist()])
    assert len(centres) == 3 and a.toPandas().groupby("label").cluster.nunique().tolist() == [1, 1, 1]
    scratch = Scratch(spark)
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    trained = scratch.put(learning.train_path_forest(train, "id", "vec", "label", 4, scratch))
    got = learning.classify_path_forest(trained, train, test, "id", "vec").join(test.select("id", F.col("label").alias("t")), "id")
    assert got.where("label <> t").count() == 0
    assert learning.cluster_by_density(df, "id", "vec", 8, scratch).join(df.select("id", "label"), "id").groupBy("cluster").agg(F.countDistinct("label").alias("n")).where("n > 1").count() == 0


def test_kmeans_with_partitions_without_samples(spark):
    x = [[float(i % 3 * 9), float(i % 2)] for i in range(6)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(i, None) for i in range(6, 12)], "id long, vec array<double>")
    for some in (df.repartition(20, "id"), df.coalesce(1).unionByName(df.limit(0)), df.where("id < 6").coalesce(1).unionByName(df.where("id >= 6"))):
        a, centres = learning.kmeans(some, "id", "vec", 3, initial=[[0.0, 0.0], [9.0, 0.0], [18.0, 0.0]])
        assert centres == [[0.0, 0.5], [9.0, 0.5], [18.0, 0.5]]
        assert sorted((r["id"], r["cluster"]) for r in a.collect()) == [(i, i % 3 + 1) for i in range(6)]


@pytest.mark.parametrize("rows", [60, 5])
def test_cluster_hierarchy_of_a_file_with_splits_without_rows(spark, tmp_path, rows):
    """One row group in several splits: all but one of them hold no rows."""
    x = np.random.default_rng(7).normal(0, 5, (rows, 400))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.parquet(f"{tmp_path}/embeddings.parquet").rdd.getNumPartitions() > 1
        got = registry.QUERIES["cluster_hierarchy"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    v = x.astype("float32").astype(float)

    def lloyd(v, k):
        c = v[:k].copy()
        for _ in range(10):
            near = ((v[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.stack([v[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        return ((v[:, None] - c[None]) ** 2).sum(2).argmin(1) + 1, c

    low, c = lloyd(v, 10)
    top, _ = lloyd(c, 3)
    assert sorted((r["vec_id"], r["low"], r["top"]) for r in got) == [(i, low[i], top[low[i] - 1]) for i in range(rows)]


def test_mixture_cut_and_basins(spark):
    a = np.zeros((6, 8), dtype=int)
    a[:, 4:] = 200
    got = forests.mixture_cut(image(spark, a, {(0, 0): 1, (7, 5): 2}), "v", "seed").toPandas()
    assert (got[got.x < 4].label == 1).all() and (got[got.x >= 4].label == 0).all()
    b = np.full((5, 5), 9)
    b[2, 2], b[0, 0] = 1, 2
    full = forests.close_basins(image(spark, b), "v").toPandas()
    assert full[(full.x == 2) & (full.y == 2)].closed.item() == 9 and full[(full.x == 0) & (full.y == 0)].closed.item() == 2
    some = forests.close_basins(image(spark, b), "v", 3).toPandas()
    assert some[(some.x == 2) & (some.y == 2)].closed.item() == 4
    assert forests.gray_watershed(image(spark, b), "v", 3).select("region").distinct().count() == 2
    assert forests.superpixels_recentred(image(spark, a), "v", 4).toPandas().superpixel.nunique() == 2


def test_spanning_tree_equals_that_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(9 * i, 1, (1, 3)), 12, 0) for i in range(3)] + [rng.normal(0, 4, (60, 3))])
    d = neighbours.pairwise(x, x)
    up, true = list(range(len(x))), set()

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for w, a, b in sorted((d[a, b], a, b) for a in range(len(x)) for b in range(a + 1, len(x))):
        if find(a) != find(b):
            up[find(b)] = find(a)
            true.add((a, b))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, vec array<double>")
    assert {(r["a"], r["b"]) for r in learning.spanning_tree(df, "id", "vec", 4, Scratch(spark)).collect()} == true


def test_copies_apart_from_all_lists_get_labels_and_prototypes(spark):
    # twelve copies without a label, in nobody's list of the four nearest
    rows = [(i, [float(i), 0.0], 1) for i in range(20)] + [(100 + i, [90.0, 90.0], 2) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    some = df.withColumn("label", F.when(F.col("id") < 5, F.col("label")))
    assert learning.semi_supervised(some, "id", "vec", "label", 4, Scratch(spark)).count() == 32
    trained = learning.train_path_forest(df, "id", "vec", "label", 4, Scratch(spark)).collect()
    assert {(r["label"], r["root"]) for r in trained} == {(1, 19), (2, 100)}
    assert max(r["cost"] for r in trained) == 1.0


def test_semi_supervised_and_outliers(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (9, 9))])
    rows = [(i, list(map(float, v)), i // 30 if i % 10 == 0 else None, i // 30 if i != 5 else 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, some int, label int")
    got = {r["id"]: r["label"] for r in learning.semi_supervised(df, "id", "vec", "some", 4, Scratch(spark)).collect()}
    assert got == {i: i // 30 for i in range(60)}
    assert {r["id"] for r in learning.without_outliers(df, "id", "vec", "label", 4).collect()} == set(range(60)) - {5}


def test_sql_hooks(spark):
    from arborgrid.functions import hooks

    hooks.register(spark)
    assert spark.sql("SELECT vector_l2(array(0.0D, 3.0D), array(4.0D, 0.0D)) AS d").first()["d"] == 5.0
    assert {tuple(r) for r in spark.sql("SELECT * FROM grid_sampler(4, 4, 2)").collect()} == {(1, 1), (3, 1), (1, 3), (3, 3)}


def test_rounds_of_joins_give_what_one_task_gives(spark, net, monkeypatch):
    es, df = net
    seeds = spark.createDataFrame([(0, 1, 0.0), (7, 2, 0.0)], "id long, label int, cost double")
    rows = lambda d: {tuple(r) for r in d.collect()}
    run = lambda: [
        rows(graphs.connected_components(df.select("a", "b"), Scratch(spark))),
        rows(graphs.minimum_spanning_forest(df, Scratch(spark))),
        rows(graphs.path_forest(df, seeds, Scratch(spark), graphs.fmax)),
        rows(graphs.path_forest(df, seeds, Scratch(spark), graphs.fsum)),
    ]
    one = run()
    monkeypatch.setattr(graphs, "SMALL", -1)
    assert run() == one
    with pytest.raises(RuntimeError):
        graphs.path_forest(df, seeds, Scratch(spark), graphs.fsum, max_rounds=1)


def test_components_of_tiles(spark):
    a = np.random.default_rng(4).random((30, 41)) < 0.6
    p = spark.createDataFrame([(1, x, y) for y, x in zip(*map(lambda c: c.tolist(), np.nonzero(a)))], "image_id long, x int, y int")
    number = lambda y, x: (1 << 40) + (y << 20) + x
    pairs = [(number(y, x), number(y + dy, x + dx)) for y, x in zip(*np.nonzero(a)) for dy, dx in ((0, 1), (1, 0)) if y + dy < 30 and x + dx < 41 and a[y + dy, x + dx]]
    want = {int(number(y, x)): int(number(y, x)) for y, x in zip(*np.nonzero(a))} | {int(k): int(v) for k, v in roots_of(pairs).items()}
    for tile in (7, 64):
        assert {r["id"]: r["root"] for r in graphs.grid_components(p, Scratch(spark), tile).collect()} == want
    with pytest.raises(Exception, match="too large"):
        p.select(graphs.pixel_id("image_id", "x", "y")).union(p.withColumn("x", F.lit(1 << 20)).select(graphs.pixel_id("image_id", "x", "y"))).collect()


def test_near_ties_are_ranked_by_exact_distance(spark):
    base = np.array([1000.0, 1000.0, 1000.0])
    x = np.array([base + np.array([i % 3, 0, 0]) * 1e-7 for i in range(120)])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.nearest(df, df, "id", "vec", 3, exclude_self=True).collect()}
    for i in range(120):
        want = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(120) if j != i)[:3]
        assert [got[(i, r)] for r in (1, 2, 3)] == [j for _, j in want]


def test_pca_takes_all_rows_or_raises(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],), (None,)], "v array<double>")
    assert learning.pca(df, "v", 1)[0].tolist() == [1.5, 1.5]
    with pytest.raises(ValueError):
        learning.pca(df.union(spark.createDataFrame([([1.0],)], "v array<double>")), "v", 1)
