import numpy as np
from pyspark.sql import functions as F

from arborgrid.llm import nearest


def brute(rows, k):
    ids = sorted(rows)
    out = set()
    for a in ids:
        d = sorted((float(((np.array(rows[a]) - np.array(rows[b])) ** 2).sum()), b) for b in ids if b != a)
        out |= {(a, b, r) for r, (_, b) in enumerate(d[:k], 1)}
    return out


def test_ties_copies_and_dirty_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (300, 4)).astype(float)  # many ties
    x[50:90] = x[50]  # copies
    rows = {i: list(map(float, v)) for i, v in enumerate(x)}
    bad = [(1000, None), (1001, [1.0, None, 2.0, 3.0]), (1002, [float("nan")] * 4), (1003, [float("inf")] * 4), (1004, []), (None, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows.items()] + [(i, v, 9) for i, v in bad] + [(5, rows[5], 9)], "id long, vec array<float>, rep int")
    got = nearest.nearest(df, "id", "vec", k=5, leaf=32, probes=200, trees=4)
    assert {(r["id"], r["neighbour"], r["rank"]) for r in got.collect()} == brute(rows, 5)


def test_recall_of_few_probes_and_blocks(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (200, 12)) for c in rng.normal(0, 4, (8, 12))]).astype(np.float32)
    rows = {i: list(map(float, v)) for i, v in enumerate(x)}
    df = spark.createDataFrame(list(rows.items()), "id long, vec array<float>")
    want = {p[:2] for p in brute(rows, 10)}
    got = {(r["id"], r["neighbour"]) for r in nearest.nearest(df, "id", "vec", leaf=100, probes=12).collect()}
    assert len(got & want) / len(want) > 0.9
    assert got == {(r["id"], r["neighbour"]) for r in _small_blocks(nearest, lambda: nearest.nearest(df, "id", "vec", leaf=100, probes=12).collect())}


def _small_blocks(module, run):
    kept = module.POINTS_BLOCK, module.QUERIES_BLOCK, module.LISTS_BLOCK
    module.POINTS_BLOCK, module.QUERIES_BLOCK, module.LISTS_BLOCK = 60, 80, 500
    try:
        return run()
    finally:
        module.POINTS_BLOCK, module.QUERIES_BLOCK, module.LISTS_BLOCK = kept


def test_probes_follow_from_the_wanted_recall(spark):
    rng = np.random.default_rng(2)
    for n in (1000, 4000):  # no structure at all: a fixed number of leaves would lose recall as n grows
        x = rng.normal(size=(n, 8)).astype(np.float32)
        df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, vec array<float>")
        got = {}
        for r in nearest.nearest(df, "id", "vec", leaf=64, recall=0.97).collect():
            got.setdefault(r["id"], set()).add(r["neighbour"])
        d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2) if n < 2000 else None
        if d is not None:
            np.fill_diagonal(d, np.inf)
            true = np.argsort(d, axis=1, kind="stable")[:, :10]
            hit = sum(len(got[i] & set(true[i].tolist())) for i in range(n)) / (10 * n)
        else:
            hit = nearest.recall(df, "id", "vec").first()["recall"]
        assert hit > 0.93


def test_turns_name_the_leaf_that_search_reaches():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    forest = nearest.Forest(x, 3, 4)
    turns = forest.turns(x[:20], [x[30 + i : 60 + i] for i in range(20)]).reshape(20, 30)
    own, flag = forest.search(x, 3)
    leaves = [set(o[f].tolist()) for o, f in zip(own, flag)]
    for probes in (3, 7, 20):
        reached = forest.search(x[:20], probes)[0]
        for i in range(20):
            for j in range(30):
                assert (turns[i, j] <= probes) == bool(set(reached[i].tolist()) & leaves[30 + i + j])


def test_a_class_with_most_rows(spark):
    rows = {i: [1.0, 2.0] if i % 10 else [float(i), 0.0] for i in range(600)}
    df = spark.createDataFrame(list(rows.items()), "id long, vec array<float>")
    got = {(r["id"], r["neighbour"], r["rank"]) for r in nearest.nearest(df, "id", "vec", k=3, leaf=16).collect()}
    assert got == brute(rows, 3)
    r = nearest.recall(df, "id", "vec", 3).first()
    assert (r["queries"], r["neighbours"], r["recall"]) == (6, 18, 1.0)


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, [1.0])], "id long, vec array<float>")
    assert {(r["id"], r["neighbour"]) for r in nearest.nearest(df, "id", "vec").collect()} == {(1, 2), (2, 1)}
    assert nearest.nearest(df.limit(0), "id", "vec").count() == 0


def test_matrix_rows(spark):
    m = spark.createDataFrame([(1, 2, 2, [1.0, 2.0, 3.0]), (1, 2, 2, [1.0, 2.0, 3.0]), (2, 1, 2, None), (3, 0, 2, [])], "matrix_id long, nrows int, ncols int, val array<float>").withColumn("loaded_at", F.current_timestamp())
    g = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 1), (3, 1, -1), (4, None, 0), (5, 99, 0), (6, 2, 0), (7, 1, 2)], "node_id long, z long, sample int")
    assert [(r[0], list(r[1])) for r in nearest.matrix_rows(m, g).collect()] == [(1, [1.0, 2.0])]
