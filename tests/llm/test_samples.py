import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arborgrid.llm import quota, subset


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9), st.integers(0, 80)), min_size=1, max_size=9), st.integers(0, 120))
def test_quotas_keep_floors_and_caps(classes, size):
    pct, floor, there = (np.array(c) for c in zip(*classes))
    q = quota.allocate(pct.astype(float), floor, there, size)
    low = np.minimum(floor, there)
    assert (q >= low).all() and (q <= there).all()
    can = there[pct > 0].sum() + low[pct == 0].sum()
    assert q.sum() == max(low.sum(), min(size, can)) or (q.sum() == size)
    if size <= can and size >= low.sum():
        assert q.sum() == size


def test_largest_remainder():
    q = quota.allocate(np.array([50.0, 30.0, 20.0]), np.zeros(3, int), np.array([99, 99, 99]), 7)
    assert q.tolist() == [4, 2, 1]


def test_what_a_short_category_leaves_goes_by_target():
    q = quota.allocate(np.array([80.0, 15.0, 5.0]), np.zeros(3, int), np.array([0, 5000, 5000]), 1000)
    assert q.tolist() == [0, 750, 250]
    q = quota.allocate(np.array([50.0, 30.0, 20.0]), np.array([0, 0, 60]), np.array([10, 999, 999]), 100)
    assert q.tolist() == [10, 30, 60]
    big = quota.allocate(np.array([80.0, 15.0, 5.0]), np.zeros(3, int), np.array([0, 10**9, 10**9]), 10**8)
    assert big.tolist() == [0, 75_000_000, 25_000_000]


def test_report_names_what_is_missing(spark):
    samples = spark.createDataFrame([("t", "p", 1, i) for i in range(3)] + [("t", "p", 2, i) for i in range(50)], "tbl string, pool string, class int, sample long")
    targets = spark.createDataFrame([("t", "p", 1, 50, 8, 10), ("t", "p", 2, 50, 9, 10), ("t", "p", 2, 40, None, 10), ("t", None, 1, 1, 1, 1)], "tbl string, pool string, class int, target_pct int, min_n int, sample_size int")
    got = {r["class"]: (r["quota"], r["over_size"], r["short"], r["missing"], r["unmet"]) for r in quota.quotas(samples, targets, ["tbl", "pool"], "class").collect()}
    assert got == {1: (3, 2, True, 5, 5), 2: (9, 2, False, 0, 0)}


def test_samples_of_both_tables(spark):
    split = spark.createDataFrame([(1, 1, "p"), (1, 1, "p"), (2, 0, "p"), (3, None, "p"), (4, 2, None), (5, 2, "p")], "ids long, true_labels int, pool string")
    assert {(r["class"], r["sample"]) for r in quota.split_samples(split).collect()} == {(1, 1), (2, 5)}
    names = ["p/cut/000002_0000015_leaf.nii.gz", ".\\p\\cut\\002_15.PGM\n", "./p//cut//001_0000007.scn", "P/CUT/001_0000007.PGM", "p/no.png", None, ""]
    files = spark.createDataFrame([(i, n, None, "p") for i, n in enumerate(names)], "file_id long, filename string, class int, pool string")
    assert {(r["class"], r["sample"]) for r in quota.file_samples(files).collect()} == {(2, 15), (1, 7)}


def test_draw_and_report(spark):
    rows = [("t", "p", 1, i) for i in range(900)] + [("t", "p", 2, i) for i in range(5)] + [("t", "q", 1, 1)]
    samples = spark.createDataFrame(rows, "tbl string, pool string, class int, sample long")
    targets = spark.createDataFrame([("t", "p", 1, 50, 0, 100), ("t", "p", 2, 30, 0, 100), ("t", "p", 3, 20, 2, 100), ("t", "r", 1, 100, 1, 10)], "tbl string, pool string, class int, target_pct int, min_n int, sample_size int")
    q = quota.quotas(samples, targets, ["tbl", "pool"], "class")
    got = {(r["pool"], r["class"]): (r["quota"], r["short"]) for r in q.collect()}
    assert got == {("p", 1): (95, False), ("p", 2): (5, True), ("p", 3): (0, True), ("r", 1): (0, True)}
    drawn = quota.draw(samples, q, ["tbl", "pool"], "class", "sample").toPandas()
    assert drawn.groupby(["pool", "class"]).size().to_dict() == {("p", 1): 95, ("p", 2): 5} and not drawn.duplicated().any()
    assert quota.draw(samples.limit(0), quota.quotas(samples.limit(0), targets, ["tbl", "pool"], "class"), ["tbl", "pool"], "class", "sample").count() == 0


def test_varied_subset(spark):
    big, small = list(range(0, 400)), list(range(400, 405))
    sel = [(1, 9, [0, 400, -1, None], [big, [*small, None, 99999, 400, 0], None, []]), (2, 9, [0], [[0, 1, 2]]), (3, 9, None, None), (4, 9, [7], [[7, 8]])]
    selectors = spark.createDataFrame([*sel, sel[1]], "selector_id long, graph_id long, rootarray array<bigint>, clusterlist array<array<bigint>>")
    requests = spark.createDataFrame([(1, 8), (2, 50), (3, 5), (4, 0)], "selector_id long, nsamples int")
    nodes = spark.createDataFrame([(i, "x") for i in [*big, *small]], "node_id long, cluster string")
    rng = np.random.default_rng(0)
    vec = [(i, list(map(float, rng.normal(0 if i < 390 else 8, 0.1, 5)))) for i in big] + [(400, [50.0] * 5)]
    vectors = spark.createDataFrame(vec, "node_id long, vec array<float>")
    got = subset.varied_subset(selectors, requests, nodes, vectors).toPandas()
    one = got[got.selector_id == 1]
    assert len(one) == 8 and one.node_id.is_unique and (one.cluster == 0).sum() == 4 and {0, 400} <= set(one.node_id)
    assert sorted(got[got.selector_id == 2].node_id) == [0, 1, 2] and set(got.selector_id) == {1, 2}
    assert subset.varied_subset(selectors.limit(0), requests, nodes, vectors).count() == 0


def test_rare_places_are_drawn_more_often(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.05, (950, 3)), rng.uniform(-9, 9, (50, 3))])
    ids = list(range(1000))
    sel = spark.createDataFrame([(1, 1, [-1], [ids])], "selector_id long, graph_id long, rootarray array<bigint>, clusterlist array<array<bigint>>")
    vectors = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "node_id long, vec array<float>")
    got = subset.varied_subset(sel, spark.createDataFrame([(1, 60)], "selector_id long, nsamples int"), spark.createDataFrame([(i,) for i in ids], "node_id long"), vectors).toPandas()
    assert len(got) == 60 and (got.node_id >= 950).sum() > 20  # 3 would be their share


def test_vectors_of_every_length_have_buckets(spark):
    rng = np.random.default_rng(2)
    vec = [(i, [float(v) for v in rng.normal(0, 0.01, 3)]) for i in range(300)] + [(i, [float(v) for v in rng.normal(0, 0.01, 2)]) for i in range(300, 390)]
    vec += [(i, [float(v) for v in rng.uniform(-9, 9, 2)]) for i in range(390, 400)]
    vectors = spark.createDataFrame(vec, "node_id long, vec array<float>")
    sel = spark.createDataFrame([(1, 1, [-1], [list(range(405))])], "selector_id long, graph_id long, rootarray array<bigint>, clusterlist array<array<bigint>>")
    nodes = spark.createDataFrame([(i,) for i in range(405)], "node_id long")
    requests = spark.createDataFrame([(1, 405)], "selector_id long, nsamples int")
    d = subset.varied_subset(sel, requests, nodes, vectors).toPandas().set_index("node_id").density.sort_index()
    assert d.loc[:299].median() > 5 and d.loc[300:389].median() > 60 and d.loc[390:399].max() < 20 and (d.loc[400:] == 5).all()
    assert d.loc[300:389].max() <= 90  # never counted with vectors of another length


def test_a_node_is_in_the_cluster_it_is_the_root_of(spark):
    sel = spark.createDataFrame([(1, 1, [1, 2], [[1, 2, 3], [4, 2]])], "selector_id long, graph_id long, rootarray array<bigint>, clusterlist array<array<bigint>>")
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node_id long")
    got = subset.candidates(sel, nodes).toPandas().set_index("node")
    assert got.cluster.to_dict() == {1: 0, 2: 1, 3: 0, 4: 1} and got.is_root.to_dict() == {1: True, 2: True, 3: False, 4: False}


def test_hot_buckets_give_the_same_density(spark):
    ids = list(range(600))
    sel = spark.createDataFrame([(1, 1, [-1], [ids])], "selector_id long, graph_id long, rootarray array<bigint>, clusterlist array<array<bigint>>")
    vectors = spark.createDataFrame([(i, [1.0, 1.0] if i % 10 else [float(i), 0.0]) for i in ids], "node_id long, vec array<float>")
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id long")
    got = subset.varied_subset(sel, spark.createDataFrame([(1, 600)], "selector_id long, nsamples int"), nodes, vectors).toPandas()
    assert (got[got.node_id % 10 != 0].density >= 540).all() and len(got) == 600
