import random

from pyspark.sql import functions as F

from arborgrid.llm import related
from arborgrid.plans import Scratch, skew


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_keys(spark):
    rows = [("Bráark,  Dalia Angox", "RIG 7 series 0012", "#SPC0148"), ("dalia.angox.braark", "series 12 (rig 07)", " spc-148."), ("BRAARK_ANGOX_DALIA", "rig_7:series_0012/", "148"), ("n/a", "--", "n/a"), ("Only Two", "rig 7", "1 of 2"), (None, None, None), ("", " ", "")]
    df = spark.createDataFrame(rows, "author string, source string, entity string").coalesce(1)
    got = [tuple(r) for r in df.select(*[f(F.col(n)) for n, f in related.KEYS.items()]).collect()]
    assert set(got[:3]) == {("angox braark dalia", "7/12", "148")}
    assert set(got[3:]) == {(None, None, None)}


def test_forest_matches_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2060)]
    edges = spark.createDataFrame([(min(p), max(p)) for p in pairs if p[0] != p[1]], "u long, v long").distinct()
    roots, forest = related.spanning_forest(edges, Scratch(spark))
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert {r["id"]: r["root"] for r in roots.collect()} == want
    tree = [tuple(r) for r in forest.collect()]
    assert len(tree) == len(want) - len(set(want.values())) and union_find(tree) == want


def test_split_keeps_groups_and_shares(spark):
    rng = random.Random(9)
    rows = [(i, 1 + i % 3, f"{rng.choice('abc')}x {rng.choice('def')}y w{rng.choice('ghijkl')}{rng.choice('mnopq')}" if rng.random() < 0.2 else None, None, str(rng.randrange(1500)) if rng.random() < 0.5 else "none") for i in range(3000)]
    rows += [rows[0], rows[1]] + [(None, 1, "a b c", None, None)]
    df = spark.createDataFrame(rows, "ids long, true_labels int, author string, source string, entity string").withColumn("loaded_at", F.current_timestamp()).withColumn("root", F.lit(1))
    keys = {n: f(F.col(n)) for n, f in related.KEYS.items()}
    placed, _ = related.related_split(df, "ids", "true_labels", "loaded_at", keys, {"train": 70.0, "validation": 15.0, "test": 15.0})
    got = placed.toPandas()
    assert sorted(got["id"]) == list(range(3000))
    assert (got.groupby("root")["split"].nunique() == 1).all()
    share = got["split"].value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["test"] - 0.15) < 0.03
    assert (got.set_index("id")["label"] == [1 + i % 3 for i in got["id"]]).all()


def test_one_key_holds_a_third_and_empty(spark):
    df = spark.createDataFrame([(i, 1, None, None, "7" if i % 3 == 0 else None) for i in range(900)], "ids long, true_labels int, author string, source string, entity string").withColumn("loaded_at", F.lit(None).cast("timestamp"))
    keys = {n: f(F.col(n)) for n, f in related.KEYS.items()}
    placed, _ = related.related_split(df, "ids", "true_labels", "loaded_at", keys, {"a": 50.0, "b": 50.0})
    got = placed.toPandas()
    assert (got[got.id % 3 == 0].root == 0).all() and abs((got.split == "a").mean() - 0.5) < 0.03
    none, forest = related.related_split(df.limit(0), "ids", "true_labels", "loaded_at", keys, {"a": 50.0, "b": 50.0})
    assert none.count() == 0 and forest.count() == 0


def test_hot_keys_are_cut_and_give_the_same_groups(spark):
    rng = random.Random(5)
    rows = [(i, 1, None, None, "7" if i % 2 else str(100 + rng.randrange(400))) for i in range(2000)] + [(i, 1, "a b c", None, None) for i in range(1999, 2100)]
    df = spark.createDataFrame(rows, "ids long, true_labels int, author string, source string, entity string")
    keys = {n: f(F.col(n)) for n, f in related.KEYS.items()}
    scratch = Scratch(spark)
    plain = related.star_edges(df, "ids", keys, scratch)
    cut = related.star_edges(df, "ids", keys, scratch, part_rows=20)
    degree = cut.groupBy("u").count().agg(F.max("count")).first()[0]
    assert degree < 120 and plain.groupBy("u").count().agg(F.max("count")).first()[0] > 900
    kept, skew.TASK_ROWS = skew.TASK_ROWS, 50
    try:
        a = {r["id"]: r["root"] for r in related.spanning_forest(cut, scratch)[0].collect()}
    finally:
        skew.TASK_ROWS = kept
    assert a == {r["id"]: r["root"] for r in related.spanning_forest(plain, scratch)[0].collect()}
