import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborgrid.functions import arith, boxes, color, dictionary, distance, text
from arborgrid.operators import descriptors, detection, grid, histogram, matrices, metrics, search, sets, statistics
from arborgrid.plans import Scratch


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_colours_round_trip(spark):
    for rgb in ((0, 0, 0), (255, 255, 255), (10, 200, 90), (250, 3, 77)):
        r, g, b = (F.lit(float(v)) for v in rgb)
        out = one(spark, **{f"y{i}": c for i, c in enumerate(color.ycbcr_to_rgb(*color.rgb_to_ycbcr(r, g, b)))}, **{f"h{i}": c for i, c in enumerate(color.hsv_to_rgb(*color.rgb_to_hsv(r, g, b)[:2], color.rgb_to_hsv(r, g, b)[2]))}, **{f"l{i}": c for i, c in enumerate(color.lab_to_rgb(*color.rgb_to_lab(r, g, b)))})
        for k in "yh":
            assert [out[f"{k}{i}"] for i in range(3)] == pytest.approx(rgb, abs=1e-6)
        assert [out[f"l{i}"] for i in range(3)] == pytest.approx(rgb, abs=0.2)
    assert one(spark, h=color.rgb_to_hex(F.lit(255), F.lit(0), F.lit(16)), r=color.hex_to_rgb(F.lit("#ff0010"))[2], n=color.hex_to_rgb(F.lit("nope"))[0]) == {"h": "#FF0010", "r": 16, "n": None}


def test_white_and_black_stay_in_the_unit_cube(spark):
    for v in (0.0, 255.0):
        lab = one(spark, **{f"c{i}": c for i, c in enumerate(color.rgb_to_lab_normalized(F.lit(v), F.lit(v), F.lit(v)))})
        assert all(-1e-6 <= x <= 1.0001 for x in lab.values())


def test_text_and_paths(spark):
    p = F.lit("a/b/000002_000015_Left.Lung.nii.gz")
    got = one(spark, ext=text.extension(p), base=text.basename(p), label=text.file_label(p), sample=text.file_sample(p), suffix=text.file_suffix(p), d=text.dirname(p), none=text.dirname(F.lit("x")), j=text.join_path(F.lit("/r/"), F.lit("/s/"), F.lit("")), n=text.normal_path(F.lit(" .\\A//b\n")), at=text.split_at(F.lit("a||b"), "|", -2), pre=text.remove_prefix(F.lit("abc"), ""), suf=text.remove_suffix(F.lit("abc"), "bc"))
    assert got == {"ext": ".nii.gz", "base": "000002_000015_Left.Lung", "label": 2, "sample": 15, "suffix": "Left.Lung", "d": "a/b", "none": ".", "j": "/r/s", "n": "a/b", "at": "", "pre": "abc", "suf": "a"}


def test_dictionaries(spark):
    m = dictionary.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))
    got = one(spark, m=m, r=dictionary.remove_key(m, F.lit("a")), t=dictionary.json_type(F.lit("[1]")), bad=dictionary.get_json(F.lit("{"), "$.a"), u=dictionary.update_json(F.lit('{"a":1}'), "z", F.lit(5).cast("long")))
    assert got == {"m": {"a": 1, "b": 3}, "r": {"b": 3}, "t": "ARRAY<BIGINT>", "bad": None, "u": '{"a":1,"z":5}'}


def test_arithmetic(spark):
    got = one(spark, a=arith.half_away(F.lit(-2.5)), b=arith.unit_range(F.lit(3), F.lit(3), F.lit(3)), c=arith.zscore(F.lit(1.0), F.lit(1.0), F.lit(0.0)), d=arith.arange(0, 1, 0.5), e=arith.full_range(F.lit(255)), f=arith.full_range(F.lit(256)), g=arith.mask(F.lit(7), F.lit(2), 3), h=arith.ackley([F.lit(0.0), F.lit(0.0)]))
    assert got["h"] == pytest.approx(0, abs=1e-9) and {k: got[k] for k in "abcdefg"} == {"a": -3, "b": 0.0, "c": 0.0, "d": [0.0, 0.5, 1.0], "e": 255, "f": 511, "g": 0}
    primes = spark.range(60).where(arith.is_prime(F.col("id"))).toPandas()["id"].tolist()
    assert primes == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]


def test_distances_of_equal_and_odd_vectors(spark):
    a, b = F.array(*map(F.lit, (1.0, 0.0, 2.0))), F.array(*map(F.lit, (0.0, 1.0, 2.0)))
    got = one(spark, emd=distance.earth_movers(a, b), signed=distance.earth_movers_signed(a, b), same=distance.l2(a, a), odd=distance.l1(a, F.array(F.lit(1.0))), wave=distance.kernel_wave(a, a), corr=distance.correlation_distance(a, F.array(*[F.lit(1.0)] * 3)))
    assert got == {"emd": 1.0, "signed": 1.0, "same": 0.0, "odd": None, "wave": 1.0, "corr": 1.0}


def test_statistics_of_empty_and_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "g string, v double")
    got = {r["g"]: r["std"] for r in statistics.describe(df, "v", ["g"]).collect()}
    assert got == {"a": 0.0, "b": None}
    assert statistics.normalize(df, "v", ["g"]).where("scaled <> 0").count() == 0
    assert statistics.entropy(df, "v", ["g"]).collect()[0]["entropy"] == 0.0
    assert histogram.histogram(df.limit(0), "v", 4, 3).count() == 4
    assert statistics.describe(df.limit(0), "v", ["g"]).count() == 0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1)] * 6 + [(1, 2)] * 2 + [(2, 2)] * 3 + [(2, 1)] + [(None, 1), (2, None)], "t int, p int")
    s = metrics.summary(df, "t", "p").first()
    po, pe = 9 / 12, (7 * 8 + 5 * 4) / 144
    assert s["true_positives"] == pytest.approx(po) and s["kappa"] == pytest.approx((po - pe) / (1 - pe), abs=1e-5) and s["mean_recall"] == pytest.approx((6 / 8 + 3 / 4) / 2)
    assert metrics.metric("kappa", df, "t", "p").first()["value"] == s["kappa"]
    empty = spark.createDataFrame([(0, 0)], "a int, b int")
    assert metrics.overlap(empty, "a", "b").first()["dice"] == 1.0


def test_detection(spark):
    t = spark.createDataFrame([(0, 1, 0, 0, 9, 9), (0, 2, 100, 100, 120, 120), (1, 1, 0, 0, 3, 3)], "image_id long, id int, x0 int, y0 int, x1 int, y1 int")
    f = spark.createDataFrame([(0, 1, 0, 0, 9, 4), (0, 2, 60, 60, 70, 70), (0, 3, 0, 5, 9, 9)], "image_id long, id int, x0 int, y0 int, x1 int, y1 int")
    assert {(r["true_id"], r["found_id"], r["iou"]) for r in detection.match(t, f, "image_id").collect()} == {(1, 1, 0.5), (1, 3, 0.5)}
    got = {(r["threshold"], r["image_id"]): (r["found"], r["missed"], r["wrong"]) for r in detection.evaluate(t, f, "image_id", (0.3, 0.6)).collect()}
    assert got == {(0.3, 0): (1, 1, 1), (0.6, 0): (0, 2, 3), (0.3, 1): (0, 1, 0), (0.6, 1): (0, 1, 0)}
    b = boxes.box()
    assert t.where(boxes.contains(b, F.lit(110), F.lit(110))).count() == 1 and t.where("id = 1 AND image_id = 0").select(boxes.area(b)).first()[0] == 100


def test_average_precision(spark):
    c = spark.createDataFrame([(1, 0, 1.0, 0.5), (1, 1, 0.5, 1.0)], "t int, i int, precision double, recall double")
    assert metrics.average_precision(c, "t").first()["ap"] == pytest.approx(0.5 + 0.5 * 0.75)


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string"), spark.createDataFrame([(2, "q")], "k int, v string")
    assert sets.difference(a, b, ["k"]).count() == 2 and sets.intersection(a, b, ["k"]).count() == 1
    with pytest.raises(ValueError):
        sets.union_all(a, b.select("k"))


def test_matrices(spark):
    rng = np.random.default_rng(0)
    m = [rng.integers(0, 5, (4, 4)).astype(float) for _ in range(3)]
    dfs = [spark.createDataFrame([(i, j, float(x[i, j])) for i in range(4) for j in range(4)], "i long, j long, v double") for x in m]
    got = np.zeros((4, 4))
    for r in matrices.chain(*dfs).collect():
        got[r["i"], r["j"]] = r["v"]
    assert np.allclose(got, m[0] @ m[1] @ m[2])
    p = matrices.transform_point(matrices.rotation("z", 90), [F.lit(1.0), F.lit(0.0), F.lit(0.0)], (0, 0, 5))
    assert [one(spark, **{f"c{i}": c for i, c in enumerate(p)})[f"c{i}"] for i in range(3)] == pytest.approx([0, 1, 5])
    assert one(spark, d=matrices.plane_distance((0, 0, 2), (0, 0, 1), [F.lit(3.0), F.lit(4.0), F.lit(6.0)]))["d"] == 5.0


def pixels(spark, a):
    return spark.createDataFrame([(0, x, y, int(v)) for y, r in enumerate(a) for x, v in enumerate(r)], "image_id long, x int, y int, v int")


def test_surfaces_and_boundaries(spark):
    a, b = np.zeros((9, 9), dtype=int), np.zeros((9, 9), dtype=int)
    a[2:6, 2:6], b[2:6, 3:7] = 1, 1
    r = descriptors.surface_distance(pixels(spark, a), pixels(spark, b)).first()
    edge = lambda m: {(y, x) for y in range(9) for x in range(9) if m[y, x] and not all(0 <= y + dy < 9 and 0 <= x + dx < 9 and m[y + dy, x + dx] for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
    mean = lambda s, t: np.mean([min(math.dist(p, q) for q in t) for p in s])
    assert r["asd"] == pytest.approx(mean(edge(a), edge(b)), abs=1e-6) and r["assd"] == pytest.approx((mean(edge(a), edge(b)) + mean(edge(b), edge(a))) / 2, abs=1e-6)
    same = pixels(spark, a).withColumn("l", F.col("v"))
    assert descriptors.boundary_recall(same, "v", "l").first()["boundary_recall"] == 1.0


def test_skeleton_of_a_bar(spark):
    a = np.zeros((9, 20), dtype=int)
    a[3:6, 2:18] = 1
    s = descriptors.skeleton(pixels(spark, a), "v").where("skeleton = 1")
    assert s.where("y <> 4").count() == 0 and s.count() >= 10
    assert descriptors.topology_points(s.select("image_id", "x", "y")).where("kind = 'end'").count() == 2


def test_diameter(spark):
    rng = np.random.default_rng(1)
    pts = rng.integers(0, 50, (200, 2))
    df = spark.createDataFrame([(0, int(x), int(y)) for x, y in pts], "g int, x int, y int")
    true = max(math.dist(p, q) for p in pts for q in pts)
    assert true * math.cos(math.pi / 64) <= descriptors.furthest_pair(df, "g").first()["diameter"] <= true + 1e-6


def test_furthest_pair_between_directions_is_exact(spark):
    turn = math.pi / 64  # half way between two of 32 directions
    spokes = [(r * s, k * turn) for k, r in ((0, 998.9), (1, 1000.0), (2, 998.9)) for s in (1, -1)]
    df = spark.createDataFrame([(1, r * math.cos(a), r * math.sin(a)) for r, a in spokes], "g int, x double, y double")
    assert abs(descriptors.furthest_pair(df, "g").first()["diameter"] - 2000) < 1e-6


def test_diffusion_keeps_constant_maps(spark):
    p = pixels(spark, np.full((4, 4), 9)).withColumn("s", F.lit(0.25))
    assert descriptors.diffuse(p, "s", "v", 2, Scratch(spark)).where("abs(s - 0.25) > 1e-9").count() == 0


def test_searches(spark):
    f = lambda p: -((p["a"] - 3) ** 2) - (p["b"] + 1) ** 2
    at, v = search.multi_scale({"a": 0.0, "b": 0.0}, [{"a": 1.0, "b": 1.0}, {"a": 0.5, "b": 0.5}], f)
    assert at == {"a": 3.0, "b": -1.0} and v == 0
    assert search.best(search.parameter_grid(spark, {"a": [1, 3], "b": [-1, 0]}), f) == {"a": 3.0, "b": -1.0, "fitness": 0.0}
    assert search.random_parameters(spark, {"a": (0.0, 1.0)}, 5).where("a BETWEEN 0 AND 1").count() == 5


def test_projection_keeps_blobs_apart(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, list(map(float, rng.normal(10 * (i % 2), 0.3, 5)))) for i in range(80)], "id long, v array<double>")
    t = search.tsne(df, "id", "v", perplexity=10).set_index("id")[["x", "y"]].to_numpy()
    a, b = t[::2], t[1::2]
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > 2 * max(a.std(), b.std())


def test_projection_has_every_row(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, list(map(float, rng.normal(10 * (i % 3), 0.3, 4)))) for i in range(4500)], "id long, v array<double>")
    t = search.tsne(df, "id", "v", perplexity=5, rounds=2)
    assert t["id"].tolist() == list(range(4500)) and np.isfinite(t[["x", "y"]].to_numpy()).all()


def test_repulsion_by_grid_equals_all_pairs():
    y = np.random.default_rng(2).normal(0, 15, (700, 2))
    d = y[:, None] - y[None]
    w = 1 / (1 + (d * d).sum(2))
    true = ((w * w)[:, :, None] * d).sum(1)
    for exact, near in ((5000, 1e-9), (0, 3e-2)):
        push, total = search.Repulsion(exact)(y)
        assert abs(total / (w.sum() - 700) - 1) < near
        assert np.linalg.norm(push - true) < near * np.linalg.norm(true)


def test_pooling_and_resizing(spark):
    p = pixels(spark, np.arange(16).reshape(4, 4))
    assert {(r["x"], r["y"]): r["max_pool"] for r in grid.pool(p, "v", 2).collect()} == {(0, 0): 5, (1, 0): 7, (0, 1): 13, (1, 1): 15}
    assert grid.resize(p, "v", 1.0, 1.0).join(p.withColumnRenamed("v", "w"), ["image_id", "x", "y"]).where("v <> w").count() == 0
