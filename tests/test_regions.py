import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborgrid.functions import architecture
from arborgrid.operators import graphs, learning, markers, matrices, regions, volumes
from arborgrid.plans import Scratch
from arborgrid.sources import images


def test_png_of_every_row_rule():
    a = np.random.default_rng(0).integers(0, 256, (6, 5, 3))
    assert (images.decode_png(images.encode_png(a)) == a).all()
    assert (images.decode_png(images.encode_png(a[:, :, :1] * 200)) == a[:, :, :1] * 200).all()
    flat = a.astype(int).reshape(6, 15)
    raw = b""
    for y in range(6):
        rule = y % 5
        left = np.concatenate([[0] * 3, flat[y, :-3]])
        up = flat[y - 1] if y else np.zeros(15, int)
        corner = np.concatenate([[0] * 3, up[:-3]])
        base = left + up - corner
        best = np.select([(abs(base - left) <= abs(base - up)) & (abs(base - left) <= abs(base - corner)), abs(base - up) <= abs(base - corner)], [left, up], corner)
        guess = [0 * left, left, up, (left + up) // 2, best][rule]
        raw += bytes([rule]) + bytes(((flat[y] - guess) % 256).tolist())
    part = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    png = images.PNG + part(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert (images.decode_png(png) == a).all()
    with pytest.raises(ValueError):
        images.decode_png(b"x")
    with pytest.raises(ValueError):
        images.decode_png(images.PNG + part(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 3, 0, 0, 0)))


def test_architecture_edits():
    layers = architecture.add_layer(architecture.add_layer([], architecture.create_layer(noutput_channels=32)), architecture.create_layer(noutput_channels=64))
    assert [l["ninput_channels"] for l in layers] == [3, 32]
    changed = architecture.change_layer(layers, 0, architecture.create_layer(noutput_channels=5))
    assert [l["ninput_channels"] for l in changed] == [3, 5] and layers[0]["noutput_channels"] == 32
    assert len(architecture.remove_layer(layers, 0)) == 1 and architecture.remove_layer([]) == []
    with pytest.raises(ValueError):
        architecture.create_layer(pool_type="median")


def test_small_matrices(spark):
    m = np.array([[2.0, 1.0, 0.0], [1.0, 3.0, 1.0], [0.0, 1.0, 4.0]])
    a = matrices.sparse(spark, m)
    assert np.allclose(matrices.dense(matrices.inverse(a)), np.linalg.inv(m)) and np.isclose(matrices.determinant(a), np.linalg.det(m))
    assert np.allclose(matrices.cofactors(m).T / np.linalg.det(m), np.linalg.inv(m))
    assert np.allclose(matrices.dense(matrices.pseudo_inverse(matrices.sparse(spark, m[:, :2]))), np.linalg.pinv(m[:, :2]))
    assert np.allclose(matrices.generalized_eigenvalues(m, np.eye(3)), np.sort(np.linalg.eigvalsh(m))[::-1])
    for v in ([1.0, 2.0, 3.0], [0.0, 0.0, 2.0], [0.0, 0.0, -1.0]):
        r = matrices.align_with_z(v)
        assert np.allclose(r @ np.array(v), [0, 0, np.linalg.norm(v)]) and np.allclose(r @ r.T, np.eye(3))
    with pytest.raises(ValueError):
        matrices.contract(a, a, ["i"])
    with pytest.raises(ValueError):
        matrices.dense(spark.createDataFrame([(10**6, 10**6, 1.0)], "i long, j long, v double"))


def test_empty_volumes_and_masks(spark):
    v = spark.createDataFrame([], "image_id long, x int, y int, z int, v int")
    assert volumes.resample(v, "v", (2, 2, 2)).count() == volumes.add_frame(v, 1, 0, "v").count() == volumes.gradient(v, "v").count() == 0
    p = spark.createDataFrame([], "image_id long, x int, y int, m int")
    assert regions.fill_holes(p, "m", Scratch(spark)).count() == regions.open_mask(p, "m", 2.0).count() == 0
    one = spark.createDataFrame([(1, 0, 0, None), (1, 1, 0, 1)], "image_id long, x int, y int, m int")
    assert {tuple(r) for r in regions.dilate_mask(one, "m", 1.0).collect()} == {(1, 0, 0, 1), (1, 1, 0, 1)}
    assert {tuple(r) for r in regions.fill_holes(one, "m", Scratch(spark)).collect()} == {(1, 0, 0, 0), (1, 1, 0, 1)}


def test_iterated_forest_and_best_k_find_blobs(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (9, 0), (0, 9))])
    df = spark.createDataFrame([(i, list(map(float, v)), i // 40) for i, v in enumerate(x)], "id long, vec array<double>, label int")
    scratch = Scratch(spark)
    g = scratch.put(learning.connected_knn_graph(df, "id", "vec", 4, scratch))
    assert graphs.connected_components(g, scratch).select("root").distinct().count() == 1
    for cost in (graphs.fsum, graphs.fmax):
        got = learning.iterated_path_forest(df, "id", "vec", g, 3, scratch, cost).join(df, "id").groupBy("cluster").agg(F.countDistinct("label").alias("n"), F.count(F.lit(1)).alias("m")).collect()
        assert [(r["n"], r["m"]) for r in got] == [(1, 40)] * 3
    k, found = learning.best_k(df, "id", "vec", (4, 12), scratch, cut=lambda edges, labels: -edges.count())
    assert k == 12 and found.count() == 120


def test_disc_decoder_prefers_object_bands(spark):
    rows = [(0, x, y, [1.0 if x < 4 else 0.0, 0.0 if x < 4 else 1.0]) for x in range(8) for y in range(4)]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, bands array<double>")
    for by in (False, True):
        got = markers.disc_decoder(px, (1, 0), by).toPandas()
        inner = got[got.y.between(1, 2)]  # outside counts as 0, which weighs at corners
        assert (inner[inner.x.between(1, 2)].saliency == 255).all() and (got[got.x > 4].saliency == 0).all()
