import json
import zipfile

import numpy as np
import pytest

from arborgrid.operators import markers
from arborgrid.sources import images, tabular


@pytest.mark.parametrize("rows,want", [([["name", "n"], ["x", "3"]], True), ([["a", "b"], ["c", "d"]], False), ([["a", "b"]], False), ([["a", "1"], ["b", "2"]], False), ([["a"], ["-3"]], False), ([["a"], ["1e5"]], False), ([], False)])
def test_header_guess(rows, want):
    assert tabular.has_header(rows) is want


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;n\nx;1\n;2\n")
    df = tabular.read_csv(spark, str(tmp_path / "a.csv"), ";")
    assert df.columns == ["name", "n"] and {tuple(r) for r in df.collect()} == {("x", "1"), ("", "2")}
    (tmp_path / "b.csv").write_text("1,2\n3,4\n")
    assert {tuple(r) for r in tabular.read_csv(spark, str(tmp_path / "b.csv")).collect()} == {("1", "2"), ("3", "4")}
    (tmp_path / "c.csv").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="not 2 cells"):
        tabular.read_csv(spark, str(tmp_path / "c.csv")).collect()
    (tmp_path / "d.csv").write_text('name,n\n"x",1\nname,n\n y ,\n')
    assert sorted(tuple(r) for r in tabular.read_csv(spark, str(tmp_path / "d.csv")).collect()) == [(" y ", ""), ('"x"', "1"), ("name", "n")]
    with pytest.raises(ValueError):
        tabular.write_csv(df, str(tmp_path / "o"), "|")
    tabular.write_csv(df, str(tmp_path / "o"), ";")
    assert spark.read.csv(str(tmp_path / "o"), sep=";", header=True).count() == 2


def test_numpy_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("b", [1], [7.5])], "name string, shape array<int>, data array<double>")
    assert tabular.write_numpy(df, str(tmp_path)).count() == 2
    got = {r["path"].rsplit("/")[-1]: (r["dtype"], list(r["shape"]), list(r["data"])) for r in tabular.read_numpy(spark, str(tmp_path)).collect()}
    assert got == {"a.npy": ("<f4", [2, 3], [1, 2, 3, 4, 5, 6]), "b.npy": ("<f4", [1], [7.5])}
    np.save(tmp_path / "f.npy", np.asfortranarray(np.arange(6).reshape(2, 3)))
    assert [list(r["data"]) for r in tabular.read_numpy(spark, str(tmp_path / "f.npy")).collect()] == [[0, 1, 2, 3, 4, 5]]


def test_seeds_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(3, 4, 1, 0), (5, 6, 2, 1)], "x int, y int, marker int, label int")
    tabular.write_seeds(s, str(tmp_path / "s"), 50, 40)
    got = tabular.read_seeds(spark, str(tmp_path / "s"))
    assert {tuple(r)[1:] for r in got.collect()} == {(50, 40, 3, 4, 1, 0), (50, 40, 5, 6, 2, 1)}


def test_boxes_json_files_and_zip(spark, tmp_path):
    (tmp_path / "b.xml").write_text("<annotation><object><name>cell</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>10</xmax><ymax>20</ymax></bndbox></object></annotation>")
    assert [tuple(r)[1:] for r in tabular.read_boxes(spark, str(tmp_path / "b.xml")).collect()] == [("cell", 0, 1, 10, 20)]
    (tmp_path / "d.json").write_text(json.dumps({"k": [1, 2]}))
    assert tabular.read_json_dict(spark, str(tmp_path / "d.json")).selectExpr("try_variant_get(value, '$.k[1]', 'int')").first()[0] == 2
    assert tabular.list_files(spark, str(tmp_path), suffix=".xml").count() == 1
    assert tabular.list_files(spark, str(tmp_path), pattern=r"d\.js").count() == 1
    assert tabular.read_lines(spark, str(tmp_path / "b.xml"), "cell").count() == 1
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m/a.txt", "hello")
    assert [tuple(r)[1:] for r in tabular.read_zip(spark, str(tmp_path / "z.zip")).collect()] == [("m/a.txt", bytearray(b"hello"))]


def test_architecture(spark, tmp_path):
    def layer(k, d, m, n, kind):
        return {"conv": {"kernel_size": [*k, 0], "dilation_rate": [d, d, d], "nkernels_per_marker": m, "noutput_channels": n}, "pooling": {"size": [3, 3, 0], "stride": 1, "type": kind}}

    arch = {"nlayers": 2, "stdev_factor": 0.01, "layer1": layer([3, 3], 1, 1, 32, "max_pool"), "layer2": layer([5, 5], 3, 5, 64, "avg_pool")}
    (tmp_path / "arch.json").write_text(json.dumps(arch))
    got = [r.asDict() for r in tabular.read_architecture(spark, str(tmp_path / "arch.json")).orderBy("layer").collect()]
    assert [(r["ninput_channels"], r["noutput_channels"], r["kernel_size"], r["dilation"], r["pool_type"], r["pool_size"]) for r in got] == [(3, 32, [3, 3], 1, "max_pool", [3, 3]), (32, 64, [5, 5], 3, "avg_pool", [3, 3])]


def test_pixmaps(spark, tmp_path):
    a = np.arange(24).reshape(2, 4, 3)
    (tmp_path / "c.ppm").write_bytes(images.encode_pnm(a))
    (tmp_path / "t.pgm").write_text("P2\n# note\n3 1\n255\n1 2 3\n")
    (tmp_path / "w.pgm").write_bytes(images.encode_pnm(np.full((2, 2, 1), 700)))
    assert (images.decode_pnm((tmp_path / "c.ppm").read_bytes()) == a).all()
    assert images.decode_pnm((tmp_path / "t.pgm").read_bytes()).ravel().tolist() == [1, 2, 3]
    assert images.decode_pnm((tmp_path / "w.pgm").read_bytes()).max() == 700
    px = images.to_pixels(images.read_images(spark, str(tmp_path / "c.ppm"))).toPandas()
    assert all(a[r.y, r.x, r.band] == r.v for r in px.itertuples()) and len(px) == 24
    with pytest.raises(ValueError):
        images.decode_pnm(b"")
    p = spark.createDataFrame([(3, 0, 0, 5), (3, 1, 0, 9)], "image_id long, x int, y int, v int")
    assert images.write_images(p, str(tmp_path / "out")).collect()[0]["image_id"] == 3
    assert images.decode_pnm((tmp_path / "out" / "3.pgm").read_bytes()).ravel().tolist() == [5, 9]


def test_kernels_have_unit_length_and_layers_run(spark):
    rng = np.random.default_rng(0)
    px = spark.createDataFrame([(i, x, y, [float(v) for v in rng.integers(0, 255, 2)]) for i in (0, 1) for y in range(8) for x in range(8)], "image_id long, x int, y int, bands array<double>")
    mk = spark.createDataFrame([(0, 1, 1, 1, 1), (0, 2, 2, 1, 1), (0, 5, 5, 2, 0), (0, 6, 6, 2, 0)], "image_id long, x int, y int, marker int, label int")
    layers = markers.fit(px, mk, [markers.Layer(kernels_per_marker=1, out_channels=2)])
    assert layers[0].kernels.shape == (2, 18) and np.allclose(np.linalg.norm(layers[0].kernels, axis=1), 1)
    out = markers.forward(px, layers)
    assert out.count() == 128 and len(out.first()["bands"]) == 2
    assert markers.vanilla_decoder(out).where("saliency < 0 OR saliency > 255").count() == 0
    assert markers.fit(px, mk.limit(0), [markers.Layer()]) == []
    # beyond the bound all centroids are clustered on the cluster
    far = markers.fit(px, mk, [markers.Layer(kernels_per_marker=2, out_channels=4)], max_patches=1)
    near = markers.fit(px, mk, [markers.Layer(kernels_per_marker=2, out_channels=4)])
    assert np.allclose(sorted(far[0].kernels.tolist()), sorted(near[0].kernels.tolist()))
