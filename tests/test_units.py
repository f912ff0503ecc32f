"""Small cases and invariants of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import color
from gridloom.operators import evaluation as E
from gridloom.operators import learners as L
from gridloom.operators import matching as M
from gridloom.operators import stencil as S
from gridloom.sources import formats


def grid(spark, a, image_id=1):
    return spark.createDataFrame([(image_id, r, c, float(v)) for r, row in enumerate(a) for c, v in enumerate(row)], "image_id long, r int, c int, v double")


def back(df, value="v"):
    rows = df.collect()
    out = np.full((max(r["r"] for r in rows) + 1, max(r["c"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["r"], r["c"]] = r[value]
    return out


def test_integral_is_brute_sum(spark):
    a = np.arange(16).reshape(4, 4)
    got = back(S.integral(grid(spark, a)))
    assert all(got[r, c] == a[:r, :c].sum() for r in range(5) for c in range(5))


def test_spike_convolution_gives_kernel(spark):
    a = np.zeros((5, 5))
    a[2, 2] = 1
    got = back(S.separable(grid(spark, a), [0.25, 0.5, 0.25]))
    assert np.allclose(got[1:4, 1:4], np.outer([0.25, 0.5, 0.25], [0.25, 0.5, 0.25]))


def test_constant_gradient_is_zero(spark):
    g = S.gradient(grid(spark, np.ones((4, 4))))
    assert g.filter("magnitude != 0").count() == 0


def test_components_join_by_diagonals_and_u_shapes(spark):
    a = np.array([[1, 0, 1, 0, 0], [1, 0, 1, 0, 0], [1, 1, 1, 0, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, 1]])
    cells = grid(spark, a).filter("v = 1").select("image_id", "r", "c")
    labels = {(r["r"], r["c"]): r["label"] for r in S.connected(cells, 5).collect()}
    assert set(labels.values()) == {0, 19}
    assert labels[0, 2] == labels[2, 1] == 0


def test_components_of_nothing(spark):
    assert S.connected(grid(spark, np.ones((2, 2))).filter("v = 0").select("image_id", "r", "c"), 2).count() == 0


def test_distance_transform_is_brute_force(spark):
    a = np.random.default_rng(1).random((7, 6)) < 0.15
    a[3, 3] = True
    df = grid(spark, a).selectExpr("image_id", "r", "c", "v = 1 as v")
    got = back(S.distance_transform(df, None, 7, 6), "d")
    on = np.argwhere(a)
    for r in range(7):
        for c in range(6):
            assert got[r, c] == ((on - [r, c]) ** 2).sum(axis=1).min()

def test_distance_transform_of_long_columns(spark):
    rng = np.random.default_rng(9)
    v = rng.random((2, 45, 37)) < np.array([0.01, 0.2])[:, None, None]
    df = spark.createDataFrame([(i, int(r), int(c), bool(v[i, r, c])) for i in range(2) for r in range(45) for c in range(37)], "image_id long, r int, c int, v boolean")
    got = {(x.image_id, x.r, x.c): (x.d, x.nr, x.nc) for x in S.distance_transform(df, None, 45, 37).collect()}
    for i in range(2):
        true = np.argwhere(v[i]).tolist()
        for r in range(45):
            for c in range(37):
                assert got[i, r, c] == min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in true)


def test_union_commutes_and_self_similarity_is_one(spark):
    h = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 2, 1.0), (1, 1, 5, 3.0)], "hist_id long, tree int, idx long, value double")
    g = spark.createDataFrame([(1, 0, 2, 4.0), (1, 2, 1, 1.0)], "hist_id long, tree int, idx long, value double")
    rows = lambda d: sorted(map(tuple, d.select("tree", "idx", "value").collect()))
    assert rows(M.union(h, g, ["hist_id"])) == rows(M.union(g, h, ["hist_id"]))
    assert M.pyramid_match(h, h, ["hist_id"]).first()["score"] == pytest.approx(1)


def test_earth_movers():
    assert M.earth_movers([1, 2], [1, 1], [1, 2], [1, 1]) == 0
    assert M.earth_movers([0], [1], [3], [1]) == 3
    assert M.earth_movers([0, 1], [1, 1], [1, 5], [1, 1]) == M.earth_movers([1, 5], [1, 1], [0, 1], [1, 1]) == pytest.approx(2.5)
    assert M.earth_movers([0], [2], [1], [1]) == pytest.approx(1)


def test_perfect_and_inverted_rankings(spark):
    good = spark.createDataFrame([(i, float(10 - i), i < 4) for i in range(8)], "id long, rank double, positive boolean")
    assert E.auc(E.changes(good)).first()["auc"] == pytest.approx(1)
    assert E.average_precision(E.changes(good)).first()["ap"] == pytest.approx(1)
    bad = good.selectExpr("id", "-rank as rank", "positive")
    # only points where true positives increase are kept, so the first step is half of one positive's share
    assert E.auc(E.changes(bad)).first()["auc"] == pytest.approx(1 / 8)


def test_nearest_finds_itself_first_and_all_when_k_is_large(spark):
    p = spark.createDataFrame([(i, [float(i), 0.0]) for i in [1, 2, 2, 5]], "id long, data array<double>")
    got = M.nearest(p, p.filter("id = 5"), 10).orderBy("place").collect()
    assert [r["id"] for r in got] == [5, 2, 2, 1]


def test_kmeans_separates_and_keeps_empty_clusters(spark):
    p = spark.createDataFrame([(i, [float(i % 2) * 10 + i * 0.01]) for i in range(10)], "id long, data array<double>")
    c = sorted(x[0] for x in L.kmeans(p, 2))
    assert c[0] < 1 and c[1] > 9
    assert L.kmeans(p, 2, start=[[0.0], [1e9]])[1] == [1e9]


def test_tree_learns_a_threshold(spark):
    p = spark.createDataFrame([(i, [float(i)], int(i >= 6)) for i in range(12)], "id long, data array<double>, label int")
    m = L.tree(p, [0], bins=12)
    got = L.hard(L.soft(p, [m]))
    assert got.filter("label != predicted").count() == 0


def test_ransac_ignores_outliers(spark):
    rows = [(i, float(i % 5), float(i // 5), 2.0 * (i % 5) + 1 + (50 if i % 6 == 0 else 0), float(i // 5) - 1) for i in range(30)]
    c = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    m = L.ransac(c, 30, 3, 0.01).first()
    assert (round(m["a"], 6), round(m["b"], 6), round(m["t"], 6)) == (2, 0, 1) and m["consensus"] == 25


def test_homography_of_an_exact_map(spark):
    h = np.array([[1.0, 0.2, 3], [0.1, 1.5, -1], [0.01, 0.02, 1]])
    xy = [(x, y) for x in range(4) for y in range(4)]
    to = [h @ [x, y, 1] for x, y in xy]
    c = spark.createDataFrame([(1, float(x), float(y), float(t[0] / t[2]), float(t[1] / t[2])) for (x, y), t in zip(xy, to, strict=True)], "g int, x0 double, y0 double, x1 double, y1 double")
    got = [r["h"] for r in L.homographies(c, ["g"]).orderBy("i").collect()]
    assert np.allclose(np.reshape(got, (3, 3)), h, atol=1e-6)


def test_formats_round_trip(tmp_path, spark):
    a = np.arange(12).reshape(3, 4) / 255
    assert np.allclose(formats.parse_pgm(formats.write_pgm(a)), a)
    assert formats.parse_pgm(b"P5\n2 2\n127\nabcd") is None
    assert formats.parse_ppm(b"P6\n# note\n1 1\n65535\n\xff\xff\x00\x00\x80\x80").tolist() == [[[255, 0, 128]]]
    m = np.array([[1.5, 2], [3, 4], [5, 6]])
    for compressed in (False, True):
        for order in "<>":
            assert formats.parse_mat5(formats.write_mat5({"m": m}, compressed, order))["m"].tolist() == m.tolist()
    (tmp_path / "x.pgm").write_bytes(formats.write_pgm(a))
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.pgm"))
    assert formats.parsed(files, formats.parse_pgm).count() == 12


def test_nested_matrices_and_small_formats():
    value = {"title": "Zürich", "cells": [np.arange(6.0).reshape(2, 3), "x", [np.eye(2)], {"deep": "y"}], "yes": np.array([[True, False]]), "z": np.array([[1 + 2j, 3]]), "n": np.array([[1], [-2]], "i2"), "f": np.float32([[0.5]]), "none": np.zeros((0, 0))}
    for compressed in (False, True):
        for order in "<>":
            back = formats.parse_mat5(formats.write_mat5({"s": value, "m": np.eye(3)}, compressed, order) + b"\n")
            assert back["m"].tolist() == np.eye(3).tolist()
            (s,) = back["s"]
            assert s["title"] == ["Zürich"] and s["cells"][0].tolist() == [[0, 1, 2], [3, 4, 5]] and s["cells"][1] == ["x"] and s["cells"][2][0].tolist() == [[1, 0], [0, 1]] and s["cells"][3][0]["deep"] == ["y"]
            assert s["yes"].tolist() == [[1, 0]] and s["z"].tolist() == [[1 + 2j, 3]] and s["n"].tolist() == [[1], [-2]] and s["f"].tolist() == [[0.5]] and s["none"].size == 0
    nodes = [(3, 70000, -1, 0.25), (255, 1, 2, -4.0)]
    data = formats.write_histogram("a", nodes) + formats.write_histogram("n" * 300, [])
    assert formats.parse_histograms(data + b"\n") == [("a", nodes), ("n" * 300, [])]
    labels = [(0, "sky", 1, 2, 255), (300, "é" * 100, 0, 10, 13)]
    assert formats.parse_labels(formats.write_labels(labels)) == labels
    assert formats.parse_match(formats.write_match(5, 7, True)) == (5, 7, True)


def test_files_keep_every_byte(spark, tmp_path):
    contents = {"all": bytes(range(256)) * 3, "lines": b"\n\r\n\x00\n", "one": b"\xff", "empty": b""}
    formats.save_files(spark.createDataFrame(list(contents.items()), "name string, content binary").repartition(2), str(tmp_path / "f"))
    assert {r["path"]: bytes(r["content"]) for r in formats.scan_files(spark, str(tmp_path / "f")).collect()} == contents


def test_bitmaps_of_any_width(spark, tmp_path):
    for columns in (1, 2, 3, 4):
        a = np.random.default_rng(columns).integers(0, 256, (3, columns, 3)).astype(np.uint8)
        (tmp_path / f"{columns}.bmp").write_bytes(formats.write_bmp(a))
        row = spark.read.format("image").load(str(tmp_path / f"{columns}.bmp")).select("image.*").first()
        assert (row["height"], row["width"], row["nChannels"]) == (3, columns, 3)
        assert np.frombuffer(bytes(row["data"]), np.uint8).reshape(3, columns, 3)[..., ::-1].tolist() == a.tolist()


def test_stream_gives_the_batch_windows(spark, tmp_path):
    from gridloom.streaming.windows import replay, tumbling

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "events"))
    live = replay(spark, e, str(tmp_path / "events"), "live_windows")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, tumbling(e).collect()))


def test_gaussian_kernel_sums_to_one():
    assert math.isclose(sum(S.gaussian_kernel(1.3)), 1)


def test_nearest_takes_more_queries_than_a_block_holds(spark):
    p = spark.createDataFrame([(i, [float(i * i % 37), float(i % 5)]) for i in range(60)], "id long, data array<double>")
    whole = sorted(tuple(r) for r in M.nearest(p, p, 4).collect())
    assert len(whole) == 240 and sorted(tuple(r) for r in M.nearest(p, p, 4, most=7).collect()) == whole


def test_breadth_first_tree_lowers_its_threshold_and_sees_all_features(spark):
    p = spark.createDataFrame([(i, [0.0] * 63 + [float(i % 10)], int(i % 10 >= 5) if i >= 10 else i % 2) for i in range(100)], "id long, data array<double>, label int")
    found = L.breadth_first_tree(p, list(range(64)), threshold=0.9, depth=2, minimum=0)
    assert found[1]["feature"] == 63
    # at 0.9 alone nothing grows
    assert L.breadth_first_tree(p, list(range(64)), threshold=0.9, depth=2, minimum=0, tries=1)[1]["feature"] is None
    assert L.breadth_first_tree(p, list(range(64)), threshold=0.9, depth=2, minimum=1, tries=1)[1]["feature"] == 63


def test_scale_space_levels_are_cumulative(spark):
    """Against one image blurred in numpy: each level from the one before it, octaves from the first level."""
    rng = np.random.default_rng(20)
    image = rng.random((8, 8))

    def blurred(x, sigma, step=1):
        n = math.ceil(3 * sigma)
        k = np.exp(-(np.arange(-n, n + 1) ** 2) / (2 * sigma**2))
        at = (np.arange(0, len(x), step)[:, None] + np.arange(-n, n + 1)).clip(0, len(x) - 1)
        one = lambda y: np.einsum("ikc,k->ic", y[at], k / k.sum())
        return one(one(x).T).T

    cells = spark.createDataFrame([(1, r, c, float(image[r, c])) for r in range(8) for c in range(8)], "image_id long, r int, c int, v double")
    got = {(x["octave"], x["level"], x["r"], x["c"]): x["v"] for x in S.scale_space(cells, 8, 3, 4).collect()}
    base, m, want = blurred(image, 1.6), math.sqrt(2 ** (2 / 3) - 1), {}
    for octave in range(2):
        at = base
        for level in range(3):
            at = at if level == 0 else blurred(at, 1.6 * m**level)
            want |= {(octave, level, r, c): at[r, c] for r in range(len(at)) for c in range(len(at))}
        base = blurred(base, 3.2, 2)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_lab_of_dark_and_yellow(spark):
    r = spark.range(1).select(*color.rgb_to_lab(F.lit(0.02), F.lit(0.0), F.lit(0.0)), *color.rgb_to_lab(F.lit(1.0), F.lit(1.0), F.lit(0.0))).first()
    assert r[0] == 20.0 and 0 < r[1] < 1 and r[5] == 70.0 and 97 < r[3] < 97.3
