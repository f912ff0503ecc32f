"""Operators whose work grows with their input alone, against plain ones on small cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import matching as M


def test_sums_of_dot_products_need_no_pairs(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3)], int(rng.integers(3))) for i in range(30)]
    rows += [(30, [1.0, None, 2.0], 0), (31, None, 1), (32, [inf, 0.0, 1.0], 2), (33, [1.0, -inf, 0.5], None), (34, [nan, 1.0, 1.0], 4), (35, [None, None, None], 5), (33, [2.0, 1.0], 6)]
    df = spark.createDataFrame(rows, "id long, data array<double>, label int")

    def dot(a, b):
        both = [x * y for x, y in zip(a or [], b or [], strict=False) if x is not None and y is not None]
        return sum(both) if both else None

    want = {}
    for k, v, _ in rows:
        for _, w, label in rows:
            want.setdefault((label, k, str(v)), []).append(dot(w, v))
    sums = M.dot_sums(df).select(F.col("label").alias("group"), "n", "sums")
    joined = df.join(F.broadcast(sums)).select("group", "id", "data", M.dot_with("sums", "data").alias("v"))
    got = {(r["group"], r["id"], str(r["data"])): r["v"] for r in joined.collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        known = [x for x in values if x is not None]
        assert got[k] is None if not known else (math.isnan(got[k]) if math.isnan(sum(known)) else got[k] == sum(known) or math.isclose(got[k], sum(known), abs_tol=1e-9)), k
    assert {r["group"]: r["n"] for r in sums.collect()} == {g: sum(1 for x in rows if x[2] == g) for g in {x[2] for x in rows}}


def test_resampling_shuffles_sums_alone(spark):
    from gridloom.operators import pixels as P

    rng = np.random.default_rng(23)
    images = {i: rng.normal(size=(4, 5)) for i in (1, 2)}
    rows = [(i, r, c, float(a[r, c])) for i, a in images.items() for r in range(4) for c in range(5)] + [(None, 0, 0, 1.0)]
    out = P.resampled(spark.createDataFrame(rows, "image_id long, r int, c int, v double"), 4, 5, 7, 6)
    assert "image_id" not in [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x][0]
    got = {(x["image_id"], x["r"], x["c"]): x["v"] for x in out.collect()}
    assert len(got) == 2 * 7 * 6
    for (i, r, c), v in got.items():
        y, x = r * 4 / 7, c * 5 / 6
        a, b = math.floor(y), math.floor(x)
        at = lambda p, q, i=i: images[i][min(p, 3), min(q, 4)]
        want = sum(at(a + m, b + n) * (1 - abs(y - a - m)) * (1 - abs(x - b - n)) for m in (0, 1) for n in (0, 1))
        assert math.isclose(v, want, abs_tol=1e-12)


def test_hue_query_goes_there_and_back(spark):
    """The query converts to hue, chroma and value first; the conversion back alone has a query of its own."""
    from gridloom import catalog
    from gridloom.sources import tables as T

    sf = "/root/testdata/sf0.001"
    assert "P9_hsv_rgb_direct" in catalog.queries()
    want = T.rgb(spark, sf).select("image_id", "r", "c", *[F.round(F.col(x) / 255.0, 5).alias(x) for x in ("red", "green", "blue")])
    assert catalog.queries()["P9_hsv_rgb"](spark, sf).exceptAll(want).count() == 0


def test_packed_integral_is_brute_sum(spark):
    from gridloom.operators import stencil as S

    a = np.arange(12.0).reshape(3, 4)
    df = spark.createDataFrame([(1, a.ravel().tolist(), 3, 4), (2, [None, 2.0], 1, 2)], "image_id long, data array<double>, rows int, columns int")
    got = {r["image_id"]: r["integral"] for r in S.integral_packed(df).collect()}
    assert got[1] == [a[:r, :c].sum() for r in range(4) for c in range(5)]
    assert got[2] == [0, 0, 0, 0, 0, 2]


def test_haar_values_shuffle_images_alone(spark):
    """Values are not added up over a shuffle: what is above the packing of images is one broadcast of the dictionary."""
    from gridloom import catalog

    plan = catalog.queries()["W24_haar_values_whole"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


def test_archives_give_back_their_files(spark, tmp_path, monkeypatch):
    import os

    from gridloom.sources import formats

    contents = {f"image-{i}": bytes([i % 256, 10, 13, 0, 255]) * (i % 7) for i in range(500)}
    contents["long" * 40] = b"\n"
    formats.save_archives(spark.createDataFrame(list(contents.items()), "path string, content binary").repartition(2), str(tmp_path / "a"))
    got = {r["path"]: bytes(r["content"]) for r in formats.scan_archives(spark, str(tmp_path / "a")).collect()}
    assert got == contents
    assert sum(n.endswith(".txt") for _, _, names in os.walk(tmp_path / "a") for n in names) == 2
    formats.save_archives(spark.createDataFrame([], "path string, content binary"), str(tmp_path / "none"))


def test_bitmaps_read_as_written():
    from gridloom.sources import formats

    a = np.random.default_rng(3).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    assert (formats.parse_bmp(formats.write_bmp(a)) == a[:, :, ::-1]).all()
    assert formats.parse_bmp(b"P5 1 1 255 x") is None


def test_kd_leaves_stay_few_beside_the_points(spark):
    """Queries times chunks is what a search queues, so chunks must not be as small as leaves; blocks of queries give the same."""
    from gridloom.operators import spatial

    rng = np.random.default_rng(11)
    a = rng.normal(size=(3000, 4)).round(1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], "id long, data array<double>")
    tree = spatial.kd_tree(df, 10, 2, 4096)
    assert tree.leaves.count() == 4
    asked = df.filter("id % 100 = 0")
    got = {(r["query"], r["place"]): r["id"] for r in spatial.kd_search(tree, asked, 5, block=7).collect()}
    for i in range(0, 3000, 100):
        d = ((a - a[i]) ** 2).sum(axis=1)
        assert [got[i, p + 1] for p in range(5)] == np.lexsort((np.arange(3000), d))[:5].tolist()


def test_image_points_and_descriptors_join_no_cells(spark):
    from gridloom import catalog
    from gridloom.operators import stencil as S
    from gridloom.plans import tree_queries as Q

    sf = "/root/testdata/sf0.001"
    assert "Join" not in Q.image_points(spark, sf, [F.lit(1.0)])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in catalog.queries()["W26_contour_descriptor"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[0]
    cells = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 3, 3)], "image_id long, r int, c int")
    plans = []
    S.connected(cells, 5, save=lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.localCheckpoint())
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_edges_sort_no_cells(spark):
    """Thinning and hysteresis take an image as one row: above its packing are no windows and joins, nor tests that repeat its arrays for each cell."""
    from gridloom import catalog
    from gridloom.operators import stencil as S

    for name in ("W11_canny_hysteresis", "W11_canny_thinning"):
        above = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
        assert not any(x in above for x in ("Window", "Join", "Filter (size", "Relation")), name
    a = np.random.default_rng(5).normal(size=(5, 7)).round(1)
    packed = spark.createDataFrame([(1, a.ravel().tolist(), 5, 7)], "image_id long, data array<double>, rows int, columns int")
    tall = spark.createDataFrame([(1, r, c, float(a[r, c])) for r in range(5) for c in range(7)], "image_id long, r int, c int, v double")
    want = {(x["r"], x["c"]): (x["gx"], x["gy"], x["magnitude"]) for x in S.gradient(tall).collect()}
    assert [tuple(x) for x in S.gradient_packed(packed).first()["g"]] == [want[r, c] for r in range(5) for c in range(7)]
    sides = [(1, 4, [0, 1, 5, 11, 8, 12], [0]), (2, 3, [2, 3], [2]), (None, 3, [1], [1]), (3, 3, [1], [])]
    cells = S.linked(spark.createDataFrame(sides, "image_id long, columns int, weak array<int>, strong array<int>")).collect()
    assert sorted(tuple(x) for x in cells if x[0]) == [(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 2, 0), (1, 3, 0), (2, 0, 2)]


def test_overlapping_boxes_meet_in_blocks(spark):
    """Pairs come from blocks held against each other, not from a join of boxes by cells, and none is lost or told twice."""
    from gridloom import catalog

    plan = catalog.queries()["J14_box_iou"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "gx" not in plan
    rng = np.random.default_rng(14)
    rows = [(int(i), *corner, *(corner + size)) for i, corner, size in zip(rng.permutation(300), rng.normal(size=(300, 2)).round(1), rng.integers(0, 20, (300, 2)) / 10, strict=True)]
    rows = [tuple(float(x) if k else x for k, x in enumerate(r)) for r in rows] + [(None, 0.0, 0.0, 1.0, 1.0), (400, None, 0.0, 1.0, 1.0), (rows[0][0], 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    want = []
    for a in rows:
        for b in rows:
            if None in a + b or a[0] >= b[0]:
                continue
            i = max(min(a[3], b[3]) - max(a[1], b[1]), 0) * max(min(a[4], b[4]) - max(a[2], b[2]), 0)
            if i > 0 and (iou := i / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - i)) > 0.5:
                want.append((a[0], b[0], round(iou, 9)))
    assert len(want) > 100
    for most in (7, 64, 8192):
        assert sorted((r["id"], r["other"], round(r["iou"], 9)) for r in M.overlapping(df, most).collect()) == sorted(want), most
    assert M.overlapping(df.limit(0)).count() == 0
