"""Spatial and density trees against plain versions of them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import catalog
from gridloom.operators import density, spatial

POINTS = "id long, data array<double>, label int"


def points_of(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], POINTS).repartition(4)


def clusters(seed, n=60, centres=((0.0, 0.0, 0.0), (6.0, 0.0, 3.0), (6.0, 7.0, -3.0))):
    rng = random.Random(seed)
    return [(i, [rng.gauss(c, 0.4) for c in centres[i % len(centres)]]) for i in range(n)]


# --- kd-trees -----------------------------------------------------------------------------------


def nearest(rows, q, k):
    return [(i, d) for d, i in sorted((sum((a - b) ** 2 for a, b in zip(q, v, strict=True)), i) for i, v in rows)[:k]]


@pytest.mark.parametrize("leaf", [4, 1000])
def test_kd_search_is_exact(spark, leaf):
    rows = clusters(1, 200)
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a leaf that can't be split, and ties
    tree = spatial.kd_tree(points_of(spark, [*rows, (None, [0.0] * 3), (2000, None)]), leaf, 6)
    asked = [(i, v) for i, v in rows if i % 10 == 0] + [(5000, [100.0, -100.0, 0.0])]
    got = {}
    for r in spatial.kd_search(tree, points_of(spark, [*asked, asked[0], (None, [1.0] * 3)]), 5).collect():
        got.setdefault(r["query"], []).append((r["place"], r["id"], r["d"]))
    assert set(got) == {i for i, _ in asked}
    for i, q in asked:
        want = nearest(rows, q, 5)
        assert [x[1] for x in sorted(got[i])] == [x[0] for x in want]
        assert np.allclose([x[2] for x in sorted(got[i])], [x[1] for x in want])
    if leaf == 4:
        assert len(tree.splits) > 8 and tree.leaves.filter("chunk > 0").count() > 0


def test_kd_splits_are_at_the_mean_of_the_widest_dimension(spark):
    rows = clusters(2, 90)

    def plain(at, own):
        x = np.array([v for _, v in own])
        if len(own) <= 10 or at >= 2**5 or not x.var(axis=0).max():
            return {}
        f = int(x.var(axis=0).argmax())
        left, right = [r for r in own if r[1][f] < x[:, f].mean()], [r for r in own if r[1][f] >= x[:, f].mean()]
        return {at: (f, x[:, f].mean())} | plain(2 * at, left) | plain(2 * at + 1, right)

    got, want = spatial.kd_splits(points_of(spark, rows), 10, 5), plain(1, rows)
    assert {k: f for k, (f, _) in got.items()} == {k: f for k, (f, _) in want.items()}
    assert all(math.isclose(got[k][1], want[k][1], abs_tol=1e-9) for k in want)


def test_kd_budget(spark):
    rows = clusters(3, 300)
    tree = spatial.kd_tree(points_of(spark, rows), 8, 7)
    asked = points_of(spark, [r for r in rows if r[0] % 6 == 0])
    right = {(i, j) for i, q in rows if i % 6 == 0 for j, _ in nearest(rows, q, 3)}
    recall = [len(right & {(r["query"], r["id"]) for r in spatial.kd_search(tree, asked, 3, b).collect()}) / len(right) for b in (-1, 10, 40, 0)]
    assert recall == sorted(recall) and recall[0] < recall[-1] == 1.0 and recall[2] > 0.8


def test_kd_recall_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    exact = {(r["query"], r["id"]) for r in catalog.queries()["M3_kdtree_search"](spark, sf).collect()}
    some = {(r["query"], r["id"]) for r in catalog.queries()["M3_kdtree_budget"](spark, sf).collect()}
    assert len(exact & some) / len(exact) > 0.8


def test_kd_tree_of_nothing(spark):
    tree = spatial.kd_tree(points_of(spark, []), 4, 3)
    assert spatial.kd_search(tree, points_of(spark, [(1, [0.0] * 3)]), 3).count() == 0
    tree = spatial.kd_tree(points_of(spark, [(1, [0.0] * 3), (2, [1.0] * 3)]), 1, 3)
    assert [r["id"] for r in spatial.kd_search(tree, points_of(spark, [(9, [0.2] * 3)]), 5).orderBy("place").collect()] == [1, 2]


# --- density trees ------------------------------------------------------------------------------


def plain_cut(values, lo, hi, y_all, n_all):
    best = None
    h = lambda a, b: sum(-x * math.log2(x / (a + b)) for x in (a, b))
    for x in sorted(set(values)):
        for inclusive in (False, True):
            y = sum(v < x or (inclusive and v == x) for v in values)
            n = math.floor((x - lo) * n_all / (hi - lo))
            if min(y, n, y_all - y, n_all - n) <= 0:
                continue
            gain = round(-(h(y, n) + h(y_all - y, n_all - n)) / (y_all + n_all), 12)
            if best is None or gain > best[0]:
                best = (gain, x, inclusive)
    return best and best[1:]


def plain_region(values, lo, hi, in_lo, in_hi, a, b, total):
    own = [v for v in values if (v > lo or (in_lo and v == lo)) and (v < hi or (in_hi and v == hi))]
    n = max(len(own), math.floor((hi - lo) * total / (b - a)))
    return {"lo": lo, "hi": hi, "in": (in_lo, in_hi), "v": own, "n": n, "rd": len(own) / n if n else math.nan}


def plain_look(values, a, b, total):
    """The three cuts of one feature, one after the other."""
    one = plain_cut(values, a, b, len(values), total)
    if not one:
        return None
    r = lambda *z: plain_region(values, *z, a, b, total)
    c1, i1 = one
    p, q = r(a, c1, True, i1), r(c1, b, not i1, True)
    low = p if p["rd"] < q["rd"] else q
    if not low["v"]:
        return c1, i1, low["rd"]
    two = plain_cut(low["v"], low["lo"], low["hi"], len(low["v"]), low["n"])
    if not two:
        return None
    c2, i2 = two
    left = low is p
    p, q = r(low["lo"], c2, low["in"][0], i2), r(c2, low["hi"], not i2, low["in"][1])
    if (q["rd"] > p["rd"]) if left else (p["rd"] > q["rd"]):
        return c2, i2, min(p["rd"], q["rd"])
    low = p if p["rd"] < q["rd"] else q
    if not low["v"]:
        return None
    three = plain_cut(low["v"], low["lo"], low["hi"], len(low["v"]), low["n"])
    if not three:
        return None
    c3, i3 = three
    side = lambda c, i: r(c, c3, not i, i3) if c < c3 else r(c3, c, not i3, i)
    return c3, i3, min(side(c1, i1)["rd"], side(c2, i2)["rd"])


def plain_tree(own, bounds, n, least, depth, level=0, at=1):
    out = {at: (len(own), n, None)}
    if len(own) <= least or level == depth:
        return out
    n = max(n, len(own))
    found = [(rd, f, c, i) for f, (a, b) in bounds.items() if b > a and (z := plain_look([v[f] for v in own], a, b, n)) for c, i, rd in [z] if not math.isnan(rd)]
    if not found:
        return out
    _, f, c, i = min(found)
    a, b = bounds[f]
    share = int((c - a) * n / (b - a))
    left, right = [v for v in own if v[f] < c or (i and v[f] == c)], [v for v in own if not (v[f] < c or (i and v[f] == c))]
    out[at] = (len(own), n, (f, c, i))
    return out | plain_tree(left, bounds | {f: (a, c)}, share, least, depth, level + 1, 2 * at) | plain_tree(right, bounds | {f: (c, b)}, n - share, least, depth, level + 1, 2 * at + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_density_tree_looks_ahead_as_the_plain_one(spark, seed):
    rows = [(i, [round(x, 1) for x in v]) for i, v in clusters(seed, 70)]
    own = [v for _, v in rows]
    bounds = {f: (min(v[f] for v in own), max(v[f] for v in own)) for f in range(3)}
    got = density.density_tree(points_of(spark, [*rows, (999, None)]), [0, 1, 2], 8, 3)
    want = plain_tree(own, bounds, len(own), 8, 3)
    assert {k: (n.y, n.n, None if n.feature is None else (n.feature, n.cut, n.inclusive)) for k, n in got.items()} == want
    assert len(want) > 3


def test_density_regions_find_planted_clusters(spark):
    rows = clusters(5, 300)
    tree = density.prune(density.density_tree(points_of(spark, rows), [0, 1, 2], 10, 4), 0.05, 0.5)
    got = {r["id"]: tree[r["k"]].label for r in points_of(spark, rows).select("id", density.routed(tree, stops=True).alias("k")).collect()}
    by_cluster = [{got[i] for i, _ in rows if i % 3 == c} - {0} for c in range(3)]
    assert all(by_cluster) and not by_cluster[0] & by_cluster[1] and not by_cluster[1] & by_cluster[2] and not by_cluster[0] & by_cluster[2]


def node(y, n, feature=None):
    return density.Node(y, n, {0: (0.0, 1.0)}, feature=feature)


def test_prune():
    shape = lambda: {1: node(100, 100, 0), 2: node(3, 50), 3: node(97, 50, 0), 6: node(50, 25), 7: node(47, 25)}
    t = density.prune(shape(), 0.1, 1.0)  # two whole leaves close up; the empty side stays apart
    assert (t[2].label, t[3].stop, t[3].label, t[1].stop) == (0, True, 1, False)
    t = density.prune(shape(), 0.1, 0.01)  # the empty side is dense enough to belong
    assert t[1].stop and t[1].label == 1
    t = density.prune(shape(), 0.99, 1.0)
    assert t[1].stop and t[1].empty and t[1].label == 0


def test_trees_of_few_points(spark):
    for rows in ([], [(1, [0.5, 0.5, 0.5])], [(i, [1.0, 1.0, 1.0]) for i in range(30)]):
        assert set(density.density_tree(points_of(spark, rows), [0, 1, 2], 2, 3)) == {1}
        assert set(density.random_cluster_tree(points_of(spark, rows), 3, 2, 10, 0.05, 0.5, 3)) == {1}


def test_valley():
    wide = np.array([40, 30, 2, 1, 0, 1, 2, 35, 40])
    score, cut, left = density.valley(wide, 0.0, 9.0, 151, 5, 0.5)
    assert 3.0 <= cut <= 6.0 and left == int(cut * 151 / 9)
    narrow = np.array([50, 50, 1, 50, 50])
    assert density.valley(narrow, 0.0, 5.0, 201, 5, 0.5)[1] == 2.5
    assert density.valley(np.full(9, 10), 0.0, 9.0, 90, 5, 0.5) is None
    assert density.valley(wide, 0.0, 9.0, 151, 76, 0.5) is None


def test_random_cluster_tree_cuts_between_planted_clusters(spark):
    rows = clusters(9, 300)
    tree = density.random_cluster_tree(points_of(spark, rows), 3, 2, 20, 0.05, 0.3, 4)
    leaf = {r["id"]: r["k"] for r in points_of(spark, rows).select("id", density.routed(tree).alias("k")).collect()}
    leaves = [{leaf[i] for i, _ in rows if i % 3 == c} for c in range(3)]
    assert len(tree) >= 5 and not leaves[0] & leaves[1] and not leaves[1] & leaves[2] and not leaves[0] & leaves[2]
    assert all(n.y == tree[2 * k].y + tree[2 * k + 1].y and n.feature in n.features for k, n in tree.items() if n.feature is not None)
    assert tree != density.density_tree(points_of(spark, rows), [0, 1, 2], 15, 3)


def test_every_point_has_a_region(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    for name in ("M4_density_regions", "M5_random_cluster_leaves"):
        got = catalog.queries()[name](spark, sf)
        assert got.count() == n == got.select("id").distinct().count()
    assert catalog.queries()["M4_density_regions"](spark, sf).agg(F.max("region")).first()[0] == catalog.queries()["M4_density_tree"](spark, sf).agg(F.max("region")).first()[0]
