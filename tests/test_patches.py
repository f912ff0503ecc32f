"""Patches, draws of scale space, contour descriptors and filter banks against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import filters
from gridloom.operators import banks, patches

CELLS = "image_id long, r int, c int, v double"


def grid(seed, rows, columns):
    return np.random.default_rng(seed).normal(size=(rows, columns))


def tall(spark, images):
    return spark.createDataFrame([(i, r, c, float(a[r, c])) for i, a in images.items() for r in range(a.shape[0]) for c in range(a.shape[1])], CELLS).repartition(3)


def test_contour_mask():
    mask = patches.contour_mask()
    weight, cells = Counter(), Counter()
    for r, c, cell, n, w in mask:
        weight[r, c] += w
        cells[cell, n] += w
    assert set(weight) == {(r - 14, c - 14) for r in range(28) for c in range(28)} and set(weight.values()) == {2}
    assert Counter(n for _, n in cells) == {1: 8, 4: 8, 8: 8} and len({c for c, _ in cells}) == 24
    sizes = {n: {cells[k] for k in cells if k[1] == n} for n in (1, 4, 8)}
    assert sizes == {1: {4}, 4: {32}, 8: {160}}  # an eighth of each ring: 16, 128 and 640 places, twice
    starts = patches.contour_starts()
    assert starts[0] == 0 and starts[1] == 8 and starts[3] == 24 and max(starts.values()) == 96
    half = {(r, c): sorted(x[2] for x in mask if x[:2] == (r, c)) for r, c in ((-14, -14), (-14, 13), (13, -14), (13, 13), (-6, -6), (-2, -2))}
    assert half == {(-14, -14): [0, 2], (-14, 13): [1, 7], (13, -14): [12, 22], (13, 13): [17, 23], (-6, -6): [3, 4], (-2, -2): [8, 9]}


def test_contour_descriptors(spark):
    rng = random.Random(4)
    rows = [(i, r, c, rng.random(), rng.choice([0.0, rng.uniform(0, 2 * math.pi - 1e-9)])) for i in (1, 2) for r in range(9) for c in range(31)]
    g = spark.createDataFrame(rows, "image_id long, r int, c int, magnitude double, direction double")
    samples = [(7, 1, 4, 20), (8, 1, 0, 0), (9, 2, 8, 30)]
    got = {(r["key"], r["place"]): r["v"] for r in patches.contour_descriptors(g, spark.createDataFrame(samples, "key long, image_id long, r int, c int")).collect()}
    at = {r[:3]: r[3:] for r in rows}
    want = Counter()
    starts = patches.contour_starts()
    for key, image, r, c in samples:
        for dr, dc, cell, n, w in patches.contour_mask():
            m, d = at[image, min(max(r + dr, 0), 8), min(max(c + dc, 0), 30)]
            for b in range(n):  # the share of a direction falls with the distance from its centre, around the circle
                gap = abs(d / (2 * math.pi) * n - (b + 0.5))
                want[key, starts[cell] + b] += w * m * (1 if n == 1 else max(0.0, 1 - min(gap, n - gap)))
    assert set(got) == {k for k, v in want.items() if v} and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


@pytest.mark.parametrize("tile", [3, 16])
def test_patches(spark, tile):
    images = {1: grid(1, 11, 7), 2: grid(2, 4, 20)}
    samples = [(i, r, c, f"s{r}") for i in images for r in (-9, -1, 2, 9) for c in (-2, 3, 25)]
    out = patches.patches(tall(spark, images), spark.createDataFrame(samples, "image_id long, r int, c int, note string"), 4, 5, ["image_id"], tile).collect()
    assert len(out) == len(samples) and {r["note"] for r in out} == {"s-9", "s-1", "s2", "s9"}
    for r in out:
        a = images[r["image_id"]]
        want = [a[min(max(r["r"] + i, 0), a.shape[0] - 1), min(max(r["c"] + j, 0), a.shape[1] - 1)] for i in range(4) for j in range(5)]
        assert np.allclose(r["patch"], want)


@pytest.mark.parametrize("method", ["uniform", "scale"])
def test_draws_of_scale_space_have_the_stated_odds(spark, method):
    pyramid = spark.range(3000).withColumnRenamed("id", "image_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("image_id", (F.col("k") >= 32).cast("int").alias("octave"), (F.col("k") % 2).cast("int").alias("level"), F.expr("cast((k % 32) div 8 as int)").alias("r"), F.expr("cast(k % 8 div 2 as int)").alias("c"))
    out = patches.scale_space_samples(pyramid, 3, method)
    counts = {r["image_id"]: r["n"] for r in out.groupBy("image_id").agg(F.countDistinct("octave", "level", "r", "c").alias("n")).collect()}
    assert set(counts.values()) == {3} and len(counts) == 3000
    first = out.filter("turn = 1")
    share = first.filter("octave = 1").count() / 3000
    assert abs(share - (0.2 if method == "uniform" else 0.5)) < 0.04
    assert abs(first.filter("level = 1").count() / 3000 - 0.5) < 0.04
    assert out.filter("x != c * pow(2, octave) or y != r * pow(2, octave)").count() == 0
    with pytest.raises(ValueError):
        patches.scale_space_samples(pyramid, 3, "other")


def test_bank_responses(spark):
    images = {1: grid(3, 5, 9), 2: grid(4, 1, 1), 3: grid(5, 12, 6)}
    packed = spark.createDataFrame([(i, [float(x) for x in a.ravel()], *a.shape) for i, a in images.items()] + [(9, None, 1, 1), (10, [], 0, 0)], "image_id long, data array<double>, rows int, columns int")
    bank = {"edge": ("edge", 2.0, 0.7), "wide": ("laplacian", 10.0, 0.0), "small": ("gaussian", 0.4, 0.0)}
    got = {(r["image_id"], r["filter"]): r["data"] for r in banks.bank_responses(packed, bank).collect()}
    assert len(got) == 9
    for (i, name), data in got.items():
        a, k = images[i], np.array(filters.kernel(*bank[name]))
        half = k.shape[0] // 2
        p = np.pad(a, half, mode="edge")
        want = [(p[r : r + 2 * half + 1, c : c + 2 * half + 1] * k).sum() for r in range(a.shape[0]) for c in range(a.shape[1])]
        assert np.allclose(data, want, atol=1e-10)
    assert max(np.array(filters.kernel(*s)).shape[0] for s in bank.values()) == 61


def test_banks_have_full_reach():
    reach = {n: len(filters.kernel(*s)) // 2 for n, s in filters.leung_malik().items()}
    assert reach["edge_2_1"] == 15 and reach["laplacian_7"] == 34
    reach = {n: len(filters.kernel(*s)) // 2 for n, (_, *s) in filters.mr8().items()}
    assert reach["gaussian"] == 30 and reach["bar_4_3"] == 28
