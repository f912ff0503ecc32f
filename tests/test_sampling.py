"""Draws, training samples and templates: statistics and plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import pixels as P
from gridloom.operators import sampling as R
from gridloom.operators import templates as M

CELLS = "image_id long, r int, c int, label int"


def test_draws_have_the_stated_distributions(spark):
    k = F.col("id")
    d = spark.range(20_000).select(R.uniform(k, 3).alias("u"), R.normal(k, 4).alias("x"), R.test(k, 5, 0.2).cast("int").alias("t"), R.distribution(k, 6, 4).alias("p")).toPandas()
    assert abs(d.u.mean() - 0.5) < 0.01 and abs(d.u.var() - 1 / 12) < 0.005 and d.u.min() >= 0 and d.u.max() < 1
    assert abs(d.x.mean()) < 0.03 and abs(d.x.std() - 1) < 0.03 and abs((d.x > 1.96).mean() - 0.025) < 0.01
    assert abs(d.t.mean() - 0.2) < 0.01
    p = np.stack(d.p)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p.mean(axis=0), 0.25, atol=0.02)
    assert abs(np.corrcoef(d.u[:-1], d.u[1:])[0, 1]) < 0.05
    assert spark.range(1).select(R.uniform(F.lit(-7), 1).alias("u")).first()["u"] >= 0


def labelled(spark, rows=9, columns=7):
    rng = random.Random(1)
    return spark.createDataFrame([(i, r, c, rng.randrange(3) * i) for i in (1, 2, 3) for r in range(rows) for c in range(columns)], CELLS)


def test_grid_samples(spark):
    got = {(r["r"], r["c"]) for r in R.grid_samples(labelled(spark), 3, 1, 2).filter("image_id = 2").collect()}
    assert got == {(r, c) for r in range(1, 8, 3) for c in range(2, 5, 3)}
    assert R.grid_samples(labelled(spark), 1, 5, 0).count() == 0


def test_supervision(spark):
    labels = labelled(spark)
    key = F.col("r") * 100 + F.col("c")
    s = R.grid_samples(labels, 1, 0, 0)
    part = R.supervised(s, labels, "part", key, 2).collect()
    assert len(part) == 189 and {(r["image_id"], r["label"]) for r in part} == {(i, k * i) for i in (1, 2, 3) for k in range(3)}
    assert {r["label"] for r in R.supervised(s, labels, "none", key, 2).collect()} <= set(range(20))
    assert R.supervised(s, labels, "full", key, 2) is s
    with pytest.raises(ValueError):
        R.supervised(s, labels, "half", key, 2)


def test_splits(spark):
    s = spark.range(6000).select(F.col("id"), (F.col("id") % 300).alias("image_id"))
    points = R.split_samples(s, 2, F.col("id"), 3, 0.25)
    n = {r["split"]: r["count"] for r in points.groupBy("split").count().collect()}
    assert all(abs(n[k] - 1500) < 150 for k in (0, 1))
    images = R.split_samples(s, 2, F.col("id"), 3, 0.5, 0.4).groupBy("split").agg(F.countDistinct("image_id").alias("i")).collect()
    assert all(abs(r["i"] - 120) < 30 for r in images)


def test_matches_of_placed_templates(spark):
    rng = random.Random(2)
    d = {(r, c): (rng.randrange(30), rng.randrange(6), rng.randrange(8)) for r in range(6) for c in range(8)}
    transform = spark.createDataFrame([(1, r, c, *v) for (r, c), v in d.items()], "image_id long, r int, c int, d long, nr int, nc int")
    o = {(r, c): rng.uniform(0, 2 * math.pi) for r in range(6) for c in range(8)}
    orientations = spark.createDataFrame([(1, r, c, a) for (r, c), a in o.items()], "image_id long, r int, c int, direction double")
    points = [(rng.uniform(-3, 9), rng.uniform(-3, 7), rng.uniform(0, 2 * math.pi)) for _ in range(12)]
    templates = spark.createDataFrame([("t", *p) for p in points], "template string, x double, y double, angle double")
    where = [(0, 0, 0, 1.0, 1.0), (1, 2, -3, 1.0, 1.0), (2, 1, 1, 0.4, 1.7), (3, 500, 0, 1.0, 1.0)]
    placements = spark.createDataFrame([(k, 1, "t", r, c, sx, sy) for k, r, c, sx, sy in where], "key long, image_id long, template string, row int, column int, sx double, sy double")
    near = {r["key"]: r["score"] for r in M.chamfer_match(transform, templates, placements, 4).collect()}
    turned = {r["key"]: r["score"] for r in M.orientation_match(transform, orientations, templates, placements).collect()}
    for k, row, column, sx, sy in where:
        cells = [(p, (int(y * sy + row), int(x * sx + column))) for p, (x, y, _) in zip(points, points, strict=True)]
        cells = [(p, at) for p, at in cells if at in d]
        if not cells:
            assert k not in near and k not in turned
            continue
        assert math.isclose(near[k], sum(min(math.sqrt(d[at][0]), 4) for _, at in cells) / (4 * len(cells)))
        fold = lambda a: min(a % math.pi, math.pi - a % math.pi)
        assert math.isclose(turned[k], sum(fold(abs(o[d[at][1:]] - p[2])) for p, at in cells) / (math.pi / 2 * len(cells)))


@pytest.mark.parametrize("where", ["right", "bottom"])
def test_appended(spark, where):
    a, b = np.arange(1.0, 13).reshape(3, 4), np.arange(1.0, 11).reshape(2, 5) * -1
    tall = lambda x: spark.createDataFrame([(7, r, c, float(x[r, c])) for r in range(x.shape[0]) for c in range(x.shape[1])], "image_id long, r int, c int, v double")
    for one, two in ((a, b), (b, a)):
        want = np.zeros((3, 9) if where == "right" else (5, 5))
        for x, at in ((one, 0), (two, one.shape[1] if where == "right" else one.shape[0])):
            free = (want.shape[0] - x.shape[0]) // 2 if where == "right" else (want.shape[1] - x.shape[1]) // 2
            r, c = (free, at) if where == "right" else (at, free)
            want[r : r + x.shape[0], c : c + x.shape[1]] = x
        got = np.full(want.shape, np.nan)
        for r in P.appended(tall(one), tall(two), where).collect():
            got[r["r"], r["c"]] = r["v"]
        assert (got == want).all()


def test_rankings_with_outliers_ties_and_gaps(spark):
    from gridloom.operators import evaluation as E

    rng = random.Random(6)
    rows = [(i, rng.choice([rng.random(), 0.5, 1e12, -1e300]), rng.random() < 0.3) for i in range(3000)]
    odd = [(5000, None, True), (5001, 0.5, None), (5002, float("nan"), True)]
    got = {r["id"]: (r["tp"], r["fp"], r["p"], r["n"]) for r in E.changes(spark.createDataFrame(rows + odd, "id long, rank double, positive boolean")).collect()}
    tp = fp = 0
    p = sum(y for *_, y in rows)
    for i, _, y in sorted(rows, key=lambda r: (-r[1], r[0])):
        tp, fp = tp + y, fp + (not y)
        assert got.pop(i) == (tp, fp, p, 3000 - p)
    assert not got
    parts = E.ranges(spark.range(50_000).selectExpr("id", "cast(pow(1.001, id) as double) as x"), "x", 64).groupBy("part").count()
    assert parts.count() >= 60 and parts.agg(F.max("count")).first()[0] < 1200
    assert E.changes(spark.createDataFrame([], "id long, rank double, positive boolean")).count() == 0
