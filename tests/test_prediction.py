"""What trees and vines tell of a point, against plain versions."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import features as X
from gridloom.operators import learners as L
from gridloom.operators import prediction as R
from gridloom.plans import tree_queries as Q

SF = "/root/testdata/sf0.001"
POINTS = "id long, data array<double>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(240):
        label = i % 3
        out.append((i, [rng.gauss(label if f == 2 else 0, 0.5) for f in range(5)], label))
    return out


@pytest.fixture(scope="module")
def points(spark, rows):
    return spark.createDataFrame(rows, POINTS).repartition(3)


def leaf_of(model, v, node=1):
    while R.inner(model, node):
        node = 2 * node + (v[model[node]["feature"]] >= model[node]["threshold"])
    return node


def entropy(labels):
    return -sum(p * math.log2(p) for k in set(labels) for p in [labels.count(k) / len(labels)]) * len(labels)


def test_candidate_tree_takes_the_best_of_its_own_candidates(spark, rows, points):
    odd = spark.createDataFrame([(None, [0.0] * 5, 1), (900, None, 1), (901, [0.0] * 5, None)], POINTS)
    model, tried = R.candidate_tree(points.unionByName(odd), 5, tries=3, thresholds=4, depth=3)
    assert 1 in tried and len(tried) > 2
    for node, options in tried.items():
        own = [(v, y) for _, v, y in rows if any(leaf_of({k: m for k, m in model.items() if k < node or k.bit_length() < node.bit_length()}, v) == node for _ in [0])]
        assert len({f for _, f, _ in options}) <= 3
        for score, f, t in options:
            left, right = [y for v, y in own if v[f] < t], [y for v, y in own if v[f] >= t]
            assert left and right and math.isclose(score, -(entropy(left) + entropy(right)) / len(own), abs_tol=1e-9)
        assert (model[node]["feature"], model[node]["threshold"]) in [(f, t) for s, f, t in options if s >= max(o[0] for o in options) - 1e-9]
        f = options[0][1]
        mean = np.mean([v[f] for v, _ in own])
        assert any(math.isclose(t, mean, abs_tol=1e-9) for _, g, t in options if g == f)
    assert sum(model[1]["dist"].values()) == len(rows)
    assert all(model[n]["dist"][k] == model[2 * n]["dist"][k] + model[2 * n + 1]["dist"][k] for n in tried for k in (0, 1, 2))


def test_candidate_tree_of_one_label_is_a_leaf(points):
    model, tried = R.candidate_tree(points.filter("label = 1"), 5)
    assert not tried and set(model) == {1} and model[1]["dist"] == {1: 80.0}
    assert R.candidate_tree(points.limit(0), 5) == ({}, {})


def test_path_fold(rows, points):
    model = {1: {"feature": 2, "threshold": 1.0}, 3: {"feature": 0, "threshold": 0.2}, 6: {"feature": 4, "threshold": 0.0}}
    got = {r["id"]: r["x"] for r in points.select("id", R.path_fold(model, lambda a, x: a * 0.5 + x, F.lit(2.0)).alias("x")).collect()}

    def fold(v, node=1):
        if node not in model:
            return 2.0
        x = v[model[node]["feature"]]
        return fold(v, 2 * node + (x >= model[node]["threshold"])) * 0.5 + x

    assert all(math.isclose(got[i], fold(v)) for i, v, _ in rows)


def test_sparse_codes_tell_how_far_down_paths_part(rows, points):
    model = {n: {"feature": n % 5, "threshold": 0.3} for n in range(1, 8)}
    got = {r["id"]: r["codes"] for r in R.sparse_codes(points, [model], 4).collect()}
    code = {8 + k: sum(4**j for j in range(3) if k >> j & 1) for k in range(8)}
    assert all(got[i] == [code[leaf_of(model, v)]] for i, v, _ in rows)
    assert abs(code[8] - code[9]) < abs(code[8] - code[10]) < abs(code[8] - code[12])


def test_sub_forest():
    models = [{1: {"feature": k}} for k in range(6)]
    got = R.sub_forest(models, 3, 5)
    assert len({m[1]["feature"] for m in got}) == 3 and got == R.sub_forest(models, 3, 5)
    assert len(R.sub_forest(models, 9)) == 6 and {tuple(m[1]["feature"] for m in R.sub_forest(models, 1, s)) for s in range(60)} == {(k,) for k in range(6)}


def test_refilling_adds_and_leaves_the_given_trees_alone(rows, points):
    first = R.refilled(points.filter("id < 100"), Q.FIXED[:0] + [{1: {"feature": 2, "threshold": 1.0}}])
    before = {n: dict(v["dist"]) for n, v in first[0].items()}
    second = R.refilled(points.filter("id >= 100"), first)
    assert {n: v["dist"] for n, v in first[0].items()} == before
    assert second[0][1]["dist"] == {0: 80.0, 1: 80.0, 2: 80.0}
    assert second[0][2]["dist"] == {k: float(sum(v[2] < 1.0 and y == k for _, v, y in rows)) for k in range(3)}


def test_generated_sql_gives_the_same_in_both_engines(spark):
    p, model = Q.emitted(spark, SF)
    text = R.label_sql(model, lambda f: f"data[{f}]")
    ours = {r["id"]: r["predicted"] for r in p.select("id", F.expr(text).alias("predicted")).collect()}
    other = dict(duckdb.sql(f"SELECT vec_id, {R.label_sql(model, lambda f: f'embedding[{f + 1}]::DOUBLE')} FROM '{SF}/embeddings.parquet'").fetchall())
    assert ours == other and len(set(ours.values())) > 1
    hard = {r["id"]: max(sorted(model[leaf_of(model, r["data"])]["dist"]), key=lambda k: (model[leaf_of(model, r["data"])]["dist"][k], -k)) for r in p.collect()}  # noqa: B023
    assert ours == hard


def vine_end(levels, v):
    node, level = 0, 0
    for k, rules in enumerate(levels):
        if node not in rules:
            break
        f, t, left, right = rules[node]
        node, level = (left if v[f] < t else right), k + 1
    return level, node


def test_trained_vine_routes_and_classifies(rows, points):
    levels = L.vine(points, list(range(5)), width=3, depth=3)
    got = {r["id"]: (r["level"], r["node"]) for r in R.vine_steps(points, levels).collect()}
    assert got == {i: vine_end(levels, v) for i, v, _ in rows}
    soft = R.vine_soft(points, levels, R.vine_distributions(points, levels)).collect()
    total, best = {}, {}
    for r in soft:
        total[r["id"]] = total.get(r["id"], 0) + r["p"]
        best[r["id"]] = max(best.get(r["id"], (0, 0)), (r["p"], r["predicted"]))
    assert all(math.isclose(x, 1) for x in total.values()) and len(total) == len(rows)
    assert sum(best[i][1] == y for i, _, y in rows) / len(rows) > 0.6


def test_vine_without_levels_or_points(points):
    assert {(r["level"], r["node"]) for r in R.vine_steps(points, []).collect()} == {(0, 0)}
    assert R.vine_steps(points.limit(0), Q.VINE).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_vine_responses(rows, points, seed):
    rng = random.Random(seed)
    widths = [1, 2, 3, 3]
    levels = [{n: (rng.randrange(5), 0.0, *(rng.randrange(w) for _ in "lr")) for n in range(widths[k])} for k, w in enumerate(widths[1:])]
    levels[-1] = {n: (f, t, *(x if n else 2 for x in s)) for n, (f, t, *s) in levels[-1].items()}
    leaves = max(max(x[2:]) for x in levels[-1].values()) + 1

    def plain(v):
        parents = [0.0] * 9
        for k, rules in enumerate(levels):
            children = [-1e9] * 9
            for n, (f, _, left, right) in sorted(rules.items()):
                x = parents[n] + (k + 1) * v[f]
                for c in (left, right):
                    children[c] = max(children[c], x) if len(rules) >= leaves else x
            parents = children
        return [x / 6 for x in parents[:leaves]]

    got = {r["id"]: r["responses"] for r in R.vine_responses(points, levels, F.greatest, -1e9).collect()}
    assert all(np.allclose(got[i], plain(v)) for i, v, _ in rows)


def test_drawn_features(spark):
    named = X.drawn(30, seed=2)
    assert [n for n, _ in named] == [n for n, _ in X.drawn(30, seed=2)] != [n for n, _ in X.drawn(30, seed=3)]
    assert len({n.split()[0] for n, _ in named}) >= 5
    cells = Q.cells(spark, SF).filter("image_id < 5")
    row = cells.agg(*[F.count(f).alias(f"n{i}") for i, (_, f) in enumerate(named)], F.count("*").alias("n")).first()
    assert all(row[f"n{i}"] == row["n"] for i in range(30))


def test_image_tree_learns_from_drawn_features(spark):
    named = X.drawn(12, seed=6)
    p = Q.image_points(spark, SF, [f for _, f in named]).filter("image_id < 60")
    model, tried = R.candidate_tree(p, 12, tries=6, depth=3)
    assert tried and all(model[n]["feature"] < 12 for n in tried)
    hit = p.withColumn("predicted", F.expr(R.label_sql(model, lambda f: f"data[{f}]"))).agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0]
    most = p.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert hit >= most
