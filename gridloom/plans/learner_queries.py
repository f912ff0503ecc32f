"""Queries over the learners."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import learners as L
from gridloom.plans.match_queries import correspondences
from gridloom.plans.pixel_queries import CELL
from gridloom.registry import query
from gridloom.sources import tables as T

FEATURES = [0, 1, 2, 3, 4, 5, 6, 7]
SQ = "list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 for x in list_zip(a.data, b.data)])"


def weighted(spark, sf):
    return T.points(spark, sf).withColumn("weight", F.lit(1.0))


@query("M1_kmeans_step", f"""WITH a AS (SELECT id AS k, data FROM points WHERE id < 3), d AS (SELECT b.id, b.data, a.k, row_number() OVER (PARTITION BY b.id ORDER BY {SQ}, a.k) AS n FROM points b, a)
SELECT k::INT AS cluster, (i - 1)::INT AS i, round(avg(data[i]::DOUBLE), 6) + 0.0 AS x FROM d, (SELECT unnest(range(1, 65)) AS i) WHERE n = 1 GROUP BY ALL""")
def m1(spark, sf):
    """One assignment and update from three given centres."""
    p = T.points(spark, sf)
    start = [r["data"] for r in p.filter("id < 3").orderBy("id").collect()]
    return L.assign(p, start).select("cluster", F.posexplode("data").alias("i", "x")).groupBy("cluster", "i").agg((F.round(F.avg("x"), 6) + 0.0).alias("x"))


@query("M1_kmeans")
def m1full(spark, sf):
    p = weighted(spark, sf)
    return L.assign(p, L.kmeans(p, 5)).select("id", "cluster", "d")


@query("M2_scalable_kmeans")
def m2(spark, sf):
    p = weighted(spark, sf)
    return L.assign(p, L.scalable_seeds(p, 4)).select("id", "cluster", "d")


VOTES = f"WITH d AS (SELECT a.id AS query, b.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY {SQ}, b.id) AS k FROM points a, points b WHERE a.id % 50 = 0), v AS (SELECT query, label, count(*) AS n FROM d WHERE k <= 7 GROUP BY ALL) SELECT query, arg_max(label, {{'n': n, 'k': -label}})::INT AS label FROM v GROUP BY query"


@query("M3_knn_classify", VOTES)
@query("M3_knn_classify_searches", VOTES)
def m3(spark, sf):
    """Exact neighbours of every point with an id divisible by 50 vote; the lowest label of equals wins."""
    from gridloom.operators.matching import nearest

    p = T.points(spark, sf)
    v = nearest(p, p.filter("id % 50 = 0"), 7).join(p.select("id", "label"), "id").groupBy("query", "label").count()
    return v.groupBy("query").agg((-F.max(F.struct("count", (-F.col("label")).alias("k")))["k"]).alias("label"))


@query("M4_density_predict", "SELECT id, CASE WHEN data[1] < 0 THEN CASE WHEN data[2] < 0.05 THEN 0 ELSE 1 END ELSE CASE WHEN data[3] < -0.05 THEN 2 ELSE 3 END END::INT AS region FROM points")
def m4p(spark, sf):
    """Points under a fixed tree, as one nested CASE."""
    model = {1: {"feature": 0, "threshold": 0.0}, 2: {"feature": 1, "threshold": 0.05}, 3: {"feature": 2, "threshold": -0.05}}
    return T.points(spark, sf).select("id", (L.route(model) - 4).alias("region"))


def tree_rows(spark, models):
    return L.as_table(spark, models)


@query("M6_decision_tree")
def m6(spark, sf):
    """Random feature candidates at quantile thresholds."""
    features = sorted(int(x) for x in np.random.default_rng(6).choice(64, 12, replace=False))
    return tree_rows(spark, [L.tree(weighted(spark, sf), features, depth=4)])


@query("M7_breadth_first_tree")
def m7(spark, sf):
    """All 64 features are offered to all open nodes of a round."""
    return tree_rows(spark, [L.breadth_first_tree(weighted(spark, sf), list(range(64)), threshold=0.01, depth=3)])


CUTS = {0: [-0.1, 0.0, 0.1], 5: [-0.05, 0.05]}
LONG = "x AS (SELECT id, label, 0 AS feature, data[1]::DOUBLE AS v FROM points UNION ALL SELECT id, label, 5, data[6]::DOUBLE FROM points), t(feature, k, threshold) AS (VALUES (0, 0, -0.1), (0, 1, 0.0), (0, 2, 0.1), (5, 0, -0.05), (5, 1, 0.05))"


def cumulative(spark, sf):
    c = L.split_counts(weighted(spark, sf).withColumn("node", F.lit(1)), CUTS)
    cuts = spark.createDataFrame([(f, k, t) for f, q in CUTS.items() for k, t in enumerate(q)], "feature int, k int, threshold double")
    j = c.join(F.broadcast(cuts), "feature")
    left = F.sum(F.when(F.col("bin") <= F.col("k"), F.col("n")).otherwise(0.0))
    return j.groupBy("feature", "threshold", "label").agg(left.alias("left"), (F.sum("n") - left).alias("right"))


@query("M8_split_counts", f"WITH {LONG} SELECT x.feature, threshold::DOUBLE AS threshold, label, sum((v < threshold)::INT)::DOUBLE AS \"left\", sum((v >= threshold)::INT)::DOUBLE AS \"right\" FROM x JOIN t USING (feature) GROUP BY ALL")
def m8(spark, sf):
    return cumulative(spark, sf)


@query("M9_split_scores", f"WITH {LONG}, c AS (SELECT feature, threshold, label, sum((v < threshold)::INT) AS l, sum((v >= threshold)::INT) AS r FROM x JOIN t USING (feature) GROUP BY ALL), s AS (SELECT *, sum(l) OVER w AS tl, sum(r) OVER w AS tr FROM c WINDOW w AS (PARTITION BY feature, threshold)) SELECT feature, threshold::DOUBLE AS threshold, round(sum(CASE WHEN l > 0 THEN l * log2(l / tl) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / tr) ELSE 0 END) / max(tl + tr), 6) AS score, round(0.9 * -sum(CASE WHEN l > 0 THEN l * log2(l / tl) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / tr) ELSE 0 END) / max(tl + tr) + 0.1 * max(abs(tl - tr)) / max(tl + tr), 6) AS energy FROM s GROUP BY feature, threshold")
def m9(spark, sf):
    """The negative weighted entropy of the children, and the energy that weighs it with the balance."""
    w = W.partitionBy("feature", "threshold")
    c = cumulative(spark, sf).withColumn("tl", F.sum("left").over(w)).withColumn("tr", F.sum("right").over(w))
    h = lambda a, t: F.when(F.col(a) > 0, F.col(a) * F.log2(F.col(a) / F.col(t))).otherwise(0.0)
    e = F.sum(h("left", "tl") + h("right", "tr")) / F.max(F.col("tl") + F.col("tr"))
    return c.groupBy("feature", "threshold").agg(F.round(e, 6).alias("score"), F.round(0.9 * -e + 0.1 * F.max(F.abs(F.col("tl") - F.col("tr"))) / F.max(F.col("tl") + F.col("tr")), 6).alias("energy"))


FIXED = [
    {1: {"feature": 0, "threshold": 0.0}, 2: {"feature": 3, "threshold": 0.02}, 3: {"feature": 4, "threshold": -0.03}},
    {1: {"feature": 9, "threshold": 0.01}, 2: {"feature": 7, "threshold": 0.0}, 3: {"feature": 8, "threshold": 0.05}},
]
NODES = "leaf AS (SELECT id, label, 0 AS tree, CASE WHEN data[1] < 0 THEN CASE WHEN data[4] < 0.02 THEN 4 ELSE 5 END ELSE CASE WHEN data[5] < -0.03 THEN 6 ELSE 7 END END AS node FROM points UNION ALL SELECT id, label, 1, CASE WHEN data[10] < 0.01 THEN CASE WHEN data[8] < 0 THEN 4 ELSE 5 END ELSE CASE WHEN data[9] < 0.05 THEN 6 ELSE 7 END END FROM points)"
FILLED = f"{NODES}, n AS (SELECT tree, node, label, count(*) AS n FROM leaf GROUP BY ALL), g AS (SELECT t.tree, t.node, l.label, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT tree, node FROM n) t, (SELECT DISTINCT label FROM points) l LEFT JOIN n ON n.tree = t.tree AND n.node = t.node AND n.label = l.label), d AS (SELECT tree, node, label, (n + 0.0001 / count(*) OVER w) / (sum(n) OVER w + 0.0001) AS p FROM g WINDOW w AS (PARTITION BY tree, node))"


def filled(spark, sf):
    """The fixed trees with distributions filled from the points, at all nodes."""
    p = T.points(spark, sf)
    labels = sorted(r["label"] for r in p.select("label").distinct().collect())
    models = []
    for m in FIXED:
        model = {n: dict(v) for n, v in m.items()}
        for r in p.withColumn("node", L.route(m)).groupBy("node", "label").count().collect():
            node = r["node"]
            while node:
                model.setdefault(node, {"feature": None}).setdefault("dist", dict.fromkeys(labels, 0.0))[r["label"]] += r["count"]
                node //= 2
        models.append(model)
    return p, models


@query("M10_predict_leaf", f"WITH {NODES} SELECT id, node::INT AS node FROM leaf WHERE tree = 0")
def m10(spark, sf):
    return T.points(spark, sf).select("id", L.route(FIXED[0]).alias("node"))


@query("M10_predict_hard", f"WITH {FILLED} SELECT id, arg_max(d.label, {{'p': round(p, 12), 'k': -d.label}})::INT AS predicted FROM leaf JOIN d USING (tree, node) WHERE tree = 0 GROUP BY id")
def m10h(spark, sf):
    p, models = filled(spark, sf)
    return L.hard(L.soft(p, models[:1]).withColumn("p", F.round("p", 12))).select("id", "predicted")


@query("M11_forest_soft", f"WITH {FILLED} SELECT id, d.label AS predicted, round(sum(p) / 2, 6) AS p FROM leaf JOIN d USING (tree, node) GROUP BY id, d.label")
def m11(spark, sf):
    p, models = filled(spark, sf)
    return L.soft(p, models).select("id", "predicted", F.round("p", 6).alias("p"))


@query("M12_forest_training")
def m12(spark, sf, trees: int = 4, parts: int = 2):
    """Tree i learns from part i mod ``parts`` of the points and features of its own."""
    p = weighted(spark, sf)
    models = []
    for t in range(trees):
        part = p.filter(F.pmod(F.xxhash64(F.lit(12), "id"), F.lit(parts)) == t % parts)
        models.append(L.tree(part, sorted(int(x) for x in np.random.default_rng(t).choice(64, 8, replace=False)), depth=3))
    return L.hard(L.soft(p, models))


@query("M13_fill_nodes", f"WITH {NODES} SELECT tree, (node >> k)::INT AS node, label, count(*) AS n FROM leaf, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL")
def m13(spark, sf):
    """Counts at all nodes: each visit counts for the leaf and its ancestors."""
    from gridloom.operators.evaluation import ancestors

    visits = None
    for t, m in enumerate(FIXED):
        v = T.points(spark, sf).select("id", "label", F.lit(t).alias("tree"), L.route(m).alias("idx"))
        visits = v if visits is None else visits.unionByName(v)
    return ancestors(visits, 2).groupBy("tree", "node", "label").agg(F.count("*").alias("n"))


@query("M14_classify_image", "SELECT image_id, r, c, CASE WHEN v < 0 THEN CASE WHEN r < 4 THEN 4 ELSE 5 END ELSE CASE WHEN c < 3 THEN 6 ELSE 7 END END::INT AS leaf FROM raster")
def m14(spark, sf):
    """A tree over a cell's value and place gives each cell its leaf."""
    model = {1: {"feature": 0, "threshold": 0.0}, 2: {"feature": 1, "threshold": 4.0}, 3: {"feature": 2, "threshold": 3.0}}
    return T.raster(spark, sf).withColumn("data", F.array("v", F.col("r").cast("double"), F.col("c").cast("double"))).select(*CELL, L.route(model).alias("leaf"))


@query("M15_vine")
def m15(spark, sf):
    levels = L.vine(T.points(spark, sf), FEATURES)
    return spark.createDataFrame([(d, n, f, float(t), a, b) for d, level in enumerate(levels) for n, (f, t, a, b) in level.items()], "level int, node int, feature int, threshold double, left int, right int")


@query("M16_ransac")
def m16(spark, sf):
    c = correspondences(spark, sf)
    noisy = c.withColumn("x1", F.when(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, F.col("x1") + 3).otherwise(F.col("x1")))
    return L.ransac(noisy, 40, 3, 0.05)


SUMS = "s AS (SELECT count(*)::DOUBLE AS n, sum(x0) AS x, sum(y0) AS y, sum(x0 * x0) AS xx, sum(x0 * y0) AS xy, sum(y0 * y0) AS yy, sum(x1) AS p, sum(x0 * x1) AS xp, sum(y0 * x1) AS yp FROM (SELECT data[1]::DOUBLE AS x0, data[2]::DOUBLE AS y0, 2 * data[1]::DOUBLE + 0.1 + data[3]::DOUBLE * 0.1 AS x1 FROM points)), k AS (SELECT *, xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x) AS det FROM s)"


@query("M17_affine_fit", f"WITH {SUMS} SELECT round((xp * (yy * n - y * y) - xy * (yp * n - y * p) + x * (yp * y - yy * p)) / det, 5) AS a, round((xx * (yp * n - y * p) - xp * (xy * n - y * x) + x * (xy * p - yp * x)) / det, 5) AS b, round((xx * (yy * p - yp * y) - xy * (xy * p - yp * x) + xp * (xy * y - yy * x)) / det, 5) AS t FROM k")
def m17(spark, sf):
    return L.affine_sums(correspondences(spark, sf), []).select(*[F.round(c, 5).alias(c) for c in "abt"])


@query("M18_homography")
def m18(spark, sf):
    """A projective map for each label."""
    c = correspondences(spark, sf).join(T.points(spark, sf).select("id", "label"), "id")
    return L.homographies(c, ["label"])


@query("M18_projective_transform", "SELECT id, round((2 * data[1]::DOUBLE + 0.1) / (1 + 0.1 * data[2]::DOUBLE), 6) AS x, round((data[2]::DOUBLE - 0.2) / (1 + 0.1 * data[2]::DOUBLE), 6) AS y FROM points")
def m18a(spark, sf):
    d = F.col("data")
    w = 1 + 0.1 * d[1]
    return T.points(spark, sf).select("id", F.round((2 * d[0] + 0.1) / w, 6).alias("x"), F.round((d[1] - 0.2) / w, 6).alias("y"))


@query("M19_grid_samples", "SELECT image_id, r, c, label, (image_id % 3)::INT AS split FROM labels_r WHERE r % 2 = 1 AND c % 2 = 1 AND (image_id * 64 + r * 8 + c) * 2654435761 % 100 < 50")
def m19(spark, sf):
    """A sampling operator: grid points, half of them by an arithmetic hash, dealt to splits by image."""
    keep = ((F.col("image_id") * 64 + F.col("r") * 8 + F.col("c")) * 2654435761) % 100 < 50
    return T.labels(spark, sf).filter((F.col("r") % 2 == 1) & (F.col("c") % 2 == 1) & keep).withColumn("split", (F.col("image_id") % 3).cast("int"))
