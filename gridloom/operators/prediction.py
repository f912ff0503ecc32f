"""What trained trees, forests and vines tell of a point or of a part of an image, beyond its label.

A tree is a dict by heap place with feature, threshold and, at nodes that were filled, dist; a vine is a list of levels, each a dict from
a node to (feature, threshold, left, right), whose last two are nodes of the next level.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import stencil
from gridloom.operators.evaluation import ancestors
from gridloom.operators.learners import entropy_sum, route, with_distributions

Tree = dict[int, dict]
Vine = list[dict[int, tuple[int, float, int, int]]]


def inner(model: Tree, node: int) -> bool:
    return model.get(node, {}).get("feature") is not None


# --- trees and forests --------------------------------------------------------------------------


def path_fold(model: Tree, reduce: Callable[[Column, Column], Column], start: Column, data: str = "data") -> Column:
    """The fold of all tested values on a point's path, from the leaf (where it is ``start``) up to the root."""

    def at(node: int) -> Column:
        if not inner(model, node):
            return start
        x = F.col(data)[model[node]["feature"]]
        return F.when(x < model[node]["threshold"], reduce(at(2 * node), x)).otherwise(reduce(at(2 * node + 1), x))

    return at(1)


def sparse_code(model: Tree, depth: int) -> Column:
    """A number for a leaf such that leaves that part further down are nearer: a right turn at level l adds 4^(depth - l - 2).

    ``depth`` counts the levels with the leaves' own, so the lowest branches add 1. Missing values go right.
    """

    def code(node: int, so_far: int) -> Column:
        if not inner(model, node):
            return F.lit(so_far).cast("long")
        gap = 4 ** max(depth - (node.bit_length() - 1) - 2, 0)
        return F.when(F.col("data")[model[node]["feature"]] < model[node]["threshold"], code(2 * node, so_far)).otherwise(code(2 * node + 1, so_far + gap))

    return code(1, 0)


def sparse_codes(points: DataFrame, models: list[Tree], depth: int) -> DataFrame:
    """(id, codes): one code a tree."""
    return points.select("id", F.array(*[sparse_code(m, depth) for m in models]).alias("codes"))


def sub_forest(models: list[Tree], size: int, seed: int = 1) -> list[Tree]:
    """``size`` different trees (all, if there are fewer) in random order."""
    order = np.random.default_rng(seed).permutation(len(models))
    return [models[i] for i in order[:size]]


def refilled(points: DataFrame, models: list[Tree]) -> list[Tree]:
    """The trees with the points' weights added, by label, to what all nodes on their paths hold; the given ones stay as they are."""
    points = points if "weight" in points.columns else points.withColumn("weight", F.lit(1.0))
    labels = sorted({r["label"] for r in points.select("label").distinct().collect()} | {k for m in models for n in m.values() for k in n.get("dist", {})})
    out = []
    for m in models:
        copy = {n: v | {"dist": dict.fromkeys(labels, 0.0) | v.get("dist", {})} for n, v in m.items()}
        out.append(with_distributions(points, copy, labels))
    return out


def tree_sql(model: Tree, column: Callable[[int], str]) -> str:
    """The tree as SQL text that gives the heap place of the leaf; ``column`` writes the value of a feature."""

    def at(node: int) -> str:
        if not inner(model, node):
            return str(node)
        n = model[node]
        return f"CASE WHEN {column(n['feature'])} < {float(n['threshold'])!r} THEN {at(2 * node)} ELSE {at(2 * node + 1)} END"

    return at(1)


def label_sql(model: Tree, column: Callable[[int], str]) -> str:
    """The tree as SQL text that gives the commonest label of a point's leaf, the lowest of equals."""
    best = {n: min(d, key=lambda k: (-d[k], k)) for n, v in model.items() if (d := v.get("dist"))}

    def at(node: int) -> str:
        if not inner(model, node):
            return str(best.get(node, "NULL"))
        n = model[node]
        return f"CASE WHEN {column(n['feature'])} < {float(n['threshold'])!r} THEN {at(2 * node)} ELSE {at(2 * node + 1)} END"

    return at(1)


def candidate_tree(points: DataFrame, dims: int, tries: int = 8, thresholds: int = 5, depth: int = 4, support: float = 2, seed: int = 6) -> tuple[Tree, dict[int, list[tuple]]]:
    """A tree whose nodes draw their own candidates: ``tries`` features, each with the mean of the node's values and thresholds drawn around it.

    Thresholds come from the normal distribution fitted to the node's values of that feature. A level takes two aggregations: mean and
    spread of each node's drawn features, then label weights between the sorted thresholds of all candidates (nodes x tries x (thresholds + 1) x
    labels rows). The candidate of the least entropy of its sides wins; nodes of one label, of less weight than ``support`` or without a
    candidate that parts them stay leaves. Null vectors, labels and identifiers are left out.

    Returns the tree and, for each branch, its candidates (score, feature, threshold).
    """
    points = points.filter("id is not null and data is not null and label is not null")
    points = points if "weight" in points.columns else points.withColumn("weight", F.lit(1.0))
    labels = sorted(r["label"] for r in points.select("label").distinct().collect())
    at = {v: i for i, v in enumerate(labels)}
    model: Tree = {}
    tried: dict[int, list[tuple]] = {}
    open_ = [1]
    for _ in range(depth):
        drawn = {n: [int(f) for f in np.sort(np.random.default_rng((seed, n)).choice(dims, min(tries, dims), replace=False))] for n in open_}
        here = points.withColumn("node", route(model)).filter(F.col("node").isin(open_))
        which = F.when(F.lit(False), F.array(F.lit(0)))
        for n, f in drawn.items():
            which = which.when(F.col("node") == n, F.lit(f))
        here = here.select("node", "label", "weight", "data", F.explode(which).alias("f")).select("node", "label", "weight", "f", F.col("data")[F.col("f")].alias("x"))
        fitted = here.groupBy("node", "f").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd")).collect()  # nodes x tries rows
        cuts = {}
        for r in fitted:
            z = np.random.default_rng((seed, r["node"], r["f"])).normal(size=thresholds - 1)
            cuts[r["node"], r["f"]] = sorted([r["mean"], *(r["mean"] + r["sd"] * z).tolist()])
        if not cuts:
            break
        table = points.sparkSession.createDataFrame([(n, f, t) for (n, f), t in cuts.items()], "node int, f int, cuts array<double>")
        bins = F.size(F.filter("cuts", lambda t: F.col("x") >= t))
        rows = here.join(F.broadcast(table), ["node", "f"]).groupBy("node", "f", bins.alias("bin"), "label").agg(F.sum("weight").alias("w")).collect()
        counts: dict[tuple, np.ndarray] = {}
        for r in rows:
            counts.setdefault((r["node"], r["f"]), np.zeros((thresholds + 1, len(labels))))[r["bin"], at[r["label"]]] += r["w"]
        grown = []
        for n in open_:
            options = []
            for f in drawn[n]:
                c = counts.get((n, f))
                if c is None or c.sum() < support or (c.sum(axis=0) > 0).sum() < 2:
                    continue
                left = c.cumsum(axis=0)[:-1]
                right = c.sum(axis=0) - left
                score = -(entropy_sum(left) + entropy_sum(right)) / c.sum()
                options += [(float(s), f, t) for s, t, a, b in zip(score, cuts[n, f], left.sum(axis=1), right.sum(axis=1), strict=True) if a > 0 and b > 0]
            if options:
                best = max(options, key=lambda o: (round(o[0], 12), -o[1], -o[2]))
                model[n] = {"feature": best[1], "threshold": best[2]}
                tried[n] = options
                grown += [2 * n, 2 * n + 1]
        open_ = grown
        if not grown:
            break
    return with_distributions(points, model, labels), tried


# --- vines ----------------------------------------------------------------------------------------


def vine_steps(points: DataFrame, levels: Vine) -> DataFrame:
    """Add ``level`` and ``node``, where each point ends: at a node that the next level doesn't part, or behind the last one.

    A level is one pair of array lookups, so the plan grows with the number of levels and not with that of paths.
    """
    out = points.withColumn("node", F.lit(0)).withColumn("level", F.lit(0))
    for k, level in enumerate(levels):
        size = max(level, default=-1) + 1
        if not size:
            break
        part = [F.lit([level.get(n, (-1, 0.0, 0, 0))[j] if j != 1 else float(level.get(n, (-1, 0.0, 0, 0))[1]) for n in range(size)]) for j in range(4)]
        f, t, left, right = (F.get(p, F.col("node")) for p in part)
        goes = (F.col("level") == k) & F.coalesce(f >= 0, F.lit(False))
        out = out.withColumn("__to", F.when(goes, F.when(F.get("data", f) < t, left).otherwise(right))).withColumns({"node": F.coalesce("__to", "node"), "level": F.when(F.col("__to").isNotNull(), k + 1).otherwise(F.col("level"))}).drop("__to")
    return out


def vine_distributions(points: DataFrame, levels: Vine) -> DataFrame:
    """(level, node, label, p): shares of the labels of the points that end at each node."""
    counts = vine_steps(points.filter("label is not null"), levels).groupBy("level", "node", "label").agg(F.count("*").alias("n"))
    return counts.select("level", "node", "label", (F.col("n") / F.sum("n").over(W.partitionBy("level", "node"))).alias("p"))


def vine_soft(points: DataFrame, levels: Vine, filled: DataFrame) -> DataFrame:
    """(id, predicted, p): the distribution of the node where each point ends. ``filled`` has a row a node and label; points at nodes that it lacks have no rows."""
    size = (len(levels) + 1) * (max((max(x[2:]) for level in levels for x in level.values()), default=0) + 1)
    table = filled.withColumnRenamed("label", "predicted")
    return vine_steps(points, levels).select("id", "level", "node").join(F.broadcast(table) if size < 10_000 else table, ["level", "node"]).select("id", "predicted", "p")


def vine_responses(points: DataFrame, levels: Vine, reduce: Callable[[Column, Column], Column], start: float = 0.0) -> DataFrame:
    """(id, responses): the values tested along all paths to each node behind the last level.

    A path's response is the sum of (level + 1) times the value tested there. A node of the next level takes over the response of the parent's side that
    leads to it; where a level is as wide as the last, sides that meet are folded by ``reduce`` from ``start`` on. All is divided by the sum of the level numbers.
    """
    leaves = max((max(x[2:]) for x in levels[-1].values()), default=0) + 1
    out = points.select("id", "data", F.array(F.lit(0.0)).alias("r0"))
    for k, level in enumerate(levels):
        width = leaves if k == len(levels) - 1 else max(max(x[2:]) for x in level.values()) + 1
        into: list[Column] = [F.lit(start)] * width
        for n, (f, _, *sides) in sorted(level.items()):
            response = F.get(f"r{k}", F.lit(n)) + (k + 1) * F.col("data")[f]
            for child in sides:
                into[child] = reduce(into[child], response) if len(level) >= leaves else response
        out = out.withColumn(f"r{k + 1}", F.array(*into)).drop(f"r{k}")
    norm = len(levels) * (len(levels) + 1) / 2
    return out.select("id", F.transform(f"r{len(levels)}", lambda x: x / norm).alias("responses"))


# --- images -----------------------------------------------------------------------------------------


def leaf_integrals(leaves: DataFrame) -> DataFrame:
    """Integral images of each leaf that an image meets: (image_id, tree, leaf, r, c, v).

    ``leaves`` is a leaf image, (image_id, r, c, tree, leaf). Lines of one image and leaf come together, never more; there are at most as many of these
    images as leaves that occur in the image.
    """
    met = leaves.select("image_id", "tree", "leaf").distinct()
    cells = leaves.select("image_id", "tree", "r", "c", F.col("leaf").alias("own"))
    each = cells.join(met, ["image_id", "tree"]).select(F.struct("image_id", "tree", "leaf").alias("image_id"), "r", "c", (F.col("own") == F.col("leaf")).cast("double").alias("v"))
    return stencil.integral(each).select("image_id.*", "r", "c", "v")


def leaf_histograms(table: DataFrame, rectangles: DataFrame, depth: int) -> DataFrame:
    """(key, image_id, tree, node, value): shares of the cells of a rectangle by node, inner nodes as the sums of their leaves.

    ``rectangles``: (key, image_id, r0, c0, height, width), inside their images. Each leaf's count is four lookups in ``table`` (leaf_integrals), an
    equi-join whose cost doesn't depend on the rectangle's size. Nodes without cells have no row.
    """
    corner = lambda r, c, s: F.struct(r.alias("r"), c.alias("c"), F.lit(s).alias("s"))
    top, left, bottom, right = F.col("r0"), F.col("c0"), F.col("r0") + F.col("height"), F.col("c0") + F.col("width")
    corners = F.array(corner(bottom, right, 1), corner(top, right, -1), corner(bottom, left, -1), corner(top, left, 1))
    wanted = rectangles.withColumn("area", F.col("height") * F.col("width")).select("key", "image_id", "area", F.explode(corners).alias("k")).select("key", "image_id", "area", "k.*")
    counts = wanted.join(table, ["image_id", "r", "c"]).groupBy("key", "image_id", "area", "tree", "leaf").agg(F.sum(F.col("s") * F.col("v")).alias("n")).filter("n > 0")
    every = ancestors(counts.withColumnRenamed("leaf", "idx"), depth).filter("node > 0")
    return every.groupBy("key", "image_id", "area", "tree", "node").agg(F.sum("n").alias("n")).select("key", "image_id", "tree", "node", (F.col("n") / F.col("area")).alias("value"))


def leaf_distributions(leaves: DataFrame, filled: DataFrame, trees: int) -> DataFrame:
    """(image_id, r, c, label, p): the mean over the trees of the distributions (tree, leaf, label, p) of a cell's leaves."""
    return leaves.join(F.broadcast(filled), ["tree", "leaf"]).groupBy("image_id", "r", "c", "label").agg((F.sum("p") / trees).alias("p"))
