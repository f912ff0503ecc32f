"""Iterative learners: each round is one aggregation over the points; models are small tables on the driver."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hashed(seed: int, *cols) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / float(1 << 53)


# --- clustering -----------------------------------------------------------------------------


def assign(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Nearest centre of each point, the lowest of equals; all centres are one literal, read from text, so the plan doesn't grow with them."""
    table = F.from_json(F.lit(json.dumps([[float(x) for x in c] for c in centres])), "array<array<double>>")
    each = F.transform(table, lambda c, k: F.struct(k.alias("k"), c.alias("c")))
    d = lambda s: F.aggregate(F.zip_with("data", s["c"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    return points.withColumn("b", F.array_min(F.transform(each, lambda s: F.struct(d(s).alias("d"), s["k"].alias("k"))))).withColumn("cluster", F.col("b.k")).withColumn("d", F.col("b.d")).drop("b")


def means(assigned: DataFrame, k: int, before: list[list[float]]) -> list[list[float]]:
    """New centres: weighted means; a cluster without points keeps its old centre."""
    rows = assigned.select("cluster", F.col("weight"), F.posexplode("data").alias("i", "x")).groupBy("cluster", "i").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x")).collect()  # k rows for each dimension
    out = [list(c) for c in before]
    for r in rows:
        out[r["cluster"]][r["i"]] = r["x"]
    return out


def kmeans(points: DataFrame, k: int, seed: int = 1, rounds: int = 20, start: list[list[float]] | None = None) -> list[list[float]]:
    """Lloyd's rounds from spread-out seeds, until no centre moves or ``rounds`` are over."""
    points = points if "weight" in points.columns else points.withColumn("weight", F.lit(1.0))
    centres = start or seeds(points, k, seed)
    for _ in range(rounds):
        new = means(assign(points, centres), k, centres)
        still = max((abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True)), default=0) < 1e-12
        centres = new
        if still:
            break
    return centres


def seeds(points: DataFrame, k: int, seed: int) -> list[list[float]]:
    """Each next seed is drawn by squared distance to the nearest so far: the row with the least -ln(u) / d."""
    first = points.orderBy(hashed(seed, "id"), "id").limit(1).collect()
    centres = [first[0]["data"]] if first else []
    while len(centres) < k and first:
        key = -F.ln(1 - hashed(seed + len(centres), "id")) / F.greatest(F.col("d") * F.col("weight"), F.lit(1e-300))
        centres.append(assign(points, centres).agg(F.min_by("data", F.struct(key.alias("k"), "id"))).first()[0])
    return centres


def scalable_seeds(points: DataFrame, k: int, seed: int = 1, oversample: float = 2.0) -> list[list[float]]:
    """Rounds of independent draws (probability l * d / cost), then weighted k-means over the candidates (about l ln(cost) of them)."""
    points = points if "weight" in points.columns else points.withColumn("weight", F.lit(1.0))
    centres = seeds(points, 1, seed)
    cost = assign(points, centres).agg(F.sum("d")).first()[0] or 0.0
    for r in range(max(1, int(math.log(max(cost, math.e))))):
        drawn = assign(points, centres).filter(hashed(seed + 100 + r, "id") < F.col("d") * (oversample * k / max(cost, 1e-300))).select("data").collect()
        centres += [x["data"] for x in drawn]
        cost = assign(points, centres).agg(F.sum("d")).first()[0]
    weight = {r["cluster"]: r["n"] for r in assign(points, centres).groupBy("cluster").agg(F.sum("weight").alias("n")).collect()}
    table = points.sparkSession.createDataFrame([(i, [float(x) for x in c], float(weight.get(i, 0.0)) or 1e-9) for i, c in enumerate(centres)], "id long, data array<double>, weight double")
    return kmeans(table, k, seed)


# --- trees ----------------------------------------------------------------------------------


def quantiles(points: DataFrame, features: list[int], bins: int) -> dict[int, list[float]]:
    cuts = [i / bins for i in range(1, bins)]
    row = points.agg(*[F.percentile_approx(F.col("data")[f], cuts, 10000).alias(f"q{f}") for f in features]).first()
    return {f: sorted(set(row[f"q{f}"] or [])) for f in features}


def split_counts(points: DataFrame, cuts: dict[int, list[float]]) -> DataFrame:
    """Weights by (node, feature, bin, label) in one pass; a value equal to a threshold belongs to its right side."""
    cell = lambda f, q: F.struct(F.lit(f).alias("feature"), sum((F.when(F.col("data")[f] >= t, 1).otherwise(0) for t in q), F.lit(0)).alias("bin"))
    rows = points.select("node", "label", "weight", F.explode(F.array(*[cell(f, q) for f, q in cuts.items() if q])).alias("s"))
    return rows.groupBy("node", "s.feature", "s.bin", "label").agg(F.sum("weight").alias("n"))


def entropy_sum(counts: np.ndarray) -> np.ndarray:
    """Total weight times entropy (base 2) of the last axis."""
    total = counts.sum(axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.where(counts > 0, counts * np.log2(counts / total), 0.0).sum(axis=-1)


def best_splits(counts: pd.DataFrame, cuts: dict[int, list[float]], labels: list[int], balance: float = 0.0) -> dict[int, dict]:
    """The split of each node with the greatest gain: prefix sums over bins score all thresholds at once."""
    out = {}
    at = {v: i for i, v in enumerate(labels)}
    for (node, feature), part in counts.groupby(["node", "feature"]):
        node, feature = int(node), int(feature)
        table = np.zeros((len(cuts[feature]) + 1, len(labels)))
        table[part["bin"], part["label"].map(at)] = part["n"]
        left = table.cumsum(axis=0)[:-1]
        right = table.sum(axis=0) - left
        whole = table.sum()
        gain = (entropy_sum(table.sum(axis=0)) - entropy_sum(left) - entropy_sum(right)) / whole
        if balance:
            gain = (1 - balance) * gain + balance * (1 - np.abs(left.sum(axis=1) - right.sum(axis=1)) / whole)
        ok = (left.sum(axis=1) > 0) & (right.sum(axis=1) > 0)
        if ok.any():
            k = int(np.where(ok, gain, -np.inf).argmax())
            if node not in out or gain[k] > out[node]["gain"]:
                out[node] = {"feature": int(feature), "threshold": float(cuts[feature][k]), "gain": float(gain[k]), "whole": table.sum(axis=0)}
    return out


def route(model: dict[int, dict]) -> Column:
    """The heap place of the leaf that a point reaches, as one nested CASE expression."""

    def at(node: int) -> Column:
        n = model.get(node)
        if not n or n.get("feature") is None:
            return F.lit(node)
        return F.when(F.col("data")[n["feature"]] < n["threshold"], at(2 * node)).otherwise(at(2 * node + 1))

    return at(1)


def tree(points: DataFrame, features: list[int], bins: int = 8, depth: int = 3, support: float = 2, least_gain: float = 1e-6, balance: float = 0.0) -> dict[int, dict]:
    """A decision tree grown breadth first: all open nodes of a level are scored by one aggregation.

    ``model[node]`` has feature, threshold (absent at leaves) and dist (weights by label).
    """
    points = points if "weight" in points.columns else points.withColumn("weight", F.lit(1.0))
    labels = sorted(r["label"] for r in points.select("label").distinct().collect())
    cuts = quantiles(points, features, bins)
    model: dict[int, dict] = {}
    for d in range(depth):
        here = points.withColumn("node", route(model)).filter(F.col("node") >= 2**d)
        found = best_splits(split_counts(here, cuts).toPandas(), cuts, labels, balance)  # at most nodes x features x bins x labels rows
        grown = {n: s for n, s in found.items() if s["gain"] > least_gain and s["whole"].sum() >= support}
        model |= {n: {"feature": s["feature"], "threshold": s["threshold"]} for n, s in grown.items()}
        if not grown:
            break
    return with_distributions(points, model, labels)


def breadth_first_tree(points: DataFrame, features: list[int], threshold: float = 0.01, bins: int = 8, depth: int = 3, minimum: int = 1, support: float = 2, tries: int = 5) -> dict[int, dict]:
    """A tree whose open nodes are all offered the same features in each round, by one aggregation.

    A node grows at its best split if the gain is above ``threshold`` or its level is under ``minimum``; nodes of a
    single label, of less weight than ``support`` or at ``depth`` stay leaves. After a round without growth the
    threshold falls by a part in ``tries`` of its first value; after so many such rounds the tree is done.
    """
    points = points if "weight" in points.columns else points.withColumn("weight", F.lit(1.0))
    labels = sorted(r["label"] for r in points.select("label").distinct().collect())
    cuts = quantiles(points, features, bins)
    model: dict[int, dict] = {}
    step, left, counts = threshold / tries, tries, None
    while left:
        if counts is None:
            here = points.withColumn("node", route(model)).filter(F.col("node") < 2**depth)
            counts = best_splits(split_counts(here, cuts).toPandas(), cuts, labels)  # at most nodes x features x bins x labels rows
        open_ = {n: s for n, s in counts.items() if s["whole"].sum() >= support and (s["whole"] > 0).sum() > 1}
        if not open_:
            break
        grown = {n: s for n, s in open_.items() if s["gain"] > 0 and (s["gain"] > threshold or n.bit_length() - 1 < minimum)}
        if grown:
            model |= {n: {"feature": s["feature"], "threshold": s["threshold"]} for n, s in grown.items()}
            counts = None
        else:
            threshold, left = threshold - step, left - 1
    return with_distributions(points, model, labels)


def with_distributions(points: DataFrame, model: dict[int, dict], labels: list) -> dict[int, dict]:
    """The model with the weights by label of all its nodes."""
    leaves = points.withColumn("node", route(model)).groupBy("node", "label").agg(F.sum("weight").alias("n")).collect()
    for r in leaves:
        node = r["node"]
        while node:
            dist = model.setdefault(node, {"feature": None}).setdefault("dist", dict.fromkeys(labels, 0.0))
            dist[r["label"]] += r["n"]
            node //= 2
    return model


def as_table(spark, models: list[dict[int, dict]]) -> DataFrame:
    rows = [(t, n, m.get("feature"), m.get("threshold"), {int(k): float(v) for k, v in m.get("dist", {}).items()}) for t, model in enumerate(models) for n, m in sorted(model.items())]
    return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, dist map<int,double>")


def soft(points: DataFrame, models: list[dict[int, dict]], alpha: float = 1e-4) -> DataFrame:
    """Label distributions of a forest: the smoothed leaf distributions of its trees, averaged."""
    rows = []
    for t, m in enumerate(models):
        for n, v in m.items():
            dist = v.get("dist") or {}
            total = sum(dist.values())
            rows += [(t, n, int(k), (x + alpha / len(dist)) / (total + alpha)) for k, x in dist.items()]
    leaves = points.sparkSession.createDataFrame(rows, "tree int, node int, predicted int, p double")
    visits = points.select("id", "label", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), route(m).alias("node")) for t, m in enumerate(models)])).alias("v")).select("id", "label", "v.*")
    return visits.join(F.broadcast(leaves), ["tree", "node"]).groupBy("id", "label", "predicted").agg((F.sum("p") / len(models)).alias("p"))


def hard(dist: DataFrame) -> DataFrame:
    return dist.groupBy("id", "label").agg((-F.max(F.struct("p", (-F.col("predicted")).alias("k")))["k"]).alias("predicted"))


def vine(points: DataFrame, features: list[int], width: int = 4, depth: int = 3, bins: int = 6, seed: int = 3, tries: int = 40) -> list[dict]:
    """A layered graph: children of a level are at most ``width``; parents' sides are dealt to children so as to lower the entropy.

    Each level's state is its parents' sides by label, a small table; the search over it is on the driver.
    """
    points = points.withColumn("weight", F.lit(1.0)).withColumn("node", F.lit(0))
    labels = sorted(r["label"] for r in points.select("label").distinct().collect())
    cuts, rng, levels = quantiles(points, features, bins), np.random.default_rng(seed), []
    here = points
    for _ in range(depth):
        counts = split_counts(here, cuts).toPandas()
        found = best_splits(counts, cuts, labels, 0.1)
        sides, names = [], []
        for node, s in sorted(found.items()):
            part = counts[(counts["node"] == node) & (counts["feature"] == s["feature"])]
            k = cuts[s["feature"]].index(s["threshold"])
            for right in (0, 1):
                v = part[(part["bin"] > k) == bool(right)].groupby("label")["n"].sum().reindex(labels, fill_value=0.0)
                sides.append(v.to_numpy(float))
                names.append((node, right))
        if not sides:
            break
        table, n = np.stack(sides), min(width, len(sides))
        child = np.arange(len(sides)) % n
        cost = lambda c: sum(float(entropy_sum(table[c == j].sum(axis=0))) for j in range(n) if (c == j).any())  # noqa: B023, E731
        for _ in range(tries):
            i = rng.integers(len(sides))
            options = [np.where(np.arange(len(sides)) == i, j, child) for j in range(n)]
            child = min(options, key=cost)
        level = {node: (s["feature"], s["threshold"], int(child[names.index((node, 0))]), int(child[names.index((node, 1))])) for node, s in sorted(found.items())}
        levels.append(level)
        step = F.lit(None).cast("int")
        for node, (f, t, a, b) in level.items():
            step = F.when(F.col("node") == node, F.when(F.col("data")[f] < t, a).otherwise(b)).otherwise(step)
        here = here.withColumn("node", step).filter("node is not null")  # points of nodes that aren't parted stay there
    return levels


# --- model fitting --------------------------------------------------------------------------


def affine_sums(c: DataFrame, by: list[str]) -> DataFrame:
    """Least-squares affine maps x1 = a x0 + b y0 + t, y1 = d x0 + e y0 + u: normal equations from sums, solved by Cramer's rule."""
    s = c.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.sum(e).alias(n) for n, e in {
            "x": F.col("x0"), "y": F.col("y0"), "xx": F.col("x0") * F.col("x0"), "xy": F.col("x0") * F.col("y0"), "yy": F.col("y0") * F.col("y0"),
            "p": F.col("x1"), "xp": F.col("x0") * F.col("x1"), "yp": F.col("y0") * F.col("x1"), "q": F.col("y1"), "xq": F.col("x0") * F.col("y1"), "yq": F.col("y0") * F.col("y1"),
        }.items()]
    )
    m = [[F.col("xx"), F.col("xy"), F.col("x")], [F.col("xy"), F.col("yy"), F.col("y")], [F.col("x"), F.col("y"), F.col("n").cast("double")]]

    def det(a):
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    def solve(v, k):
        return F.try_divide(det([[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]), det(m))

    px, py = [F.col("xp"), F.col("yp"), F.col("p")], [F.col("xq"), F.col("yq"), F.col("q")]
    return s.select(*by, *[solve(v, k).alias(n) for v, names in ((px, "abt"), (py, "deu")) for k, n in enumerate(names)])


def residual() -> Column:
    dx = F.col("a") * F.col("x0") + F.col("b") * F.col("y0") + F.col("t") - F.col("x1")
    dy = F.col("d") * F.col("x0") + F.col("e") * F.col("y0") + F.col("u") - F.col("y1")
    return F.sqrt(dx * dx + dy * dy)


def ransac(c: DataFrame, candidates: int, size: int, threshold: float) -> DataFrame:
    """Models from hash-ordered samples of ``size`` rows, the one with the largest consensus, fitted again to all of that."""
    order = c.withColumn("h", F.xxhash64(F.lit(16), "id")).orderBy("h", "id").limit(candidates * size)
    sample = order.withColumn("candidate", F.expr(f"cast((row_number() over (order by h, id) - 1) div {size} as int)"))
    models = affine_sums(sample, ["candidate"])
    scored = c.join(F.broadcast(models)).withColumn("near", residual() < threshold)  # ``candidates`` rows
    best = scored.filter("near").groupBy("candidate").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("candidate")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("candidate"), F.col("b.n").alias("consensus"))
    chosen = scored.filter("near").join(F.broadcast(best), "candidate")
    return affine_sums(chosen, ["candidate", "consensus"])


def homographies(c: DataFrame, by: list[str]) -> DataFrame:
    """Projective maps by direct linear equations: the eigenvector of the least eigenvalue of their 9 x 9 normal matrix.

    The matrix is 45 sums over the correspondences, so only those reach Python, one row a group.
    """
    a, b, p, q = (F.col(x) for x in ("x0", "y0", "x1", "y1"))
    o, z = F.lit(1.0), F.lit(0.0)
    equations = ([a, b, o, z, z, z, -p * a, -p * b, -p], [z, z, z, a, b, o, -q * a, -q * b, -q])
    pairs = [(i, j) for i in range(9) for j in range(i, 9)]
    sums = c.groupBy(*by).agg(F.array(*[F.sum(sum((e[i] * e[j] for e in equations), z)) for i, j in pairs]).alias("m"))

    def solve(frames):
        for f in frames:
            for row in f.itertuples(index=False):
                m = np.zeros((9, 9))
                for (i, j), v in zip(pairs, row.m, strict=True):
                    m[i, j] = m[j, i] = v
                h = np.linalg.eigh(m)[1][:, 0]
                yield pd.DataFrame({**{k: [getattr(row, k)] * 9 for k in by}, "i": range(9), "h": h / h[8]})

    kinds = ", ".join(f"{k} {dict(c.dtypes)[k]}" for k in by)
    return sums.mapInPandas(solve, f"{kinds}, i int, h double")
