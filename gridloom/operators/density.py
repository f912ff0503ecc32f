"""Trees that cut points from empty space: density trees and random cluster trees, grown a level at a time.

Points are held against as many virtual ones, spread evenly over a node's bounds; those are never made, only counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.sources.staging import staged

#: Equal-width stretches of a feature's range in a node, within which running counts are windows.
STRETCHES = 256


@dataclass
class Node:
    """Points ``y``, virtual points ``n``, bounds by feature, and, at branches, the cut and the places of the children."""

    y: int
    n: int
    bounds: dict[int, tuple[float, float]]
    level: int = 0
    feature: int | None = None
    cut: float = 0.0
    inclusive: bool = False
    stop: bool = False
    empty: bool = False
    label: int = -1
    features: list[int] = field(default_factory=list)

    @property
    def density(self) -> float:
        return self.y / self.n if self.n else float("inf")


def routed(tree: dict[int, Node], data: str = "data", stops: bool = False) -> Column:
    """The heap place of the leaf (or, with ``stops``, of the pruned node) that a point reaches, as one nested CASE."""

    def at(k: int) -> Column:
        n = tree[k]
        if n.feature is None or (stops and n.stop):
            return F.lit(k)
        x = F.col(data)[n.feature]
        return F.when(x <= n.cut if n.inclusive else x < n.cut, at(2 * k)).otherwise(at(2 * k + 1))

    return at(1)


# --- density trees ----------------------------------------------------------------------------


def entropy_term(a: Column, b: Column) -> Column:
    """(a + b) times the entropy of a and b; null where either is 0."""
    part = lambda x: F.when((a > 0) & (b > 0), x * F.log2(x / (a + b)))
    return -(part(a) + part(b))


def find_cuts(values: DataFrame, regions: DataFrame) -> DataFrame:
    """The cut of each region that tells points from virtual ones best: regions with ``cut`` and ``inclusive``.

    ``values``: (node, f, x, c), how often each value occurs. ``regions``: (node, f, lo, hi, in_lo, in_hi, y, n), one a node and feature. Both
    cuts at a value, before and after it, are tried where both sides have points of either kind; of equal gains the first in order counts. Regions without such a cut have none.

    Running counts are sums of stretches of a region first, then within a stretch, so that no task holds a whole feature.
    """
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    inside = ((x > lo) | ((x == lo) & F.col("in_lo"))) & ((x < hi) | ((x == hi) & F.col("in_hi")))
    rows = values.join(regions, ["node", "f"]).filter(inside & (hi > lo))
    rows = rows.withColumn("s", F.least(F.floor((x - lo) / (hi - lo) * STRETCHES), F.lit(STRETCHES - 1)).cast("int"))
    sums = rows.groupBy("node", "f", "s").agg(F.sum("c").alias("t")).withColumn("start", F.coalesce(F.sum("t").over(W.partitionBy("node", "f").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("t")
    within = W.partitionBy("node", "f", "s").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(sums, ["node", "f", "s"]).withColumn("before", F.coalesce(F.sum("c").over(within), F.lit(0)) + F.col("start"))
    n_left = F.floor((x - lo) * F.col("n") / (hi - lo))
    sides = F.explode(F.array(F.struct(F.lit(False).alias("inclusive"), F.col("before").alias("left")), F.struct(F.lit(True).alias("inclusive"), (F.col("before") + F.col("c")).alias("left"))))
    tried = rows.withColumn("n_left", n_left).select("node", "f", "x", "y", "n", "n_left", sides.alias("side")).select("*", "side.*")
    left = entropy_term(F.col("left").cast("double"), F.col("n_left").cast("double"))
    right = entropy_term((F.col("y") - F.col("left")).cast("double"), (F.col("n") - F.col("n_left")).cast("double"))
    gain = F.round(-(left + right) / (F.col("y") + F.col("n")), 12)
    found = tried.filter(gain.isNotNull()).groupBy("node", "f").agg(F.min(F.struct((-gain).alias("g"), "x", "inclusive")).alias("b"))
    return regions.join(found.select("node", "f", F.col("b.x").alias("cut"), "b.inclusive"), ["node", "f"])


def with_counts(values: DataFrame, regions: DataFrame) -> DataFrame:
    """Points (y) and virtual points (n) in each region, and their ratio; virtual ones by its share of the node's bounds (a, b, total), at least as many as points."""
    x = F.col("x")
    inside = ((x > F.col("lo")) | ((x == F.col("lo")) & F.col("in_lo"))) & ((x < F.col("hi")) | ((x == F.col("hi")) & F.col("in_hi")))
    keys = ["node", "f", "side"]
    y = values.join(regions.select(*keys, "lo", "hi", "in_lo", "in_hi"), ["node", "f"]).filter(inside).groupBy(*keys).agg(F.sum("c").alias("y"))
    n = F.floor((F.col("hi") - F.col("lo")) * F.col("total") / (F.col("b") - F.col("a")))
    counted = regions.join(y, keys, "left").fillna(0, ["y"]).withColumn("n", F.greatest("y", n))
    return counted.withColumn("rd", F.when(F.col("n") > 0, F.col("y") / F.col("n")).otherwise(F.lit(float("nan"))))


REGION = ["lo", "hi", "in_lo", "in_hi"]


def halves(rows: DataFrame, pairs: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Two regions a row: (side, lo, hi, in_lo, in_hi) as SQL."""
    each = ", ".join(f"struct({side} as side, cast({lo} as double) as lo, cast({hi} as double) as hi, {a} as in_lo, {b} as in_hi)" for side, lo, hi, a, b in pairs)
    return rows.withColumn("__h", F.explode(F.expr(f"array({each})"))).select("node", "f", "a", "b", "total", "__h.*")


def density_cuts(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, f, cut, inclusive, rd): the cut of each node and feature after looking ahead.

    The first cut parts the node; the second parts its sparser side. Where the part of that next to the first cut is the denser one, the second cut
    stands, with the density of the sparser part beyond. Otherwise the third cut parts the sparser of the two parts, and the least density of
    the regions between it and the first two is its own. A sparser side without points ends at the first cut. ``nodes``: (node, f, a, b, y, total).
    """
    whole = nodes.select("node", "f", "a", "b", "total", "y", F.col("total").alias("n"), F.col("a").alias("lo"), F.col("b").alias("hi"), F.lit(True).alias("in_lo"), F.lit(True).alias("in_hi"))
    one = staged(find_cuts(values, whole).select("node", "f", "a", "b", "total", "cut", "inclusive"), "density-one")
    sides = with_counts(values, halves(one, [("0", "a", "cut", "true", "inclusive"), ("1", "cut", "b", "not inclusive", "true")]))

    def sparser(rows: DataFrame) -> DataFrame:
        """The region of less density of each pair; not a number counts as not less, of equal ones the second."""
        both = rows.groupBy("node", "f").agg(F.max(F.when(F.col("side") == 0, F.struct(*REGION, "y", "n", "rd", "side"))).alias("p"), F.max(F.when(F.col("side") == 1, F.struct(*REGION, "y", "n", "rd", "side"))).alias("q"))
        less = ~F.isnan("p.rd") & ~F.isnan("q.rd") & (F.col("p.rd") < F.col("q.rd"))
        return both.withColumn("l", F.when(less, F.col("p")).otherwise(F.col("q"))).withColumn("r", F.when(less, F.col("q")).otherwise(F.col("p")))

    first = staged(sparser(sides).join(one, ["node", "f"]), "density-sides")
    ended = first.filter("l.y = 0").select("node", "f", "cut", "inclusive", F.col("l.rd").alias("rd"))
    going = first.filter("l.y > 0").select("node", "f", "a", "b", "total", F.col("cut").alias("cut1"), F.col("inclusive").alias("inc1"), F.col("l.side").alias("side1"), "l.*")
    two = staged(find_cuts(values, going.drop("rd", "side")).select("node", "f", "a", "b", "total", "cut1", "inc1", "side1", *REGION, "cut", "inclusive"), "density-two")
    parts = sparser(with_counts(values, halves(two, [("0", "lo", "cut", "in_lo", "inclusive"), ("1", "cut", "hi", "not inclusive", "in_hi")])))
    second = staged(parts.join(two.select("node", "f", "a", "b", "total", "cut1", "inc1", "side1", F.col("cut").alias("cut2"), F.col("inclusive").alias("inc2")), ["node", "f"]), "density-parts")
    # next to the first cut lies the second part of a left side, and the first part of a right side
    stands = ~F.isnan("p.rd") & ~F.isnan("q.rd") & F.when(F.col("side1") == 0, F.col("q.rd") > F.col("p.rd")).otherwise(F.col("p.rd") > F.col("q.rd"))
    second_ended = second.filter(stands).select("node", "f", F.col("cut2").alias("cut"), F.col("inc2").alias("inclusive"), F.least("p.rd", "q.rd").alias("rd"))
    last = second.filter(~stands & (F.col("l.y") > 0)).select("node", "f", "a", "b", "total", "cut1", "inc1", "cut2", "inc2", "l.*")
    three = find_cuts(values, last.drop("rd", "side")).select("node", "f", "a", "b", "total", "cut1", "inc1", "cut2", "inc2", "cut", "inclusive")
    three = staged(three, "density-three")
    between = lambda side, c, i: (str(side), f"least({c}, cut)", f"greatest({c}, cut)", f"not if({c} < cut, {i}, inclusive)", f"if({c} < cut, inclusive, {i})")
    least = with_counts(values, halves(three, [between(0, "cut1", "inc1"), between(1, "cut2", "inc2")])).groupBy("node", "f").agg(F.min("rd").alias("rd"))
    third = three.join(least, ["node", "f"]).select("node", "f", "cut", "inclusive", "rd")
    return ended.unionByName(second_ended).unionByName(third)


def density_tree(points: DataFrame, features: list[int], least: int, depth: int) -> dict[int, Node]:
    """The tree by heap place: each open node is cut where the sparsest region over all features is told apart.

    A level is a fixed number of aggregations over its nodes' values, whatever their number; what comes to the driver is one row a node and
    feature. Nodes of ``least`` points or fewer, and those without a cut, are leaves. A node's virtual points are at least its points; children
    share them by width. Null vectors are left out; no points give one empty leaf.
    """
    points = points.filter("data is not null")
    ends = points.agg(F.count("*").alias("y"), *[g(F.col("data")[f]).alias(f"{k}{f}") for f in features for k, g in (("lo", F.min), ("hi", F.max))]).first()
    tree = {1: Node(ends["y"], ends["y"], {f: (ends[f"lo{f}"], ends[f"hi{f}"]) for f in features})}
    for level in range(depth):
        open_ = {k: n for k, n in tree.items() if n.level == level and n.y > least}
        if not open_:
            break
        rows = [(k, f, float(n.bounds[f][0]), float(n.bounds[f][1]), n.y, max(n.n, n.y)) for k, n in open_.items() for f in features if n.bounds[f][1] > n.bounds[f][0]]
        if not rows:
            break
        nodes = points.sparkSession.createDataFrame(rows, "node int, f int, a double, b double, y long, total long")
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col("data")[f].alias("x")) for f in features]))
        here = points.select(routed(tree).alias("node"), each.alias("e"))
        here = here.filter(F.col("node").isin(list(open_))).groupBy("node", "e.f", "e.x").agg(F.count("*").alias("c"))
        found = density_cuts(staged(here, "density-values"), nodes).filter(~F.isnan("rd"))
        best = found.groupBy("node").agg(F.min(F.struct("rd", "f", "cut", "inclusive")).alias("b")).select("node", "b.*").collect()  # one row a node
        if not best:
            break
        for r in best:
            n, f = tree[r["node"]], r["f"]
            n.feature, n.cut, n.inclusive, n.n = f, r["cut"], r["inclusive"], max(n.n, n.y)
        left = children(points, tree, [r["node"] for r in best])
        for r in best:
            k, n = r["node"], tree[r["node"]]
            lo, hi = n.bounds[n.feature]
            share = int((n.cut - lo) * n.n / (hi - lo))
            tree[2 * k] = Node(left.get(k, 0), share, n.bounds | {n.feature: (lo, n.cut)}, level + 1)
            tree[2 * k + 1] = Node(n.y - left.get(k, 0), n.n - share, n.bounds | {n.feature: (n.cut, hi)}, level + 1)
    return tree


def children(points: DataFrame, tree: dict[int, Node], places: list[int]) -> dict[int, int]:
    """Points on the left side of each of these nodes, whose children aren't in the tree yet."""
    grown = tree | {c: Node(0, 0, {}) for k in places for c in (2 * k, 2 * k + 1)}
    rows = points.select(routed(grown).alias("node")).groupBy("node").agg(F.count("*").alias("y")).collect()  # one row a leaf
    return {r["node"] // 2: r["y"] for r in rows if r["node"] // 2 in places and r["node"] % 2 == 0}


def prune(tree: dict[int, Node], least_share: float, least_density: float) -> dict[int, Node]:
    """Mark where regions end, and number them from 1, left to right; sparse ones get 0.

    A child of fewer points than the share of all is empty. A branch ends the region itself if both children are empty (then it is empty too),
    if its empty child is denser than ``least_density``, or if both children are whole regions.
    """
    least = int(least_share * tree[1].y)
    for n in tree.values():
        n.stop, n.empty, n.label = False, False, -1

    def mark(k: int) -> None:
        n = tree[k]
        if n.feature is None:
            n.stop = True
            return
        pair = tree[2 * k], tree[2 * k + 1]
        few = [c.y < least for c in pair]
        for j in (0, 1):
            if few[j]:
                pair[j].stop = pair[j].empty = True
            else:
                mark(2 * k + j)
        if all(few):
            n.stop = n.empty = True
        elif any(few):
            n.stop = pair[few.index(True)].density > least_density
        else:
            n.stop = all(c.stop and not c.empty for c in pair)

    mark(1)
    count, stack = 0, [1]
    while stack:
        k = stack.pop()
        n = tree[k]
        if n.stop:
            count += not n.empty
            n.label = 0 if n.empty else count
        else:
            stack += [2 * k + 1, 2 * k]
    return tree


def region_rows(tree: dict[int, Node]) -> list[tuple]:
    """(label, points, virtual points, feature, lo, hi) of the regions of a pruned tree, for features that a cut bounds."""
    whole = tree[1].bounds
    out, stack = [], [1]
    while stack:
        k = stack.pop()
        n = tree[k]
        if not n.stop:
            stack += [2 * k + 1, 2 * k]
        elif n.label > 0:
            out += [(n.label, n.y, n.n, f, float(lo), float(hi)) for f, (lo, hi) in sorted(n.bounds.items()) if (lo, hi) != whole[f]] or [(n.label, n.y, n.n, None, None, None)]
    return out


# --- random cluster trees -------------------------------------------------------------------------


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with a mirrored border."""
    reach = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    padded = np.pad(x, reach, mode="symmetric") if len(x) >= reach else np.pad(x, reach, mode="edge")
    return np.convolve(padded, k / k.sum(), mode="valid")


def valley(counts: np.ndarray, lo: float, hi: float, total: int, least: int, least_density: float) -> tuple[float, float, int] | None:
    """(score, threshold, virtual points to the left) of the best valley of one feature, or None.

    ``counts`` are points in equal stretches of [lo, hi]. For thresholds i < j with enough points on both sides of i and a density between them below ``least_density``,
    the score is the density before i plus that after i, less that between. A valley wider than three stretches is cut at the least of its smoothed
    densities, a narrower one in the middle.
    """
    bins = len(counts)
    step = (hi - lo) / bins
    y = np.cumsum(counts)
    n = np.append((np.arange(1, bins) * total / bins).astype(int), total)
    cuts = lo + step * np.arange(1, bins)
    best = None
    for i in range(bins - 1):
        if y[i] < least or y[-1] - y[i] < least:
            continue
        sides = y[i] / max(n[i], 1) + (y[-1] - y[i]) / max(total - n[i], 1)
        for j in range(i + 1, bins - 1):
            middle = (y[j] - y[i]) / max(n[j] - n[i], 1)
            if middle < least_density and (best is None or sides - middle > best[0]):
                best = (sides - middle, i, j)
    if best is None:
        return None
    score, i, j = best
    if j - i > 3:
        density = np.diff(y[i : j + 1]) / np.maximum(np.diff(n[i : j + 1]), 1)
        cut = cuts[i + int(smooth(density).argmin())]
    else:
        cut = (cuts[i] + cuts[j]) / 2
    return float(score), float(cut), int((cut - lo) * total / (hi - lo))


def random_cluster_tree(points: DataFrame, dims: int, tries: int, thresholds: int, least_share: float, least_density: float, depth: int, seed: int = 5) -> dict[int, Node]:
    """A tree whose nodes try ``tries`` features drawn for each and cut at the best valley of density.

    A level takes two aggregations: the ends of each node's features, then counts in ``thresholds`` + 1 equal stretches between
    them, nodes x tries x (thresholds + 1) rows, over which the driver searches. Nodes without a valley, and those at ``depth`` - 1, are leaves. The
    least number of points of a side is a share of all points. Null vectors are left out.
    """
    points = points.filter("data is not null")
    total = points.count()
    tree = {1: Node(total, total, {})}
    for level in range(depth - 1):
        open_ = {k: n for k, n in tree.items() if n.level == level and n.y > 0}
        if not open_:
            break
        for k, n in open_.items():
            n.features = sorted(int(f) for f in np.random.default_rng((seed, k)).choice(dims, min(tries, dims), replace=False))
        drawn = F.when(F.lit(False), F.array(F.lit(0)))
        for k, n in open_.items():
            drawn = drawn.when(F.col("node") == k, F.lit(n.features))
        here = points.select(routed(tree).alias("node"), "data").filter(F.col("node").isin(list(open_))).select("node", "data", F.explode(drawn).alias("f")).select("node", "f", F.col("data")[F.col("f")].alias("x"))
        ends = here.groupBy("node", "f").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        ends = staged(ends, "cluster-ends")  # nodes x tries rows
        bins = thresholds + 1
        # a value equal to a threshold lies after it
        at = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
        counts = here.join(F.broadcast(ends), ["node", "f"]).filter("hi > lo").groupBy("node", "f", "lo", "hi", at.alias("bin")).agg(F.count("*").alias("c")).collect()
        table: dict[tuple, np.ndarray] = {}
        for r in counts:
            table.setdefault((r["node"], r["f"], r["lo"], r["hi"]), np.zeros(bins, np.int64))[r["bin"]] += r["c"]
        for k, n in open_.items():
            n.n = max(n.n, n.y)
            found = [(v, f) for (node, f, lo, hi), c in sorted(table.items()) if node == k and (v := valley(c, lo, hi, n.n, int(least_share * total), least_density))]
            if found:
                (_, n.cut, share), n.feature = max(found, key=lambda x: x[0][0])
                tree[2 * k], tree[2 * k + 1] = Node(0, share, {}, level + 1), Node(0, n.n - share, {}, level + 1)
        for r in points.select(routed(tree).alias("node")).groupBy("node").agg(F.count("*").alias("y")).collect():  # one row a leaf
            tree[r["node"]].y = r["y"]
        for k, n in open_.items():
            if n.feature is not None and not (tree[2 * k].y and tree[2 * k + 1].y):
                n.feature = None
                del tree[2 * k], tree[2 * k + 1]
    return tree
