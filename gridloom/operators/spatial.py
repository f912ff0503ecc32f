"""A kd-tree over points as a table: one aggregation a level builds it, joins with shrinking bounds search it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.literals import doubles, integers
from gridloom.sources.staging import staged

#: Lower bounds are taken a little lower, so that rounding never hides a point.
SLACK = 1 - 1e-12


@dataclass
class KdTree:
    """``splits``: (dimension, threshold) of each branch by heap place (children of n are 2n and 2n + 1).

    ``points``: (node, chunk, id, data), in leaves; a leaf that can't be split is dealt to chunks.
    ``boxes``: (node, lo, hi) of all nodes, at most 2^(depth + 1). ``leaves``: (node, chunk, n).
    """

    splits: dict[int, tuple[int, float]]
    depth: int
    points: DataFrame
    boxes: DataFrame
    leaves: DataFrame


def place(splits: dict[int, tuple[int, float]], depth: int, data: str = "data") -> Column:
    """The heap place of the leaf that a point falls into; a value equal to a threshold goes right."""
    size = 2 ** (depth + 1)
    dims, cuts = integers(splits.get(n, (-1, 0.0))[0] for n in range(size)), doubles(splits.get(n, (-1, 0.0))[1] for n in range(size))
    step = lambda n, _: F.when(dims[n] >= 0, 2 * n + (F.col(data)[dims[n]] >= cuts[n]).cast("int")).otherwise(n)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step) if splits else F.lit(1)


def kd_splits(points: DataFrame, leaf: int = 256, depth: int = 10) -> dict[int, tuple[int, float]]:
    """Nodes of more than ``leaf`` points are cut at the mean of their dimension of most variance, of equal ones the first.

    One aggregation a level over the points of open nodes; a level's splits (at most 2^level) come to the driver. Nodes of
    equal points stay leaves.
    """
    splits: dict[int, tuple[int, float]] = {}
    for level in range(depth):
        here = points.select(place(splits, depth).alias("node"), "data").filter(F.col("node") >= 2**level)
        each = here.select("node", F.posexplode("data").alias("i", "x")).groupBy("node", "i").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
        widest = each.groupBy("node").agg(F.max("n").alias("n"), F.max(F.struct("var", (-F.col("i")).alias("first"), "mean")).alias("w"))
        found = widest.filter((F.col("n") > leaf) & (F.col("w.var") > 0)).select("node", (-F.col("w.first")).alias("i"), "w.mean").collect()
        if not found:
            break
        splits |= {r["node"]: (r["i"], r["mean"]) for r in found}
    return splits


def kd_tree(points: DataFrame, leaf: int = 256, depth: int = 10, chunk_rows: int = 0) -> KdTree:
    """The tree over (id, data). Points without an identifier or a vector are left out; the points are staged once, by leaf.

    Empty tables give a tree without leaves. Chunks of a leaf have about ``chunk_rows`` rows or those of two leaves, whichever is more: a search queues all chunks for each query.
    """
    points = points.filter("id is not null and data is not null").select("id", "data")
    splits = kd_splits(points, leaf, depth)
    placed = points.withColumn("node", place(splits, depth))
    counts = placed.groupBy("node").agg(F.count("*").alias("n"), F.ceil(F.count("*") / max(2 * leaf, chunk_rows)).cast("int").alias("chunks"))
    chunked = placed.join(F.broadcast(counts.select("node", "chunks")), "node")  # at most 2^depth rows
    kept = staged(chunked.select("node", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), "id", "data").repartition("node", "chunk"), "kd-points")
    ends = kept.select("node", F.posexplode("data").alias("i", "x")).groupBy("node", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    above = F.expr(f"filter(transform(sequence(0, {depth}), k -> shiftright(node, k)), n -> n > 0)")
    ends = ends.select(F.explode(above).alias("node"), "i", "lo", "hi").groupBy("node", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sides = F.array_sort(F.collect_list(F.struct("i", "lo", "hi")))  # one entry a dimension
    boxes = staged(ends.groupBy("node").agg(sides.alias("s")).select("node", F.transform("s", lambda x: x["lo"]).alias("lo"), F.transform("s", lambda x: x["hi"]).alias("hi")), "kd-boxes")
    leaves = staged(kept.groupBy("node", "chunk").agg(F.count("*").alias("n")), "kd-leaves")
    return KdTree(splits, depth, kept, boxes, leaves)


def to_box(q: str = "q") -> Column:
    """Squared distance from a point to the nearest place of a box (lo, hi), rounded down."""
    outside = F.zip_with(F.zip_with("lo", q, lambda lo, x: lo - x), F.zip_with(q, "hi", lambda x, hi: x - hi), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(outside, F.lit(0.0), lambda acc, x: acc + x * x) * SLACK


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query so far; tasks drop what can't be among them before the shuffle."""
    order = W.partitionBy("query").orderBy("d", "id")
    return rows.select("query", "id", "d").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def compared(visits: DataFrame, tree: KdTree, k: int, blocks: int) -> DataFrame:
    """Of each visit (query, q, node, chunk, bound) the k nearest points, as far as they are within the bound, with their squared distances.

    The points of a chunk meet the visits to it in one task; the queries of many visits come in ``blocks``, so what a task holds is bounded.
    """

    def find(key: tuple, asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(points):
            x, own = np.stack([np.asarray(v, float) for v in points["data"]]), points["id"].to_numpy()
            for query, q, bound in zip(asked["query"], asked["q"], asked["bound"], strict=True):
                d = ((x - np.asarray(q, float)) ** 2).sum(axis=1)
                near = np.flatnonzero(d <= (np.inf if pd.isna(bound) else bound))
                near = near[np.lexsort((own[near], d[near]))[:k]]
                out.append((np.full(len(near), query), own[near], d[near]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query", "id", "d"), cols, strict=True)))

    left = visits.select("query", "q", "node", "chunk", "bound", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))
    right = tree.points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["node", "chunk", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(find, "query long, id long, d double")


def kd_search(tree: KdTree, queries: DataFrame, k: int, budget: int = 0, block: int = 16_384) -> DataFrame:
    """(query, id, d, place): the k nearest points of each query (id, data), best leaves first; ties by id.

    Each query first visits the leaf that it falls into. Its k-th distance so far bounds a descent from the root that keeps
    children whose boxes are as near (one join a level, against at most 2^(depth + 1) boxes). What leaves remain are visited
    from the nearest on, four times as many each round; each round's finds shrink the bound that the next one meets.

    ``budget`` 0 is exact. A positive one stops a query after the leaf with which it has been compared to that many points beyond its own
    leaf; a negative one stops after the first leaf. Queries that repeat count once; those without an identifier or a vector are left out.
    """
    asked = queries.filter("id is not null and data is not null").select(F.col("id").alias("query"), F.col("data").alias("q")).dropDuplicates(["query"])
    asked = staged(asked.withColumn("own", place(tree.splits, tree.depth, "q")), "kd-queries")
    boxes = F.broadcast(tree.boxes)  # at most 2^(depth + 1) rows
    first = asked.join(tree.leaves.withColumnRenamed("node", "own"), "own").select("query", "q", F.col("own").alias("node"), "chunk")
    blocks = max(1, -(-asked.count() // block))
    found = staged(best(compared(first.withColumn("bound", F.lit(None).cast("double")), tree, k, blocks), k), "kd-found")
    if budget < 0:
        return found
    bound = lambda: found.groupBy("query").agg(F.when(F.count("*") == k, F.max("d")).alias("bound"))
    near = lambda rows: rows.filter(F.col("bound").isNull() | (F.col("lb") <= F.col("bound")))
    front = asked.join(bound(), "query", "left").withColumn("node", F.lit(1))
    ends = None
    for _ in range(tree.depth + 1):
        front = near(front.join(boxes, "node").withColumn("lb", to_box())).select("query", "q", "own", "bound", "node", "lb")
        inner = F.col("node").isin(list(tree.splits)) if len(tree.splits) <= 64 else F.array_contains(integers(sorted(tree.splits)), F.col("node"))
        done = front.filter(~inner & (F.col("node") != F.col("own"))) if tree.splits else front.limit(0)
        ends = done if ends is None else ends.unionByName(done)
        front = front.filter(inner).withColumn("node", F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1))).drop("lb") if tree.splits else front.limit(0).drop("lb")
    order = W.partitionBy("query").orderBy("lb", "node", "chunk")  # at most the leaves of the tree
    queue = ends.join(F.broadcast(tree.leaves), "node").withColumn("turn", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    queue = staged((queue.filter(F.col("before") < budget) if budget else queue).select("query", "node", "chunk", "lb", "turn"), "kd-queue")
    turns, done, step = queue.agg(F.max("turn")).first()[0] or 0, 0, 1
    while done < turns:
        now = queue.filter((F.col("turn") > done) & (F.col("turn") <= done + step)).join(bound(), "query", "left")
        visits = near(now).join(asked.select("query", "q"), "query")
        found = staged(best(found.select("query", "id", "d").unionByName(compared(visits, tree, k, blocks)), k), "kd-found")
        done, step = done + step, step * 4
    return found
