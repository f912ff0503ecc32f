"""Histogram algebra, kernels and joins of a geometric kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.sources.staging import staged

BIN = ["tree", "idx"]


def union(a: DataFrame, b: DataFrame, key: list[str], sign: float = 1.0) -> DataFrame:
    """Bins of either side, values added (b's times ``sign``): an aggregation, so both sides combine before the shuffle."""
    both = a.select(*key, *BIN, "value").unionByName(b.select(*key, *BIN, (F.col("value") * sign).alias("value")))
    return both.groupBy(*key, *BIN).agg(F.sum("value").alias("value"))


def intersection(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b.withColumnRenamed("value", "other"), [*key, *BIN]).select(*key, *BIN, F.least("value", "other").alias("value"))


def pyramid_match(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Per key the pyramid match kernel of two histograms of trees, normalised, averaged over trees.

    Matches of a level weigh half of those one level deeper; new matches are what a level has beyond the next.
    """
    level = lambda c: F.length(F.bin(c)).cast("int") - 1
    j = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), [*key, *BIN], "full_outer").na.fill(0.0, ["x", "y"])
    j = j.groupBy(*key, "tree", level(F.col("idx")).alias("level")).agg(F.sum("x").alias("xx"), F.sum("y").alias("yy"), F.sum(F.least("x", "y")).alias("xy"))
    w = W.partitionBy(*key, "tree")
    depth = F.max("level").over(w)
    weight = F.pow(F.lit(0.5), depth - F.col("level"))
    deeper = lambda c: F.col(c) - F.coalesce(F.lead(c).over(w.orderBy("level")), F.lit(0.0))
    k = j.select(*key, "tree", *[(F.when(F.col("level") == depth, F.col(c)).otherwise(deeper(c) * weight)).alias(c) for c in ("xx", "yy", "xy")])
    t = k.groupBy(*key, "tree").agg(*[F.sum(c).alias(c) for c in ("xx", "yy", "xy")])
    return t.groupBy(*key).agg(F.avg(F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))).alias("score"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def similarity_upper(df: DataFrame, blocks: int | None = None, within: str | None = None, metric: Callable[[str, str], Column] = dot, keep: tuple[str, ...] = (), block_rows: int = 4096) -> DataFrame:
    """A metric (the dot product) of all pairs id <= other, block against block: each row goes to the blocks that it meets, an equi-join.

    With ``within`` only pairs that agree in that column are formed. There are at least 8 ``blocks``, and as many that one has about ``block_rows`` rows.
    Columns ``keep`` come along for both sides (the other's as name_other), so that what is summed over pairs adds up
    beside the join, before a shuffle. The result has a row for each pair; its size is what is asked for.
    """
    blocks = blocks or max(8, -(-df.count() // block_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    group = [within] if within else []
    left = df.select(F.col("id"), F.col("data"), *group, *keep, own.alias("p")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = df.select(F.col("id").alias("other"), F.col("data").alias("data2"), *group, *[F.col(c).alias(f"{c}_other") for c in keep], own.alias("q")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.join(right, ["p", "q", *group]).filter("id <= other").select("id", "other", *keep, *[f"{c}_other" for c in keep], metric("data", "data2").alias("v"))


def dot_sums(df: DataFrame) -> DataFrame:
    """(label, n, sums): what a label's vectors add to the dot products with any vector, by component.

    Dot products are linear, so the sum of those of many vectors with one is that of their sum with it: one aggregation in place of
    all pairs. Null components count as absent. ``x`` is the sum of a component; ``far`` is the sum of its products with infinity, which
    is what an infinite component of the other vector meets.
    """
    rows = df.groupBy("label").agg(F.count("*").alias("n"))
    each = df.select("label", F.posexplode("data").alias("i", "x")).filter("x is not null").groupBy("label", "i").agg(F.sum("x").alias("x"), F.sum(F.col("x") * float("inf")).alias("far"))
    sums = each.groupBy(F.col("label").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("x", "far")))).alias("m"), F.max("i").alias("last"))  # an entry a component
    sums = sums.select("of", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.try_element_at("m", i)).alias("sums"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def dot_with(sums: str, data: str) -> Column:
    """The sum of the dot products of ``data`` with all the vectors of ``sums``; null where no component meets one."""
    meets = F.filter(F.zip_with(data, sums, lambda x, s: F.struct(x.alias("x"), s.alias("s"))), lambda p: p["x"].isNotNull() & p["s"].isNotNull())
    term = lambda p: F.when(F.abs(p["x"]) == float("inf"), F.signum(p["x"]) * p["s"]["far"]).otherwise(p["x"] * p["s"]["x"])
    return F.when(F.size(meets) > 0, F.aggregate(meets, F.lit(0.0), lambda acc, p: acc + term(p)))


def block_nearest(df: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query the k best of each batch of points."""
    q = queries.select("id", "data").toPandas()
    ids, table = q["id"].to_numpy(), np.stack(q["data"].to_numpy()) if len(q) else np.zeros((0, 1))

    def best(frames):
        for f in frames:
            if not len(f):
                continue
            x, own = np.stack(f["data"].to_numpy()), f["id"].to_numpy()
            for i, v in zip(ids, table, strict=True):
                d = ((x - v) ** 2).sum(axis=1)
                at = np.lexsort((own, d))[:k]
                yield pd.DataFrame({"query": i, "id": own[at], "d": d[at]})

    return df.select("id", "data").mapInPandas(best, "query long, id long, d double")


def nearest(df: DataFrame, queries: DataFrame, k: int, most: int = 10_000) -> DataFrame:
    """The k nearest points of each query, exact; ties by id.

    A block of about ``most`` queries is sent to all tasks; a task gives its k best for each, and the best of those
    are the answer, so only k rows of each query and task are shuffled. More queries go in several blocks, one
    pass over the points each; the finds of a block are staged, so the driver holds one block at a time.
    """
    blocks = max(1, -(-queries.count() // most))
    if blocks == 1:
        found = block_nearest(df, queries, k)
    else:
        block, found = F.pmod(F.xxhash64("id"), F.lit(blocks)), None
        for b in range(blocks):
            part = staged(block_nearest(df, queries.filter(block == b), k), "nearest")
            found = part if found is None else found.unionByName(part)
    place = F.row_number().over(W.partitionBy("query").orderBy("d", "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> float:
    """Least cost to move ``supply`` to ``demand`` (equal sums), by successive cheapest augmenting paths."""
    n, m = cost.shape
    flow = np.zeros((n, m))
    left, need = supply.astype(float).copy(), demand.astype(float).copy()
    while left.sum() > 1e-9:
        dist, back = np.full(n + m, np.inf), np.full(n + m, -1)
        dist[:n][left > 1e-12] = 0
        for _ in range(n + m):
            to = dist[:n, None] + cost
            best, who = to.min(axis=0), to.argmin(axis=0)
            better = best < dist[n:] - 1e-12
            dist[n:][better], back[n:][better] = best[better], who[better]
            rev = np.where(flow > 1e-12, dist[None, n:] - cost, np.inf)
            best, who = rev.min(axis=1), rev.argmin(axis=1)
            again = best < dist[:n] - 1e-12
            dist[:n][again], back[:n][again] = best[again], n + who[again]
            if not better.any() and not again.any():
                break
        end = n + int(np.where(need > 1e-12, dist[n:], np.inf).argmin())
        path, at = [], end
        while back[at] >= 0:
            path.append((int(back[at]), at))
            at = int(back[at])
        amount = min(left[at], need[end - n], *[flow[b, a - n] for a, b in path if a >= n])
        for a, b in path:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[at] -= amount
        need[end - n] -= amount
    return float((flow * cost).sum())


def earth_movers(x: list[float], wx: list[float], y: list[float], wy: list[float]) -> float:
    """Earth mover's distance of two weighted sets on a line, by the general solver; surplus mass is free."""
    a, b = np.asarray(wx, float), np.asarray(wy, float)
    cost = np.abs(np.asarray(x, float)[:, None] - np.asarray(y, float)[None])
    if a.sum() > b.sum():
        cost, b = np.hstack([cost, np.zeros((len(a), 1))]), np.append(b, a.sum() - b.sum())
    elif b.sum() > a.sum():
        cost, a = np.vstack([cost, np.zeros((1, len(b)))]), np.append(a, b.sum() - a.sum())
    return transport(cost, a, b) / min(sum(wx), sum(wy))


def box_blocks(boxes: DataFrame, most: int) -> DataFrame:
    """Boxes (id, x0, y0, x1, y1), none of them null, as rows of up to ``most``, near each other in ``x0`` and sorted by ``y0``, with the bounds of all."""
    names = ["id", "x0", "y0", "x1", "y1"]

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by("y0").combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), pa.array(t.column(c).to_numpy())) for c in names]
        ends = [pa.array([float(f(t.column(c).to_numpy()))]) for c, f in zip(names[1:], (np.min, np.min, np.max, np.max), strict=True)]
        return pa.RecordBatch.from_arrays([*lists, *ends], [*names, "left", "top", "right", "bottom"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, most - n)
                held.append(part)
                n, b = n + part.num_rows, b.slice(part.num_rows)
                if n == most:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    near = boxes.select(*names).repartitionByRange("x0").sortWithinPartitions("x0")
    return near.mapInArrow(run, "id array<long>, x0 array<double>, y0 array<double>, x1 array<double>, y1 array<double>, left double, top double, right double, bottom double")


def overlapping(boxes: DataFrame, most: int = 8192) -> DataFrame:
    """Pairs of boxes (id, x0, y0, x1, y1) whose overlap is above half of what they cover together: (id, other, iou), the lower id first.

    Boxes are packed into blocks, which are written; blocks whose bounds meet are held against each other, one pair of blocks after
    the other in a task. An overlap above a half needs one in each axis, which bounds where the other box may begin. Boxes with a null or without finite ends give no pairs.
    """
    ends = ["x0", "y0", "x1", "y1"]
    whole = boxes.filter("id is not null").filter(" and ".join(f"abs({c}) < double('infinity')" for c in ends))
    blocks = staged(box_blocks(whole, most).withColumn("block", F.monotonically_increasing_id()), "boxes")
    bounds = ["block", "left", "top", "right", "bottom"]
    a, b = blocks.select(*bounds), blocks.select(*[F.col(c).alias(f"{c}_") for c in bounds])
    meet = staged(a.join(b, F.expr("block <= block_ and left <= right_ and left_ <= right and top <= bottom_ and top_ <= bottom")).select("block", "block_"), "blocks")
    first = blocks.select("block", "id", *ends)
    second = first.select(*[F.col(c).alias(f"{c}_") for c in first.columns])
    both = meet.join(first.hint("merge"), "block").join(second.hint("merge"), "block_").repartition(max(meet.count(), 1), "block", "block_")  # about one pair of blocks a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = lambda c, batch=batch, k=k: batch.column(batch.schema.get_field_index(c))[k].values.to_numpy()
                same = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                i1, x0, y0, x1, y1 = (at(c) for c in ("id", *ends))
                i2, u0, v0, u1, v1 = (at(f"{c}_") for c in ("id", *ends))
                s, t, h = (x1 - x0) * (y1 - y0), (u1 - u0) * (v1 - v0), y1 - y0
                low, high = np.searchsorted(v0, y0 - h * (1 + 1e-9)), np.searchsorted(v0, y0 + h * (0.5 + 1e-9), "right")
                low = np.maximum(low, np.arange(1, len(low) + 1)) if same else low
                found, n = [], 0
                for j in np.flatnonzero(low < high):
                    w = slice(low[j], high[j])
                    inter = np.maximum(np.minimum(u1[w], x1[j]) - np.maximum(u0[w], x0[j]), 0.0)
                    inter *= np.minimum(v1[w], y1[j]) - np.maximum(v0[w], y0[j])
                    hit = np.flatnonzero(inter * 3.0000001 > t[w] + s[j])  # wide; the exact test follows
                    if len(hit):
                        v = inter[hit]
                        found.append((np.full(len(hit), i1[j]), i2[w][hit], v / (s[j] + t[w][hit] - v)))
                        n += len(hit)
                    if n >= 1 << 16:
                        yield chosen(found)
                        found, n = [], 0
                if found:
                    yield chosen(found)

    def chosen(found: list) -> pa.RecordBatch:
        p, q, iou = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = (iou > 0.5) & (p != q)
        p, q = p[keep], q[keep]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(p, q), np.maximum(p, q), iou[keep])], ["id", "other", "iou"])

    return both.select("block", "block_", "id", *ends, "id_", *[f"{c}_" for c in ends]).mapInArrow(run, "id long, other long, iou double")
