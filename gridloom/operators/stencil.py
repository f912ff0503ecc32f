"""Neighbourhood operators over tall rasters.

Work along one axis brings a line (a row or a column of one image) together as an array: one
shuffle per axis, whatever the kernel's length. Two-dimensional neighbourhoods send each cell's weighted
value to the cells that it reaches and add up there, so partial sums are made before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def integral(df: DataFrame) -> DataFrame:
    """Sums over all cells above and to the left, with a zero row and column in front."""
    along = W.partitionBy("image_id", "r").orderBy("c").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("image_id", "c").orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    sums = df.withColumn("v", F.sum("v").over(along)).withColumn("v", F.sum("v").over(down))
    inner = sums.select("image_id", (F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"), "v")
    size = df.groupBy("image_id").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("columns"))
    edge = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("columns")), lambda c: F.struct(F.lit(0).alias("r"), c.alias("c"))),
        F.transform(F.sequence(F.lit(1), F.col("rows")), lambda r: F.struct(r.alias("r"), F.lit(0).alias("c"))),
    )
    border = size.select("image_id", F.explode(edge).alias("e")).select("image_id", "e.r", "e.c", F.lit(0.0).alias("v"))
    return inner.unionByName(border)


def integral_packed(images: DataFrame) -> DataFrame:
    """Packed images (image_id, data, rows, columns) with ``integral``: the same sums, row by row in one array. Null cells count as 0."""
    last = lambda a, back: F.element_at(a, -back)
    zeros = F.array_repeat(F.lit(0.0), (F.col("columns") + 1).cast("int"))

    def line(r: Column) -> Column:
        cells = F.slice("data", (r * F.col("columns") + 1).cast("int"), F.col("columns").cast("int"))
        return F.aggregate(cells, F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(last(a, F.lit(1)) + F.coalesce(x, F.lit(0.0)))))

    above = lambda table: F.slice(table, -(F.col("columns") + 1).cast("int"), (F.col("columns") + 1).cast("int"))
    down = F.aggregate(F.sequence(F.lit(0), (F.col("rows") - 1).cast("int")), zeros, lambda table, r: F.concat(table, F.zip_with(above(table), line(r), lambda x, y: x + y)))
    return images.select("image_id", "rows", "columns", down.alias("integral"))


def rectangle_sums(table: DataFrame, rectangles: DataFrame, rows: int, columns: int) -> DataFrame:
    """Sums over ``rectangles`` (key, image_id, r0, c0, height, width), cut to the image, at least one cell: four lookups."""
    clamp = lambda x, top: F.greatest(F.least(x, F.lit(top)), F.lit(0))
    top, left = clamp(F.col("r0"), rows - 1), clamp(F.col("c0"), columns - 1)
    bottom, right = F.greatest(clamp(F.col("r0") + F.col("height"), rows), top + 1), F.greatest(clamp(F.col("c0") + F.col("width"), columns), left + 1)
    corner = lambda r, c, s: F.struct(r.alias("r"), c.alias("c"), F.lit(s).alias("s"))
    corners = F.array(corner(bottom, right, 1), corner(top, right, -1), corner(bottom, left, -1), corner(top, left, 1))
    wanted = rectangles.withColumn("k", F.explode(corners)).select("key", "image_id", "k.r", "k.c", "k.s")
    return wanted.join(table, ["image_id", "r", "c"]).groupBy("key", "image_id").agg(F.sum(F.col("s") * F.col("v")).alias("v"))


def lines(df: DataFrame, axis: str) -> DataFrame:
    other = "c" if axis == "r" else "r"
    return df.groupBy("image_id", other).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, "v"))), lambda x: x["v"]).alias("line"))


def mirrored(i: Column, n: Column) -> Column:
    """-1 is 0, -2 is 1, n is n - 1 (the edge is repeated)."""
    return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)


def clamped(i: Column, n: Column) -> Column:
    return F.greatest(F.least(i, n - 1), F.lit(0))


def convolved(df: DataFrame, kernel: list[float], axis: str, border=clamped, step: int = 1) -> DataFrame:
    """Weighted sums along an axis, the kernel centred on each ``step``-th cell."""
    half, other = len(kernel) // 2, "c" if axis == "r" else "r"
    n = F.size("line")

    def at(i: Column) -> Column:
        return sum((F.get("line", border(i + (k - half), n)) * w for k, w in enumerate(kernel)), F.lit(0.0))

    return lines(df, axis).select("image_id", other, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), at)).alias(axis, "v"))


def separable(df: DataFrame, kernel: list[float], border=clamped, step: int = 1) -> DataFrame:
    return convolved(convolved(df, kernel, "c", border, step), kernel, "r", border, step)


def separable_many(df: DataFrame, kernel: list[float], values: list[str], border=clamped) -> DataFrame:
    """As separable, for several values of a cell together: their lines are made by one shuffle for each axis."""
    half = len(kernel) // 2
    for axis, other in (("c", "r"), ("r", "c")):
        line = F.array_sort(F.collect_list(F.struct(axis, *values)))

        def at(i: Column) -> Column:
            near = [(F.get("line", border(i + (k - half), F.size("line"))), w) for k, w in enumerate(kernel)]
            return F.struct(*[sum((x[v] * w for x, w in near), F.lit(0.0)).alias(v) for v in values])

        df = df.groupBy("image_id", other).agg(line.alias("line")).select("image_id", other, F.posexplode(F.transform(F.sequence(F.lit(0), F.size("line") - 1), at)).alias(axis, "s")).select("image_id", other, axis, "s.*")
    return df


def half_kernel(half: list[float]) -> list[float]:
    """The full symmetric kernel whose centre and right side are ``half``."""
    return [*half[:0:-1], *half]


def gaussian_kernel(sigma: float, width: int | None = None) -> list[float]:
    n = width if width is not None else math.ceil(3 * sigma)
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-n, n + 1)]
    return [x / sum(raw) for x in raw]


def scale_space(df: DataFrame, side: int, levels: int, least: int = 64, sigma: float = 1.6) -> DataFrame:
    """(octave, level, image_id, r, c, v). The first level of the first octave is the source blurred by ``sigma``.

    The next octave's is that blurred by 2 sigma and halved, while both sides are at least ``least``. Each further level
    blurs the one before it, by sigma * m, sigma * m ** 2, ..., m = sqrt(2 ** (2 / levels) - 1).
    """
    base, octave, parts = separable(df, gaussian_kernel(sigma)), 0, []
    m = math.sqrt(2 ** (2 / levels) - 1)
    while side >= least:
        at = base
        for k in range(levels):
            at = at if k == 0 else separable(at, gaussian_kernel(sigma * m**k))
            parts.append(at.select(F.lit(octave).alias("octave"), F.lit(k).alias("level"), "image_id", "r", "c", "v"))
        base = separable(base, gaussian_kernel(2 * sigma), clamped, 2)
        side, octave = (side + 1) // 2, octave + 1
    return reduce(DataFrame.unionByName, parts)


def stencil2d(df: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """A two-dimensional kernel, for the cells where all of it is inside the image."""
    h, w = len(kernel), len(kernel[0])
    taps = F.array(*[F.struct(F.lit(i - h // 2).alias("dr"), F.lit(j - w // 2).alias("dc"), F.lit(float(kernel[i][j])).alias("w")) for i in range(h) for j in range(w)])
    sent = df.withColumn("t", F.explode(taps)).select("image_id", (F.col("r") - F.col("t.dr")).alias("r"), (F.col("c") - F.col("t.dc")).alias("c"), (F.col("v") * F.col("t.w")).alias("v"))
    return sent.groupBy("image_id", "r", "c").agg(F.sum("v").alias("v"), F.count("*").alias("n")).filter(F.col("n") == h * w).drop("n")


def gradient(df: DataFrame) -> DataFrame:
    """Central differences, not halved, one-sided at the border; magnitude and direction in [0, 2 pi)."""

    def difference(axis: str) -> Column:
        other = "c" if axis == "r" else "r"
        w = W.partitionBy("image_id", other).orderBy(axis)
        v = F.col("v")
        return F.coalesce(F.lead("v").over(w), v) - F.coalesce(F.lag("v").over(w), v)

    out = df.select("image_id", "r", "c", difference("c").alias("gx"), difference("r").alias("gy"))
    angle = F.atan2("gy", "gx")
    return out.withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).withColumn("direction", F.when(angle < 0, angle + 2 * math.pi).otherwise(angle))


def moments(g: DataFrame) -> DataFrame:
    return g.select("image_id", "r", "c", (F.col("gx") * F.col("gx")).alias("xx"), (F.col("gy") * F.col("gy")).alias("yy"), (F.col("gx") * F.col("gy")).alias("xy"))


def eigensystem(m: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Eigenvalues (twice the true ones, by convention) and unit eigenvectors of the blurred moments."""
    df = separable_many(m, gaussian_kernel(sigma), ["xx", "yy", "xy"])
    root = F.sqrt(4 * F.col("xy") * F.col("xy") + (F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")))
    df = df.withColumn("l1", F.col("xx") + F.col("yy") + root).withColumn("l2", F.col("xx") + F.col("yy") - root)
    angle = F.atan2(F.col("l1") / 2 - F.col("xx"), F.col("xy"))
    return df.withColumn("x1", F.cos(angle)).withColumn("y1", F.sin(angle)).withColumn("x2", -F.sin(angle)).withColumn("y2", F.cos(angle))


def gradient_packed(images: DataFrame) -> DataFrame:
    """Packed images (image_id, data, rows, columns) with ``gradient``: an array of (gx, gy, magnitude), row by row."""
    n, at = F.col("columns"), lambda i: F.get("data", i.cast("int"))

    def differences(i: Column) -> Column:
        c, v = i % n, at(i)
        right, left = F.coalesce(F.when(c < n - 1, at(i + 1)), v), F.coalesce(F.when(c > 0, at(i - 1)), v)
        return F.struct((right - left).alias("gx"), (F.coalesce(at(i + n), v) - F.coalesce(F.when(i >= n, at(i - n)), v)).alias("gy"))

    g = F.transform(F.sequence(F.lit(0), F.size("data") - 1), differences)
    magnitude = lambda x: F.sqrt(x["gx"] * x["gx"] + x["gy"] * x["gy"])
    return images.withColumn("g", g).withColumn("g", F.transform("g", lambda x: F.struct(x["gx"].alias("gx"), x["gy"].alias("gy"), magnitude(x).alias("magnitude"))))


def thinned(g: DataFrame) -> DataFrame:
    """Non-maximal suppression: a cell stays if its magnitude is above both values interpolated along its gradient.

    Of packed gradients (see ``gradient_packed``), so that cells meet their neighbours without a sort of cells: an array of (magnitude, keep) a row.
    """
    n = F.col("columns")

    def keep(x: Column, i: Column) -> Column:
        ax, ay = F.abs(x["gx"]), F.abs(x["gy"])
        t = F.coalesce(F.try_divide(F.least(ax, ay), F.greatest(ax, ay)), F.lit(0.0))
        flat, same = ax >= ay, x["gx"] * x["gy"] >= 0

        def near(dr: int, dc: int) -> Column:
            c = i % n + dc
            return F.when((c >= 0) & (c < n) & (i + n * dr >= 0), F.get("g", (i + n * dr + dc).cast("int"))["magnitude"])

        straight = lambda a, b: F.when(flat, near(*a)).otherwise(near(*b))
        diagonal = lambda a, b: F.when(same, near(*a)).otherwise(near(*b))
        ahead = straight((0, 1), (1, 0)) * (1 - t) + F.when(flat, diagonal((1, 1), (-1, 1))).otherwise(diagonal((1, 1), (1, -1))) * t
        behind = straight((0, -1), (-1, 0)) * (1 - t) + F.when(flat, diagonal((-1, -1), (1, -1))).otherwise(diagonal((-1, -1), (-1, 1))) * t
        return F.coalesce((x["magnitude"] > ahead) & (x["magnitude"] >= behind), F.lit(False))

    thin = F.transform("g", lambda x, i: F.struct(x["magnitude"].alias("magnitude"), keep(x, i).alias("keep")))
    return g.select("image_id", "rows", "columns", thin.alias("thin"))


def linked(images: DataFrame) -> DataFrame:
    """Cells (image_id, r, c) of the lists ``weak`` (cell numbers) that a path of neighbouring weak cells joins to one of the lists ``strong``.

    One list is an image's; each of its cells is visited once, and images meet in no join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, cells, wide = [], [], b.column(3).to_pylist()
            for k, (weak, edge, n) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), wide, strict=True)):
                left = set(weak).difference(edge)
                for i in edge:  # grows as it goes
                    c = i % n
                    for j in [i + dr * n + dc for dr in (-1, 0, 1) for dc in (-1, 0, 1) if 0 <= c + dc < n]:
                        if j in left:
                            left.remove(j)
                            edge.append(j)
                of += [k] * len(edge)
                cells += edge
            at, n = np.array(cells, np.int32), np.array(wide, np.int32)[of] if of else np.ones(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int32())), pa.array(at // n), pa.array(at % n)], ["image_id", "r", "c"])

    return images.select("image_id", "weak", "strong", F.col("columns").cast("int")).mapInArrow(run, "image_id long, r int, c int")


def neighbours8(df: DataFrame, *cols: str) -> DataFrame:
    """Each cell once for each of its 8 neighbours' places (and its own)."""
    around = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("o", F.explode(around)).select("image_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), *cols)


def connected(cells: DataFrame, columns: int, save=None) -> DataFrame:
    """8-connected components of ``cells`` (image_id, r, c): each cell with its component's least cell number.

    In each round only cells whose label fell in the round before tell their neighbours, and labels jump to their label's label where
    that fell; images without a change are complete and left out of further rounds. Each round's table of the images still open is
    written (``save``), so lineage stays short. All joins merge sorted sides: tables of cells or images don't pass through the driver.
    """
    save = save or (lambda df: df)
    cell, number = ["image_id", "r", "c"], F.col("r") * columns + F.col("c")
    labels, moved, complete = save(cells.select(*cell, number.alias("label"), F.lit(True).alias("fell"))), None, []
    while True:
        moved = labels.filter("fell") if moved is None else moved
        near = neighbours8(moved, "label").groupBy(*cell).agg(F.min("label").alias("near"))
        spread = labels.join(near.hint("merge"), cell, "left").select(*cell, "label", "fell", F.coalesce(F.least("label", "near"), "label").alias("near"))
        jump = spread.filter("fell or near < label").select("image_id", number.alias("near"), F.col("near").alias("beyond"))
        new = save(spread.join(jump.hint("merge"), ["image_id", "near"], "left").select(*cell, F.col("label").alias("old"), F.least("near", F.coalesce("beyond", "near")).alias("label")))
        new, moved = new.select(*cell, "label", (F.col("label") < F.col("old")).alias("fell")), new.filter("label < old").select(*cell, "label")
        if moved.isEmpty():
            complete.append(new)
            break
        images = moved.select("image_id").distinct().hint("merge")
        complete.append(new.join(images, "image_id", "left_anti"))
        labels = new.join(images, "image_id", "left_semi")
    out = complete[0]
    for part in complete[1:]:
        out = out.unionByName(part)
    return out.select(*cell, "label")


def envelope(found: Column, c: Column, rows: int) -> Column:
    """Which of the cells ``found`` (array of (r, nc), by r) is nearest to column ``c`` in each row: an array of (r, nc, s), each from row ``s`` on.

    The lower envelope of their parabolas. A cell beats all before it from some row on, so those that it ousts are the
    last ones, and where they begin is found by bisection: n log n steps for n cells. Of equally near cells the upper one stays.
    """
    far = lambda x, r: (x["r"] - r) * (x["r"] - r) + (x["nc"] - c) * (x["nc"] - c)
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(rows.bit_length()))])
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def add(stack: Column, q: Column) -> Column:
        def stays(i: Column) -> Column:
            return once(F.get(stack, i), lambda x: far(x, x["s"]) <= far(q, x["s"]))

        def start(m: Column) -> Column:
            begins = lambda top: F.floor((far(q, 0) - far(top, 0)) / (2 * (q["r"] - top["r"]))).cast("int") + 1
            return F.when(m == 0, 0).otherwise(once(F.get(stack, m - 1), begins))

        kept = F.aggregate(halves, F.lit(0), lambda m, b: F.when(m + b > F.size(stack), m).when(stays(m + b - 1), m + b).otherwise(m))
        place = once(kept, lambda m: F.struct(m.alias("m"), start(m).alias("s")))
        new = lambda p: F.array(F.struct(q["r"].cast("int").alias("r"), q["nc"].cast("int").alias("nc"), p["s"].alias("s")))
        return once(place, lambda p: F.when(p["s"] < rows, F.concat(F.slice(stack, F.lit(1), p["m"]), new(p))).otherwise(stack))

    return F.aggregate(found, F.array().cast("array<struct<r:int,nc:int,s:int>>"), add)


def distance_transform(cells: DataFrame, size: DataFrame, rows: int, columns: int) -> DataFrame:
    """Squared Euclidean distance of every cell to the nearest true one, and that one (least row, then column).

    In two passes: the nearest true cell within each row by running windows, then within each
    column the lower envelope of that column's rows. ``cells``: (image_id, r, c, v boolean).
    """
    w = W.partitionBy("image_id", "r").orderBy("c")
    left = F.last(F.when(F.col("v"), F.col("c")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    right = F.first(F.when(F.col("v"), F.col("c")), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    near = cells.withColumn("left", left).withColumn("right", right)
    at = F.when(F.col("right").isNull() | (F.col("c") - F.col("left") <= F.col("right") - F.col("c")), F.col("left")).otherwise(F.col("right"))
    near = near.withColumn("nc", at).select("image_id", "r", "c", "nc")
    column = near.groupBy("image_id", "c").agg(F.array_sort(F.collect_list(F.when(F.col("nc").isNotNull(), F.struct("r", "nc")))).alias("found"))
    spans = column.select("image_id", "c", envelope(F.col("found"), F.col("c"), rows).alias("spans"))
    span = spans.select("image_id", "c", "spans", F.posexplode("spans").alias("i", "x"))
    end = F.coalesce(F.get("spans", F.col("i") + 1)["s"], F.lit(rows)) - 1
    grid = span.select("image_id", F.explode(F.sequence("x.s", end)).alias("r"), "c", F.col("x.r").alias("nr"), F.col("x.nc").alias("nc"))
    d = (F.col("nr") - F.col("r")) * (F.col("nr") - F.col("r")) + (F.col("nc") - F.col("c")) * (F.col("nc") - F.col("c"))
    return grid.select("image_id", "r", "c", d.cast("long").alias("d"), "nr", "nc")


def pooled(df: DataFrame, size: int, every: int, rows: int, columns: int, reduce) -> DataFrame:
    """``reduce`` over [-size/2, size/2) around each ``every``-th cell; each cell goes to the windows that hold it."""
    low, high = -(size // 2), size - size // 2
    taps = F.array(*[F.struct(F.lit(-i).alias("dr"), F.lit(-j).alias("dc")) for i in range(low, high) for j in range(low, high)])
    sent = df.withColumn("o", F.explode(taps)).select("image_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "v")
    inside = (F.col("r") % every == 0) & (F.col("c") % every == 0) & F.col("r").between(0, rows - 1) & F.col("c").between(0, columns - 1)
    return sent.filter(inside).groupBy("image_id", "r", "c").agg(reduce.alias("v"))


def hough(points: DataFrame, bins: tuple[float, ...], dims: tuple[str, ...]) -> DataFrame:
    """Votes for bins trunc(x / size) per dimension and their face neighbours."""
    base = [F.expr(f"cast({d} / {b} as bigint)") for d, b in zip(dims, bins, strict=True)]
    moves = [[0] * len(dims)] + [[s if i == k else 0 for i in range(len(dims))] for k in range(len(dims)) for s in (-1, 1)]
    rows = points.select("id", *[x.alias(f"b{k}") for k, x in enumerate(base)])
    arr = F.array(*[F.struct(*[F.lit(m).alias(f"m{k}") for k, m in enumerate(move)]) for move in moves])
    voted = rows.withColumn("o", F.explode(arr)).select("id", *[(F.col(f"b{k}") + F.col(f"o.m{k}")).alias(f"b{k}") for k in range(len(dims))])
    return voted.groupBy(*[f"b{k}" for k in range(len(dims))]).agg(F.count("*").alias("votes"), F.min("id").alias("first"))


def haar_dictionary(spark, side: int) -> DataFrame:
    """All two-, three- and four-rectangle features of every place and size in a square of ``side``."""
    n = F.sequence(F.lit(0), F.lit(side - 1))
    grid = spark.range(1).select(F.explode(n).alias("r")).select("r", F.explode(n).alias("c")).select("r", "c", F.explode(F.sequence(F.lit(1), F.lit(side))).alias("h")).select("r", "c", "h", F.explode(F.sequence(F.lit(1), F.lit(side))).alias("w"))
    kinds = {"two_h": (1, 2), "two_v": (2, 1), "three_h": (1, 3), "three_v": (3, 1), "four": (2, 2)}
    out = None
    for kind, (down, across) in kinds.items():
        part = grid.filter((F.col("r") + F.col("h") * down <= side) & (F.col("c") + F.col("w") * across <= side)).withColumn("kind", F.lit(kind)).withColumn("down", F.lit(down)).withColumn("across", F.lit(across))
        out = part if out is None else out.unionByName(part)
    return out


def zero_mean(df: DataFrame) -> DataFrame:
    from gridloom.operators.pixels import normalised

    return normalised(df)


def splat(points: DataFrame, rows: int, columns: int) -> DataFrame:
    """Weights of points (image_id, y, x, w) dealt bilinearly to the four cells around them."""
    cell = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    df = points.withColumn("o", F.explode(cell)).withColumn("r", (F.floor("y") + F.col("o.i")).cast("int")).withColumn("c", (F.floor("x") + F.col("o.j")).cast("int"))
    share = (1 - F.abs(F.col("y") - F.col("r"))) * (1 - F.abs(F.col("x") - F.col("c")))
    return df.filter(F.col("r").between(0, rows - 1) & F.col("c").between(0, columns - 1)).groupBy("image_id", "r", "c").agg(F.sum(F.col("w") * share).alias("v"))
