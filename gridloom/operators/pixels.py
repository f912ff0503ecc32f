"""Per-cell maps over tall rasters. None of them shuffles but for statistics of whole images and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.evaluation import ranges
from gridloom.sources.staging import staged


def by_image():
    return W.partitionBy("image_id")


def by_pixel():
    return W.partitionBy("image_id", "r", "c")


def threshold(df: DataFrame, t: float, less_than: bool = False) -> DataFrame:
    """Cells at or below ``t`` become ``less_than``, the others its opposite."""
    return df.withColumn("v", F.when(F.col("v") <= t, F.lit(less_than)).otherwise(F.lit(not less_than)))


def with_statistics(df: DataFrame, **statistics: Column) -> DataFrame:
    """``df`` with statistics of its images. Each is added up before the shuffle, so an image of any size is spread over tasks; one row an image is joined."""
    return df.join(df.groupBy("image_id").agg(*[s.alias(n) for n, s in statistics.items()]), "image_id")


def rescaled(df: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values of each image stretched to low .. high; a constant image becomes ``low``."""
    lo, hi = F.col("__lo"), F.col("__hi")
    out = with_statistics(df, __lo=F.min("v"), __hi=F.max("v"))
    return out.withColumn("v", F.coalesce(F.try_divide(F.col("v") - lo, hi - lo), F.lit(0.0)) * (high - low) + low).drop("__lo", "__hi").select(df.columns)


def normalised(df: DataFrame) -> DataFrame:
    """Zero mean and unit (population) variance in each image; a zero deviation counts as 1."""
    sd = F.col("__sd")
    out = with_statistics(df, __mean=F.avg("v"), __sd=F.stddev_pop("v"))
    return out.withColumn("v", (F.col("v") - F.col("__mean")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)).drop("__mean", "__sd").select(df.columns)


def to_bytes(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.withColumn("v", ((F.greatest(F.least("v", F.lit(high)), F.lit(low)) - low) / (high - low) * 255).cast("long"))


def extract(df: DataFrame, r0: int, c0: int, rows: int, columns: int) -> DataFrame:
    """A rectangle of each image, edge cells repeated where it leaves the image."""
    size = df.groupBy("image_id").agg(F.max("r").alias("max_r"), F.max("c").alias("max_c"))
    grid = size.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    clamp = lambda x, top: F.greatest(F.least(x, top), F.lit(0))
    grid = grid.select("image_id", "r", "c", clamp(F.col("r") + r0, F.col("max_r")).alias("sr"), clamp(F.col("c") + c0, F.col("max_c")).alias("sc"))
    return grid.join(df.select("image_id", F.col("r").alias("sr"), F.col("c").alias("sc"), "v"), ["image_id", "sr", "sc"]).select("image_id", "r", "c", "v")


def flipped(df: DataFrame, axis: str, size: int) -> DataFrame:
    return df.withColumn(axis, F.lit(size - 1) - F.col(axis))


def subsampled(df: DataFrame, k: int, rows: int, columns: int) -> DataFrame:
    inside = (F.col("r") % k == 0) & (F.col("c") % k == 0) & (F.col("r") < rows // k * k) & (F.col("c") < columns // k * k)
    return df.filter(inside).withColumns({x: F.expr(f"cast({x} div {k} as int)") for x in ("r", "c")})


def resampled(df: DataFrame, rows: int, columns: int, new_rows: int, new_columns: int, source: tuple[Column, Column] | None = None, background: float | None = None, kernel: str = "bilinear") -> DataFrame:
    """Images on a new grid, each target cell a weighted sum of the source cells around where it comes from.

    ``source``: row and column there, as expressions of the target's (r, c); by default a scaling.
    ``kernel``: nearest, bilinear or cubic (a cubic B-spline). Cells from outside take ``background``,
    or the nearest edge cell where it is None. Which cells meet is the same in all images: a table of 1, 4 or 16 rows for each cell of the
    new grid, which is broadcast, so source cells go to where they count and add up there before the one shuffle.
    """
    sr, sc = source or (F.col("r") * (rows / new_rows), F.col("c") * (columns / new_columns))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = df.sparkSession.range(1).select(upto(new_rows).alias("r")).select("r", upto(new_columns).alias("c")).withColumn("y", sr).withColumn("x", sc)
    if kernel == "nearest":
        taps, weight, base = [0], lambda d: F.lit(1.0), lambda z: F.floor(z + 0.5)
    elif kernel == "bilinear":
        taps, weight, base = [0, 1], lambda d: 1 - F.abs(d), F.floor
    else:
        taps, base = [-1, 0, 1, 2], F.floor

        def weight(d: Column) -> Column:
            d = F.abs(d)
            return F.when(d < 1, (4 - 6 * d * d + 3 * d * d * d) / 6).when(d < 2, F.pow(2 - d, F.lit(3)) / 6).otherwise(F.lit(0.0))

    offsets = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in taps for j in taps])
    cells = grid.withColumn("o", F.explode(offsets)).withColumn("br", base(F.col("y")) + F.col("o.dr")).withColumn("bc", base(F.col("x")) + F.col("o.dc"))
    cells = cells.withColumn("w", weight(F.col("y") - F.col("br")) * weight(F.col("x") - F.col("bc")))
    to = lambda x, n: F.greatest(F.least(x, F.lit(n - 1)), F.lit(0)).cast("int")
    taps = cells.groupBy("r", "c", to("br", rows).alias("sr"), to("bc", columns).alias("sc")).agg(F.sum("w").alias("w"))
    pieces = df.filter("image_id is not null").select("image_id", F.col("r").alias("sr"), F.col("c").alias("sc"), "v").join(F.broadcast(taps), ["sr", "sc"])
    out = pieces.groupBy("image_id", "r", "c").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    if background is not None:
        inside = sr.between(0, rows - 1) & sc.between(0, columns - 1)
        out = out.withColumn("v", F.when(inside, F.col("v")).otherwise(F.lit(background)))
    return out


def affine_source(m: tuple[float, ...], rows: int, columns: int, new_rows: int, new_columns: int) -> tuple[Column, Column]:
    """Where target cells come from under the inverse map ``m`` (a, b, tx, c, d, ty) about the centres."""
    x, y = F.col("c") - (new_columns - 1) / 2, F.col("r") - (new_rows - 1) / 2
    return m[3] * x + m[4] * y + m[5] + (rows - 1) / 2, m[0] * x + m[1] * y + m[2] + (columns - 1) / 2


def appended(left: DataFrame, right: DataFrame, where: str = "right") -> DataFrame:
    """Each image of ``left`` with its counterpart of ``right`` on its right side, or with ``where`` = ``bottom`` below it.

    The smaller one is centred along the other axis (rounded down), and what neither covers is 0. Images without a counterpart have no rows.
    """
    along, across = ("c", "r") if where == "right" else ("r", "c")
    size = lambda df, n: df.groupBy("image_id").agg((F.max(along) + 1).alias(f"{n}_along"), (F.max(across) + 1).alias(f"{n}_across"))
    sizes = size(left, "left").join(size(right, "right"), "image_id").withColumn("across", F.greatest("left_across", "right_across"))
    centred = lambda n: (F.col(across) + F.floor((F.col("across") - F.col(f"{n}_across")) / 2)).cast("int").alias(across)
    one = left.join(sizes, "image_id").select("image_id", F.col(along), centred("left"), "v")
    two = right.join(sizes, "image_id").select("image_id", (F.col(along) + F.col("left_along")).alias(along), centred("right"), "v")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    grid = sizes.withColumn(along, upto(F.col("left_along") + F.col("right_along"))).withColumn(across, upto(F.col("across"))).select("image_id", along, across, F.lit(0.0).alias("v"))
    every = one.unionByName(two).unionByName(grid)
    return every.groupBy("image_id", "r", "c").agg(F.sum("v").alias("v"))


def numbered(keys: DataFrame, order: str) -> DataFrame:
    """Keys with ``label``: their places, from 1, by rising ``order`` (without nulls or ties).

    Places within ranges, which come from quantiles, are added to the counts of the ranges before; no task holds all keys.
    """
    rows = ranges(staged(keys, "keys"), order)
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = F.sum("n").over(W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(order))
    return rows.withColumn("place", place).join(F.broadcast(counts), "part").withColumn("label", F.col("before") + F.col("place")).drop("part", "place", "before")


def smoothed_distribution(df: DataFrame, alpha: float = 1e-4) -> DataFrame:
    """Each cell's distribution with a Dirichlet prior of ``alpha`` in all over its labels."""
    n, total = F.count("*").over(by_pixel()), F.sum("p").over(by_pixel())
    a = F.lit(alpha) / n
    return df.withColumn("p", (F.col("p") + a) / (total + n * a))


def argmax(df: DataFrame) -> DataFrame:
    """The likeliest label of each cell, the lowest of equals."""
    return df.groupBy("image_id", "r", "c").agg((-F.max(F.struct("p", (-F.col("label")).alias("k")))["k"]).alias("label"))
