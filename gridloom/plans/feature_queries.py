"""Queries over the features of points and image cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import features as X
from gridloom.registry import query
from gridloom.sources import tables as T


def _r(v):
    return F.round(v, 6) + 0.0


@query("U2_unary_features", "SELECT id, round(data[4], 6) + 0.0 AS plain, round(abs(data[4]), 6) + 0.0 AS magnitude, round(ln(greatest(abs(data[4]::DOUBLE), 0.0001)), 6) + 0.0 AS log, round(abs(ln(greatest(abs(data[4]::DOUBLE), 0.0001))), 6) + 0.0 AS abs_log FROM (SELECT id, data::DOUBLE[] AS data FROM points)")
def u2(spark, sf):
    v = F.col("data")[3]
    return T.points(spark, sf).select("id", _r(X.unary(v)).alias("plain"), _r(X.unary(v, absolute=True)).alias("magnitude"), _r(X.unary(v, log=True)).alias("log"), _r(X.unary(v, log=True, absolute=True)).alias("abs_log"))


@query("U4_binary_features", "SELECT id, round(a - b, 6) + 0.0 AS subtract, round(a + b, 6) + 0.0 AS add, round(a * b, 6) + 0.0 AS multiply, round(a / d, 4) + 0.0 AS divide, round(a * ln(abs(d)), 6) + 0.0 AS log, round(abs(a - b), 6) + 0.0 AS distance FROM (SELECT *, CASE WHEN b = 0 THEN 0.0001 ELSE b END AS d FROM (SELECT id, data[2]::DOUBLE AS a, CASE WHEN id % 9 = 0 THEN 0 ELSE data[6]::DOUBLE END AS b FROM points))")
def u4(spark, sf):
    """Some of the second values are set to 0, which counts as the least magnitude in a divisor and a logarithm."""
    p = T.points(spark, sf).select("id", F.col("data")[1].alias("a"), F.when(F.col("id") % 9 == 0, 0.0).otherwise(F.col("data")[5]).alias("b"))
    a, b = F.col("a"), F.col("b")
    return p.select("id", *[_r(X.binary(a, b, how)).alias(how) for how in ("subtract", "add", "multiply", "log")], (F.round(X.binary(a, b, "divide"), 4) + 0.0).alias("divide"), _r(X.binary(a, b, "subtract", absolute=True)).alias("distance"))


def cells(spark, sf):
    """Every cell of every image with its packed image, so that neighbours are met without a shuffle."""
    e = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("data"), F.lit(T.SIDE).alias("rows"), F.lit(T.SIDE).alias("columns"))
    return e.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(T.SIDE - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(T.SIDE - 1))))


CELLS = "cells AS (SELECT image_id, r, c, e.embedding::DOUBLE[] AS data FROM raster JOIN embeddings e ON e.vec_id = image_id)"


def beside(dr, dc):
    return f"data[least(greatest(r + ({dr}), 0), 7) * 8 + least(greatest(c + ({dc}), 0), 7) + 1]"


def inside(dr, dc):
    return f"CASE WHEN r + ({dr}) BETWEEN 0 AND 7 AND c + ({dc}) BETWEEN 0 AND 7 THEN data[(r + ({dr})) * 8 + c + ({dc}) + 1] ELSE 0 END"


@query("U3_unary_image_feature", f"WITH {CELLS} SELECT image_id, r, c, round(ln(greatest(abs({beside(-2, 3)}), 0.0001)), 6) + 0.0 AS v FROM cells")
def u3(spark, sf):
    return cells(spark, sf).select("image_id", "r", "c", _r(X.unary(X.shifted(-2, 3), log=True)).alias("v"))


@query("U5_binary_image_feature", f"WITH {CELLS} SELECT image_id, r, c, round(abs({beside(1, -1)} - {beside(-3, 2)}), 6) + 0.0 AS v, round({beside(0, 4)} * {beside(2, 0)}, 6) + 0.0 AS product FROM cells")
def u5(spark, sf):
    return cells(spark, sf).select("image_id", "r", "c", _r(X.binary(X.shifted(1, -1), X.shifted(-3, 2), "subtract", absolute=True)).alias("v"), _r(X.binary(X.shifted(0, 4), X.shifted(2, 0), "multiply")).alias("product"))


@query("U6_part_features", f"WITH {CELLS} SELECT image_id, r, c, round(0.5 * ({inside(-1, 0)}) - 2 * ({inside(3, 3)}) + ({inside(0, -2)}), 6) + 0.0 AS parts FROM cells")
def u6parts(spark, sf):
    return cells(spark, sf).select("image_id", "r", "c", _r(X.parts([(-1, 0, 0.5), (3, 3, -2.0), (0, -2, 1.0)])).alias("parts"))


@query("U6_rectangle_features", "SELECT a.image_id, a.r, a.c, round(sum(CASE WHEN b.r < a.r + 2 THEN b.v ELSE 0 END), 6) + 0.0 AS rectangle, round(sum(CASE WHEN b.r < a.r + 2 THEN b.v ELSE -b.v END), 6) + 0.0 AS haar FROM raster a JOIN raster b ON b.image_id = a.image_id AND b.r BETWEEN a.r AND a.r + 3 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY ALL")
def u6rectangles(spark, sf):
    """Sums over 2 x 3 cells, and less those over the 2 x 3 cells below."""
    return cells(spark, sf).select("image_id", "r", "c", _r(X.rectangle(0, -1, 2, 3)).alias("rectangle"), _r(X.two_rectangles(0, -1, 2, 3)).alias("haar"))


@query("U6_combination_feature", f"WITH {CELLS} SELECT image_id, r, c, round(0.25 * {beside(1, 1)} - 0.75 * abs({beside(0, -1)}) + 2 * ({inside(2, 2)}), 6) + 0.0 AS v FROM cells")
def u6combination(spark, sf):
    return cells(spark, sf).select("image_id", "r", "c", _r(X.combined([X.shifted(1, 1), X.unary(X.shifted(0, -1), absolute=True), X.parts([(2, 2, 1.0)])], [0.25, -0.75, 2.0])).alias("v"))
