"""Templates of edge points held against distance transforms of images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def placed(templates: DataFrame, placements: DataFrame) -> DataFrame:
    """Where the points (template, x, y, and more) of templates come to lie: cells (r, c) for each placement.

    ``placements``: (key, image_id, template, row, column, sx, sy). A point goes to row + sy y and column + sx x, cut to whole numbers towards 0; (0, 0) and
    scales of 1 leave it where it is.
    """
    cut = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")
    return placements.join(templates, "template").withColumns({"r": cut(F.col("y") * F.col("sy") + F.col("row")), "c": cut(F.col("x") * F.col("sx") + F.col("column"))}).drop("row", "column", "sx", "sy")


def nearest_edges(transform: DataFrame, points: DataFrame) -> DataFrame:
    """The nearest true cell (nr, nc) and the squared distance d of the cells (key, image_id, r, c) of points; points outside have no row."""
    return points.join(transform, ["image_id", "r", "c"])


def chamfer_match(transform: DataFrame, templates: DataFrame, placements: DataFrame, most: float) -> DataFrame:
    """(key, image_id, score): the mean distance, cut at ``most``, of a placed template's points inside the image, as a share of ``most``.

    Smaller is better. Placements without any point inside, and images without edges, have no row. Sums of a placement are added up before the shuffle.
    """
    found = nearest_edges(transform, placed(templates, placements))
    return found.groupBy("key", "image_id").agg((F.avg(F.least(F.sqrt("d"), F.lit(float(most)))) / most).alias("score"))


def folded(angle: Column) -> Column:
    """The angle between two undirected lines, from that between directions in 0 to 2 pi."""
    d = F.abs(angle)
    d = F.when(d > math.pi, d - math.pi).otherwise(d)
    return F.when(d > math.pi / 2, math.pi - d).otherwise(d)


def orientation_match(transform: DataFrame, orientations: DataFrame, templates: DataFrame, placements: DataFrame) -> DataFrame:
    """(key, image_id, score): the mean angle between a placed template's points (with ``angle``) and the edges nearest to them, as a share of a right one.

    ``orientations``: (image_id, r, c, direction), in 0 to 2 pi. Otherwise as chamfer_match.
    """
    found = nearest_edges(transform, placed(templates, placements)).select("key", "image_id", "angle", "nr", "nc")
    edges = orientations.select("image_id", F.col("r").alias("nr"), F.col("c").alias("nc"), "direction")
    return found.join(edges, ["image_id", "nr", "nc"]).groupBy("key", "image_id").agg((F.avg(folded(F.col("direction") - F.col("angle"))) / (math.pi / 2)).alias("score"))
