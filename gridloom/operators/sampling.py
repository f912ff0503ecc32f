"""Random draws that a hash of the rows decides, so reruns and lost tasks give the same; training samples of labelled images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; draws are whole multiples of its inverse.
PRIME = 1_000_003


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) for each whole number ``key``: a line and then a fifth power modulo the prime, both one to one."""
    x = F.pmod(F.pmod(key, F.lit(PRIME)) * (2 * seed + 2_654_435_761) + seed * 40_503, F.lit(PRIME))
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME / F.lit(float(PRIME))


def test(key: Column, seed: int, rate: float | Column) -> Column:
    """Whether a draw falls below a rate."""
    return uniform(key, seed) < rate


def normal(key: Column, seed: int) -> Column:
    """A draw from the standard normal distribution, made of two uniform ones."""
    u = uniform(key, seed) + 0.5 / PRIME
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * uniform(key, seed + 1))


def distribution(key: Column, seed: int, length: int) -> Column:
    """A random distribution over ``length`` values: cubes of uniform draws, divided by their sum."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.pow(uniform(key * length + i, seed) + 0.5 / PRIME, F.lit(3.0)))
    total = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(raw, lambda x: x / total)


def grid_samples(cells: DataFrame, every: int, box_rows: int, box_columns: int) -> DataFrame:
    """The cells (image_id, r, c) of a grid, ``every`` apart, from (box_rows, box_columns) on and as far from the lower and right edges."""
    size = cells.groupBy("image_id").agg((F.max("r") + 1).alias("__rows"), (F.max("c") + 1).alias("__columns"))
    inside = (F.col("r") >= box_rows) & (F.col("c") >= box_columns) & (F.col("r") < F.col("__rows") - box_rows) & (F.col("c") < F.col("__columns") - box_columns)
    on_grid = ((F.col("r") - box_rows) % every == 0) & ((F.col("c") - box_columns) % every == 0)
    return cells.filter(on_grid).join(size, "image_id").filter(inside).drop("__rows", "__columns")


def supervised(samples: DataFrame, labels: DataFrame, mode: str, key: Column, seed: int, many: int = 20) -> DataFrame:
    """Labels of samples by the mode of supervision.

    ``full``: the cell's own label. ``part``: one of the labels that the image has, drawn from its set. ``none``: any of ``many`` numbers. ``labels`` is
    (image_id, r, c, label), of whole images; ``key`` tells samples apart.
    """
    if mode == "full":
        return samples
    if mode == "none":
        return samples.withColumn("label", F.floor(uniform(key, seed) * many).cast("int"))
    if mode != "part":
        raise ValueError(f"unknown mode {mode}")
    sets = labels.groupBy("image_id").agg(F.array_sort(F.collect_set("label")).alias("__set"))  # the labels of one image
    at = F.floor(uniform(key, seed) * F.size("__set")).cast("int")
    return samples.join(sets, "image_id").withColumn("label", F.get("__set", at)).drop("__set")


def split_samples(samples: DataFrame, splits: int, key: Column, seed: int, rate: float, image_rate: float | None = None) -> DataFrame:
    """``samples`` with ``split``: each split draws its own rows at ``rate``; with ``image_rate``, of images that it draws at that rate first."""
    every = samples.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    kept = every.filter(test(key * splits + F.col("split"), seed, rate))
    return kept if image_rate is None else kept.filter(test(F.col("image_id") * splits + F.col("split"), seed + 7, image_rate))
