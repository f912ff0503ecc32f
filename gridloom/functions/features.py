"""Features of points and of image cells, as column expressions; a tree can split on any of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least magnitude that a logarithm or a divisor is taken of.
LEAST = 1e-4


def unary(v: Column, log: bool = False, absolute: bool = False) -> Column:
    """A value as it is, the logarithm of its magnitude (at least ``LEAST``), and of either the magnitude."""
    v = F.log(F.greatest(F.abs(v), F.lit(LEAST))) if log else v
    return F.abs(v) if absolute else v


def binary(a: Column, b: Column, how: str, absolute: bool = False) -> Column:
    """Two values combined: subtract, add, multiply, divide, or log (a times the logarithm of b's magnitude). A zero divisor or magnitude counts as ``LEAST``."""
    whole = F.when(b == 0, F.lit(LEAST)).otherwise(b)
    v = {"subtract": a - b, "add": a + b, "multiply": a * b, "divide": a / whole, "log": a * F.log(F.abs(whole))}[how]
    return F.abs(v) if absolute else v


def _index(r: Column, c: Column, columns: Column) -> Column:
    return (r * columns + c).cast("int")


def shifted(dr: int, dc: int, data: str = "data", rows: str = "rows", columns: str = "columns") -> Column:
    """The value beside the cell (r, c) of a packed image, the nearest one where that is outside."""
    inside = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.col(n) - 1)
    return F.get(data, _index(inside(F.col("r") + dr, rows), inside(F.col("c") + dc, columns), F.col(columns)))


def parts(offsets: list[tuple[int, int, float]], data: str = "data", rows: str = "rows", columns: str = "columns") -> Column:
    """Weighted sum of values beside the cell; those outside the image are 0."""
    total = F.lit(0.0)
    for dr, dc, weight in offsets:
        r, c = F.col("r") + dr, F.col("c") + dc
        total += F.when((r >= 0) & (r < F.col(rows)) & (c >= 0) & (c < F.col(columns)), F.get(data, _index(r, c, F.col(columns))) * weight).otherwise(0.0)
    return total


def rectangle(dr: int, dc: int, height: int, width: int, **names: str) -> Column:
    """Sum over a rectangle beside the cell, as far as it is inside the image."""
    return parts([(dr + i, dc + j, 1.0) for i in range(height) for j in range(width)], **names)


def two_rectangles(dr: int, dc: int, height: int, width: int, **names: str) -> Column:
    """The sum over a rectangle less that over the one below it."""
    return rectangle(dr, dc, height, width, **names) - rectangle(dr + height, dc, height, width, **names)


def combined(features: list[Column], weights: list[float]) -> Column:
    """A linear combination of features."""
    return sum((f * w for f, w in zip(features, weights, strict=True)), F.lit(0.0))


def drawn(count: int, reach: int = 3, seed: int = 1) -> list[tuple[str, Column]]:
    """``count`` named features of an image cell, of kinds, offsets up to ``reach`` and sizes drawn by the seed.

    The kinds are single cells, pairs of cells, rectangles, rectangles against the one below, weighted parts, and combinations of two others.
    """
    rng = np.random.default_rng(seed)
    offset = lambda: (int(rng.integers(-reach, reach + 1)), int(rng.integers(-reach, reach + 1)))
    out: list[tuple[str, Column]] = []
    while len(out) < count:
        kind = ("unary", "binary", "rectangle", "two rectangles", "parts", "combination")[rng.integers(6 if len(out) > 1 else 5)]
        a, b, size = offset(), offset(), (int(rng.integers(1, reach + 1)), int(rng.integers(1, reach + 1)))
        if kind == "unary":
            log, absolute = (bool(x) for x in rng.integers(2, size=2))
            out.append((f"{kind} {a} log={log} abs={absolute}", unary(shifted(*a), log, absolute)))
        elif kind == "binary":
            how = ("subtract", "add", "multiply", "divide", "log")[rng.integers(5)]
            out.append((f"{kind} {a} {how} {b}", binary(shifted(*a), shifted(*b), how)))
        elif kind in ("rectangle", "two rectangles"):
            out.append((f"{kind} {a} {size}", (rectangle if kind == "rectangle" else two_rectangles)(*a, *size)))
        elif kind == "parts":
            weights = [round(float(x), 3) for x in rng.normal(size=2)]
            out.append((f"{kind} {a} {b} {weights}", parts([(*a, weights[0]), (*b, weights[1])])))
        else:
            i, j = (int(x) for x in rng.choice(len(out), 2, replace=False))
            out.append((f"{kind} of {i} and {j}", combined([out[i][1], out[j][1]], [0.5, -0.5])))
    return out
