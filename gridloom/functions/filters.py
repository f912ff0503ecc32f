"""Filter kernels as small tables made on the driver."""

from __future__ import annotations

import math


def normalised(k: list[list[float]]) -> list[list[float]]:
    """Unit L2 norm, then zero mean if any value is negative, then unit L1 norm."""
    flat = [x for row in k for x in row]
    norm = math.sqrt(sum(x * x for x in flat)) or 1.0
    flat = [x / norm for x in flat]
    if min(flat) < 0:
        mean = sum(flat) / len(flat)
        flat = [x - mean for x in flat]
    total = sum(map(abs, flat)) or 1.0
    w = len(k[0])
    return [[x / total for x in flat[i : i + w]] for i in range(0, len(flat), w)]


def _grid(radius: int):
    return [[(x, y) for x in range(-radius, radius + 1)] for y in range(-radius, radius + 1)]


def _g(x: float, s: float, order: int) -> float:
    e = math.exp(-x * x / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
    return e if order == 0 else -x / (s * s) * e if order == 1 else (x * x / s**4 - 1 / (s * s)) * e


def oriented(scale: float, angle: float, order: int, radius: int | None = None) -> list[list[float]]:
    """An edge (order 1) or bar (order 2) filter across the turned rows, three times as long as wide; it reaches 7 scales."""
    c, s = math.cos(angle), math.sin(angle)
    grid = _grid(math.ceil(7 * scale) if radius is None else radius)
    return normalised([[_g(c * x - s * y, 3 * scale, 0) * _g(s * x + c * y, scale, order) for x, y in row] for row in grid])


def radial(scale: float, order: int, radius: int | None = None) -> list[list[float]]:
    """A Gaussian (order 0), or its second derivative along the distance (order 2), of the distance from the centre; it reaches 3 scales."""
    grid = _grid(math.ceil(3 * scale) if radius is None else radius)
    return normalised([[_g(math.hypot(x, y), scale, order) for x, y in row] for row in grid])


def point(radius: int, dr: int, dc: int) -> list[list[float]]:
    return [[1.0 if (x, y) == (dc, dr) else 0.0 for x, y in row] for row in _grid(radius)]


def leung_malik(start: float = 1.0) -> dict[str, tuple[str, float, float]]:
    """48 filters (kind, scale, angle), with scales in steps of sqrt(2): edges and bars at 3 scales and 6 angles, 4 Gaussians, 8 Laplacians."""
    step = lambda k: start * math.sqrt(2) ** k
    bank = {f"{kind}_{i}_{o}": (kind, step(i), math.pi * o / 6) for kind in ("edge", "bar") for i in range(3) for o in range(1, 7)}
    return bank | {f"gaussian_{i}": ("gaussian", step(i), 0.0) for i in range(4)} | {f"laplacian_{i}": ("laplacian", step(i), 0.0) for i in range(8)}


def mr8() -> dict[str, tuple[int, str, float, float]]:
    """38 filters (group, kind, scale, angle) in 8 groups; a group's response is the greatest over its angles."""
    sized = [(kind, float(2**i)) for kind in ("edge", "bar") for i in range(3)]
    bank = {f"{kind}_{s:g}_{o}": (g, kind, s, math.pi * o / 6) for g, (kind, s) in enumerate(sized) for o in range(1, 7)}
    return bank | {"gaussian": (6, "gaussian", 10.0, 0.0), "laplacian": (7, "laplacian", 10.0, 0.0)}


def kernel(kind: str, scale: float, angle: float, radius: int | None = None) -> list[list[float]]:
    if kind in ("edge", "bar"):
        return oriented(scale, angle, 1 if kind == "edge" else 2, radius)
    return radial(scale, 0 if kind == "gaussian" else 2, radius)
