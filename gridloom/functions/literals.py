"""Arrays of numbers as literals: one piece of SQL text each, as thousands of single literals take long to hand over."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def integers(values: Iterable[int]) -> Column:
    return F.expr(f"array({', '.join(str(int(v)) for v in values)})")


def doubles(values: Iterable[float]) -> Column:
    """Finite numbers, and infinities."""
    text = lambda v: f"double('{v}')" if v in (float("inf"), float("-inf")) else f"{float(v)!r}D"
    return F.expr(f"array({', '.join(map(text, values))})")


def strings(values: Iterable[str], sep: str = ";") -> Column:
    """Strings without the separator."""
    return F.split(F.lit(sep.join(values)), sep)
