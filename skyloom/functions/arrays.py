"""Column functions for array variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hyper(x: Column, start: int = 0, count: int | None = None, interval: int = 1) -> Column:
    """Elements start, start + interval, ... of an array (count of them)."""
    end = start + count * interval if count is not None else None
    return F.filter(x, lambda _, i: (i >= start) & ((i - start) % interval == 0) & (F.lit(True) if end is None else i < end))


def index_between(x: Column, low: int, high: int) -> Column:
    """Elements with an index from low to high."""
    return F.filter(x, lambda _, i: (i >= low) & (i <= high))


def transposed(x: Column) -> Column:
    """Rows and columns of a nested array swapped."""
    return F.transform(F.sequence(F.lit(0), F.size(x[0]) - 1), lambda j: F.transform(x, lambda row: F.get(row, j)))


def passes(v: Column, low, high, fill=None, inclusive: bool = True) -> Column:
    """Whether a value is in range; the fill value always is."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & ((v >= low) if inclusive else (v > low))
    if high is not None:
        ok = ok & ((v <= high) if inclusive else (v < high))
    return ok if fill is None else ok | (v == fill)


def masked(x: Column, low, high, fill=None, pad=None, inclusive: bool = True) -> Column:
    """Elements out of range replaced by the fill value, else the pad."""
    other = F.lit(fill if fill is not None else pad)
    return F.transform(x, lambda v: F.when(passes(v, low, high, fill, inclusive), v).otherwise(other))


def expanded(x: Column, times: int) -> Column:
    """A dimension that does not vary, re-expanded."""
    return F.array_repeat(x, times)


def flattened(name: str, size: int) -> list[Column]:
    """Columns name, name_0 ... name_{size-3}, name_end of a 1-D variable."""
    names = [name, *(f"{name}_{i}" for i in range(size - 2)), f"{name}_end"][:size]
    return [F.col(name)[i].alias(n) for i, n in enumerate(names)]
