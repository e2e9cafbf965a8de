"""Vector expressions.

Every factory takes two sequences of Columns of equal length (or one) and gives
one Column.  Sums are unrolled, so they stay inside whole-stage codegen;
``cells`` turns an array column of known width into such a sequence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def columns(names: Sequence[str]) -> list[Column]:
    """Columns by name as doubles."""
    return [F.col(f"`{n}`").cast("double") for n in names]


def cells(array: Column | str, width: int) -> list[Column]:
    """The entries of an array column as doubles."""
    col = F.col(array) if isinstance(array, str) else array
    return [col[i].cast("double") for i in range(width)]


def total(parts: Sequence[Column]) -> Column:
    return reduce(add, parts) if parts else F.lit(0.0)


def dot(a: Vector, b: Sequence[Column | float]) -> Column:
    return total([x * y for x, y in zip(a, b, strict=True)])


def affine(a: Vector, weights: Sequence[float], shift: float = 0.0) -> Column:
    """The weighted sum of columns with plain numbers, and a shift."""
    return total([x * F.lit(float(w)) for x, w in zip(a, weights, strict=True)]) + F.lit(float(shift))


def l1(a: Vector, b: Vector) -> Column:
    return total([F.abs(x - y) for x, y in zip(a, b, strict=True)])


def l2_squared(a: Vector, b: Vector) -> Column:
    """The reduced form of the Euclidean distance: same order, no root."""
    return total([(x - y) * (x - y) for x, y in zip(a, b, strict=True)])


def l2(a: Vector, b: Vector) -> Column:
    return F.sqrt(l2_squared(a, b))


def linf(a: Vector, b: Vector) -> Column:
    parts = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def lp(p: float):
    def distance(a: Vector, b: Vector) -> Column:
        return F.pow(total([F.pow(F.abs(x - y), F.lit(float(p))) for x, y in zip(a, b, strict=True)]), F.lit(1.0 / p))

    return distance


def wasserstein(a: Vector, b: Vector) -> Column:
    """One-dimensional bins: the sum of absolute running differences."""
    run, parts = None, []
    for x, y in zip(a, b, strict=True):
        run = x - y if run is None else run + (x - y)
        parts.append(F.abs(run))
    return total(parts)


DISTANCES = {"l1": l1, "l2": l2, "linf": linf, "wasserstein": wasserstein}


def norm(a: Vector, kind: str) -> Column:
    if kind == "l1":
        return total([F.abs(x) for x in a])
    if kind == "l2":
        return F.sqrt(total([x * x for x in a]))
    if kind == "max":
        return F.greatest(*[F.abs(x) for x in a]) if len(a) > 1 else F.abs(a[0])
    raise ValueError(f"no such norm: {kind}")


def log_sum_exp(values: Column) -> Column:
    """Of an array column; shifted by the greatest part, so nothing overflows."""
    most = F.array_max(values)
    return most + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - most)))


def softmax(values: Column) -> Column:
    """Shares of an array column's exponentials."""
    norm_ = log_sum_exp(values)
    return F.transform(values, lambda x: F.exp(x - norm_))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def argmax(values: Vector, labels: Sequence) -> Column:
    """The label of the greatest value; ties keep the earlier one.  Each value is computed once."""
    pairs = F.array(*[F.struct(v.cast("double").alias("value"), F.lit(-i).alias("place")) for i, v in enumerate(values)])
    return F.array(*[F.lit(c) for c in labels])[-F.array_max(pairs)["place"]]
