"""Sufficient statistics in one pass, and sums over rows for iterative fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotEnoughSamples, require
from ..functions import vec
from ..sources.shipping import ship

#: Up to this many products are summed by JVM aggregates; beyond it by numpy over Arrow batches.
JVM_PRODUCTS = 150


@dataclass(frozen=True)
class Moments:
    """n (or the sum of weights), means, and the centred scatter matrix of some columns."""

    columns: tuple[str, ...]
    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def at(self, names: Sequence[str]) -> np.ndarray:
        return np.array([self.columns.index(c) for c in names])

    def raw(self, a: Sequence[str], b: Sequence[str]) -> np.ndarray:
        """Sums of products, not centred."""
        i, j = self.at(a), self.at(b)
        return self.scatter[np.ix_(i, j)] + self.n * np.outer(self.mean[i], self.mean[j])

    def centred(self, a: Sequence[str], b: Sequence[str]) -> np.ndarray:
        return self.scatter[np.ix_(self.at(a), self.at(b))]


def moments(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> Moments:
    """Rows with a null in any of the columns are left out.

    Products are taken around approximate means of a first, cheap pass, so
    that large offsets cost no precision.
    """
    d = len(columns)
    cols = vec.columns(columns)
    full = None
    for c in cols:
        full = c.isNotNull() if full is None else full & c.isNotNull()
    rows = df.filter(full)
    about = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols]).first()
    require(about[0] > 0, "no complete rows", NotEnoughSamples)
    centre = np.array(about[1:], float)
    w = F.col(f"`{weight}`").cast("double") if weight else None
    if d * (d + 1) // 2 <= JVM_PRODUCTS:
        x = [c - float(m) for c, m in zip(cols, centre)]
        wide = x if w is None else [w * c for c in x]
        sums = [F.count(F.lit(1)).cast("double") if w is None else F.sum(w), *[F.sum(c) for c in wide]]
        sums += [F.sum(wide[i] * x[j]) for i in range(d) for j in range(i, d)]
        got = np.array(rows.agg(*sums).first(), float)
        n, s = got[0], got[1 : d + 1]
        s2 = np.zeros((d, d))
        s2[np.triu_indices(d)] = got[d + 1 :]
        s2 = s2 + np.triu(s2, 1).T
    else:

        def part(x: np.ndarray) -> np.ndarray:
            ww = x[:, d] if weight else np.ones(len(x))
            z = np.column_stack([np.ones(len(x)), x[:, :d] - centre])
            return (z.T @ (z * ww[:, None])).ravel()

        extra = [*columns, weight] if weight else list(columns)
        total = summed(rows, extra, part, (d + 1) ** 2).reshape(d + 1, d + 1)
        n, s, s2 = total[0, 0], total[0, 1:], total[1:, 1:]
    return Moments(tuple(columns), float(n), centre + s / n, s2 - np.outer(s, s) / n)


def complete(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features alone, as doubles, without rows that lack any or hold NaN.

    One condition a column: a single one over many columns would make the
    optimizer try every mixture of their aliases.
    """
    keep = None
    for c in vec.columns(features):
        ok = c.isNotNull() & ~F.isnan(c)
        keep = ok if keep is None else keep & ok
    return df.filter(keep).select(*[c.alias(f) for c, f in zip(vec.columns(features), features)])


#: Rows that numpy looks at together.
_BATCH = 4096


def summed(df: DataFrame, columns: Sequence[str], part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of ``part`` of row blocks, a vector of ``size`` numbers.

    Each task adds up its own rows; the tasks' vectors are added by an
    aggregate over (place, value), so no task and no driver sees them all.
    """
    ship(df.sparkSession)
    rows = df.select(*vec.columns(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for i in range(0, len(x), _BATCH):
                total += part(x[i : i + _BATCH])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    out = np.zeros(size)
    for place, value in rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value")).collect():
        out[place] = value
    return out


def with_numbers(df: DataFrame, columns: Sequence[str], f: Callable[[np.ndarray], np.ndarray], names: Sequence[str], kind: str = "double") -> DataFrame:
    """``df`` with further columns that numpy computes from some of its own, batch by batch.

    Where the cells hold a null, ``f`` sees NaN.
    """
    ship(df.sparkSession)
    schema = df.schema
    arrow = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
            y = f(x)
            new = [pa.array(np.ascontiguousarray(y if y.ndim == 1 else y[:, i]), arrow) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    spark_type = {"double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType()}[kind]
    return df.mapInArrow(run, T.StructType([*schema.fields, *[T.StructField(n, spark_type) for n in names]]))
