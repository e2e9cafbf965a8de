"""Nearest neighbours, range queries and other operations on all pairs of vectors.

Vectors are array columns.  Left rows are spread over all cores; each task
meets its rows with all right rows, block by block.  The right side is
broadcast if its counted size is small, otherwise written once to the shared
folder, from where every task streams it: no row is copied by a shuffle, and
a task holds one block of either side.  Most distances are never computed:
see ``functions.pairwise``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter, MismatchedShapes, NotEnoughSamples, require
from ..functions import vec
from ..functions.pairwise import CELLS, Nearest, Screen, block_distance, differences, l2_squared, measured
from ..sources.shipping import ship
from ..sources.store import written

#: A side is broadcast up to this many numbers (64 MB of doubles).
BROADCAST_CELLS = 8_000_000
BLOCK = 4096
#: Left rows that a task meets with the right side at once.
LEFT = 4096


def vectors(df: DataFrame, id_col: str, vector_col: str, *extra: str) -> DataFrame:
    """(id, vector, extra columns) without rows that lack either."""
    v = F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    return df.select(F.col(f"`{id_col}`").alias("id"), v, *[F.col(f"`{c}`") for c in extra]).filter("id is not null and vector is not null")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def width(df: DataFrame) -> int:
    """The common length of the vectors."""
    low, high = df.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    require(low is not None, "no vectors", NotEnoughSamples)
    require(low == high, f"vectors of {low} and of {high} numbers", MismatchedShapes)
    require(low > 0, "vectors of no numbers")
    return low


Blocks = Callable[[], Iterator[pa.Table]]


def each_against_all(left: DataFrame, right: DataFrame, f: Callable[[pa.Table, Blocks], Iterator[pa.Table]], schema: str, cells: int = BROADCAST_CELLS, block: int = BLOCK) -> DataFrame:
    """``f`` of some left rows and of a function that gives all right rows, block by block.

    Every left row is in one call only, which meets all right rows.
    """
    spark = left.sparkSession
    ship(spark)
    n, most = right.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if n * (most or 0) <= cells:
        shipped = spark.sparkContext.broadcast(right.toArrow())  # at most ``cells`` numbers

        def blocks() -> Iterator[pa.Table]:
            for i in range(0, len(shipped.value), block):
                yield shipped.value.slice(i, block)

    else:
        path = written(right, "right").inputFiles()

        def blocks() -> Iterator[pa.Table]:
            from pyarrow import fs
            from pyarrow import parquet as pq

            for at in path:
                where, name = fs.FileSystem.from_uri(at)
                with where.open_input_file(name) as file:
                    for batch in pq.ParquetFile(file).iter_batches(block, use_threads=False):
                        yield pa.Table.from_batches([batch])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), LEFT):
                for out in f(pa.Table.from_batches([batch.slice(i, LEFT)]), blocks):
                    yield from out.to_batches()

    # a small file would be one task
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, -(-left.count() // 64)))
    spread = left.repartition(max(tasks, spark.sparkContext.defaultParallelism), F.xxhash64("id"))
    return spread.mapInArrow(run, schema)


def _sample(blocks: Blocks) -> np.ndarray:
    """Some right rows."""
    for y in blocks():
        if len(y):
            return matrix(y.column("vector").slice(0, 1024))
    return np.zeros((0, 1))


def k_nearest(points: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2", p: float = 2.0, cells: int = BROADCAST_CELLS, block: int = BLOCK) -> DataFrame:
    """(query, id, distance, rank) of the k points nearest to each query, ties to the smaller id.

    Exact.  A point of the query's own id counts as a point like any other.
    """
    require(k > 0, "k is at least 1")
    differences(metric, p)  # checks both
    base, asked = vectors(points, id_col, vector_col), vectors(queries, id_col, vector_col)
    require(width(base) == width(asked), "points and queries differ in width", MismatchedShapes)
    types = asked.schema["id"].dataType.simpleString(), base.schema["id"].dataType.simpleString()

    def best(x: pa.Table, blocks: Blocks) -> Iterator[pa.Table]:
        sample, kind = _sample(blocks), None
        if not len(x) or not len(sample):
            return
        near = Nearest(matrix(x.column("vector")), k, metric, p, Screen(metric, p, sample))
        for y in blocks():
            if len(y):
                kind = y.schema.field("id").type
                near.meet(matrix(y.column("vector")), y.column("id").to_numpy())
        r, c = np.nonzero(near.known)
        yield pa.table({"query": x.column("id").take(pa.array(r)), "id": pa.array(near.id[r, c], kind), "distance": pa.array(near.distance[r, c]), "rank": pa.array(c + 1, pa.int32())})

    return each_against_all(asked, base, best, f"query {types[0]}, id {types[1]}, distance double, rank int", cells, block)


def within_range(points: DataFrame, queries: DataFrame, radius: float, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2", p: float = 2.0, cells: int = BROADCAST_CELLS, block: int = BLOCK) -> DataFrame:
    """(query, id, distance) of all points nearer than ``radius``, the point of the query's own id included."""
    require(radius >= 0, "a radius is not negative")
    f = differences(metric, p)
    base, asked = vectors(points, id_col, vector_col), vectors(queries, id_col, vector_col)
    require(width(base) == width(asked), "points and queries differ in width", MismatchedShapes)
    types = asked.schema["id"].dataType.simpleString(), base.schema["id"].dataType.simpleString()

    def near(x: pa.Table, blocks: Blocks) -> Iterator[pa.Table]:
        sample = _sample(blocks)
        if not len(x) or not len(sample):
            return
        screen, ids = Screen(metric, p, sample), x.column("id")
        parts = [(i, a := matrix(x.column("vector").slice(i, 512)), screen.left(a)) for i in range(0, len(x), 512)]
        for y in blocks():
            if not len(y):
                continue
            b = matrix(y.column("vector"))
            ready = screen.right(b)
            for i, a, own in parts:
                r, c = screen.under(own, ready, np.full(len(a), radius))
                for at in range(0, len(r), CELLS):
                    rr, cc = r[at : at + CELLS], c[at : at + CELLS]
                    d = measured(f, a, b, rr, cc)
                    kept = d < radius
                    if kept.any():
                        yield pa.table({"query": ids.take(pa.array(rr[kept] + i)), "id": y.column("id").take(pa.array(cc[kept])), "distance": pa.array(d[kept])})

    return each_against_all(asked, base, near, f"query {types[0]}, id {types[1]}, distance double", cells, block)


def gaussian_similarity(points: DataFrame, eps: float, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2", p: float = 2.0, cells: int = BROADCAST_CELLS, block: int = BLOCK) -> DataFrame:
    """(i, j, value): exp(-distance / eps) of all pairs; the distance isn't squared."""
    require(eps > 0, "eps is positive")
    distance = block_distance(metric, p)
    return _all_pairs(points, id_col, vector_col, lambda a, b: np.exp(-distance(a, b) / eps), cells, block)


#: Pairs that a task hands over at once.
PAIRS = 1 << 17


def _all_pairs(points: DataFrame, id_col: str, vector_col: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray], cells: int, block: int, upper: bool = False) -> DataFrame:
    """(i, j, value); ``upper``: of i < j alone."""
    base = vectors(points, id_col, vector_col)
    width(base)
    kind = base.schema["id"].dataType.simpleString()

    def pairs(x: pa.Table, blocks: Blocks) -> Iterator[pa.Table]:
        a, own = matrix(x.column("vector")), x.column("id").combine_chunks()
        for y in blocks():
            b, ids = matrix(y.column("vector")), y.column("id").combine_chunks()
            m = len(b)
            step = max(1, PAIRS // max(1, m))
            for i in range(0, len(a) if m else 0, step):
                value = f(a[i : i + step], b)
                if upper:
                    r, c = np.nonzero(own.to_numpy(zero_copy_only=False)[i : i + step, None] < ids.to_numpy(zero_copy_only=False)[None])
                    value = value[r, c]
                else:
                    r, c = np.repeat(np.arange(len(value)), m), np.tile(np.arange(m), len(value))
                if len(r):
                    yield pa.table({"i": own.take(pa.array(r + i)), "j": ids.take(pa.array(c)), "value": pa.array(value.ravel())})

    return each_against_all(base, base, pairs, f"i {kind}, j {kind}, value double", cells, block)


def silhouette(points: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cells: int = BROADCAST_CELLS, block: int = BLOCK) -> DataFrame:
    """(silhouette): the mean over all points of (b - a) / max(a, b), from exact distances.

    With one label only it is 1; a point alone in its cluster has a = 0.
    """
    labelled = vectors(points, id_col, vector_col, label_col).withColumnRenamed(label_col, "label").filter("label is not null")
    width(labelled)
    spark = labelled.sparkSession
    found = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("size")).collect()  # one row a cluster
    size = np.array([r["size"] for r in found], float)
    codes = spark.createDataFrame([(r["label"], i) for i, r in enumerate(found)], f"label {labelled.schema['label'].dataType.simpleString()}, code int")
    base = labelled.join(F.broadcast(codes), "label").select("id", "vector", "code")

    def values(x: pa.Table, blocks: Blocks) -> Iterator[pa.Table]:
        a, own = matrix(x.column("vector")), x.column("code").to_numpy()
        step = max(1, min(512, 4_000_000 // len(size)))
        for first in range(0, len(a), max(step, min(len(a), 4_000_000 // len(size)))):
            part = a[first : first + max(step, min(len(a), 4_000_000 // len(size)))]
            total = np.zeros((len(part), len(size)))
            for y in blocks():
                if not len(y):
                    continue
                code = y.column("code").to_numpy()
                order = np.argsort(code, kind="stable")
                b, code = matrix(y.column("vector"))[order], code[order]
                starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                for i in range(0, len(part), step):
                    total[i : i + step, code[starts]] += np.add.reduceat(np.sqrt(l2_squared(part[i : i + step], b)), starts, axis=1)
            mine = own[first : first + len(part)]
            rows = np.arange(len(part))
            inner = np.where(size[mine] > 1, total[rows, mine] / np.maximum(size[mine] - 1, 1), 0.0)
            outer = total / size
            outer[rows, mine] = np.inf
            outer = outer.min(axis=1)
            most = np.maximum(inner, outer)
            value = np.where(len(size) == 1, 1.0, np.divide(outer - inner, most, out=np.zeros(len(part)), where=most != 0))
            yield pa.table({"value": pa.array(value)})

    return each_against_all(base, base, values, "value double", cells, block).agg(F.avg("value").alias("silhouette"))


# Kernels


def kernel_function(kind: str, a: float = 1.0, b: float = 1.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """gaussian(eps), linear, or polynomial(constant, degree) between rows of two matrices."""
    if kind == "gaussian":
        require(a > 0, "eps is positive")
        return lambda x, y: np.exp(l2_squared(x, y) / -a)
    if kind == "linear":
        return lambda x, y: x @ y.T
    if kind == "polynomial":
        return lambda x, y: (x @ y.T + a) ** b
    raise InvalidParameter(f"no such kernel: {kind}")


def dense_kernel(points: DataFrame, kind: str, a: float = 1.0, b: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = BROADCAST_CELLS, block: int = BLOCK) -> DataFrame:
    """(i, j, value) of all pairs."""
    return _all_pairs(points, id_col, vector_col, kernel_function(kind, a, b), cells, block)


def sparse_kernel(points: DataFrame, k: int, kind: str, a: float = 1.0, b: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = BROADCAST_CELLS) -> DataFrame:
    """(i, j, value) where j is among the k nearest of i, i of j, or both are one point."""
    kernel_function(kind, a, b)  # checks them
    near = k_nearest(points, points, k + 1, id_col, vector_col, cells=cells).filter("query != id").select(F.col("query").alias("i"), F.col("id").alias("j"), "distance")
    base = vectors(points, id_col, vector_col)
    if kind == "gaussian":  # the distance is enough
        edges = written(near.select("i", "j", F.exp(-F.col("distance") * F.col("distance") / a).alias("value")), "near")
        own = base.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value"))
        return edges.union(edges.select("j", "i", "value")).union(own).groupBy("i", "j").agg(F.min("value").alias("value"))
    d = width(base)
    near = written(near.select("i", "j"), "near")
    edges = near.union(near.select("j", "i")).union(base.select(F.col("id").alias("i"), F.col("id").alias("j"))).distinct()
    f = kernel_column(kind, a, b, d)
    left = base.select(F.col("id").alias("i"), F.col("vector").alias("u"))
    right = base.select(F.col("id").alias("j"), F.col("vector").alias("v"))
    return edges.join(left, "i").join(right, "j").select("i", "j", f("u", "v").alias("value"))


def kernel_column(kind: str, a: float, b: float, d: int) -> Callable[[str, str], Column]:
    """The same kernels as column expressions."""

    def run(u: str, v: str) -> Column:
        x, y = vec.cells(u, d), vec.cells(v, d)
        if kind == "gaussian":
            return F.exp(-vec.l2_squared(x, y) / a)
        if kind == "linear":
            return vec.dot(x, y)
        if kind == "polynomial":
            return F.pow(vec.dot(x, y) + a, F.lit(float(b)))
        raise InvalidParameter(f"no such kernel: {kind}")

    return run


def kernel_sum(kernel: DataFrame) -> DataFrame:
    """(i, total): the sum of each row."""
    return kernel.groupBy("i").agg(F.sum("value").alias("total"))


def kernel_dot(kernel: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """The kernel times a matrix (j, columns): (i, columns)."""
    return kernel.join(right, "j").groupBy("i").agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in columns])


def kernel_diagonal(kernel: DataFrame) -> DataFrame:
    return kernel.filter("i = j").select("i", "value")


def kernel_column_of(kernel: DataFrame, j: object) -> DataFrame:
    return kernel.filter(F.col("j") == F.lit(j)).select("i", "value")


def kernel_upper_triangle(kernel: DataFrame) -> DataFrame:
    return kernel.filter("i < j")


def kernel_size(kernel: DataFrame) -> int:
    return kernel_diagonal(kernel).count()


# The same of a dense kernel, without its table


def dense_kernel_diagonal(points: DataFrame, kind: str, a: float = 1.0, b: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(i, value): one pass."""
    kernel_function(kind, a, b)  # checks them
    base = vectors(points, id_col, vector_col)
    return base.select(F.col("id").alias("i"), kernel_column(kind, a, b, width(base))("vector", "vector").alias("value"))


def dense_kernel_upper_triangle(points: DataFrame, kind: str, a: float = 1.0, b: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = BROADCAST_CELLS, block: int = BLOCK) -> DataFrame:
    """(i, j, value) of all i < j: other pairs never leave numpy."""
    return _all_pairs(points, id_col, vector_col, kernel_function(kind, a, b), cells, block, upper=True)


def dense_kernel_dot(points: DataFrame, right: DataFrame, columns: list[str], kind: str, a: float = 1.0, b: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = BROADCAST_CELLS, block: int = BLOCK) -> DataFrame:
    """(i, columns): the dense kernel times a matrix (j, columns).

    A linear kernel takes one pass of sums, as x_i . x_j r_j summed over j is
    x_i . (sum of x_j r_j).  Others add up blocks of products: no pair
    becomes a row.
    """
    kernel_function(kind, a, b)  # checks them
    base = vectors(points, id_col, vector_col)
    d = width(base)
    both = base.join(right.select(F.col("j").alias("id"), *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"_r{k}") for k, c in enumerate(columns)]), "id")
    return _dot(base, both, d, columns, kind, a, b, cells, block)


def dense_kernel_sum(points: DataFrame, kind: str, a: float = 1.0, b: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = BROADCAST_CELLS, block: int = BLOCK) -> DataFrame:
    """(i, total): the sum of each row of the dense kernel."""
    kernel_function(kind, a, b)  # checks them
    base = vectors(points, id_col, vector_col)
    return _dot(base, base.withColumn("_r0", F.lit(1.0)), width(base), ["total"], kind, a, b, cells, block)


def _dot(base: DataFrame, both: DataFrame, d: int, columns: list[str], kind: str, a: float, b: float, cells: int, block: int) -> DataFrame:
    ship(base.sparkSession)
    names = [f"_r{k}" for k in range(len(columns))]
    if kind == "linear":

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, len(names)))
            for batch in batches:
                if len(batch):
                    total += matrix(batch.column("vector")).T @ np.column_stack([batch.column(c).to_numpy() for c in names])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["place", "value"])

        total = np.zeros(d * len(names))
        for place, value in both.mapInArrow(part, "place int, value double").groupBy("place").agg(F.sum("value")).collect():
            total[place] = value
        by = total.reshape(d, len(names))
        x = vec.cells("vector", d)
        return base.select(F.col("id").alias("i"), *[vec.affine(x, by[:, k]).alias(c) for k, c in enumerate(columns)])
    f = kernel_function(kind, a, b)

    def products(x: pa.Table, blocks: Blocks) -> Iterator[pa.Table]:
        own = matrix(x.column("vector"))
        total = np.zeros((len(own), len(names)))
        for y in blocks():
            if len(y):
                other, r = matrix(y.column("vector")), np.column_stack([y.column(c).to_numpy() for c in names])
                for i in range(0, len(own), 256):
                    total[i : i + 256] += f(own[i : i + 256], other) @ r
        yield pa.table({"i": x.column("id"), **{c: total[:, k] for k, c in enumerate(columns)}})

    schema = f"i {base.schema['id'].dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in columns)
    return each_against_all(base, both, products, schema, cells, block)
