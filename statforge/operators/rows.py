"""Row numbers, running totals and exact quantiles over tables of any size.

An unpartitioned window would pull a whole table into one task.  Here rows fall
into buckets between quantiles of the first key, each bucket is summed on its
own, and the buckets before it add an offset: one row a bucket is all that
meets in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotEnoughSamples, require

ROWS_A_BUCKET = 1_000_000


def _in_buckets(df: DataFrame, key: str, descending: bool, rows_a_bucket: int) -> DataFrame | None:
    """``df`` with _bucket ascending in the wanted order; None if one bucket holds everything."""
    n = df.count()
    buckets = -(-n // rows_a_bucket)
    if buckets <= 1:
        return None
    place = F.col(f"`{key}`").cast("double")
    cuts = df.select(place.alias("k")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    placed = Bucketizer(splits=edges, inputCol="_place", outputCol="_bucket", handleInvalid="keep").transform(df.withColumn("_place", place)).drop("_place")
    return placed.withColumn("_bucket", -F.col("_bucket")) if descending else placed


def running(df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column], descending: bool = False, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """``df`` with inclusive running totals in the order of ``keys``, which must tell all rows apart.

    The first key must be numeric if the table is larger than one bucket.
    """
    order = [F.col(f"`{k}`").desc() if descending else F.col(f"`{k}`").asc() for k in keys]
    placed = _in_buckets(df, keys[0], descending, rows_a_bucket)
    if placed is None:
        own = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(v).over(own).alias(k) for k, v in totals.items()])
    sums = placed.groupBy("_bucket").agg(*[F.sum(v).alias(f"_{k}") for k, v in totals.items()])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offset = sums.select(F.col("_bucket"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in totals])
    own = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(v).over(own).alias(k) for k, v in totals.items()])
    joined = summed.join(offset, "_bucket")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in totals])


def indexed(df: DataFrame, keys: Sequence[str], name: str = "row_id", rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """``df`` with contiguous row numbers from 0 in the order of ``keys``."""
    return running(df, keys, {name: F.lit(1).cast("bigint")}, rows_a_bucket=rows_a_bucket).withColumn(name, F.col(name) - 1)


def quantile(df: DataFrame, value: Column, q: float, most: int = 200_000) -> float:
    """The exact quantile, linear between the two nearest ranks; nulls don't count.

    Approximate quantiles bracket the wanted ranks, and only the values within
    the bracket are looked at again, until few enough are left to sort.
    """
    require(0 <= q <= 1, "a quantile's level is between 0 and 1")
    values = df.select(value.cast("double").alias("v")).filter("v is not null")
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    require(n > 0, "no values", NotEnoughSamples)
    rank = q * (n - 1)
    first, below = int(rank), 0
    inside, size = values, n
    while size > most and low < high:
        at = (first - below) / max(size - 1, 1)
        a, b = inside.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, at - 0.0005)), F.lit(min(1.0, at + 0.0005 + 2 / size))), F.lit(20_000))).first()[0]
        if (a, b) == (low, high):
            break
        under, kept = inside.agg(F.count_if(F.col("v") < a), F.count_if((F.col("v") >= a) & (F.col("v") <= b))).first()
        if not (below + under <= first and first + 1 < below + under + kept or first == n - 1 and below + under <= first):
            break  # the bracket missed: sort what there is
        inside, size, below, low, high = values.filter((F.col("v") >= a) & (F.col("v") <= b)), kept, below + under, a, b
    if low == high:
        return float(low)
    counted = running(inside.groupBy("v").agg(F.count(F.lit(1)).alias("c")), ["v"], {"upto": F.col("c")})
    wanted = [first - below, min(first + 1, n - 1) - below]
    found = counted.agg(*[F.min(F.when(F.col("upto") > w, F.col("v"))) for w in wanted]).first()
    return float(found[0] + (found[1] - found[0]) * (rank - first))


def median(df: DataFrame, value: Column) -> float:
    return quantile(df, value, 0.5)
