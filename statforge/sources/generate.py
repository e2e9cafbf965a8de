"""Synthetic datasets, made in parallel from row numbers and seeds.

A value depends only on the seed, its row number and its column, so any number
of partitions and any rerun gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions.hashing import SPAN, drawn


def uniform(seed: int, *keys: Column | int) -> Column:
    """A number in (0, 1) hashed from seed and keys."""
    return (drawn(seed, *keys).cast("double") + 0.5) / float(SPAN)


def normal(seed: int, *keys: Column | int) -> Column:
    """A standard normal number by the Box-Muller transform."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys, 0))) * F.cos(2 * math.pi * uniform(seed, *keys, 1))


Distribution = Callable[..., Column]


def blobs(spark: SparkSession, size: int, centroids: Sequence[Sequence[float]], seed: int = 42, distribution: Distribution = normal) -> DataFrame:
    """(row_id, x0.., blob): ``size`` rows around each centroid, blob after blob."""
    require(size >= 0, "a size is not negative")
    require(len({len(c) for c in centroids}) == 1, "centroids differ in width")
    rows = spark.range(size * len(centroids)).withColumnRenamed("id", "row_id")
    blob = (F.col("row_id") / size).cast("int")
    centre = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centroids])
    return rows.select(
        "row_id", *[(centre[blob][j] + distribution(seed, F.col("row_id"), j)).alias(f"x{j}") for j in range(len(centroids[0]))], blob.alias("blob")
    )


def make_dataset(spark: SparkSession, rows: int, features: int, targets: int, seed: int = 42, feature_distribution: Distribution = uniform, target_distribution: Distribution = uniform) -> DataFrame:
    """(row_id, x0.., y0..): independent numbers of two distributions."""
    base = spark.range(rows).withColumnRenamed("id", "row_id")
    return base.select(
        "row_id",
        *[feature_distribution(seed, F.col("row_id"), j).alias(f"x{j}") for j in range(features)],
        *[target_distribution(seed + 1, F.col("row_id"), j).alias(f"y{j}") for j in range(targets)],
    )


def swissroll(spark: SparkSession, height: float, speed: float, points: int, seed: int = 42) -> DataFrame:
    """(row_id, x, y, z) on a rolled-up sheet: angle up to 10, radius speed times angle."""
    base = spark.range(points).withColumnRenamed("id", "row_id").withColumn("phi", 10 * uniform(seed, F.col("row_id"), 0))
    radius = F.lit(speed) * F.col("phi")
    return base.select("row_id", (radius * F.cos("phi")).alias("x"), (radius * F.sin("phi")).alias("y"), (F.lit(height) * uniform(seed, F.col("row_id"), 1)).alias("z"))


def _ringed(spark: SparkSession, rings: Sequence[tuple[float, float]], points: int, seed: int) -> DataFrame:
    each = math.ceil(points / len(rings))
    base = spark.range(each * len(rings)).withColumnRenamed("id", "row_id").withColumn("ring", (F.col("row_id") / each).cast("int"))
    bounds = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in rings])[F.col("ring")]
    return (
        base.withColumn("r", bounds[0] + (bounds[1] - bounds[0]) * uniform(seed, F.col("row_id"), 0))
        .withColumn("phi", 2 * math.pi * uniform(seed, F.col("row_id"), 1))
        .withColumn("theta", 2 * math.pi * uniform(seed, F.col("row_id"), 2))
    )


def convoluted_rings(spark: SparkSession, rings: Sequence[tuple[float, float]], points: int, seed: int = 42) -> DataFrame:
    """(row_id, x, y, z, ring): spherical shells of the given radii, ceil(points / rings) rows each."""
    r, phi, theta = F.col("r"), F.col("phi"), F.col("theta")
    return _ringed(spark, rings, points, seed).select(
        "row_id", (r * F.sin(theta) * F.cos(phi)).alias("x"), (r * F.sin(theta) * F.sin(phi)).alias("y"), (r * F.cos(theta)).alias("z"), "ring"
    )


def rings2d(spark: SparkSession, rings: Sequence[tuple[float, float]], points: int, seed: int = 42) -> DataFrame:
    """(row_id, x, y, ring): the same in the plane."""
    r, phi = F.col("r"), F.col("phi")
    return _ringed(spark, rings, points, seed).select("row_id", (r * F.cos(phi)).alias("x"), (r * F.sin(phi)).alias("y"), "ring")
