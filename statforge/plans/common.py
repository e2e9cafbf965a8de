"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import table

Query = Callable[[SparkSession, str], DataFrame]

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


class Book:
    """Queries and their SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """The columns rounded, without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


def listed(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A few results of a fit as a table."""
    return spark.createDataFrame([tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows], schema)


def embedded(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """(vec_id, e0.., label): embeddings with a column for each coordinate."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", *[e[i].cast("double").alias(f"e{i}") for i in range(width)], "label")


def dims(width: int) -> list[str]:
    return [f"e{i}" for i in range(width)]
