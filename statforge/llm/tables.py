"""Reading tables and cutting lineage, for the queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statforge.sources.shipping import ship
from statforge.sources.store import table, written

__all__ = ["only", "table", "written"]


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under new names: other columns can't clash."""
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").alias(new) for new, c in columns.items()])
