"""All queries of the reference's operators with their SQL counterparts."""

from __future__ import annotations

from . import data, models
from .common import Query


def queries() -> dict[str, Query]:
    return data.BOOK.queries | models.BOOK.queries


def oracle_sql() -> dict[str, str]:
    return data.BOOK.sql | models.BOOK.sql
