"""Numbers drawn by hash: the same for the same parts in Spark, Python and SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 52


def drawn(*parts: Column | int) -> Column:
    """A number below 2^52: the first 13 hexadecimal digits of the MD5 sum of the parts, joined by bars."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def drawn_number(*parts: object) -> int:
    """The same outside of Spark."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def uniform_number(*parts: object) -> float:
    return (drawn_number(*parts) + 0.5) / SPAN


def drawn_sql(*parts: object) -> str:
    """The same as an SQL expression; the parts are expressions."""
    return f"('0x' || substr(md5({' || \'|\' || '.join(f'({p})::varchar' for p in parts)}), 1, 13))::bigint"


def uniform_sql(*parts: object) -> str:
    return f"(({drawn_sql(*parts)} + 0.5) / {SPAN}.0)"


def normal_sql(*parts: object) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(*parts, 0)})) * cos(2 * pi() * {uniform_sql(*parts, 1)}))"
