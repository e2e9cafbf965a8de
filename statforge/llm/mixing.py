"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixed corpus, in characters.  The mean
repetition of its documents is share * total / own size; a document's count is
the inverse of the Poisson distribution of that mean at a uniform number
hashed from seed, id and text.  Documents are exploded by their counts and put
in the order of a hash of each copy: a global shuffle that any rerun repeats.

Results: a document of count 0 is left out.  A null source is a source of its
own.  A null text has size 0 but is replicated like any other of its source.
Equal rows of one id are told apart by nothing and get equal counts.  An
empty table gives an empty one.  A source of total size 0 has mean 1.  Targets
of sources that don't occur are left out and the others rescaled; sources
without a target get none and their documents are dropped.  Very long texts
are replicated whole.  Columns of any names stay as they are: the rows travel
nested, beside our own columns.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statforge.sources.shipping import ship

from .tables import written

#: Sizes to this power are the default targets: small sources gain, large ones lose.
TEMPERATURE = 0.5
SEED = 11
#: Distribution tables of up to this many numbers are broadcast; beyond it they are joined by shuffle.
BROADCAST_NUMBERS = 1_000_000


def rates(df: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, size, rate): characters and mean repetition of each source."""
    sizes = df.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.coalesce(F.sum(F.length(F.col(f"`{text_col}`"))), F.lit(0)).cast("bigint").alias("size"))
    if targets is None:
        aim = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        aim = F.lit(None).cast("double")
        for name, weight in targets.items():
            aim = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(aim)
    every = Window.partitionBy(F.lit(1))  # one row a source
    share = F.col("aim") / F.sum("aim").over(every)
    rate = F.when(F.col("aim").isNull(), 0.0).when(F.col("size") == 0, 1.0).otherwise(share * F.sum("size").over(every) / F.col("size"))
    return sizes.withColumn("aim", aim).withColumn("rate", rate).select("source", "size", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def digest(*parts: F.Column) -> F.Column:
    """MD5 sum of the parts, in hexadecimal; a null counts as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def fraction(hexed: F.Column) -> F.Column:
    """A number in (0, 1) from the first 13 hex digits."""
    return (F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def distribution(mean: float) -> tuple[int, list[float]]:
    """(k, [P(count <= k), P(count <= k + 1), ...]) over all counts within 12 deviations of the mean, and 40 more."""
    mode, reach = math.floor(mean), math.ceil(12 * math.sqrt(mean))
    start = max(0, mode - reach)
    up = np.cumprod(mean / np.arange(mode + 1, mode + reach + 41))
    down = np.cumprod(np.arange(mode, start, -1) / mean) if mean > 0 else np.zeros(0)
    p = np.concatenate([down[::-1], [1.0], up])
    return start, (p.cumsum() / p.sum()).tolist()


def _copies(
    df: DataFrame, targets: dict[str, float] | None, temperature: float, seed: int, id_col: str, source_col: str, text_col: str
) -> DataFrame:
    """(row, copy, turn): each copy of each row, in shuffled order."""
    per_source = rates(df, targets, temperature, source_col, text_col)
    ship(df.sparkSession)
    tabled = F.udf(distribution, "start bigint, cdf array<double>")  # once a source
    table = written(per_source.filter("rate > 0").withColumn("d", tabled("rate")).select("source", "d.start", "d.cdf"), "rates")
    if (table.agg(F.sum(F.size("cdf"))).first()[0] or 0) <= BROADCAST_NUMBERS:
        table = F.broadcast(table)
    own = digest(F.lit(seed), F.col(f"`{id_col}`"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), own.alias("own"), F.col(f"`{source_col}`").alias("from"))
    return (
        rows.withColumn("u", fraction(F.col("own")))
        .join(table, F.col("from").eqNullSafe(F.col("source")))
        .withColumn("count", F.col("start") + F.size(F.filter("cdf", lambda c: c < F.col("u"))))
        .filter("count > 0")
        .select("row", "own", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count"))).alias("copy"))
        .select("row", "copy", fraction(digest(F.col("copy"), F.col("own"))).alias("turn"))
        .repartition(F.col("turn"))
        .sortWithinPartitions("turn")
    )


def mixed(
    df: DataFrame,
    targets: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    numbered: bool = True,
) -> DataFrame:
    """The replicated documents in shuffled order, with ``df``'s columns.

    If ``numbered``, ``_copy`` (from 1) and ``_order`` follow; their names get
    further underscores in front where ``df`` has such columns.
    """
    copies = _copies(df, targets, temperature, seed, id_col, source_col, text_col)
    taken = {c.lower() for c in df.columns}
    named = []
    for name, col in (("_copy", "copy"), ("_order", "turn")) if numbered else ():
        while name in taken:
            name = f"_{name}"
        named.append(F.col(col).alias(name))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in df.columns], *named)


def poisson_count(u: float, mean: float) -> int:
    """The inverse of the distribution, for tests."""
    start, cdf = distribution(mean)
    return start + sum(c < u for c in cdf)
