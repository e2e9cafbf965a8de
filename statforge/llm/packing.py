"""Packing documents into training windows by online sum of squares.

Documents arrive one by one.  Of all fill levels of open windows (and the
empty window) that have room, the one is taken after which the sum over levels
h of N(h)^2 is least, N(h) being the number of windows filled to h and full
windows not counting; ties go to the fuller window.  N is kept in a level
array, with a queue of windows for each level.  A document longer than a
window first fills whole windows of its own; its rest is placed as above.

Lengths are token counts.  Packing is online within a shard: documents are
spread over ``shards`` by hash and come in the order of a hash.  Shards are even
at any size and waste at most a few windows each; by default there is one for
each ``SHARD_ROWS`` documents.

Results: null and empty texts have length 0 and take no room: they get no row.
Repeated rows are placed one by one, spread over all shards, and rows with a
null id like any others.  Texts of any length are counted whole.  An empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tables import written
from .textops import begins

WINDOW = 2048
SHARD_ROWS = 50_000


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces as (item, window number, start in the window, length)."""
    level = np.zeros(window + 1, np.int64)
    queues: list[deque] = [deque() for _ in range(window + 1)]
    item, at, begin, size = [], [], [], []
    opened = 0
    for i, n in enumerate(lengths.tolist()):
        while n >= window:
            item.append(i), at.append(opened), begin.append(0), size.append(window)
            opened += 1
            n -= window
        if n <= 0:
            continue
        # change of the sum of squares / 2 by moving a window from level h to h + n
        cost = level[n : window + 1] - level[: window + 1 - n] + 1
        cost[-1] = -level[window - n]  # a full window doesn't count ...
        cost = 2 * cost + (np.arange(len(cost)) == len(cost) - 1)
        cost[0] = 2 * level[n] + 1 if n < window else 0  # ... nor does an empty one
        ok = level[: window + 1 - n] > 0
        ok[0] = True
        options = np.flatnonzero(ok)
        c = cost[options]
        h = int(options[len(c) - 1 - int(np.argmin(c[::-1]))])
        if h:
            w = queues[h].popleft()
            level[h] -= 1
        else:
            w = opened
            opened += 1
        item.append(i), at.append(w), begin.append(h), size.append(n)
        if h + n < window:
            level[h + n] += 1
            queues[h + n].append(w)
    return tuple(np.array(x, np.int64) for x in (item, at, begin, size))


def packed(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_rows: int = SHARD_ROWS, shards: int | None = None, vocabulary: str = tokens.DEFAULT_VOCABULARY
) -> DataFrame:
    """(doc_id, piece, shard, window, begin, length): where each piece of each document goes, in tokens."""
    counted = tokens.token_counts(df, id_col, text_col, vocabulary, hashed=True).filter("n_tokens > 0")
    # equal rows are counted first and then numbered, so that none of them share a turn
    sized = written(counted.groupBy("doc_id", "n_tokens", "text_hash").agg(F.count(F.lit(1)).alias("n")), "lengths")
    if shards is None:
        shards = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // shard_rows))
    each = sized.select("doc_id", F.col("n_tokens").cast("int").alias("length"), "text_hash", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    turned = each.select("doc_id", "length", F.xxhash64("doc_id", "text_hash", "copy").alias("turn"))
    placed = turned.withColumn("shard", F.pmod(F.xxhash64("turn"), F.lit(shards)).cast("int"))
    id_type = sized.schema["doc_id"].dataType.simpleString()

    def pack(group: pa.Table) -> pa.Table:
        begins("packing")
        turn, n = group.column("turn").to_numpy(), group.column("length").to_numpy()
        order = np.lexsort((n, turn))
        item, at, begin, size = place(n[order], window)
        piece = np.zeros(len(item), np.int64)
        if len(item):
            first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
            piece = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        ids = group.column("doc_id").take(pa.array(order[item]))
        shard = group.column("shard").take(pa.array(order[item]))
        return pa.table({"doc_id": ids, "piece": piece.astype(np.int32), "shard": shard, "window": at, "begin": begin.astype(np.int32), "length": size.astype(np.int32)})

    return placed.groupBy("shard").applyInArrow(pack, f"doc_id {id_type}, piece int, shard int, window bigint, begin int, length int")
