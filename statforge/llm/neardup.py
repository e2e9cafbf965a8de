"""Near duplicates by an inverted join over MinHash signature coordinates.

Each text gets K minima over its word shingles.  Two texts are near duplicates
if at least ``matches`` of their K coordinates agree.  Texts with the same
signature are one unit; units are posted under each (coordinate, value).  Two
units with t agreements share at least one of any K - t + 1 of their postings,
so each unit keeps only that many, the rarest first: values held by a single
unit use up this prefix without being posted at all, a unit with fewer than t
shared values drops out, and long lists (passages that many documents hold)
are skipped.  The lists of one leader - the smallest unit in a list - meet in
one group, where collisions are counted and the candidates are verified on
whole signatures.  Groups of any size are handled: large ones are cut into
square tiles.  Nothing is capped and the result is exact for the signatures.

``linked`` gives one row a document with its class and number of links, so
groups of copies are counted and not expanded; ``unit_pairs`` has the links
between different signatures.

Results: texts that are null or hold no word are no one's duplicates: they
have no links and, in ``linked``, no class.  Rows with a null id take part in
groups and are counted.  Repeated rows count as copies.  Ties go to the
smallest id, nulls last.  Very long texts are read whole.  An empty table
gives an empty one.  Other columns may have any names: ``linked`` ignores
them and ``deduplicated`` keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import only, written
from .textops import Words, begins, mix, slices

COORDINATES = 64
MATCHES = 36
SHINGLE = 3
TILE = 2048
#: Bytes of text signed at once; scratch memory is some 60 times as much.
SLICE = 1_000_000
#: Units of a group whose candidates are taken at once, and pairs verified at once.
ROWS, PAIRS = 128, 20_000
_RNG = np.random.default_rng(20240501)
_MULTIPLIERS = _RNG.integers(0, 1 << 63, size=1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: pa.Array, coordinates: int = COORDINATES, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x coordinates, int64) and a mask of texts that have any word."""
    out = np.zeros((len(texts), coordinates), np.int64)
    has = np.zeros(len(texts), bool)
    for i, j in slices(texts, SLICE):
        h, off = Words(texts.slice(i, j - i)).shingles(shingle)
        rows = np.flatnonzero(np.diff(off)) + i
        has[rows] = True
        starts = off[:-1][np.diff(off) > 0]
        if len(starts):
            for c in range(coordinates):
                out[rows, c] = mix(np.minimum.reduceat(h * _MULTIPLIERS[c], starts) + np.uint64(c)).view(np.int64)
    return out, has


def signed(df: DataFrame, id_col: str, text_col: str, coordinates: int, shingle: int) -> DataFrame:
    """(doc_id, th, unit, sig): unit is a hash of the signature, th one of the text."""
    rows = only(df, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("neardup")
        for batch in batches:
            sig, has = signatures(batch.column("text"), coordinates, shingle)
            unit = np.full(len(sig), 17, np.uint64)
            for c in range(coordinates):
                unit = mix(unit * np.uint64(31) + sig[:, c].view(np.uint64))
            offsets = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * coordinates)
            lists = pa.ListArray.from_arrays(offsets, pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(unit.view(np.int64), mask=~has), lists],
                names=["doc_id", "th", "unit", "sig"],
            )

    return rows.mapInArrow(sign, f"doc_id {id_type}, th bigint, unit bigint, sig array<bigint>")


def confirmed(meets: np.ndarray, sig: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, matches) with a < b of the candidates that agree often enough, found in blocks of rows."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for first in range(0, len(meets), ROWS):
        a, b = np.nonzero(np.triu(meets[first : first + ROWS], first + 1))
        a += first
        for s in range(0, len(a), PAIRS):
            x, y = a[s : s + PAIRS], b[s : s + PAIRS]
            count = (sig[x] == sig[y]).sum(axis=1).astype(np.int32)
            ok = count >= matches
            out.append((x[ok], y[ok], count[ok]))
    return tuple(np.concatenate(c) for c in zip(*out))


def unit_pairs(units: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(a, b, matches) with a < b for all pairs of units (unit, sig) that agree often enough."""
    posted = units.select("unit", F.explode("sig").alias("value"))
    lists = posted.groupBy("value").agg(F.count(F.lit(1)).alias("df"), F.min("unit").alias("leader")).filter("df > 1")
    own = Window.partitionBy("unit")
    prefix = (
        posted.join(lists, "value")
        .withColumn("shared", F.count(F.lit(1)).over(own))
        .withColumn("nth", F.row_number().over(own.orderBy("df", "value")))
        .filter(F.col("nth") <= F.col("shared") - (matches - 1))
    )
    members = prefix.groupBy("unit", "leader").agg(F.collect_list("value").alias("values"))
    size = members.groupBy("leader").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    tiled = (
        members.join(units, "unit")
        .join(size, "leader")
        .withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("unit"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "unit", "sig", "values")
    )

    def verify(group: pa.Table) -> pa.Table:
        begins("neardup")
        unit = group.column("unit").to_numpy()
        own_tile = group.column("own").to_numpy()
        sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(len(unit), -1)
        values = group.column("values").combine_chunks()
        row = np.repeat(np.arange(len(unit)), np.diff(values.offsets.to_numpy()))
        flat = values.flatten().to_numpy()
        order = np.argsort(flat, kind="stable")
        row, flat = row[order], flat[order]
        edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
        meets = np.zeros((len(unit), len(unit)), bool)
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if e - s > 1:
                meets[np.ix_(row[s:e], row[s:e])] = True
        if group.column("i")[0].as_py() != group.column("j")[0].as_py():
            meets &= own_tile[:, None] != own_tile[None, :]  # pairs within a tile have a group of their own
        a, b, count = confirmed(meets, sig, matches)
        x, y = unit[a], unit[b]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "matches": count})

    found = tiled.groupBy("leader", "i", "j").applyInArrow(verify, "a bigint, b bigint, matches int")
    return found.dropDuplicates(["a", "b"])


def _units(signed_docs: DataFrame) -> DataFrame:
    """(unit, sig, rep, n): each signature once, with the smallest id that has it and its number of rows."""
    return signed_docs.filter("unit is not null").groupBy("unit").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))


def linked(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    shingle: int = SHINGLE,
) -> DataFrame:
    """(doc_id, class_id, links) of each row.

    ``class_id`` is the smallest id among the documents that are near
    duplicates directly or through others; ``links`` is the number of other
    rows that agree in at least ``matches`` coordinates.
    """
    docs = written(signed(df, id_col, text_col, coordinates, shingle), "signatures")
    units = written(_units(docs), "units")
    pairs = written(unit_pairs(units.select("unit", "sig"), coordinates, matches), "pairs")
    roots = components(pairs).withColumnRenamed("node", "unit")
    both = pairs.select(F.col("a").alias("unit"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("unit"), F.col("a").alias("other")))
    others = both.join(units.select(F.col("unit").alias("other"), "n"), "other").groupBy("unit").agg(F.sum("n").alias("others"))
    rooted = units.select("unit", "rep", "n").join(roots, "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    classes = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = rooted.join(classes, "root").join(others, "unit", "left").select("unit", "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return docs.select("doc_id", "unit").join(known, "unit", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b), by alternating large and small stars."""
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").filter("u > v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def deduplicated(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    shingle: int = SHINGLE,
) -> DataFrame:
    """The rows of ``df`` with one document of each near-duplicate group: that of the smallest id.

    Groups are connected components of the pairs.  All columns stay as they are.
    """
    docs = written(signed(df, id_col, text_col, coordinates, shingle), "signatures")
    units = written(_units(docs), "units")
    groups = components(unit_pairs(units.select("unit", "sig"), coordinates, matches))
    known = docs.filter("unit is not null").select("doc_id", "th", "unit")
    grouped = known.join(groups.withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    counted = grouped.groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    keepers = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "n")).alias("k"))
    kept = written(keepers.select(F.col("k.doc_id").alias("kept_id"), F.col("k.th").alias("kept_th"), (F.col("k.n") > 1).alias("again")), "kept")
    wordless = docs.filter("unit is null").select(F.col("doc_id").alias("kept_id"), F.col("th").alias("kept_th"), F.lit(False).alias("again")).distinct()
    # the row is nested, so that its columns can't clash with ours
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("own_th"))
    joined = rows.join(kept.unionByName(wordless), F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_th") == F.col("kept_th")))
    out = joined.filter("not again").select("row")
    if kept.filter("again").limit(1).count():  # the kept row itself is repeated: one of its copies stays
        other = [F.col("row").getField(f.name) for f in df.schema.fields if f.dataType.typeName() in ("string", "long", "integer", "double") and f.name != text_col]
        order = F.struct(*other) if other else F.lit(0)
        out = out.unionByName(joined.filter("again").groupBy("kept_id", "kept_th").agg(F.min_by("row", order).alias("row")).select("row"))
    return out.select([F.col("row").getField(c).alias(c) for c in df.columns])
