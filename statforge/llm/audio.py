"""Chroma fingerprints of recordings, and their alignment.

A recording is a column of 16-bit mono PCM.  Short-time spectra are folded to
twelve pitch classes and normalised; an integral image over these frames makes
each filter - a difference of rectangle sums - a few lookups, and 16 filters of
2 bits (in Gray code) pack into one 32-bit integer a frame.

Two recordings are aligned where their integers agree: equal integers vote for
an offset, the best offset of the histogram is taken, and the pair is kept if
enough frames overlap there and the share of differing bits is small.

Recordings of equal fingerprints are one class, and only its smallest id meets
others.  Candidates come from an inverted index of integers.  A recording's
integers are posted rarest first, and only so many of them that a pair with
``VOTES`` equal integers must meet in one; an integer's first, second, ...
occurrence are postings of their own, so repeated ones count as often as both
recordings hold them.  Where recordings meet, all their equal integers are
sorted once into (pair, offset) counts: a pair costs as much as the integers
it shares, and only those with enough votes for one offset are aligned.

Results: null, empty or too short recordings have an empty fingerprint, no
class, and align with nothing.  Repeated rows are rows of one class; rows of
one id and equal fingerprints count as one recording.  Very long recordings
are compared whole.  Silence gives frames without direction and one constant
integer.  Ties between offsets go to the smaller shift, then the negative one.
An empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neardup import components
from .tables import only, written

RATE, FRAME, HOP = 4000, 512, 256
#: Kind, first pitch class, height and width of the 16 filters, in the manner of published chroma fingerprints.
FILTERS = (
    (0, 4, 3, 15), (4, 4, 6, 15), (1, 0, 4, 16), (3, 8, 2, 12), (3, 4, 4, 8), (4, 0, 3, 5), (1, 2, 2, 9), (2, 7, 3, 4),
    (2, 6, 2, 16), (2, 1, 3, 2), (5, 10, 1, 15), (3, 6, 2, 10), (2, 1, 1, 14), (3, 5, 6, 4), (1, 9, 2, 12), (3, 4, 2, 14),
)
WIDTH = 16
LEVELS = (-0.12, 0.0, 0.12)
VOTES = 12
LEAST_OVERLAP = 24
MOST_ERRORS = 0.2
_MEETINGS = 1 << 20
#: Recordings meet in tiles of about so many frames, and tiles are taken together up to about so many frames.
TILE = 1 << 16
_TOGETHER = 1 << 19


def chroma(signal: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Unit pitch-class vectors (frames x 12) of one recording."""
    n = (len(signal) - frame) // hop + 1
    if n < 1:
        return np.zeros((0, 12))
    rows = np.lib.stride_tricks.sliding_window_view(signal, frame)[::hop] * np.hanning(frame)
    power = np.abs(np.fft.rfft(rows, axis=1)) ** 2
    freq = np.fft.rfftfreq(frame, 1 / rate)
    used = (freq >= 110) & (freq <= 1900)
    note = np.zeros((len(freq), 12))
    note[np.flatnonzero(used), np.round(12 * np.log2(freq[used] / 440)).astype(int) % 12] = 1
    c = power @ note
    norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, c / np.maximum(norm, 1e-12), 0.0)


def fingerprint(c: np.ndarray) -> np.ndarray:
    """One packed integer for each window of WIDTH frames."""
    n = len(c) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.int32)
    total = np.zeros((len(c) + 1, 13))
    total[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    x = np.arange(n)

    def area(x0: np.ndarray, y0: int, x1: np.ndarray, y1: int) -> np.ndarray:
        y0, y1 = min(y0, 12), min(y1, 12)
        return total[x1, y1] - total[x0, y1] - total[x1, y0] + total[x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(x, y, x + w, y + h)
        if kind == 0:
            part = whole / 2
        elif kind == 1:  # upper half
            part = area(x, y + h // 2, x + w, y + h)
        elif kind == 2:  # later half
            part = area(x + w // 2, y, x + w, y + h)
        elif kind == 3:  # two opposite quarters
            part = area(x, y + h // 2, x + w // 2, y + h) + area(x + w // 2, y, x + w, y + h // 2)
        elif kind == 4:  # middle third by class
            part = area(x, y + h // 3, x + w, y + 2 * h // 3)
        else:  # middle third by time
            part = area(x + w // 3, y, x + 2 * w // 3, y + h)
        value = np.log1p(part) - np.log1p(whole - part)
        if kind == 0:
            value = np.log1p(whole) - np.log1p(w * h * 0.2)
        level = np.searchsorted(LEVELS, np.round(value, 9))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out.view(np.int32)


def pcm16(cell: pa.Scalar) -> np.ndarray | None:
    """Bytes of 16-bit mono PCM as numbers in [-1, 1); an odd last byte is dropped."""
    if not cell.is_valid:
        return None
    raw = cell.as_buffer()
    return np.frombuffer(raw, np.int16, count=len(raw) // 2) / 32768.0


def fingerprints(df: DataFrame, id_col: str, audio_col: str, rate: int = RATE, decode: Callable[[pa.Scalar], np.ndarray | None] = pcm16) -> DataFrame:
    """(rec_id, prints): the integers of each recording.

    ``decode`` turns a cell of the media column into a signal.  It runs where
    the signal is used, one recording at a time: decoded audio is many times
    the size of the column and never leaves the worker.
    """
    rows = only(df, rec_id=id_col, audio=audio_col)
    id_type = rows.schema["rec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for a in batch.column("audio"):
                signal = decode(a)
                prints.append(np.zeros(0, np.int32) if signal is None else fingerprint(chroma(signal, rate)))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prints])]).astype(np.int32))
            flat = pa.array(np.concatenate(prints) if prints else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.ListArray.from_arrays(offsets, flat)], names=["rec_id", "prints"])

    return rows.mapInArrow(run, f"rec_id {id_type}, prints array<int>")


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal integers, sorted by value: values, starts and lengths."""
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(a)))
    order = np.argsort(a[start], kind="stable")
    return a[start][order], start[order], size[order]


def histogram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Votes by offset + len(a); b[i + offset] answers a[i].

    Two runs of one integer vote for a range of offsets in the shape of a
    trapezoid, which four second differences describe: a held note costs one meeting.
    """
    (va, sa, na), (vb, sb, nb) = _runs(a), _runs(b)
    low, high = np.searchsorted(vb, va, "left"), np.searchsorted(vb, va, "right")
    n = high - low
    upto = np.cumsum(n)
    bend = np.zeros(len(a) + len(b) + 3, np.int64)
    i = 0
    while i < len(va):  # repeated integers meet as often as the product of their runs: some at a time
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _MEETINGS)))
        m = n[i:j]
        at = np.repeat(np.arange(i, j), m)
        to = np.repeat(low[i:j], m) + np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
        first = sb[to] - sa[at] - na[at] + 1 + len(a)
        for place, sign in ((first, 1), (first + na[at], -1), (first + nb[to], -1), (first + na[at] + nb[to], 1)):
            bend += sign * np.bincount(place, minlength=len(bend))
        i = j
    return bend.cumsum().cumsum()[: len(a) + len(b)]


def measured(a: np.ndarray, b: np.ndarray, best: int, least: int, most: float) -> tuple[int, int, float] | None:
    """(offset, overlap, share of differing bits) at one offset, or None."""
    start, stop = max(0, -best), min(len(a), len(b) - best)
    if stop - start < least:
        return None
    errors = np.bitwise_count(a[start:stop].view(np.uint32) ^ b[start + best : stop + best].view(np.uint32)).sum()
    share = round(float(errors) / (32 * (stop - start)), 6)
    return (best, stop - start, share) if share <= most else None


def compare(a: np.ndarray, b: np.ndarray, votes: int = VOTES, least: int = LEAST_OVERLAP, most: float = MOST_ERRORS) -> tuple[int, int, float] | None:
    """(offset, overlap, share of differing bits) at the offset of most votes, or None; b[i + offset] answers a[i]."""
    count = histogram(a, b)
    if count.max(initial=0) < max(votes, 1):
        return None
    offset = np.flatnonzero(count == count.max()) - len(a)
    return measured(a, b, int(offset[np.lexsort((offset, abs(offset)))[0]]), least, most)


def best_offsets(value: np.ndarray, frame: np.ndarray, rec: np.ndarray, side: np.ndarray, group: np.ndarray, votes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Pairs of recordings (a < b) with enough votes for one offset, the offset of most votes, and pairs to be compared by themselves.

    The arrays hold one entry for each frame of each recording of each group.
    Recordings (numbers, each of one group) of side 0 meet each other, those
    of side 1 only those of side 2.
    """
    order = np.lexsort((frame, rec, side, value, group))
    value, frame, rec, side, group = (x[order] for x in (value, frame, rec, side, group))
    fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])])
    own = fresh | np.concatenate([[True], rec[1:] != rec[:-1]])
    turn = fresh | np.concatenate([[True], side[1:] != side[:-1]])

    def ends(first: np.ndarray) -> np.ndarray:
        """For each entry, where the next stretch begins."""
        at = np.flatnonzero(first)
        return np.repeat(np.append(at[1:], len(first)), np.diff(np.append(at, len(first))))

    begin, end = np.where(side == 1, ends(turn), ends(own)), ends(fresh)
    n = np.where(side == 2, 0, end - begin)
    left = np.flatnonzero(n)
    left = left[np.argsort(rec[left], kind="stable")]
    upto = np.cumsum(n[left])
    edge = np.append(np.flatnonzero(np.concatenate([[True], rec[left][1:] != rec[left][:-1]])), len(left)) if len(left) else np.zeros(1, np.int64)
    span = 2 * int(frame.max(initial=0)) + 2
    out, alone = [], []
    i = 0
    while i + 1 < len(edge):
        done = upto[edge[i] - 1] if edge[i] else 0
        j = max(i + 1, int(np.searchsorted(upto[edge[1:] - 1], done + _MEETINGS, "right")))
        part = left[edge[i] : edge[j]]
        if j == i + 1 and upto[edge[j] - 1] - done > 4 * _MEETINGS:  # one recording of many equal integers
            met = np.unique(np.concatenate([rec[b:e] for b, e in set(zip(begin[part].tolist(), end[part].tolist()))]))
            alone += [(int(rec[part[0]]), int(x)) for x in met]
        else:
            m = n[part]
            at = np.repeat(part, m)
            to = np.repeat(begin[part], m) + np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            x, y, shift = rec[at], rec[to], frame[to] - frame[at]
            swap = x > y
            x, y, shift = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, -shift, shift)
            base = int(x.min())
            wide = int(y.max()) - base + 1
            key = np.sort(((x - base) * wide + y - base) * span + shift + span // 2)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(first, len(key)))
            ok = count >= votes
            key, count = key[first[ok]], count[ok]
            pair, offset = key // span, key % span - span // 2
            best = np.lexsort((offset, abs(offset), -count, pair))
            best = best[np.concatenate([[True], pair[best][1:] != pair[best][:-1]])] if len(best) else best
            out.append(np.stack([pair[best] // wide + base, pair[best] % wide + base, offset[best]]))
        i = j
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return found[0], found[1], found[2], alone


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, frames, value): each integer with the number of its occurrence in the lower half."""
    for batch in batches:
        lists = batch.column("prints")
        flat = lists.flatten().to_numpy().astype(np.int64)
        frames = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(lists)), frames)
        order = np.lexsort((flat, row))
        row, flat = row[order], flat[order]
        first = np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])[: len(flat)]
        nth = np.arange(len(flat)) - np.maximum.accumulate(np.where(first, np.arange(len(flat)), 0))
        yield pa.RecordBatch.from_arrays([batch.column("rec_id").take(pa.array(row)), pa.array(frames[row].astype(np.int32)), pa.array((flat << 32) | nth)], names=["rec_id", "frames", "value"])


def aligned(prints: DataFrame, votes: int = VOTES, least: int = LEAST_OVERLAP, most: float = MOST_ERRORS) -> DataFrame:
    """(rec_a, rec_b, offset, overlap, bit_errors), rec_a < rec_b, from (rec_id, prints): all pairs that align.

    A pair is a candidate if it may share ``votes`` integers, counted as often as
    both hold them; that is exact, as the votes of one offset pair each integer
    once: each recording posts all but its votes - 1 commonest shared
    occurrences, the rarest first.
    """
    prints = prints.filter("rec_id is not null and size(prints) > 0").select("rec_id", "prints")
    id_type = prints.schema["rec_id"].dataType.simpleString()
    numbered = prints.mapInArrow(_occurrences, f"rec_id {id_type}, frames int, value bigint")
    posted = numbered.distinct()
    lists = posted.groupBy("value").agg(F.count(F.lit(1)).alias("df"), F.min("rec_id").alias("leader")).filter("df > 1")
    own = Window.partitionBy("rec_id")
    kept = written(
        posted.join(lists, "value")
        .withColumn("shared", F.count(F.lit(1)).over(own))
        .withColumn("nth", F.row_number().over(own.orderBy("df", "value")))
        .filter(F.col("nth") <= F.col("shared") - (votes - 1))
        .select("rec_id", "frames", "leader")
        .distinct(),
        "postings",
    )
    size = kept.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.sum("frames") / TILE).cast("int").alias("tiles")).filter("size > 1")
    spread = kept.join(size, "leader")
    frames = spread.agg(F.sum(F.col("frames").cast("bigint") * F.col("tiles"))).first()[0] or 0
    together = max(1, -(-frames // _TOGETHER))
    tiled = (
        spread.drop("frames")
        .join(prints, "rec_id")
        .withColumn("own", F.pmod(F.xxhash64("rec_id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rec_id", "prints")
        .select(F.pmod(F.xxhash64("leader", "i", "j"), F.lit(together)).alias("part"), F.xxhash64("leader", "i", "j").alias("tile"), F.when(F.col("i") == F.col("j"), 0).when(F.col("own") == F.col("i"), 1).otherwise(2).alias("side"), "rec_id", "prints")
    )

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by([("tile", "ascending"), ("rec_id", "ascending")])
        ids = group.column("rec_id").combine_chunks()
        lists = group.column("prints").combine_chunks()
        flat, edge = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        n = np.diff(edge)
        rec = np.repeat(np.arange(len(n)), n)
        frame = np.arange(len(flat)) - edge[:-1][rec]
        a, b, offset, alone = best_offsets(flat, frame, rec, group.column("side").to_numpy()[rec], group.column("tile").to_numpy()[rec], votes)
        names = ids.to_pylist()
        part = [flat[edge[k] : edge[k + 1]] for k in range(len(n))]
        out = []
        for x, y, o in [*zip(a.tolist(), b.tolist(), offset.tolist()), *((x, y, None) for x, y in alone)]:
            if names[x] == names[y]:
                continue
            x, y = min(x, y), max(x, y)  # rows of a tile are sorted by id
            got = compare(part[x], part[y], votes, least, most) if o is None else measured(part[x], part[y], o, least, most)
            if got:
                out.append((names[x], names[y], *got))
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [ids.type, ids.type, pa.int32(), pa.int32(), pa.float64()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("rec_a", "rec_b", "offset", "overlap", "bit_errors"), cols, kinds)})

    schema = f"rec_a {id_type}, rec_b {id_type}, offset int, overlap int, bit_errors double"
    return tiled.groupBy("part").applyInArrow(verify, schema).dropDuplicates(["rec_a", "rec_b"])


_PITCH = 440.0 * 2 ** (np.arange(12) / 12)
_TONE = (9000 * np.sin(2 * np.pi * _PITCH[:, None] * np.arange(HOP * 2) / RATE)).astype(np.int16)


def rendered(cell: pa.Scalar) -> np.ndarray | None:
    """A vector played as a recording, one note for each coordinate.

    A note's pitch class follows from the coordinate's place and whether it is
    low, middling or high, so close vectors sound alike.  It stands in for the
    decoder of a media column.  A null or empty vector has no recording.
    """
    v = cell.as_py()
    if not v:
        return None
    x = np.nan_to_num(np.array([0.0 if c is None else c for c in v]))
    level = np.searchsorted([-0.43, 0.43], x / (np.sqrt((x * x).mean()) + 1e-12))
    note = (np.arange(len(x)) * 7 // 3 + np.arange(len(x)) ** 2 // 5 + 4 * level) % 12
    return _TONE[note].ravel() / 32768.0


def recordings_aligned(df: DataFrame, id_col: str = "rec_id", audio_col: str = "audio", rate: int = RATE, decode: Callable[[pa.Scalar], np.ndarray | None] = pcm16) -> DataFrame:
    """(rec_id, prints, class_id, links, best): one row for each recording.

    Recordings that align, directly or through others, have the smallest of
    their ids as ``class_id``.  ``links`` counts the other rows that a recording
    aligns with, copies included.  ``best`` is the partner of another
    fingerprint with the fewest differing bits, then the longest overlap, then
    the smallest id (of those with that partner's fingerprint); its offset o
    says that the partner's frame i + o answers frame i.  ``aligned`` gives the
    pairs themselves.
    """
    prints = written(fingerprints(df, id_col, audio_col, rate, decode), "prints")
    found = prints.filter("size(prints) > 0")
    units = written(found.groupBy("prints").agg(F.min("rec_id").alias("rec"), F.count(F.lit(1)).alias("n")).withColumn("unit", F.xxhash64("prints")), "recordings")
    pairs = written(aligned(units.select(F.col("unit").alias("rec_id"), "prints")), "aligned")
    roots = components(pairs.select(F.col("rec_a").alias("a"), F.col("rec_b").alias("b"))).withColumnRenamed("node", "unit")
    sides = pairs.select(F.col("rec_a").alias("unit"), F.col("rec_b").alias("partner"), "offset", "overlap", "bit_errors").unionByName(
        pairs.select(F.col("rec_b").alias("unit"), F.col("rec_a").alias("partner"), (-F.col("offset")).alias("offset"), "overlap", "bit_errors")
    )
    named = sides.join(units.select(F.col("unit").alias("partner"), "rec", "n"), "partner")
    linked = named.groupBy("unit").agg(
        F.sum("n").alias("others"),
        F.min(F.struct("bit_errors", (-F.col("overlap")).alias("less"), F.col("rec").isNull().alias("no"), "rec", "offset", "overlap")).alias("best"),
    )
    rooted = units.join(roots, "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    classes = rooted.groupBy("root").agg(F.min("rec").alias("class_id"))
    alike = F.when(F.size("prints") >= max(VOTES, LEAST_OVERLAP), F.col("n") - 1).otherwise(0)  # a recording aligns with its copy at 0
    known = (
        rooted.join(classes, "root")
        .join(linked, "unit", "left")
        .select("unit", "class_id", (alike + F.coalesce("others", F.lit(0))).alias("links"), F.when(F.col("best").isNotNull(), F.struct("best.rec", "best.offset", "best.overlap", "best.bit_errors")).alias("best"))
    )
    marked = prints.withColumn("unit", F.when(F.size("prints") > 0, F.xxhash64("prints")))
    return marked.join(known, "unit", "left").select("rec_id", "prints", "class_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), "best")
