"""Quality scores by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text: the shares of hashed
three-byte sequences, of which all are learned alike, and four of its shape
(repeated and distinct words, mean word length, length).  Labelled documents
give preference pairs - one of good quality beats one of low quality - and the
weights minimise the logistic loss of the score differences.  A document is
kept if its score is above a score quantile: the level is the share of low
quality among all labels (less ``SPARE``), the scores those of all labelled
documents.  The quantile is found among a rank error of 1 / 100,000.
Only the fit uses a bounded sample (``fit_rows`` labels of each class, those
of the smallest id hashes).  Weights are fixed-point numbers, so that a
score doesn't depend on the texts beside it.

Results: a text that is null or holds no word has a null score and is
rejected.  Without labels of both classes nothing is learned: scores are 0 and
every text with a word is kept; so it is where all scores are equal.  Labels
that are null or of unknown documents are ignored, repeated ones count again.
Texts of any length are read whole.  Rows of one id and several texts are
labelled alike.  An empty table gives an empty one.  Other columns may have
any names: ``judged`` ignores them and ``filtered`` keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import only, written
from .textops import Words, begins, buffers, slices

#: Labels of each class that the fit may use.
FIT_ROWS = 3_000
PAIRS_PER_ROW = 8
#: The quantile's level is the share of low quality less this part of it, so that wrong labels cost no clean document.
SPARE = 0.02
GRAMS, SHAPES = 512, 4
FEATURES = GRAMS + SHAPES
#: Shares of byte sequences are small: so many times them are features.
SCALE = 32.0
_ONE = float(1 << 40)
#: Bytes of text measured at once; scratch memory is some 60 times as much.
SLICE = 1_000_000
#: Up to this many labelled ids are broadcast to pick their texts; beyond it all texts are scored.
BROADCAST_IDS = 500_000


def shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Share of words that repeat the last one, share of distinct words, mean word length and length of each text, all bounded; and a mask of texts with any word."""
    words = Words(texts)
    _, off = buffers(texts)
    n = np.diff(words.off).astype(float)
    count = np.maximum(n, 1)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[words.off[1:]] - total[words.off[:-1]]).astype(float)

    h, owner = words.hash, words.doc()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((h, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = per_text(fresh)
    out = np.stack([np.tanh(4 * per_text(again) / count), np.minimum(1, distinct / count**0.75), np.tanh(np.diff(off) / count / 10), np.log1p(n) / 12], axis=1)
    return out, n > 0


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the three bytes from each place on, a mask of places that begin such three, and the texts' offsets."""
    raw, off = buffers(texts)
    x = raw.astype(np.uint32)
    h = x * np.uint32(0x9E3779B1)
    h[:-1] ^= x[1:] * np.uint32(0x85EBCA6B)
    h[:-2] ^= x[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    whole = np.ones(len(raw), bool)
    for back in (1, 2):
        at = off[1:] - back
        whole[at[at >= off[:-1]]] = False
    return (h >> np.uint32(23)).astype(np.int64), whole, off


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All features of each text, and a mask of texts with any word."""
    out, has = np.zeros((len(texts), FEATURES), np.float32), np.zeros(len(texts), bool)
    for i, j in slices(texts, SLICE):
        part = texts.slice(i, j - i)
        out[i:j, :SHAPES], has[i:j] = shapes(part)
        bucket, whole, off = grams(part)
        n = np.diff(off)
        key = (np.repeat(np.arange(j - i), n) * GRAMS + bucket)[whole]
        share = np.bincount(key, minlength=(j - i) * GRAMS).reshape(j - i, GRAMS)
        out[i:j, SHAPES:] = SCALE * share / np.maximum(n - 2, 1)[:, None]
    return out, has


@dataclass(frozen=True)
class Ranking:
    """Fitted weights and the score that a kept document exceeds."""

    weights: tuple[float, ...]
    threshold: float = float("-inf")


def fit_pairs(x: np.ndarray, good: np.ndarray, ridge: float = 1e-4, seed: int = 7, rounds: int = 200) -> tuple[float, ...]:
    """Bradley-Terry weights from rows x with good (True/False), by limited-memory quasi-Newton steps on the pairs' loss."""
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(winners) or not len(losers):
        return (0.0,) * x.shape[1]
    win, lose = pairs_of(winners, losers, seed)
    m, n = len(win), len(x)

    def slope(v: np.ndarray) -> tuple[float, np.ndarray]:
        s = x @ v
        d = s[win] - s[lose]
        p = 1 / (1 + np.exp(np.clip(d, -500, 500)))
        c = (np.bincount(lose, p, n) - np.bincount(win, p, n)) / m
        return float(np.logaddexp(0, -d).mean() + ridge / 2 * v @ v), x.T @ c + ridge * v

    w = np.zeros(x.shape[1])
    loss, grad = slope(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, kept = -grad, []
        for s, y in reversed(past):
            a = s @ step / (s @ y)
            step = step - a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            step = step * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            step = step + (a - y @ step / (s @ y)) * s
        size, down = 1.0, grad @ step
        while True:
            after, turned = slope(w + size * step)
            if after <= loss + 1e-4 * size * down or size < 1e-8:
                break
            size /= 2
        s, y = size * step, turned - grad
        w, loss, grad = w + s, after, turned
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y)]
        if np.abs(grad).max() < 1e-6 or size < 1e-8:
            break
    return tuple(float(v) for v in w)


def pairs_of(winners: np.ndarray, losers: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The preference pairs of a fit: each row of the larger class in PAIRS_PER_ROW of them."""
    rng = np.random.default_rng(seed)
    m = PAIRS_PER_ROW * max(len(winners), len(losers))
    return winners[rng.permutation(m) % len(winners)], losers[rng.permutation(m) % len(losers)]


def scored(df: DataFrame, weights: tuple[float, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    rows = only(df, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("quality")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score_array(batch.column("text"), weights)], names=["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {id_type}, score double")


def score_array(texts: pa.Array, weights: tuple[float, ...]) -> pa.Array:
    w = np.array(weights)
    fixed = np.round(w[SHAPES:] * SCALE * _ONE / (1 << 10)).astype(np.int64)
    out, has = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for i, j in slices(texts, SLICE):
        part = texts.slice(i, j - i)
        shape, has[i:j] = shapes(part)
        bucket, whole, off = grams(part)
        gain = fixed[bucket]
        gain[~whole] = 0
        total = np.concatenate([[0], np.cumsum(gain)])
        mean = (total[off[1:]] - total[off[:-1]]) / np.maximum(np.diff(off) - 2, 1) * ((1 << 10) / _ONE)
        out[i:j] = (shape * w[:SHAPES]).sum(axis=1) + mean
    return pa.array(np.round(out, 9), pa.float64(), mask=~has)


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
) -> tuple[float, ...]:
    """Weights from the labelled documents, at most ``fit_rows`` of each class."""
    marks = only(labels, doc_id=label_id, good=label_col).filter("doc_id is not null and good is not null").withColumn("good", F.col("good") > 0)
    sample = None
    for side in (True, False):
        part = marks.filter(F.col("good") == side).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(fit_rows)
        sample = part if sample is None else sample.unionByName(part)
    texts = only(df, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id").select("good", F.xxhash64("turn", "text").alias("turn"), "text")  # at most 2 * fit_rows rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("quality")
        for batch in batches:
            x, has = features(batch.column("text"))
            x, keep = x[has], pa.array(has)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES)
            columns = [*(pc.filter(batch.column(c), keep) for c in ("good", "turn")), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))]
            yield pa.RecordBatch.from_arrays(columns, names=["good", "turn", "x"])

    rows = texts.mapInArrow(measure, "good boolean, turn bigint, x array<float>").toArrow()  # at most 2 * fit_rows rows
    if not rows.num_rows:
        return (0.0,) * FEATURES
    rows = rows.sort_by([("turn", "ascending"), ("good", "ascending")]).combine_chunks()  # the same fit in whatever order the rows arrive
    x = np.concatenate([c.flatten().to_numpy() for c in rows.column("x").chunks]).reshape(-1, FEATURES).astype(float)
    return fit_pairs(x, rows.column("good").to_numpy())


def threshold(scores: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality") -> float:
    """The quantile of all labelled documents' scores at the share of low quality."""
    marks = only(labels, doc_id=label_id, good=label_col).filter("good is not null")
    known = scores.filter("score is not null").join(marks, "doc_id").select("score", (F.col("good") > 0).alias("good"))
    share = known.agg(F.avg((~F.col("good")).cast("double")), F.min("score"), F.max("score")).first()
    if share[0] is None or share[0] in (0.0, 1.0) or share[1] == share[2]:
        return float("-inf")
    return known.agg(F.percentile_approx("score", share[0] * (1 - SPARE), 100_000)).first()[0]


def ranking(spark_docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Ranking, DataFrame]:
    """The fitted ranking and the written scores of all documents."""
    weights = fit(spark_docs, labels, fit_rows=fit_rows)
    scores = written(scored(spark_docs, weights), "scores")
    return Ranking(weights, threshold(scores, labels)), scores


def judged(df: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score, keep) for each row."""
    model, scores = ranking(df, labels, fit_rows)
    return scores.withColumn("keep", F.coalesce(F.col("score") > F.lit(model.threshold), F.lit(False)))


def filtered(df: DataFrame, labels: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``df`` that are kept, all columns as they are."""
    weights = fit(df, labels, text_col=text_col, fit_rows=fit_rows)
    ids = only(labels, doc_id="doc_id", good="quality").filter("doc_id is not null and good is not null").select("doc_id").distinct()
    some = only(df, doc_id="doc_id", text=text_col)
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        some = some.join(F.broadcast(ids), "doc_id", "left_semi")
    model = Ranking(weights, threshold(written(scored(some, weights), "scores"), labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("quality")
        for batch in batches:
            score = score_array(batch.column(text_col), model.weights)
            yield batch.filter(pc.fill_null(pc.greater(score, model.threshold), False))

    return df.mapInArrow(keep, df.schema)
