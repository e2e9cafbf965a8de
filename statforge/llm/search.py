"""Exact top-k search (BM25) with block-at-a-time pruning.

Documents are indexed in blocks of consecutive documents.  A block has a
forward index: for each document its query words and their counts.  For each
query, the sums of the words' largest contributions within a block bound the
scores in it; blocks are taken in the order of these bounds and scored through
their forward indexes until a bound falls below the k-th score so far.  Each
task prunes on its own with nothing shared, so only k rows a query and task
are shuffled.  Document frequencies and lengths cover all documents.

Queries are taken in groups of ``QUERY_GROUP`` rows, whose words (and nothing
that grows with the documents) are shipped to the tasks.

Results: (query_id, doc_id, score, rank) for every query with at least one
hit; scores are rounded to 6 digits and ties go to the smaller id.  Null texts
are no documents; documents without words are, but hit nothing.  A null query
or one without words has no rows.  Repeated words in a query count as often;
repeated rows are documents or queries of their own (a repeated query id is
one query of all its words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import only, written
from .textops import Words, slices

K1, B = 1.2, 0.75
BLOCK = 64
QUERY_GROUP = 2_000
_SLACK = 1e-5


def _index(docs: DataFrame, vocabulary: np.ndarray, block: int) -> DataFrame:
    """Blocks of documents: ids, lengths, and the forward index as (ends, words, counts)."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the words of one query group
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            for i, j in slices(batch.column("text")):
                words = Words(batch.column("text").slice(i, j - i))
                at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
                hit = known[at] == words.hash
                key, count = np.unique(words.doc()[hit] * len(known) + at[hit], return_counts=True)
                doc, word = key // len(known), key % len(known)
                n = j - i
                ends = np.searchsorted(doc, np.arange(n), side="right")
                length = np.diff(words.off)
                first = np.arange(0, n, block)
                edge = np.append(first, n)
                cut = np.concatenate([[0], ends])[edge]
                base = np.repeat(cut[:-1], np.diff(edge))

                def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)

                yield pa.RecordBatch.from_arrays(
                    [
                        lists(batch.column("doc_id").slice(i, n), edge),
                        lists(pa.array(length.astype(np.int32)), edge),
                        lists(pa.array((ends - base).astype(np.int32)), edge),
                        lists(pa.array(word.astype(np.int32)), cut),
                        lists(pa.array(count.astype(np.int32)), cut),
                    ],
                    names=["ids", "lengths", "ends", "words", "counts"],
                )

    schema = f"ids array<{id_type}>, lengths array<int>, ends array<int>, words array<int>, counts array<int>"
    return docs.filter("text is not null").mapInArrow(build, schema)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _frequencies(index: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Document frequency of each word, number of documents, and their summed length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(_flat(batch, "words"), minlength=size)
            lengths = _flat(batch, "lengths")
            n, total = n + len(lengths), total + int(lengths.sum())
        word = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(word, [-1, -2])), pa.array(np.append(df[word], [n, total]))], names=["word", "n"]
        )

    rows = index.select("lengths", "words").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect()
    found = dict(map(tuple, rows))  # at most one row a query word
    df = np.zeros(size)
    for w, n in found.items():
        if w >= 0:
            df[w] = n
    return df, int(found.get(-1, 0)), int(found.get(-2, 0))


class Scorer:
    """The k best of each query over blocks of documents."""

    def __init__(self, weights: np.ndarray, mean_length: float, k: int):
        self.weights, self.mean, self.k = weights, mean_length, k
        self.best: list[list[tuple[float, object]]] = [[] for _ in weights]  # sorted by (-score, id)
        self.scored = 0

    def add(self, batch: pa.RecordBatch) -> None:
        lengths, words, counts = (_flat(batch, c) for c in ("lengths", "words", "counts"))
        ids = batch.column("ids").flatten()
        doc_edge = batch.column("ids").offsets.to_numpy() - batch.column("ids").offsets[0].as_py()
        word_edge = batch.column("words").offsets.to_numpy() - batch.column("words").offsets[0].as_py()
        ends = _flat(batch, "ends") + np.repeat(word_edge[:-1], np.diff(doc_edge))
        per_doc = np.diff(np.concatenate([[0], ends]))
        norm = np.repeat(K1 * (1 - B + B * lengths / self.mean), per_doc)
        part = counts * (K1 + 1) / (counts + norm)
        blocks, size = len(doc_edge) - 1, self.weights.shape[1]
        most = np.zeros(blocks * size)
        np.maximum.at(most, np.repeat(np.arange(blocks), np.diff(word_edge)) * size + words, part)
        bounds = self.weights @ most.reshape(blocks, size).T
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        for q, row in enumerate(bounds):
            best, weight = self.best[q], self.weights[q]
            for b in np.argsort(-row, kind="stable").tolist():
                kth = best[self.k - 1][0] if len(best) >= self.k else 0.0
                if row[b] <= 0 or row[b] < kth - _SLACK:
                    break
                self.scored += 1
                s, e = word_edge[b], word_edge[b + 1]
                gain = weight[words[s:e]] * part[s:e]
                d0, d1 = doc_edge[b], doc_edge[b + 1]
                some = np.flatnonzero(per_doc[d0:d1]) + d0
                score = np.round(np.add.reduceat(gain, starts[some] - s), 6)
                good = np.flatnonzero((score > 0) & (score >= kth))
                if len(good):
                    new = zip((-score[good]).tolist(), ids.take(pa.array(some[good])).to_pylist())
                    merged = sorted([(-v, i) for v, i in best] + list(new), key=lambda x: (x[0], x[1] is None, x[1]))
                    best[:] = [(-v, i) for v, i in merged[: self.k]]


def top_k(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    corpus = only(docs, doc_id=id_col, text=text_col)
    asked = only(queries, query_id=query_id, text=query_text).filter("query_id is not null and text is not null")
    types = asked.schema["query_id"].dataType.simpleString(), corpus.schema["doc_id"].dataType.simpleString()
    schema = f"query_id {types[0]}, doc_id {types[1]}, score double"
    found = docs.sparkSession.createDataFrame([], schema)
    group: list = []
    for row in asked.orderBy("query_id").toLocalIterator():
        if len(group) >= QUERY_GROUP and row[0] != group[-1][0]:
            found = found.unionByName(_searched(corpus, group, k, block, schema))
            group = []
        group.append(row)
    if group:
        found = found.unionByName(_searched(corpus, group, k, block, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(corpus: DataFrame, group: list, k: int, block: int, schema: str) -> DataFrame:
    words = Words(pa.array([r[1] for r in group], pa.string()))
    vocabulary = np.unique(words.hash)
    if not len(vocabulary):
        return corpus.sparkSession.createDataFrame([], schema)
    ids = list(dict.fromkeys(r[0] for r in group))
    place = {v: i for i, v in enumerate(ids)}
    owner = np.array([place[r[0]] for r in group])[words.doc()]
    times = np.zeros((len(ids), len(vocabulary)))
    np.add.at(times, (owner, np.searchsorted(vocabulary, words.hash)), 1)
    index = written(_index(corpus, vocabulary, block), "index")
    df, n, total = _frequencies(index, len(vocabulary))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shipped = corpus.sparkSession.sparkContext.broadcast((times * idf, ids))
    mean = max(total / max(n, 1), 1e-9)
    id_arrow = pa.array(ids).type

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, names = shipped.value
        scorer = Scorer(weights, mean, k)
        doc_type = pa.null()
        for batch in batches:
            doc_type = batch.schema.field("ids").type.value_type
            for i in range(0, len(batch), 256):
                scorer.add(batch.slice(i, 256))
        rows = [(names[q], d, s) for q, best in enumerate(scorer.best) for s, d in best]
        if rows:
            q, d, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, id_arrow), pa.array(d, doc_type), pa.array(s, pa.float64())], names=["query_id", "doc_id", "score"])

    return index.mapInArrow(search, schema)
