"""Counting terms and weighing them by inverse document frequency.

Results are long tables (id, term, count): a term matrix without its zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions import text as tx
from ..sources.files import text_files
from ..sources.store import written

#: Vocabularies of up to this many terms are broadcast to the documents; larger ones are joined by shuffle.
BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class CountVectorizer:
    """How texts become terms, and which terms are kept."""

    lower: bool = True
    pattern: str = tx.WORDS
    ngrams: tuple[int, int] = (1, 1)
    normalise: bool = True
    document_frequency: tuple[float, float] = (0.0, 1.0)
    stopwords: tuple[str, ...] = ()
    max_features: int | None = None
    tokenizer: Callable[[str], list[str]] | None = field(default=None, compare=False)

    def check(self) -> None:
        low, high = self.document_frequency
        require(0 < self.ngrams[0] <= self.ngrams[1], "n-gram lengths must be positive and in order")
        require(0 <= low <= high <= 1, "document frequencies must be shares in order")
        require(self.max_features is None or self.max_features > 0, "at least one feature must be kept")

    def terms(self, text: Column) -> Column:
        ready = tx.prepared(text, self.lower, self.normalise)
        words = tx.tokens_by(self.tokenizer)(ready) if self.tokenizer else tx.tokens(ready, self.pattern)
        return tx.ngrams(words, *self.ngrams)

    def fit(self, df: DataFrame, text_col: str = "text") -> Vocabulary:
        """The vocabulary with document frequencies.

        Bounds on the frequency are the shares times the number of documents,
        cut to whole numbers and inclusive.  Of equally frequent terms the
        greater one comes first.
        """
        self.check()
        docs = df.select(F.array_distinct(self.terms(F.col(f"`{text_col}`"))).alias("terms"))
        found = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        low, high = self.document_frequency
        if (low, high) != (0.0, 1.0):
            n = df.count()
            found = found.filter(F.col("df").between(int(low * n), int(high * n)))
        if self.stopwords:
            found = found.filter(~F.col("term").isin(list(self.stopwords)))
        if self.max_features is not None:
            found = found.orderBy(F.desc("df"), F.desc("term")).limit(self.max_features)
            return Vocabulary(self, written(found, "vocabulary"))
        if (low, high) != (0.0, 1.0) or self.stopwords:
            return Vocabulary(self, written(found, "vocabulary"))
        return Vocabulary(self, found, df, text_col)

    def fit_vocabulary(self, df: DataFrame, words: Sequence[str]) -> Vocabulary:
        """Fixed words, whatever the documents hold."""
        self.check()
        terms = df.sparkSession.createDataFrame([(w, 0) for w in dict.fromkeys(words)], "term string, df bigint")
        return Vocabulary(self, terms)

    def fit_files(self, spark, paths: Sequence[str], charset: str = "utf-8", errors: str = "strict") -> Vocabulary:
        return self.fit(text_files(spark, paths, charset, errors))


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vectoriser: the terms that count."""

    how: CountVectorizer
    terms: DataFrame
    #: Set if all terms of these texts count: they needn't be looked up when the same table is transformed.
    whole: DataFrame | None = None
    whole_col: str = ""

    def words(self) -> DataFrame:
        return self.terms.select("term", "df")

    def nentries(self) -> int:
        return self.terms.count()

    def transform(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, term, tf): counts of the vocabulary's terms."""
        all_terms = df.select(F.col(f"`{id_col}`").alias(id_col), F.explode(self.how.terms(F.col(f"`{text_col}`"))).alias("term"))
        counted = all_terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
        if df is self.whole and text_col == self.whole_col:
            return counted
        known = written(self.terms.select("term"), "terms") if self.whole is not None else self.terms.select("term")
        if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
            known = F.broadcast(known)
        return counted.join(known, "term", "left_semi").select(id_col, "term", "tf")

    def transform_files(self, spark, paths: Sequence[str], charset: str = "utf-8", errors: str = "strict") -> DataFrame:
        return self.transform(text_files(spark, paths, charset, errors), "path")


IDF = ("smooth", "non_smooth", "textbook")


def _idf(kind: str, n: Column, df: Column) -> Column:
    if kind == "smooth":
        return F.log((1 + n) / (1 + df)) + 1
    if kind == "non_smooth":
        return F.log(n / df) + 1
    return F.log(n / (1 + df))


def tf_idf(vocabulary: Vocabulary, df: DataFrame, method: str = "smooth", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf_idf), with frequencies of the documents at hand, not of those the vocabulary was fitted on."""
    require(method in IDF, f"no such method: {method}")
    n = df.count()
    tf = vocabulary.transform(df, id_col, text_col)
    frequency = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(frequency, "term").select(id_col, "term", (F.col("tf") * _idf(method, F.lit(float(n)), F.col("df"))).alias("tf_idf"))
