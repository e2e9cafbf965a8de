"""Datasets: a table with named features, targets and weights, and the ways to split and resample it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import count as counting

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import drawn
from ..errors import MismatchedShapes, require
from .rows import indexed


@dataclass(frozen=True)
class Dataset:
    """Rows numbered from 0 by ``row_id``; a missing weight column counts as 1 everywhere."""

    df: DataFrame
    features: tuple[str, ...]
    targets: tuple[str, ...] = ()
    weight: str | None = None
    row_id: str = "row_id"

    @staticmethod
    def of(df: DataFrame, features: Sequence[str], targets: Sequence[str] = (), weight: str | None = None, order: Sequence[str] = ()) -> Dataset:
        """Number the rows in the order of some keys that tell them apart."""
        return Dataset(indexed(df, order) if order else df, tuple(features), tuple(targets), weight)

    # Rebinding

    def with_records(self, df: DataFrame, features: Sequence[str]) -> Dataset:
        """Other records; weights are reset."""
        return replace(self, df=df, features=tuple(features), weight=None)

    def with_targets(self, df: DataFrame, targets: Sequence[str]) -> Dataset:
        """Other targets; weights stay."""
        return replace(self, df=df, targets=tuple(targets))

    def with_weights(self, weight: str | None) -> Dataset:
        return replace(self, weight=weight)

    def _renamed(self, old: Sequence[str], new: Sequence[str]) -> DataFrame:
        require(len(old) == len(new), f"{len(new)} names for {len(old)} columns", MismatchedShapes)
        return self.df.withColumnsRenamed(dict(zip(old, new)))

    def with_feature_names(self, names: Sequence[str]) -> Dataset:
        return replace(self, df=self._renamed(self.features, names), features=tuple(names))

    def with_target_names(self, names: Sequence[str]) -> Dataset:
        return replace(self, df=self._renamed(self.targets, names), targets=tuple(names))

    def map_targets(self, f: Callable[[Column], Column]) -> Dataset:
        return replace(self, df=self.df.withColumns({t: f(F.col(f"`{t}`")) for t in self.targets}))

    def into_single_target(self) -> Dataset:
        require(len(self.targets) == 1, "more than one target", MismatchedShapes)
        return self

    # Looking at parts

    @property
    def weights(self) -> Column:
        return F.col(f"`{self.weight}`").cast("double") if self.weight else F.lit(1.0)

    def nsamples(self) -> int:
        return self.df.select(self.row_id).count()

    def nfeatures(self) -> int:
        return len(self.features)

    def feature_iter(self) -> Iterator[Dataset]:
        """One dataset for each feature."""
        return (replace(self, features=(f,)) for f in self.features)

    def target_iter(self) -> Iterator[Dataset]:
        """One dataset for each target."""
        return (replace(self, targets=(t,)) for t in self.targets)

    def long_features(self) -> DataFrame:
        """(row_id, feature, value): one row a cell."""
        cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for f in self.features])
        return self.df.select(self.row_id, F.inline(cells))

    def sample_chunks(self, size: int) -> DataFrame:
        """All rows with their chunk number; an incomplete last chunk is dropped."""
        require(size > 0, "chunks hold at least one row")
        whole = self.nsamples() // size * size
        return self.df.filter(F.col(self.row_id) < whole).withColumn("chunk", F.floor(F.col(self.row_id) / size))

    # Labels

    def label_counts(self) -> DataFrame:
        """(target, label, n) in one pass."""
        each = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"`{t}`").cast("string").alias("label")) for t in self.targets])
        return self.df.select(F.inline(each)).groupBy("target", "label").agg(F.count(F.lit(1)).alias("n"))

    def labels(self) -> list:
        """The labels of a single target in order."""
        (t,) = self.targets
        return [r[0] for r in self.df.select(F.col(f"`{t}`").alias("label")).filter("label is not null").distinct().orderBy("label").collect()]

    def combined_labels(self) -> DataFrame:
        """The labels of all targets, each once."""
        return self.label_counts().select("label").distinct()

    def label_frequencies(self, mask: Column | None = None) -> DataFrame:
        """(label, weight): summed weights of the rows that the mask keeps."""
        (t,) = self.targets
        rows = self.df if mask is None else self.df.filter(mask)
        return rows.groupBy(F.col(f"`{t}`").alias("label")).agg(F.sum(self.weights).alias("weight"))

    def with_labels(self, labels: Sequence) -> Dataset:
        """The rows of which any target has one of these labels."""
        hit = F.lit(False)
        for t in self.targets:
            hit = hit | F.col(f"`{t}`").isin(list(labels))
        return replace(self, df=self.df.filter(hit))

    def one_vs_all(self) -> DataFrame:
        """Each row once for each label, the target being whether it has that label."""
        (t,) = self.targets
        labels = F.array(*[F.lit(v) for v in self.labels()])
        return self.df.withColumn("label", F.explode(labels)).withColumn(t, F.col(f"`{t}`") == F.col("label"))

    # Splits

    def split_with_ratio(self, ratio: float) -> tuple[Dataset, Dataset]:
        """The first ceil(n * ratio) rows, and the others."""
        require(0 <= ratio <= 1, "a ratio is between 0 and 1")
        first = math.ceil(round(self.nsamples() * ratio, 6))
        at = F.col(self.row_id)
        return replace(self, df=self.df.filter(at < first)), replace(self, df=self.df.filter(at >= first))

    def shuffle(self, seed: int = 42) -> Dataset:
        """The rows in the order of a hash; names stay and weights are dropped."""
        mixed = self.df.withColumn("_turn", drawn(F.col(self.row_id), seed)).withColumnRenamed(self.row_id, "_old")
        return replace(self, df=indexed(mixed, ["_turn", "_old"], self.row_id).drop("_turn", "_old"), weight=None)

    def _folds(self, k: int, size: int) -> Iterator[tuple[Dataset, Dataset]]:
        fold = F.floor(F.col(self.row_id) / size)
        for i in range(k):
            yield replace(self, df=self.df.filter(fold != i)), replace(self, df=self.df.filter(fold == i))

    def fold(self, k: int) -> list[tuple[Dataset, Dataset]]:
        """k pairs of training and validation rows; a remainder of rows is always training.

        The size counts the cells of all targets, as the original does.
        """
        n = self.nsamples() * max(1, len(self.targets))
        require(0 < k <= n, "there are more folds than rows")
        return list(self._folds(k, n // k))

    def iter_fold(self, k: int, fit: Callable[[Dataset], object]) -> Iterator[tuple[object, Dataset]]:
        """A model for each fold, with the rows that it hasn't seen."""
        n = self.nsamples()
        require(0 < k <= n, "there are more folds than rows")
        return ((fit(train), valid) for train, valid in self._folds(k, n // k))

    def cross_validate(self, k: int, fits: Sequence[Callable[[Dataset], object]], score: Callable[[object, Dataset], float]) -> list[float]:
        """The mean score of each of several fits over the same k folds."""
        return [sum(scores) / k for scores in ([score(m, valid) for m, valid in self.iter_fold(k, fit)] for fit in fits)]

    # Resampling with replacement

    def _drawn(self, rows: int, seed: int, turn: int) -> DataFrame:
        """``rows`` rows; _source is the row that each was drawn from."""
        n = self.nsamples()
        spark = self.df.sparkSession
        picks = spark.range(rows).select(F.col("id").alias("_new"), F.pmod(drawn(seed, turn, F.col("id")), F.lit(n)).alias("_source"))
        joined = picks.join(self.df, F.col("_source") == F.col(self.row_id))
        return joined.drop(self.row_id).withColumnRenamed("_new", self.row_id)

    def _picked_features(self, size: int, seed: int, turn: int) -> list[int]:
        """Feature places drawn by a hash; one may come twice."""
        m = len(self.features)
        row = self.df.sparkSession.range(size).select(F.pmod(drawn(seed + 1, turn, F.col("id")), F.lit(m)).cast("int").alias("f"), "id")
        return [r[0] for r in row.orderBy("id").collect()]

    def _with_picked(self, df: DataFrame, picked: Sequence[int]) -> Dataset:
        names = [f"{self.features[f]}__{i}" for i, f in enumerate(picked)]
        rest = [c for c in df.columns if c not in self.features]
        return replace(self, df=df.select(*[F.col(f"`{c}`") for c in rest], *[F.col(f"`{self.features[f]}`").alias(n) for f, n in zip(picked, names)]), features=tuple(names))

    def bootstrap(self, rows: int, features: int, seed: int = 42) -> Iterator[tuple[Dataset, list[int]]]:
        """Endless samples of rows and features, with the features' places; _source has the rows'."""
        for turn in counting():
            picked = self._picked_features(features, seed, turn)
            yield self._with_picked(self._drawn(rows, seed, turn), picked), picked

    def bootstrap_samples(self, rows: int, seed: int = 42) -> Iterator[Dataset]:
        for turn in counting():
            yield replace(self, df=self._drawn(rows, seed, turn))

    def bootstrap_features(self, features: int, seed: int = 42) -> Iterator[tuple[Dataset, list[int]]]:
        for turn in counting():
            picked = self._picked_features(features, seed, turn)
            yield self._with_picked(self.df, picked), picked
