"""Evaluation metrics as aggregates.

Regression metrics compare a column ``a`` (the prediction) with ``b`` (the
truth); classification metrics rest on a confusion matrix, of which only one
row for each pair of labels reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter, NotEnoughSamples, require
from ..sources.generate import uniform
from .rows import indexed, median, running

TINY = 1e-10


def _sums(a: Column, b: Column) -> dict[str, Column]:
    """Regression metrics that one pass can give."""
    d = a - b
    n = F.count(d)
    spread = F.var_pop(b) * n + TINY
    size = F.abs(a) + F.abs(b)
    return {
        "max_error": F.max(F.abs(d)),
        "mean_absolute_error": F.avg(F.abs(d)),
        "mean_squared_error": F.avg(d * d),
        "mean_squared_log_error": F.avg(F.pow(F.log1p(a) - F.log1p(b), F.lit(2))),
        "mean_absolute_percentage_error": F.avg(F.abs(F.try_divide(d, a))),
        "symmetric_mape": 200 * F.sum(F.when(size <= np.finfo(float).eps, 0.0).otherwise(F.try_divide(F.abs(b - a), size))) / n,
        "r2": 1 - F.sum(d * d) / spread,
        "explained_variance": 1 - (F.sum(d * d) - F.avg(b - a)) / spread,
    }


def regression_metrics(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with all nine metrics.

    As in the original, the percentage error is relative to the prediction and
    the explained variance subtracts the mean error itself.  Where a prediction
    is 0 its percentage error is left out.
    """
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    rows = df.filter(x.isNotNull() & y.isNotNull())
    middle = median(rows, F.abs(x - y))
    return rows.agg(*[v.alias(k) for k, v in _sums(x, y).items()], F.lit(middle).alias("median_absolute_error"))


def regression_metrics_by_target(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(target, metric columns): one row for each pair (prediction, truth), all in one pass but for the medians."""
    parts = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        middle = median(df, F.abs(x - y))
        parts.append(F.struct(F.lit(i).alias("target"), *[v.alias(k) for k, v in _sums(x, y).items()], F.lit(middle).alias("median_absolute_error")))
    return df.agg(F.array(*parts).alias("each")).select(F.inline("each"))


# Classification


@dataclass(frozen=True)
class ConfusionMatrix:
    """matrix[i, j]: rows predicted as members[i] whose truth is members[j]."""

    members: tuple
    matrix: np.ndarray

    @property
    def binary(self) -> bool:
        return len(self.members) == 2

    def precision(self) -> float:
        """Of two classes, m00 / (m00 + m10); of more, the mean over one-vs-all."""
        if self.binary:
            return _ratio(self.matrix[0, 0], self.matrix[0, 0] + self.matrix[1, 0])
        return float(np.mean([m.precision() for m in self.one_vs_all()]))

    def recall(self) -> float:
        """Of two classes, m00 / (m00 + m01); of more, the mean over one-vs-all."""
        if self.binary:
            return _ratio(self.matrix[0, 0], self.matrix[0, 0] + self.matrix[0, 1])
        return float(np.mean([m.recall() for m in self.one_vs_all()]))

    def precision_textbook(self) -> float:
        """Correct among the rows predicted as the class."""
        return self.recall()

    def recall_textbook(self) -> float:
        """Found among the rows that have the class."""
        return self.precision()

    def accuracy(self) -> float:
        return _ratio(np.trace(self.matrix), self.matrix.sum())

    def f_score(self, beta: float = 1.0) -> float:
        p, r = self.precision(), self.recall()
        return _ratio((1 + beta * beta) * p * r, beta * beta * p + r)

    def f1_score(self) -> float:
        return self.f_score(1.0)

    def mcc(self) -> float:
        """Matthews' correlation for any number of classes."""
        m, total = self.matrix, self.matrix.sum()
        rows, cols = m.sum(axis=1), m.sum(axis=0)
        cov = np.trace(m) * total - rows @ cols
        return _ratio(cov, np.sqrt(total**2 - rows @ rows) * np.sqrt(total**2 - cols @ cols))

    def one_vs_all(self) -> list[ConfusionMatrix]:
        m, total = self.matrix, self.matrix.sum()
        out = []
        for i in range(len(m)):
            hit, said, have = m[i, i], m[i].sum(), m[:, i].sum()
            out.append(ConfusionMatrix((True, False), np.array([[hit, said - hit], [have - hit, total - said - have + hit]])))
        return out

    def one_vs_one(self) -> list[ConfusionMatrix]:
        """All pairs of classes, each class with itself included."""
        m = self.matrix
        return [ConfusionMatrix((True, False), np.array([[m[i, i], m[i, j]], [m[j, i], m[j, j]]])) for i in range(len(m)) for j in range(i, len(m))]

    def __str__(self) -> str:
        width = max(len(str(x)) for x in [*self.members, *self.matrix.astype(int).ravel()]) + 1
        head = " " * width + "|" + "|".join(str(c).rjust(width) for c in self.members)
        return "\n".join([head, *[str(c).rjust(width) + "|" + "|".join(str(int(v)).rjust(width) for v in row) for c, row in zip(self.members, self.matrix)]])


def _ratio(a: float, b: float) -> float:
    return float(a / b) if b else float("nan")


def confusion_counts(df: DataFrame, prediction: str, truth: str) -> DataFrame:
    """(prediction, truth, n) for every pair of observed labels, zeros included."""
    p, t = F.col(f"`{prediction}`"), F.col(f"`{truth}`")
    pairs = df.filter(p.isNotNull() & t.isNotNull()).groupBy(p.alias("prediction"), t.alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    members = pairs.select(F.explode(F.array("prediction", "truth")).alias("label")).distinct()
    grid = members.select(F.col("label").alias("prediction")).crossJoin(members.select(F.col("label").alias("truth")))
    return grid.join(pairs, ["prediction", "truth"], "left").select("prediction", "truth", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def confusion_matrix(df: DataFrame, prediction: str, truth: str) -> ConfusionMatrix:
    """Classes are sorted; of exactly two, the greater comes first."""
    p, t = F.col(f"`{prediction}`"), F.col(f"`{truth}`")
    rows = df.filter(p.isNotNull() & t.isNotNull()).groupBy(p, t).count().collect()  # one row a pair of labels
    members = sorted({r[0] for r in rows} | {r[1] for r in rows})
    if len(members) == 2:
        members.reverse()
    place = {v: i for i, v in enumerate(members)}
    m = np.zeros((len(members), len(members)))
    for a, b, n in rows:
        m[place[a], place[b]] = n
    return ConfusionMatrix(tuple(members), m)


def roc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(threshold, tp, fp): the shares of positive and negative rows below each score, and (1, 1) at the end.

    A first score of 0 gives no point of its own, as in the original.
    """
    s, t = F.col(f"`{score}`").cast("double"), F.col(f"`{truth}`").cast("boolean")
    rows = df.select(s.alias("s"), t.alias("t")).filter("s >= 0 and t is not null")
    each = rows.groupBy("s").agg(F.count_if("t").alias("pos"), F.count_if(~F.col("t")).alias("neg"))
    below = running(each, ["s"], {"up_pos": F.col("pos"), "up_neg": F.col("neg")})
    totals = each.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    points = below.filter(F.col("s") > TINY).crossJoin(F.broadcast(totals))  # one row
    curve = points.select(
        F.col("s").alias("threshold"),
        F.try_divide(F.col("up_pos") - F.col("pos"), F.col("all_pos")).alias("tp"),
        F.try_divide(F.col("up_neg") - F.col("neg"), F.col("all_neg")).alias("fp"),
    )
    return curve.unionByName(totals.select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("tp"), F.lit(1.0).alias("fp")))


def area_under_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(auc): the trapezoid sum of the curve, from rank sums rather than a scan in order.

    Each step adds its share of positives times the mean share of negatives
    before and after it.
    """
    s, t = F.col(f"`{score}`").cast("double"), F.col(f"`{truth}`").cast("boolean")
    rows = df.select(s.alias("s"), t.alias("t")).filter("s >= 0 and t is not null")
    each = rows.groupBy("s").agg(F.count_if("t").alias("pos"), F.count_if(~F.col("t")).alias("neg"))
    below = running(each, ["s"], {"up_neg": F.col("neg")})
    # rows of score 0 open no point: the curve starts after them
    area = F.sum(F.when(F.col("s") > TINY, F.col("pos") * (F.col("up_neg") - F.col("neg") / 2)))
    return below.agg((F.coalesce(area, F.lit(0.0)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def log_loss(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(log_loss): the mean, with probabilities kept off 0 and 1 by the single precision epsilon."""
    eps = float(np.finfo(np.float32).eps)
    p = F.least(F.greatest(F.col(f"`{score}`").cast("double"), F.lit(eps)), F.lit(1 - eps))
    t = F.col(f"`{truth}`").cast("boolean")
    return df.agg(F.avg(F.when(t, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


# Correlation


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, correlation) of every pair of columns, in one pass."""
    require(len(columns) > 1, "correlation needs two columns")
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias("correlation")) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*each).alias("each")).select(F.inline("each"))


def pearson_p_values(df: DataFrame, columns: Sequence[str], iterations: int = 100, seed: int = 42) -> DataFrame:
    """(a, b, correlation, p_value): the share of column shuffles with a greater absolute correlation.

    A shuffle gives each row the value of another row: rows are numbered by a
    hash and joined on that number.  All shuffles run as one plan.
    """
    require(iterations > 0, "at least one shuffle is needed")
    base = indexed(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).withColumn("_k", F.monotonically_increasing_id()), ["_k"], "_row").drop("_k")
    turns = df.sparkSession.range(iterations).withColumnRenamed("id", "_turn")
    many = base.crossJoin(F.broadcast(turns))  # iterations rows
    shuffled = None
    for j, c in enumerate(columns):
        place = F.row_number().over(Window.partitionBy("_turn").orderBy(uniform(seed + j, F.col("_turn"), F.col("_row")), "_row"))
        own = many.select("_turn", F.col(f"`{c}`").alias(c), place.alias("_place"))
        shuffled = own if shuffled is None else shuffled.join(own, ["_turn", "_place"])
    real = pearson(df, columns)
    pairs = list(combinations(columns, 2))
    by_turn = shuffled.groupBy("_turn").agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("each"))
    drawn = by_turn.select(F.inline("each"))
    compared = drawn.join(real, ["a", "b"]).groupBy("a", "b").agg(F.first("correlation").alias("correlation"), F.avg((F.abs("r") > F.abs("correlation")).cast("double")).alias("p_value"))
    return compared


def correlation_text(rows: Sequence, columns: Sequence[str]) -> str:
    """A triangle of coefficients, for people."""
    r = {(x["a"], x["b"]): x["correlation"] for x in rows}
    width = max(map(len, columns))
    return "\n".join(a.ljust(width) + " " + " ".join(f"{r[a, b]:+.2f}" if (a, b) in r else "     " for b in columns[1:]) for a in columns[:-1])


def scores(m: ConfusionMatrix, beta: float = 0.5) -> dict[str, float]:
    """All scores of a confusion matrix by name."""
    require(beta > 0, "beta is positive", InvalidParameter)
    require(m.matrix.sum() > 0, "no rows", NotEnoughSamples)
    return {"precision": m.precision(), "recall": m.recall(), "accuracy": m.accuracy(), "f1": m.f1_score(), "f_beta": m.f_score(beta), "mcc": m.mcc()}
