"""Decision trees grown level by level, and ensembles of them.

All nodes of a level are split in one plan: rows are routed to their nodes by
column expressions, class weights are summed for each (node, feature, value)
with map-side combining, and running sums over the distinct values give every
exact split.  Only the best split of each node reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter, NotConverged, NotEnoughSamples, require
from ..functions import vec
from ..sources.generate import uniform
from .dataset import Dataset
from .rows import indexed, running

NEAR = 1e-5


@dataclass
class Node:
    prediction: object
    depth: int
    feature: int = 0
    value: float = 0.0
    decrease: float = 0.0
    left: Node | None = None
    right: Node | None = None

    @property
    def leaf(self) -> bool:
        return self.left is None


@dataclass(frozen=True)
class TreeParams:
    """max_depth None: no bound; weights are summed row weights."""

    quality: str = "gini"
    max_depth: int | None = None
    min_weight_split: float = 2.0
    min_weight_leaf: float = 1.0
    min_decrease: float = 1e-5

    def check(self) -> None:
        require(self.quality in ("gini", "entropy"), f"no such split quality: {self.quality}")
        require(self.min_decrease >= float(np.finfo(float).eps), "the least impurity decrease is positive")
        require(self.max_depth is None or self.max_depth >= 0, "a depth is not negative")


@dataclass(frozen=True)
class Tree:
    features: tuple[str, ...]
    root: Node

    def column(self, at: Node | None = None, names: Sequence[str] | None = None) -> Column:
        """The prediction as an expression; rows on a split value go right."""
        node, names = at or self.root, names or self.features
        if node.leaf:
            return F.lit(node.prediction)
        test = F.col(f"`{names[node.feature]}`").cast("double") < F.lit(node.value)
        return F.when(test, self.column(node.left, names)).otherwise(self.column(node.right, names))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.column())

    def iter_nodes(self) -> Iterator[Node]:
        """Breadth first."""
        queue = [self.root]
        while queue:
            node = queue.pop(0)
            yield node
            if not node.leaf:
                queue += [node.left, node.right]

    def used_features(self) -> list[int]:
        return sorted({n.feature for n in self.iter_nodes() if not n.leaf})

    def mean_impurity_decrease(self) -> list[float]:
        total, n = [0.0] * len(self.features), [0] * len(self.features)
        for node in self.iter_nodes():
            if not node.leaf:
                total[node.feature] += node.decrease
                n[node.feature] += 1
        return [t / c if c else 0.0 for t, c in zip(total, n)]

    def feature_importance(self) -> list[float]:
        """Mean decreases relative to their sum."""
        mean = self.mean_impurity_decrease()
        return [m / sum(mean) if sum(mean) else float("nan") for m in mean]

    relative_impurity_decrease = feature_importance

    def max_depth(self) -> int:
        return max(n.depth for n in self.iter_nodes())

    def num_leaves(self) -> int:
        return sum(n.leaf for n in self.iter_nodes())

    def to_tikz(self, legend: bool = False, complete: bool = True) -> str:
        """The tree as a LaTeX picture."""

        def draw(node: Node) -> str:
            pad = "\t" * (node.depth + 1)
            if node.leaf:
                return f"{pad}[Label: {node.prediction}]"
            head = f"{pad}[Val(${node.feature}$) $ \\leq {node.value:.2f}$ \\\\ Imp. ${node.decrease:.2f}$"
            return "\n".join([head, draw(node.left), draw(node.right)]) + "]"

        out = "\\begin{forest}\nfor tree={align=center, draw}\n" + draw(self.root) + "\n"
        if legend:
            lines = "".join(f"Var({f})&:&{self.features[f]}\\\\\n" for f in self.used_features())
            out += "\\node [anchor=north west] at (current bounding box.north east) {\\begin{tabular}{c c c}\nImp.&:&Impurity decrease\\\\\n" + lines + "\\end{tabular}};\n"
        out += "\\end{forest}"
        if complete:
            out = "\\documentclass[margin=10pt]{standalone}\n\\usepackage{forest}\n\\begin{document}\n" + out + "\n\\end{document}"
        return out


def _impurity(kind: str, weights: Sequence[Column]) -> Column:
    total = vec.total(weights)
    shares = [F.try_divide(w, total) for w in weights]
    if kind == "gini":
        return 1 - vec.total([s * s for s in shares])
    return vec.total([F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in shares])


def _impurity_of(kind: str, w: np.ndarray) -> float:
    p = w / w.sum()
    return float(1 - (p * p).sum()) if kind == "gini" else float(-(p[p > 0] * np.log2(p[p > 0])).sum())


def best_splits(rows: DataFrame, features: Sequence[str], classes: Sequence, target: str, weight: Column, node: Column, params: TreeParams) -> DataFrame:
    """(node, feature, value, score, left class weights) of the best split of each node.

    Of equal scores the earlier feature and the smaller value win.  Values that
    lie within 1e-5 of the next one in the node open no split.
    """
    cells = F.array(*[F.struct(F.lit(j).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for j, f in enumerate(features)])
    parts = [F.sum(F.when(F.col("_y") == F.lit(c), F.col("_w")).otherwise(0.0)).alias(f"c{i}") for i, c in enumerate(classes)]
    long = rows.select(node.alias("node"), F.col(f"`{target}`").alias("_y"), weight.alias("_w"), F.inline(cells)).filter("node >= 0 and value is not null")
    sums = long.groupBy("node", "feature", "value").agg(*parts)
    own = Window.partitionBy("node", "feature")
    upto = own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"c{i}" for i in range(len(classes))]
    scanned = sums.select(
        "node",
        "feature",
        "value",
        F.lead("value").over(own.orderBy("value")).alias("next"),
        *[F.sum(c).over(upto).alias(f"l{c}") for c in names],
        *[F.sum(c).over(own).alias(f"t{c}") for c in names],
    )
    left = [F.col(f"l{c}") for c in names]
    right = [F.col(f"t{c}") - F.col(f"l{c}") for c in names]
    wl, wr = vec.total(left), vec.total(right)
    share = wr / (wl + wr)
    score = share * _impurity(params.quality, right) + (1 - share) * _impurity(params.quality, left)
    options = scanned.filter((F.col("next") - F.col("value") >= NEAR) & (wl >= params.min_weight_leaf) & (wr >= params.min_weight_leaf))
    scored = options.select("node", F.struct(F.round(score, 12).alias("score"), "feature", ((F.col("value") + F.col("next")) / 2).alias("value"), F.array(*left).alias("left")).alias("s"))
    return scored.groupBy("node").agg(F.min("s").alias("s")).select("node", "s.feature", "s.value", "s.score", "s.left")


def decision_tree(df: DataFrame, features: Sequence[str], target: str, weight: str | None = None, params: TreeParams = TreeParams()) -> Tree:
    """Exact splits on midpoints; leaves predict the heaviest class, ties going to the smallest.

    Siblings that predict the same are merged in the end.
    """
    params.check()
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    rows = df.filter(F.col(f"`{target}`").isNotNull())
    totals = rows.groupBy(F.col(f"`{target}`").alias("y")).agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n")).collect()  # one row a class
    require(bool(totals), "no rows", NotEnoughSamples)
    weights = {r["y"]: float(r["w"]) for r in totals}
    classes = sorted(weights)

    def modal(v: np.ndarray) -> object:
        return classes[int(np.argmax(v))]

    own = np.array([weights[c] for c in classes])
    root = Node(modal(own), 0)
    level: list[tuple[Node, np.ndarray]] = [(root, own)]
    while level:
        open_ = [(n, v) for n, v in level if v.sum() >= params.min_weight_split and not (params.max_depth is not None and n.depth >= params.max_depth)]
        if not open_:
            break
        ids = {id(n): i for i, (n, _) in enumerate(open_)}
        place = _routed(root, features, ids)
        found = {r["node"]: r for r in best_splits(rows, features, classes, target, w, place, params).collect()}  # one row a node
        level = []
        for i, (node, v) in enumerate(open_):
            if i not in found:
                continue
            r = found[i]
            gain = _impurity_of(params.quality, v) - r["score"]
            if gain < params.min_decrease:
                continue
            lv = np.array(r["left"], float)
            node.feature, node.value, node.decrease = r["feature"], r["value"], gain
            node.left, node.right = Node(modal(lv), node.depth + 1), Node(modal(v - lv), node.depth + 1)
            level += [(node.left, lv), (node.right, v - lv)]
    _prune(root)
    return Tree(tuple(features), root)


def _routed(node: Node, features: Sequence[str], ids: dict[int, int]) -> Column:
    """The number of the open node that a row falls into, or -1; training rows on a split value go left."""
    if node.leaf:
        return F.lit(ids.get(id(node), -1))
    test = F.col(f"`{features[node.feature]}`").cast("double") <= F.lit(node.value)
    return F.when(test, _routed(node.left, features, ids)).otherwise(_routed(node.right, features, ids))


def _prune(node: Node) -> object | None:
    if node.leaf:
        return node.prediction
    a, b = _prune(node.left), _prune(node.right)
    if a is not None and a == b:
        node.prediction, node.left, node.right = a, None, None
        return a
    return None


# Ensembles


def votes(predictions: Sequence[Column], labels: Sequence, weights: Sequence[float] | None = None) -> Column:
    """The label with the most (weighted) votes; ties go to the smallest."""
    weights = weights or [1.0] * len(predictions)
    labels = sorted(labels)
    return vec.argmax([vec.total([F.when(p == F.lit(c), F.lit(float(w))).otherwise(0.0) for p, w in zip(predictions, weights)]) for c in labels], labels)


@dataclass(frozen=True)
class Ensemble:
    """Models with the features (places) that each of them looks at."""

    features: tuple[str, ...]
    models: tuple[Tree, ...]
    model_features: tuple[tuple[int, ...], ...]
    labels: tuple

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        each = [m.column(names=[self.features[f] for f in own]) for m, own in zip(self.models, self.model_features)]
        return df.withColumn(name, votes(each, self.labels))


Fitter = Callable[[DataFrame, Sequence[str], str], Tree]


def bagging(ds: Dataset, size: int = 1, rows_share: float = 1.0, feature_share: float = 1.0, seed: int = 42, fit: Fitter | None = None) -> Ensemble:
    """Each model sees rows and features drawn with replacement."""
    require(size > 0, "an ensemble has a model")
    require(0 < rows_share <= 1 and 0 < feature_share <= 1, "shares are above 0, and 1 at most")
    fit = fit or (lambda df, features, target: decision_tree(df, features, target))
    (target,) = ds.targets
    rows, wide = math.ceil(ds.nsamples() * rows_share), math.ceil(len(ds.features) * feature_share)
    models, places = [], []
    for (sample, picked), _ in zip(ds.bootstrap(rows, wide, seed), range(size)):
        models.append(fit(sample.df, sample.features, target))
        places.append(tuple(picked))
    return Ensemble(ds.features, tuple(models), tuple(places), tuple(ds.labels()))


def random_forest(ds: Dataset, size: int = 10, rows_share: float = 1.0, feature_share: float = 0.7, seed: int = 42, params: TreeParams = TreeParams()) -> Ensemble:
    return bagging(ds, size, rows_share, feature_share, seed, lambda df, features, target: decision_tree(df, features, target, params=params))


@dataclass(frozen=True)
class AdaBoost:
    features: tuple[str, ...]
    models: tuple[Tree, ...]
    weights: tuple[float, ...]
    labels: tuple

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, votes([m.column() for m in self.models], self.labels, self.weights))


#: The weight of a model that errs nowhere.
PERFECT = 1e6


def ada_boost(ds: Dataset, estimators: int = 50, learning_rate: float = 1.0, seed: int = 42, fit: Fitter | None = None) -> AdaBoost:
    """Each model is fitted on rows drawn by the weights of the errors before it.

    A row's weight is an expression of the models so far, so nothing is kept
    between rounds.  A draw of n rows is n hashed points on the running sum of
    weights: the number that falls on a row is its weight in the fit.
    """
    require(estimators > 0, "at least one model")
    require(learning_rate > 0, "the learning rate is positive")
    fit = fit or (lambda df, features, target: decision_tree(df, features, target, weight="_times", params=TreeParams(max_depth=1)))
    (target,) = ds.targets
    labels = ds.labels()
    require(len(labels) > 1, "there must be two classes at least", InvalidParameter)
    k, n = len(labels), ds.nsamples()
    y = F.col(f"`{target}`")
    models: list[Tree] = []
    alphas: list[float] = []
    weight = F.lit(1.0)
    for turn in range(estimators):
        rows = ds.df.withColumn("_weight", weight)
        total = rows.agg(F.sum("_weight")).first()[0]
        drawn = _drawn(rows, ds.row_id, n, total, seed + turn)
        model = fit(drawn, ds.features, target)
        wrong = model.column() != y
        error = rows.agg(F.sum(F.when(wrong, F.col("_weight")).otherwise(0.0))).first()[0] / total
        if error <= 0:
            models.append(model), alphas.append(PERFECT)
            break
        if error >= (k - 1) / k:
            require(bool(models), "the first model is no better than chance", NotConverged)
            break
        alpha = learning_rate * (math.log((1 - error) / error) + math.log(k - 1))
        weight = weight * F.when(wrong, F.lit(math.exp(alpha))).otherwise(1.0)
        models.append(model), alphas.append(alpha)
    return AdaBoost(ds.features, tuple(models), tuple(alphas), tuple(labels))


def _drawn(rows: DataFrame, row_id: str, n: int, total: float, seed: int) -> DataFrame:
    """Rows with _times: how many of n stratified points fall on each.

    The i-th point lies at a hashed place in the i-th of n equal stretches of
    the running sum, so a row's count needs its own ends alone.
    """
    placed = running(rows, [row_id], {"_upto": F.col("_weight")})
    width = total / n

    def points_below(x: Column) -> Column:
        whole = F.floor(x / width)
        inside = uniform(seed, whole) * width + whole * width
        return whole + F.when(inside < x, 1).otherwise(0)

    times = F.least(points_below(F.col("_upto")), F.lit(n)) - F.least(points_below(F.col("_upto") - F.col("_weight")), F.lit(n))
    return placed.withColumn("_times", times.cast("double")).filter("_times > 0")


__all__ = ["AdaBoost", "Ensemble", "Node", "Tree", "TreeParams", "ada_boost", "bagging", "best_splits", "decision_tree", "field", "indexed", "random_forest", "votes"]
