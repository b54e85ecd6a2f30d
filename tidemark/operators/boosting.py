"""A listwise ranker: boosted trees on pairwise gradients that are weighted by what a swap changes in NDCG, per decision date.

Gradients are windows over a date: the first ``truncation`` rows by score, a bounded number, are laid beside every row of their date, so that a row
sees its pairs with them and no two rows are joined. Each round fits one tree to the Newton steps on the cluster and sums gradients
by leaf; what comes back is a tree and a number per leaf. Validation dates stop it. Scores are cut from their lineage every few rounds.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import place
from .panel import require_finite


@dataclass(frozen=True)
class ListwiseSettings:
    # The model's settings.
    rounds: int = 1_000
    learning_rate: float = 0.03
    depth: int = 4
    leaf_rows: int = 2_000
    l2: float = 10.0
    truncation: int = 13
    top: int = 10
    gains: tuple[float, ...] = (0.0, 1.0, 31.0)
    feature_share: float = 0.8
    date_share: float = 0.8
    patience: int = 50
    min_delta: float = 1e-4
    seed: int = 20260723
    cut_every: int = 5

    def __post_init__(self):
        if min(self.rounds, self.depth, self.leaf_rows, self.truncation, self.top, self.patience, self.cut_every) < 1:
            raise ValueError("boosting counts are positive")
        if not 0 < self.feature_share <= 1 or not 0 < self.date_share <= 1 or self.learning_rate <= 0 or self.l2 < 0:
            raise ValueError("shares lie in (0, 1], the learning rate is positive, l2 isn't negative")


def _gain(settings: ListwiseSettings) -> Column:
    return F.element_at(F.array(*[F.lit(float(g)) for g in settings.gains]), F.col("ranking_relevance") + 1)


def _discount(k: Column) -> Column:
    return F.lit(1.0) / F.log2(k + F.lit(1.0))


def _ideal(by: list[str], top: int) -> Column:
    """Largest DCG at ``top`` of a date, over column gain."""
    k = place(by, F.col("gain").desc(), F.col("ticker"))
    return F.when(k <= top, F.col("gain") * _discount(k))


def ndcg(scored: DataFrame, score: str = "score", settings: ListwiseSettings = ListwiseSettings(), by: str = "decision_date") -> DataFrame:
    """by, ndcg at ``top``; 1 where a date has nothing to gain."""
    rows = scored.select(by, "ticker", _gain(settings).alias("gain"), F.col(score).alias("score"))
    k = place([by], F.col("score").desc(), F.col("ticker"))
    rows = rows.select(by, F.when(k <= settings.top, F.col("gain") * _discount(k)).alias("got"), _ideal([by], settings.top).alias("best"))
    d = rows.groupBy(by).agg(F.sum("got").alias("got"), F.sum("best").alias("best"))
    return d.select(by, F.when(F.col("best") > 0, F.col("got") / F.col("best")).otherwise(1.0).alias("ndcg"))


def lambdas(scored: DataFrame, settings: ListwiseSettings = ListwiseSettings(), by: str = "decision_date") -> DataFrame:
    """scored (by, ticker, ranking_relevance, score, ...) with gradient and hessian of every row.

    A pair is one of the first ``truncation`` rows of a date and any row below it of another relevance. Its weight is the change of NDCG that
    a swap makes, over the distance of the scores; a date's gradients are scaled so that dates with many pairs don't rule."""
    own, day = scored.columns, Window.partitionBy(by)
    n = settings.truncation
    d = scored.withColumn("gain", _gain(settings)).withColumn("_k", place([by], F.col("score").desc(), F.col("ticker"))).withColumn("_best", _ideal([by], n))
    head = F.when(F.col("_k") <= n, F.struct(F.col("_k").alias("k"), F.col("gain").alias("g"), F.col("score").alias("s"), _discount(F.col("_k")).alias("d")))
    d = d.withColumns({"_heads": F.sort_array(F.collect_list(head).over(day)), "_max": F.sum("_best").over(day), "_spread": F.max("score").over(day) > F.min("score").over(day), "_d": _discount(F.col("_k"))})

    def pair(h: Column) -> Column:
        """Sign (1: the row is the better one), push and curvature of a row against one above it."""
        gap = F.when(F.col("gain") > h["g"], F.col("score") - h["s"]).otherwise(h["s"] - F.col("score"))
        weight = F.abs(F.col("gain") - h["g"]) * F.abs(F.col("_d") - h["d"]) / F.col("_max")
        weight = F.when(F.col("_spread"), weight / (F.abs(gap) + 0.01)).otherwise(weight)
        push = F.lit(1.0) / (F.lit(1.0) + F.exp(gap))
        sign = F.when(F.col("gain") > h["g"], 1.0).otherwise(-1.0)
        real = (h["k"] < F.col("_k")) & (h["g"] != F.col("gain")) & (F.col("_max") > 0)
        return F.when(real, F.struct((sign * push * weight).alias("l"), (push * (1.0 - push) * weight).alias("h"))).otherwise(F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("h")))

    d = d.withColumn("_pairs", F.transform("_heads", pair))
    at = lambda k, c: F.coalesce(F.get("_pairs", F.lit(k))[c], F.lit(0.0))
    # What the rows below do to each of the first, summed over the date.
    sums = {f"_{c}{k}": F.sum(at(k, c)).over(day) for k in range(n) for c in ("l", "h")}
    d = d.withColumns(sums)
    total = lambda c: F.aggregate("_pairs", F.lit(0.0), lambda a, x: a + x[c])
    top = lambda c: F.when(F.col("_k") <= n, F.element_at(F.array(*[F.col(f"_{c}{k}") for k in range(n)]), F.col("_k").cast("int"))).otherwise(0.0)
    d = d.withColumns({"_grad": top("l") - total("l"), "_hess": top("h") + total("h"), "_abs": 2.0 * F.aggregate("_pairs", F.lit(0.0), lambda a, x: a + F.abs(x["l"]))})
    every = F.sum("_abs").over(day)
    scale = F.when(every > 0, F.log2(1.0 + every) / every).otherwise(1.0)
    return d.select(*own, (F.col("_grad") * scale).alias("gradient"), (F.col("_hess") * scale).alias("hessian"))


@dataclass
class Tree:
    """Arrays by node: feature (-1: a leaf), threshold, left and right child, value of a leaf."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def expression(self, columns: Sequence[str], of: Callable[[int], Column], node: int = 0) -> Column:
        if self.feature[node] < 0:
            return of(node)
        go = F.col(columns[self.feature[node]]) <= self.threshold[node]
        return F.when(go, self.expression(columns, of, self.left[node])).otherwise(self.expression(columns, of, self.right[node]))

    def values(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, threshold, left, right = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            go = x[rows, feature[at[rows]]] <= threshold[at[rows]]
            at[rows] = np.where(go, left[at[rows]], right[at[rows]])
        return np.array(self.value)[at]


def _read_tree(model, names: Sequence[str], all_names: Sequence[str]) -> Tree:
    """A fitted tree's nodes, by the features' places among all of them."""
    out = Tree([], [], [], [], [])

    def walk(node) -> int:
        k = len(out.feature)
        for a, v in zip((out.feature, out.threshold, out.left, out.right, out.value), (-1, 0.0, -1, -1, 0.0), strict=True):
            a.append(v)
        if node.subtreeDepth() > 0:
            out.feature[k], out.threshold[k] = all_names.index(names[node.split().featureIndex()]), node.split().threshold()
            out.left[k], out.right[k] = walk(node.leftChild()), walk(node.rightChild())
        return k

    walk(model._java_obj.rootNode())
    return out


@dataclass
class ListwiseModel:
    features: list[str]
    trees: list[Tree]
    history: list[float]

    def predict(self, frame: DataFrame, name: str) -> DataFrame:
        """Adds the score: all trees over Arrow batches of the features, so that a plan doesn't grow with the trees."""
        trees, features = self.trees, self.features

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            values = x.to_numpy(np.float64)
            return pd.Series(sum((t.values(values) for t in trees), np.zeros(len(values))))

        return frame.withColumn(name, score(F.struct(*[F.col(f).cast("double") for f in features])))

    def state(self) -> dict:
        return {"features": self.features, "trees": [asdict(t) for t in self.trees], "history": self.history}

    @staticmethod
    def of(state: dict) -> ListwiseModel:
        return ListwiseModel(state["features"], [Tree(**t) for t in state["trees"]], state["history"])


def fit_listwise(training: DataFrame, validation: DataFrame, features: Sequence[str], settings: ListwiseSettings = ListwiseSettings(), cut: Callable[[DataFrame], DataFrame] | None = None) -> ListwiseModel:
    """Boosted trees for NDCG at ``top``; the rounds up to the best one on the validation dates stay.

    cut writes a table and reads it back (in the shared folder); without it lineage grows with the rounds. A round draws dates and
    features by itself, from the seed: dates as a whole, so that no list is torn."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    names = list(features)
    require_finite(training, names)
    keep = ["decision_date", "ticker", "ranking_relevance", *names]
    data = training.select(*keep, F.lit(False).alias("held_out")).unionByName(validation.select(*keep, F.lit(True).alias("held_out")))
    data = data.withColumns({n: F.col(n).cast("double") for n in names}).withColumn("score", F.lit(0.0))
    cut = cut or (lambda x: x)
    data = cut(data)
    rng = random.Random(settings.seed)
    trees, history, best, best_round = [], [], -math.inf, 0
    for r in range(settings.rounds):
        drawn = sorted(rng.sample(range(len(names)), max(1, round(settings.feature_share * len(names)))))
        own = [names[k] for k in drawn]
        g = lambdas(data.filter("NOT held_out"), settings)
        share = F.pmod(F.xxhash64("decision_date", F.lit(settings.seed + r)), F.lit(1_000_000)) < int(1_000_000 * settings.date_share)
        g = g.filter(share & (F.col("hessian") > 1e-12)).withColumn("step", -F.col("gradient") / F.col("hessian")).persist()
        try:
            if g.isEmpty():
                break
            tree = DecisionTreeRegressor(featuresCol="x", labelCol="step", weightCol="hessian", maxDepth=settings.depth, minInstancesPerNode=settings.leaf_rows, maxBins=64, seed=settings.seed + r)
            model = tree.fit(VectorAssembler(inputCols=own, outputCol="x").transform(g.select(*own, "step", "hessian")))
            nodes = _read_tree(model, own, names)
            leaf = nodes.expression(names, F.lit)
            for row in g.groupBy(leaf.alias("leaf")).agg(F.sum("gradient").alias("g"), F.sum("hessian").alias("h")).collect():
                nodes.value[row.leaf] = -settings.learning_rate * row.g / (row.h + settings.l2)
        finally:
            g.unpersist()
        trees.append(nodes)
        data = data.withColumn("score", F.col("score") + nodes.expression(names, lambda k, t=nodes: F.lit(t.value[k])))
        if (r + 1) % settings.cut_every == 0:
            data = cut(data)
        history.append(ndcg(data.filter("held_out"), settings=settings).agg(F.avg("ndcg")).first()[0])
        if history[-1] is not None and history[-1] > best + settings.min_delta:
            best, best_round = history[-1], r + 1
        elif r + 1 - best_round >= settings.patience:
            break
    return ListwiseModel(names, trees[: best_round or len(trees)], history)
