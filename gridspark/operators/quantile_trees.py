"""Boosted trees for a conditional quantile.

Each round fits a Spark regression tree to the gradient of the pinball loss and then gives every leaf
the quantile of its residuals. Rows stay distributed; only the leaf values (at most ``2 ** depth`` per
round) and the trees reach the driver. Leaf values may be shrunk by their number of rows, and a tree may see a drawn part of the features only.
"""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.features import assemble, fill_missing_features
from gridspark.operators.forest import Forest, walk
from gridspark.operators.scale import exact_quantiles, few_tasks, weighted_quantile
from gridspark.session import cut_lineage

# Stands for a missing feature: below every real value, so missing rows share one branch.
MISSING = -1e30


@dataclass(frozen=True)
class TreeParams:
    """Settings of one model; the defaults are those of the global layer.

    A leaf of ``n`` rows (or weight) and residual quantile ``v`` gets ``sign(v) * max(|v| - leaf_l1 / n, 0) * n / (n + leaf_l2)``. Each tree draws
    ``columns`` of the features, one at least.
    """

    rounds: int = 150
    depth: int = 8
    rate: float = 0.1
    min_rows: int = 3
    subsample: float = 0.9
    bins: int = 64
    seed: int = 42
    checkpoint_every: int = 5
    leaf_l1: float = 0.0
    leaf_l2: float = 0.0
    columns: float = 1.0

    def shrunk(self, value: float, rows: float) -> float:
        """A leaf value under the penalties."""
        size = max(abs(value) - self.leaf_l1 / rows, 0.0) * rows / (rows + self.leaf_l2)
        return size if value >= 0 else -size

    def drawn(self, n_features: int, tree: int) -> list[int]:
        """The features of a tree, none for all of them."""
        if self.columns >= 1:
            return []
        wanted = max(1, round(self.columns * n_features))
        return sorted(random.Random(self.seed + tree).sample(range(n_features), wanted))


@dataclass
class QuantileTrees:
    """A fitted model: start value plus ``rate`` times one leaf value per tree."""

    features: list[str]
    q: float
    start: float
    params: TreeParams
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    leaves: list[list[float]] = field(default_factory=list)
    drawn: list[list[int]] = field(default_factory=list)

    def add_to(self, forest: Forest) -> int:
        """Put the trees into a node table; returns the number of the model there."""
        trees = [(t.toDebugString, v, self.params.rate, d) for t, v, d in zip(self.trees, self.leaves, self.drawn)]
        return forest.add_model(trees, self.start)

    def transform(self, df: DataFrame, out: str, floor_zero: bool = False) -> DataFrame:
        """Add the prediction; features the table lacks count as 0."""
        return predict_all(df, self.features, {out: self}, floor_zero)

    def importances(self) -> dict[str, float]:
        """Mean split importance of each feature over the trees."""
        sums = dict.fromkeys(self.features, 0.0)
        for tree, drawn in zip(self.trees, self.drawn):
            names = [self.features[i] for i in drawn] or self.features
            for f, v in zip(names, tree.featureImportances.toArray()):
                sums[f] += float(v) / len(self.trees)
        return sums

    def save(self, path: str) -> None:
        """Trees as Spark ML folders next to one JSON line of settings and leaf values."""
        for i, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree={i}")
        meta = {"features": self.features, "q": self.q, "start": self.start, "params": asdict(self.params), "leaves": self.leaves, "drawn": self.drawn}
        spark = _session()
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> QuantileTrees:
        meta = json.loads(_session().read.text(f"{path}/meta").first()[0])
        trees = [DecisionTreeRegressionModel.load(f"{path}/tree={i}") for i in range(len(meta["leaves"]))]
        return cls(meta["features"], meta["q"], meta["start"], TreeParams(**meta["params"]), trees, meta["leaves"], meta.get("drawn", [[]] * len(trees)))


def predict_all(df: DataFrame, features: Sequence[str], models: dict[str, QuantileTrees], floor_zero: bool = False) -> DataFrame:
    """Add the predictions of several models of the same features in one pass; features the table lacks count as 0."""
    forest = Forest()
    numbers = {name: model.add_to(forest) for name, model in models.items()}
    staged = fill_missing_features(df, features)
    found = staged.withColumn("_walked", walk(staged, forest, features, numbers, MISSING))
    values = {n: F.greatest(F.col("_walked")[n], F.lit(0.0)) if floor_zero else F.col("_walked")[n] for n in models}
    return found.select(*[c for c in df.columns if c not in values], *[v.alias(n) for n, v in values.items()])


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def _sliced(df, vector, drawn):
    """The drawn features as a vector of their own."""
    return VectorSlicer(inputCol=vector, outputCol="_some", indices=drawn).transform(df)


def _leaf(tree, df, vector, out, drawn=()):
    if drawn:
        return _leaf(tree, _sliced(df, vector, list(drawn)), "_some", out).drop("_some")
    view = tree.copy()
    view.setFeaturesCol(vector).setPredictionCol(f"{out}_p").setLeafCol(out)
    return view.transform(df).drop(f"{out}_p")


def _value(leaf: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), leaf.cast("int") + 1)


def fit_quantile_trees(
    df: DataFrame, features: Sequence[str], y: str, q: float, params: TreeParams = TreeParams(), weight: str | None = None
) -> QuantileTrees:
    """Fit boosted trees for the ``q`` quantile of ``y``, with optional row weights."""
    features = list(features)
    columns = [F.col(y).cast("double").alias("_y")]
    if weight:
        columns.append(F.col(weight).cast("double").alias("_w"))
    base = assemble(df, features, "_vec", MISSING).where(F.col(y).isNotNull()).select("_vec", *columns)
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    n_rows = base.count()
    rows = few_tasks(base, n_rows)

    def quantiles(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
        if weight:
            return weighted_quantile(rows, keys, value, "_w", q, "_q", rows=n_rows)
        return exact_quantiles(rows, keys, value, {"_q": q}, rows=n_rows)

    first = quantiles(rows, [], "_y").first()
    if first is None or first[0] is None:
        base.unpersist()
        raise ValueError("no rows to fit")
    model = QuantileTrees(features, q, float(first[0]), params)
    current = rows.withColumn("_f", F.lit(model.start))
    try:
        for n in range(params.rounds):
            graded = current.withColumn("_g", F.lit(q) - (F.col("_y") < F.col("_f")).cast("double"))
            sample = graded.sample(params.subsample, seed=params.seed + n) if params.subsample < 1 else graded
            drawn = params.drawn(len(features), n)
            sample = _sliced(sample, "_vec", drawn) if drawn else sample
            learner = DecisionTreeRegressor(
                featuresCol="_some" if drawn else "_vec",
                labelCol="_g",
                maxDepth=params.depth,
                maxBins=params.bins,
                minInstancesPerNode=params.min_rows,
                seed=params.seed + n,
            )
            tree = (learner.setWeightCol("_w") if weight else learner).fit(sample)
            leafed = _leaf(tree, current, "_vec", "_leaf", drawn).withColumn("_r", F.col("_y") - F.col("_f"))
            # At most 2 ** depth rows.
            found = {int(r["_leaf"]): r["_q"] for r in quantiles(leafed, ["_leaf"], "_r").collect()}
            if params.leaf_l1 or params.leaf_l2:
                sizes = leafed.groupBy("_leaf").agg(F.sum("_w" if weight else F.lit(1.0)).alias("n")).collect()
                found = {int(r["_leaf"]): params.shrunk(found.get(int(r["_leaf"]), 0.0), r["n"]) for r in sizes}
            values = [float(found.get(i, 0.0)) for i in range(max(found, default=0) + 1)]
            values += [0.0] * (tree.numNodes - len(values))
            model.trees.append(tree)
            model.leaves.append(values)
            model.drawn.append(drawn)
            step = _value(F.col("_leaf"), values) * params.rate
            current = leafed.withColumn("_f", F.col("_f") + step).drop("_leaf", "_r")
            if (n + 1) % params.checkpoint_every == 0 and n + 1 < params.rounds:
                current = cut_lineage(current)
    finally:
        base.unpersist()
    return model


def fit_quantiles(df, features, y, params=TreeParams(), quantiles=(0.1, 0.5, 0.9), weight=None) -> dict[float, QuantileTrees]:
    """One model per quantile."""
    return {q: fit_quantile_trees(df, features, y, q, params, weight) for q in quantiles}
