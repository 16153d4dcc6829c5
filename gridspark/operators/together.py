"""Boosted trees of many models in one fit: all regions, folds and settings of a grid grow level by level side by side.

A row names the groups it trains (a region, a fold of it, a setting). One aggregation per level sums gradients by (model, node,
feature, bin) for all models, one more per round gives the values of all leaves, so that the number of jobs follows from rounds and
depth and not from the number of regions, folds or quantiles. Quantile leaves come from mergeable sketches with a bounded rank
error. Only splits and leaf values reach the driver: their size is set by models and depth, not by the data.

Rows without a group, and rows whose target is NULL or NaN, take no part. A NULL or NaN feature has a bin of its own below all others. A
group without rows becomes a model that predicts 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType
from pyspark.sql.window import Window

from gridspark.operators.features import fill_missing_features
from gridspark.operators.forest import Forest
from gridspark.operators.quantile_trees import MISSING, TreeParams, predict_all
from gridspark.session import cut_lineage

# A leaf value is the residual at a rank that is off by at most one part in so many of the rows of the leaf.
ACCURACY = 2_000
# Weighted leaf values are off by at most this share of their size.
VALUE_ERROR = 0.002
# Smaller residuals count as 0 there.
TINY = 1e-12
# Every round takes other rows: their fixed random numbers are turned by this much.
TURN = 0.6180339887498949

CELLS = "slot bigint, feature int, bin int, g double, w double, n bigint"
SUMS = "slot bigint, g double, h double, n double"
RESIDUALS = "slot bigint, r double, w double"


@dataclass
class GrownTrees:
    """A fitted model: ``start`` and trees of nodes in heap order (feature or -1, largest value that goes left, value of a leaf)."""

    features: list[str]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)

    def add_to(self, forest: Forest) -> int:
        """Put the trees into a node table; returns the number of the model there."""
        return forest.add_heaps(self.trees, self.start)

    def times(self, factor: float) -> GrownTrees:
        """The same model with all values multiplied."""
        return GrownTrees(self.features, self.start * factor, [(s, b, v * factor) for s, b, v in self.trees], self.gains)

    def transform(self, df: DataFrame, out: str, floor_zero: bool = False) -> DataFrame:
        """Add the prediction; features the table lacks count as 0."""
        return predict_all(df, self.features, {out: self}, floor_zero)

    def importances(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits."""
        total = sum(self.gains.values())
        return {f: (self.gains.get(f, 0.0) / total if total else 0.0) for f in self.features}


def filled(feature: str) -> Column:
    """A feature as a number, NULL and NaN below every real value."""
    return F.coalesce(F.nanvl(F.col(feature).cast("double"), F.lit(None)), F.lit(MISSING))


def _edges(df: DataFrame, features: Sequence[str], key: Column, bins: int) -> dict[str, list[np.ndarray]]:
    """Bin edges of every feature for every key: a few dozen keys of at most ``bins`` numbers a feature."""
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    cuts = [F.percentile_approx(filled(f), shares, 100 * bins).alias(f"_e{i}") for i, f in enumerate(features)]
    rows = df.groupBy(key.alias("_key")).agg(*cuts).collect()
    return {r["_key"]: [np.array(sorted({MISSING, *r[f"_e{i}"]})) for i in range(len(features))] for r in rows}


def _bins(df: DataFrame, features: Sequence[str], key: Column, edges) -> Column:
    """The bin of every feature: the number of edges below the value."""
    table = df.sparkSession.sparkContext.broadcast(edges)

    @F.pandas_udf(ArrayType(ShortType()))
    def binned(keys: pd.Series, values: pd.DataFrame) -> pd.Series:
        x = values.to_numpy(dtype=np.float64)
        out = np.zeros(x.shape, dtype=np.int16)
        for k in keys.unique():
            mine = (keys == k).to_numpy()
            for i, cuts in enumerate(table.value[k]):
                out[mine, i] = np.searchsorted(cuts, x[mine, i], side="left")
        return pd.Series(list(out))

    return binned(key, F.struct(*[filled(f).alias(f"f{i}") for i, f in enumerate(features)]))


def _kernel(n_features: int, targets: Sequence[float], loss: str, width: int, depth: int, n_bins: int, heavy: np.ndarray):
    """The work on one Arrow batch; closed over plain values, so that tasks need numpy and Arrow only.

    ``targets``: quantiles, or one entry for the other losses. A model is a group and a target.
    """
    shares = np.asarray(targets)

    def states(batch):
        """Bins of the rows, and for each (row, model): row, model, target value, weight and prediction so far."""
        member = batch.column("_m")
        group = member.flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(member.offsets.to_numpy()))
        bins = batch.column("_k").flatten().to_numpy().reshape(batch.num_rows, n_features)
        model = (group[:, None] * len(shares) + np.arange(len(shares))).ravel()
        row = np.repeat(row, len(shares))
        y, w = batch.column("_y").to_numpy()[row], batch.column("_w").to_numpy()[row]
        return bins, row, model, y, np.where(y > 0.5, w * heavy[model], w), batch.column("_f").flatten().to_numpy()

    def descend(tree, bins, row, model):
        node = np.ones(len(row), dtype=np.int64)
        for _ in range(depth):
            split = tree[0][model, node]
            right = bins[row, np.maximum(split, 0)] > tree[1][model, node]
            node = np.where(split >= 0, 2 * node + right, node)
        return node

    def current(trees, bins, row, model, f):
        for tree in trees:
            f = f + tree[2][model, descend(tree, bins, row, model)]
        return f

    def gradient(model, y, f):
        if loss == "quantile":
            return shares[model % len(shares)] - (y < f), None
        if loss == "squared":
            return y - f, None
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    def level(batch, trees, tree, depth_now, drawn, turn, subsample):
        """Sums by (model, node, feature, bin) of the nodes of one level."""
        bins, row, model, y, w, f = states(batch)
        node = descend(tree, bins, row, model)
        taken = node >= 2**depth_now
        taken &= ((batch.column("_u").to_numpy() + turn) % 1.0)[row] < subsample[model]
        f = current(trees, bins, row, model, f)
        g, _ = gradient(model, y, f)
        row, w, g = row[taken], w[taken], g[taken]
        slots, at = np.unique(model[taken] * width + node[taken], return_inverse=True)
        parts = []
        for feature in drawn:
            code = at * n_bins + bins[row, feature]
            n = np.bincount(code, minlength=1)
            found = np.nonzero(n)[0]
            sums = [np.bincount(code, v, minlength=1)[found] for v in (w * g, w)]
            parts.append((slots[found // n_bins], np.full(len(found), feature), found % n_bins, *sums, n[found]))
        if len(slots) == 0:
            return None
        columns = [np.concatenate(c) for c in zip(*parts)]
        kinds = [np.int64, np.int32, np.int32, np.float64, np.float64, np.int64]
        names = ["slot", "feature", "bin", "g", "w", "n"]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds)], names)

    def leaves(batch, trees, tree):
        """Residuals of every leaf, or their sums where a mean is wanted."""
        bins, row, model, y, w, f = states(batch)
        f = current(trees, bins, row, model, f)
        slot = model * width + descend(tree, bins, row, model)
        if loss == "quantile":
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (slot, y - f, w)], ["slot", "r", "w"])
        g, h = gradient(model, y, f)
        slots, at = np.unique(slot, return_inverse=True)
        sums = [np.bincount(at, v, minlength=len(slots)) for v in (w * g, w if h is None else w * h, w)]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (slots, *sums)], ["slot", "g", "h", "n"])

    def moved(batch, trees):
        """The rows with the prediction after the trees."""
        bins, row, model, _, _, f = states(batch)
        member = batch.column("_m")
        ends = pa.array((member.offsets.to_numpy() - member.offsets.to_numpy()[0]) * len(shares), pa.int32())
        values = pa.ListArray.from_arrays(ends, pa.array(current(trees, bins, row, model, f)))
        names = batch.schema.names
        return pa.RecordBatch.from_arrays([values if n == "_f" else batch.column(n) for n in names], names)

    return level, leaves, moved


def _mapped(base: DataFrame, work, schema: str, *shared) -> DataFrame:
    """``work`` on every batch, its tables sent to the tasks as one broadcast."""
    table = base.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        for batch in batches:
            out = work(batch, *table.value) if batch.num_rows else None
            if out is not None:
                yield out

    return base.mapInArrow(run, schema)


def _splits(cells: DataFrame, min_rows: Column) -> DataFrame:
    """The best split of every node: ``slot, feature, bin, gain``; ties go to the first feature and bin."""
    summed = cells.groupBy("slot", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("w").alias("w"), F.sum("n").alias("n")).repartition("slot")
    # At most as many rows as there are bins.
    one = Window.partitionBy("slot", "feature")
    below = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = summed.select(
        "slot", "feature", "bin", *[F.sum(c).over(below).alias(f"l{c}") for c in "gwn"], *[F.sum(c).over(one).alias(f"t{c}") for c in "gwn"]
    )
    lg, lw, ln, tg, tw, tn = (F.col(c) for c in ("lg", "lw", "ln", "tg", "tw", "tn"))
    gain = F.try_divide(lg * lg, lw) + F.try_divide((tg - lg) * (tg - lg), tw - lw) - F.try_divide(tg * tg, tw)
    usable = sides.withColumn("gain", gain).where((ln >= min_rows) & (tn - ln >= min_rows) & (F.col("gain") > 1e-9 * tw))
    order = F.struct("gain", -F.col("feature"), -F.col("bin"))
    return usable.groupBy("slot").agg(F.max_by(F.struct("feature", "bin", "gain"), order).alias("s")).select("slot", "s.*")


def leaf_quantiles(rows: DataFrame, targets: Sequence[float], share: Column, weighted: bool) -> DataFrame:
    """``slot, value, n``: the quantile of ``r`` of every slot from one aggregation of mergeable sketches.

    Without weights the rank is off by at most ``n / ACCURACY``. Weighted rows are counted in classes of nearly equal values and the
    value is off by at most ``VALUE_ERROR`` of its size.
    """
    if not weighted:
        found = rows.groupBy("slot").agg(F.percentile_approx("r", list(targets), ACCURACY).alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
        return found.select("slot", F.element_at("v", share + 1).alias("value"), "n")
    step = float(np.log1p(2 * VALUE_ERROR))
    size = F.when(F.abs("r") > TINY, F.floor(F.log(F.abs(F.col("r")) / TINY) / step) + 1).otherwise(0)
    classes = rows.groupBy("slot", (F.signum("r") * size).cast("long").alias("c")).agg(F.sum("w").alias("w"))
    # A few thousand classes at most.
    one = Window.partitionBy("slot")
    summed = classes.select("slot", "c", F.sum("w").over(one.orderBy("c")).alias("up"), F.sum("w").over(one).alias("n"))
    wanted = F.element_at(F.array(*[F.lit(float(q)) for q in targets]), share + 1)
    first = summed.where(F.col("up") >= wanted * F.col("n") * (1 - 1e-12)).groupBy("slot").agg(F.min("c").alias("c"), F.first("n").alias("n"))
    middle = F.signum("c") * F.exp((F.abs("c") - 0.5) * step) * TINY
    return first.select("slot", F.when(F.col("c") == 0, 0.0).otherwise(middle).alias("value"), "n")


def fit_together(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    member: str,
    groups: Sequence[TreeParams],
    key: str | None = None,
    keys: Sequence[object] | None = None,
    loss: str = "quantile",
    quantiles: Sequence[float] = (0.5,),
    weight: str | None = None,
    balance: bool = False,
) -> list[list[GrownTrees]]:
    """Fit one model for each group and quantile in one go; the result is indexed by group and quantile.

    ``member``: the numbers of the groups a row trains, as an array. ``groups``: the settings of each group; bins, drawn features
    and checkpoints are those of the first. ``key`` has bin edges of its own for each value, and ``keys`` tells the value of each
    group. ``loss``: quantile (pinball), squared, or logistic, which predicts log odds of a 0/1 target; the last two have one model a group.
    ``balance`` weighs rows of target 1 by the ratio of the others to them.
    """
    if loss not in ("quantile", "squared", "logistic"):
        raise ValueError(f"unknown loss {loss}")
    features, groups = list(features), list(groups)
    targets = list(quantiles) if loss == "quantile" else [0.5]
    nt, first = len(targets), groups[0]
    models, depth = len(groups) * nt, max(g.depth for g in groups)
    width = 2 ** (depth + 1)
    place = F.lit("") if key is None else F.col(key).cast("string")
    target = F.nanvl(F.col(y).cast("double"), F.lit(None))
    used = fill_missing_features(df, features).where((F.size(member) > 0) & target.isNotNull() & place.isNotNull())
    edges = _edges(used, features, place, first.bins)
    base = cut_lineage(
        used.select(
            F.col(member).cast("array<int>").alias("_m"),
            _bins(used, features, place, edges).alias("_k"),
            target.alias("_y"),
            (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("_w"),
            F.rand(first.seed).alias("_u"),
            F.array_repeat(F.lit(0.0), F.size(member) * nt).alias("_f"),
        )
    )
    kind = base.schema.simpleString().removeprefix("struct<").removesuffix(">")
    heavy = np.ones(models)
    if balance:
        one = F.sum(F.when(F.col("_y") > 0.5, 1).otherwise(0))
        for r in base.select(F.explode("_m").alias("g"), "_y").groupBy("g").agg(one.alias("p"), F.count(F.lit(1)).alias("n")).collect():
            heavy[r["g"] * nt : (r["g"] + 1) * nt] = (r["n"] - r["p"]) / r["p"] if r["p"] else 1.0
    level, leaves, moved = _kernel(len(features), targets, loss, width, depth, first.bins + 2, heavy)
    model_of = F.floor(F.col("slot") / width).cast("int")
    share = model_of % nt
    min_rows = F.element_at(F.array(*[F.lit(int(g.min_rows)) for g in groups]), F.floor(model_of / nt).cast("int") + 1)

    def values(trees, tree, rate):
        """The value of every leaf of the tree, times its rate; penalties act on boosted leaves only."""
        found = np.zeros((models, width))
        rows = _mapped(base, leaves, RESIDUALS if loss == "quantile" else SUMS, trees, tree)
        if loss == "quantile":
            table = leaf_quantiles(rows, targets, share, weight is not None)
        else:
            table = rows.groupBy("slot").agg(F.try_divide(F.sum("g"), F.sum("h")).alias("value"), F.sum("n").alias("n"))
        for r in table.collect():
            model, node = divmod(r["slot"], width)
            params, value = groups[model // nt], r["value"] or 0.0
            if rate and (params.leaf_l1 or params.leaf_l2):
                value = params.shrunk(value, r["n"]) if r["n"] else 0.0
            found[model, node] = value * (params.rate if rate else 1.0)
        return found

    def empty():
        return np.full((models, width), -1, dtype=np.int32), np.zeros((models, width), dtype=np.int32)

    part = np.repeat([float(g.subsample) for g in groups], nt)
    root = (*empty(), np.zeros((models, width)))
    root = (*root[:2], values([], root, False))
    out = [[GrownTrees(features, float(root[2][g * nt + t, 1])) for t in range(nt)] for g in range(len(groups))]
    pending = [root]
    for n in range(max(g.rounds for g in groups)):
        tree = (*empty(), np.zeros((models, width)))
        drawn = first.drawn(len(features), n) or list(range(len(features)))
        gains = []
        for d in range(depth):
            cells = _mapped(base, level, CELLS, pending, tree, d, drawn, (n + 1) * TURN % 1.0, part)
            splits = 0
            for r in _splits(cells, min_rows).collect():
                model, node = divmod(r["slot"], width)
                if d < groups[model // nt].depth and n < groups[model // nt].rounds:
                    tree[0][model, node], tree[1][model, node] = r["feature"], r["bin"]
                    gains.append((model, r["feature"], r["gain"]))
                    splits += 1
            if not splits:
                break
        leaf = values(pending, tree, True)
        leaf[[m for m in range(models) if n >= groups[m // nt].rounds]] = 0.0
        tree = (*tree[:2], leaf)
        for model, feature, gain in gains:
            found = out[model // nt][model % nt].gains
            found[features[feature]] = found.get(features[feature], 0.0) + gain
        for g in range(len(groups)):
            if n < groups[g].rounds:
                cuts = edges.get("" if key is None else str(keys[g]))
                for t in range(nt):
                    split, bin_, value = (a[g * nt + t].copy() for a in tree)
                    below = np.array([cuts[s][min(b, len(cuts[s]) - 1)] if s >= 0 else 0.0 for s, b in zip(split, bin_)])
                    out[g][t].trees.append((split, below, value))
        pending.append(tree)
        if (n + 1) % first.checkpoint_every == 0 and n + 1 < max(g.rounds for g in groups):
            base, pending = cut_lineage(_mapped(base, moved, kind, pending)), []
    return out
