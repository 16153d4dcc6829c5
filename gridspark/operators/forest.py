"""Fitted trees of many models as one flat node table, walked in numpy batches.

A model with 150 trees would be 150 columns of a plan, times quantiles and regions. Here all trees of all models lie one after
the other in three arrays, and one expression per row walks those of the row's own model. The plan does not grow with trees or regions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Rows that are walked at a time, times the trees of a model.
WALK_CELLS = 500_000


@dataclass
class Forest:
    """Nodes in preorder: an inner node's left child follows it, ``right`` tells the other one; ``split`` is -1 at leaves.

    ``threshold`` holds the largest value that goes left, and the value of a leaf. A model is a start value and the places of its roots.
    """

    split: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    starts: list[float] = field(default_factory=list)
    roots: list[list[int]] = field(default_factory=list)

    def add_model(self, trees: Sequence[tuple[str, Sequence[float] | None, float, Sequence[int]]], start: float = 0.0) -> int:
        """Add a model, and return its number. A tree is its text, its leaf values (None: its own), their weight, and the features it drew."""
        self.starts.append(float(start))
        self.roots.append([self._add_tree(*tree) for tree in trees])
        return len(self.starts) - 1

    def add_heaps(self, trees: Sequence[tuple[Sequence[int], Sequence[float], Sequence[float]]], start: float = 0.0) -> int:
        """Add a model whose trees are arrays by heap number (feature or -1, largest value that goes left, value of a leaf); root 1."""
        self.starts.append(float(start))
        self.roots.append([self._add_heap(tree, 1) for tree in trees])
        return len(self.starts) - 1

    def _add_heap(self, tree, node) -> int:
        place, (split, below, value) = len(self.split), tree
        inner = split[node] >= 0
        self.split.append(int(split[node]))
        self.threshold.append(float(below[node] if inner else value[node]))
        self.right.append(-1)
        if inner:
            self._add_heap(tree, 2 * node)
            self.right[place] = self._add_heap(tree, 2 * node + 1)
        return place

    def _add_tree(self, text, leaves, weight, drawn) -> int:
        root, open_nodes, leaf = len(self.split), [], 0
        for line in text.splitlines():
            words = line.split()
            if not words or words[0] not in ("If", "Else", "Predict:"):
                continue
            if words[0] == "Else":
                self.right[open_nodes.pop()] = len(self.split)
                continue
            self.right.append(-1)
            if words[0] == "If":
                if words[3] != "<=":
                    raise ValueError(f"not a split of a number: {line.strip()}")
                open_nodes.append(len(self.split))
                feature = int(words[2])
                self.split.append(drawn[feature] if drawn else feature)
                self.threshold.append(float(words[4].rstrip(")")))
            else:
                self.split.append(-1)
                self.threshold.append(weight * (float(words[1]) if leaves is None else float(leaves[leaf])))
                leaf += 1
        return root

    def arrays(self) -> tuple:
        """The table as arrays: what the tasks get."""
        split, right = np.array(self.split, dtype=np.int32), np.array(self.right, dtype=np.int64)
        return split, np.array(self.threshold, dtype=np.float64), right, self.starts, [np.array(r, dtype=np.int64) for r in self.roots]


def walker(cells: int = WALK_CELLS) -> Callable[[tuple, int, np.ndarray], np.ndarray]:
    """The walk as a function of its own, so that tasks need numpy only and no package of ours."""

    def predict(arrays: tuple, model: int, x: np.ndarray) -> np.ndarray:
        """The sum of a model for each row of ``x``, added up tree by tree."""
        split, threshold, right, starts, roots = arrays
        out, trees = np.full(len(x), starts[model]), roots[model]
        step = max(1, cells // max(len(trees), 1))
        for low in range(0, len(x), step):
            part = x[low : low + step]
            at = np.repeat(trees[None, :], len(part), axis=0)
            row = np.arange(len(part))[:, None]
            inner = split[at] >= 0
            while inner.any():
                left = part[row, np.maximum(split[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(left, at + 1, right[at]), at)
                inner = split[at] >= 0
            for tree in range(len(trees)):
                out[low : low + step] += threshold[at[:, tree]]
        return out

    return predict


def walk(
    df: DataFrame, forest: Forest, features: Sequence[str], models: dict[str, dict[object, int] | int], missing: float, key: str | None = None
) -> Column:
    """A struct of predictions, one field for each entry of ``models``: the number of a model, or one for each value of ``key``.

    Rows whose key has no model get NULL. A NULL or NaN feature becomes ``missing``. The node table goes to the tasks as one broadcast
    of 20 bytes a node: its size is set by the numbers of trees and models and by their depth, not by the data.
    """
    table = df.sparkSession.sparkContext.broadcast(forest.arrays())
    names, predict = list(models), walker()
    kind = StructType([StructField(n, DoubleType()) for n in names])

    @F.pandas_udf(kind)
    def scored(keys: pd.Series, values: pd.DataFrame) -> pd.DataFrame:
        x = np.ascontiguousarray(values.to_numpy(dtype=np.float64))
        trees, found = table.value, {}
        for name in names:
            own = models[name]
            if not isinstance(own, dict):
                found[name] = predict(trees, own, x)
                continue
            result = np.full(len(x), None, dtype=object)
            for k in keys.dropna().unique():
                if k in own:
                    mine = (keys == k).fillna(False).to_numpy(dtype=bool)
                    result[mine] = predict(trees, own[k], x[mine])
            found[name] = result
        return pd.DataFrame(found)

    filled = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(missing)).alias(f"f{i}") for i, f in enumerate(features)]
    return scored(F.lit(0) if key is None else F.col(key), F.struct(*filled))
