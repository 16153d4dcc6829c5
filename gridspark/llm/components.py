"""Connected components of an edge table by alternating stars.

Every round is a grouping and a join by node, so no component is ever gathered; a component of any size converges in a
logarithmic number of rounds. Each round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut_lineage


def _stars(pairs: DataFrame) -> DataFrame:
    """Of directed (u, v) pairs: each u with its smallest neighbour or itself, joined to its v."""
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(lowest, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    stars = _stars(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    moved = stars.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(stars.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long): root is the smallest node of its component.

    Loops and repeated edges do no harm, null ends are left out, and without edges the result is empty.
    """
    edges = cut_lineage(edges.select("u", "v").filter("u <> v").distinct())
    before = _state(edges)
    while before[0]:
        edges = cut_lineage(_small(_large(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
