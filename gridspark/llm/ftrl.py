"""FTRL-proximal logistic regression over hashed word n-grams, and its scoring as sparse dot products.

A feature is a hashed n-gram that occurs in a text. Every coordinate has its own learning rate, which falls with the squared gradients it has
seen, and the L1 term keeps all coordinates at zero whose evidence stays small; so the model is a short list of (index, weight).

Training takes a sample of at most about ``TRAIN_ROWS`` labelled rows (a documented bound; all rows if there are fewer), dealt by hash into
shards of about ``SHARD_ROWS``. Each shard runs ``EPOCHS`` passes of the online updates in one task, and the weights of
the shards are averaged by index in Spark. The driver gets the non-zero averages, at most ``2 ** BITS`` numbers, and broadcasts them.

Defined results: a null or empty text has no features and the score of the intercept alone. Rows without a label are left out. Without any
labelled row, or with one label only, the model is the smoothed share of label 1. Repeated rows count as often as they stand there. A null key goes into one
shard with others; whether a row is held out is the caller's rule, which gives null for a null id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.textbytes import LOWER, WORD, chunks, mix, runs, sorted_groups, text_bytes, word_hashes

BITS = 18
TRAIN_ROWS = 16_000
SHARD_ROWS = 4_000
EPOCHS = 4


@dataclass(frozen=True)
class Rates:
    """Parameters of the updates: learning rate alpha / (beta + root of squared gradients), L1 and L2 terms."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0


@dataclass(frozen=True)
class Grams:
    """Kinds of features: (offsets of the words), such as (0,), (0, 1) for pairs and (0, 2) for pairs with a gap.

    With ``marks``, runs of other characters than words and white space are words too.
    """

    offsets: tuple[tuple[int, ...], ...]
    marks: bool = False


@dataclass(frozen=True)
class Model:
    indices: np.ndarray
    weights: np.ndarray
    bias: float


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def features(column: pa.Array, grams: Grams, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, not yet unique, and the index of their text."""
    data, offsets = text_bytes(column)
    low = LOWER[data]
    starts, ends = runs(WORD[low], offsets)
    if grams.marks:
        other_starts, other_ends = runs(~WORD[low] & ~SPACE[low], offsets)
        starts, ends = np.concatenate([starts, other_starts]), np.concatenate([ends, other_ends])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    words = word_hashes(low, starts, ends)
    text = np.searchsorted(offsets, starts, side="right") - 1
    shift = np.uint64(64 - bits)
    found, owners = [], []
    for k, places in enumerate(grams.offsets):
        n = words.size - places[-1]
        if n <= 0:
            continue
        h = mix(words[:n] + np.uint64(k + 1))
        for place in places[1:]:
            h = mix(h + words[place : place + n])
        inside = text[:n] == text[places[-1] :]
        found.append((h >> shift)[inside].astype(np.uint32))
        owners.append(text[:n][inside])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def unique_features(index: np.ndarray, owner: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a text once, by text."""
    key = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | index)
    return (key & np.uint64((1 << bits) - 1)).astype(np.uint32), (key >> np.uint64(bits)).astype(np.int64)


class Ftrl:
    """The state (z, n) of the updates; the intercept is the last coordinate and has no L1 term."""

    def __init__(self, rates: Rates, bits: int = BITS):
        self.rates = rates
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)
        self.l1 = np.full((1 << bits) + 1, rates.l1)
        self.l1[-1] = 0.0

    def weights(self, at) -> np.ndarray:
        z, r = self.z[at], self.rates
        rest = np.abs(z) - self.l1[at]
        return np.where(rest > 0, -np.sign(z) * rest / ((r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2), 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rates.alpha * w
        self.n[at] = n + g * g


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, rates: Rates, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """Weights (the intercept last) after ``epochs`` passes in a fixed shuffled order."""
    state = Ftrl(rates, bits)
    rng = np.random.default_rng(7)
    rows = [np.append(r, 1 << bits) for r in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            state.learn(rows[i], int(labels[i]))
    return state.weights(slice(None))


def _apart(df: DataFrame, shards: int) -> Column:
    """A partitioning key for each shard such that ``repartition(shards, key)`` gives every shard a task of its own."""
    keys = df.sparkSession.range(64 * shards).groupBy(F.pmod(F.hash("id"), F.lit(shards)).alias("part")).agg(F.min("id").alias("id")).orderBy("part").collect()
    spread = [r["id"] for r in keys] if len(keys) == shards else list(range(shards))
    return F.element_at(F.array(*map(F.lit, spread)), F.col("shard") + 1).cast("long")


def train(
    labelled: DataFrame,
    grams: Grams,
    rates: Rates,
    text: str = "text",
    label: str = "label",
    key: str = "doc_id",
    max_rows: int = TRAIN_ROWS,
    shard_rows: int = SHARD_ROWS,
    epochs: int = EPOCHS,
    bits: int = BITS,
) -> Model:
    """Fit a model to labelled rows (label 0 or 1); ``key`` only decides, by hash, about the sample and the shards."""
    known = labelled.filter(F.col(label).isNotNull())
    sums = known.agg(F.count("*").alias("n"), F.sum(label).alias("ones")).first()
    rows, ones = sums["n"], int(sums["ones"] or 0)
    if ones in (0, rows):
        share = (ones + 1) / (rows + 2)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    shards = max(1, round(min(rows, max_rows) / shard_rows))
    draw = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(rows))
    sample = known.filter(draw < max_rows).select(
        F.pmod(F.xxhash64(key, F.lit(13)), F.lit(shards)).cast("int").alias("shard"),
        F.xxhash64(key, F.lit(17)).alias("k"),
        F.col(text).alias("t"),
        F.col(label).cast("int").alias("y"),
    )

    def run(batches):
        for shard in sorted_groups(batches, ["shard"]):
            owned: list[np.ndarray] = []
            for part in chunks(shard.combine_chunks().to_batches(), "t"):
                index, owner = unique_features(*features(part.column("t"), grams, bits), bits)
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                owned += [index[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            w = fit(owned, shard.column("y").to_numpy(), rates, epochs, bits)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["i", "w"])

    sample = sample.repartition(shards, _apart(labelled, shards)).sortWithinPartitions("shard", "k", "t", "y")
    averages = sample.mapInArrow(run, "i long, w double").groupBy("i").agg((F.sum("w") / shards).alias("w")).orderBy("i").toPandas()
    inside = averages["i"] < (1 << bits)
    return Model(averages["i"][inside].to_numpy(), averages["w"][inside].to_numpy(), float(averages["w"][~inside].sum()))


def inner_losses(
    labelled: DataFrame, grams: Grams, grid: Sequence[Rates], folds: int = 4, text: str = "text", label: str = "label", key: str = "doc_id"
) -> list[float]:
    """The mean log loss of each of ``grid`` on one inner fold of the labelled rows, fitted to the others.

    Rates are chosen with this on training rows; rows that are held out from training never come in.
    """
    known = labelled.filter(F.col(label).isNotNull()).withColumn("_inner", F.pmod(F.xxhash64(key, F.lit(19)), F.lit(folds)) == 0)
    out = []
    for rates in grid:
        model = train(known.filter(~F.col("_inner")), grams, rates, text, label, key)
        y, p = F.col(label), F.col("_p")
        found = score(known.filter("_inner"), model, grams, text, "_p")
        out.append(found.agg(F.avg(-F.log(F.when(y == 1, p).otherwise(1 - p)))).first()[0])
    return out


def scores(column: pa.Array, weights: np.ndarray, bias: float, grams: Grams, bits: int = BITS) -> np.ndarray:
    """Probabilities of label 1."""
    index, owner = features(column, grams, bits)
    heavy = weights[index] != 0
    index, owner = unique_features(index[heavy], owner[heavy], bits)
    total = np.bincount(owner, weights[index], len(column)) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model, grams: Grams, text: str = "text", out: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with the score of every whole text; a column of that name is replaced."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast((model.indices, model.weights, model.bias))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indices, values, bias = shared.value
        weights = np.zeros(1 << bits)
        weights[indices] = values
        for batch in chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(text), weights, bias, grams, bits))], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
