import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.llm import ftrl, quality_model, toxicity
from gridspark.llm.ftrl import Ftrl, Grams, Model, Rates, features, score, train, unique_features

from .conftest import prose


def test_updates_match_a_scalar_version():
    rates = Rates(alpha=0.5, beta=1.0, l1=0.3, l2=0.1)
    state = Ftrl(rates, bits=3)
    z, n = [0.0] * 9, [0.0] * 9
    rng = np.random.default_rng(1)
    for _ in range(60):
        at, y = np.append(np.unique(rng.integers(0, 8, 3)), 8), int(rng.integers(0, 2))
        l1 = [rates.l1] * 8 + [0.0]
        w = [0.0 if abs(z[i]) <= l1[i] else -np.sign(z[i]) * (abs(z[i]) - l1[i]) / ((rates.beta + n[i] ** 0.5) / rates.alpha + rates.l2) for i in range(9)]
        p = 1 / (1 + np.exp(-sum(w[i] for i in at)))
        for i in at:
            g = p - y
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / rates.alpha * w[i]
            n[i] += g * g
        state.learn(at, y)
    assert np.allclose(state.z, z) and np.allclose(state.n, n)


@pytest.mark.parametrize("marks", [False, True])
def test_features_are_those_of_each_text_alone(marks):
    grams = Grams(((0,), (0, 1), (0, 2), (0, 1, 2)), marks)
    texts = ["Ab c*** d\ne", None, "", "x", "é ü!! é", "a b", " . "]
    index, owner = unique_features(*features(pa.array(texts), grams))
    for i, t in enumerate(texts):
        alone, _ = unique_features(*features(pa.array([t], pa.string()), grams))
        assert sorted(index[owner == i]) == sorted(alone)
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+" + (r"|[^\s0-9a-z\x80-\U0010ffff]+" if marks else ""), (t or "").lower())
        want = {tuple(words[k + o] for o in g) + (g,) for g in grams.offsets for k in range(len(words) - g[-1])}
        assert len(alone) == len(want)


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_learns_a_word_and_scores_whole_texts(spark, docs, module):
    rows = [(i, prose(i, 40) + (" vile scum" if i % 3 == 0 else "")) for i in range(600)]
    labelled = docs(rows).selectExpr("*", "cast(doc_id % 3 = 0 AS int) AS label")
    model = train(labelled, module.GRAMS, module.RATES)
    held = [(1000, prose(2000, 3000) + " vile scum"), (1001, prose(2001, 50)), (1002, None), (1003, "")]
    out = {r.doc_id: r.score for r in score(docs(held).selectExpr("*", "'x' AS score"), model, module.GRAMS).collect()}
    assert out[1000] > 0.5 > out[1001] and out[1002] == out[1003] and 0 < out[1002] < 0.5
    again = train(labelled.repartition(7), module.GRAMS, module.RATES)
    assert np.allclose(model.weights, again.weights) and (model.indices == again.indices).all()


def test_sample_and_shards_are_bounded(spark, docs):
    rows = [(i, prose(i, 20) + (" bad" if i % 2 else "")) for i in range(400)]
    labelled = docs(rows).selectExpr("*", "cast(doc_id % 2 AS int) AS label")
    model = train(labelled, toxicity.GRAMS, Rates(1.0, 1.0, 2.0, 1.0), max_rows=200, shard_rows=50)
    out = {r.doc_id: r.score for r in score(docs(rows), model, toxicity.GRAMS).collect()}
    assert np.mean([(out[i] > 0.5) == (i % 2 == 1) for i, _ in rows]) > 0.95


def test_without_labels_or_with_one_label(docs):
    none = docs([(1, "a"), (2, "b")]).selectExpr("*", "cast(NULL AS int) AS label")
    assert train(none, toxicity.GRAMS, toxicity.RATES).bias == 0.0
    ones = docs([(1, "a"), (2, "b")]).selectExpr("*", "1 AS label")
    assert train(ones, toxicity.GRAMS, toxicity.RATES).bias == pytest.approx(np.log(3))
    assert score(docs([]), Model(np.zeros(0, int), np.zeros(0), 0.0), toxicity.GRAMS).collect() == []


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_train_and_score_match_a_scalar_version(spark, docs, module):
    """Fit, average and score as a whole, against updates one coordinate at a time."""
    rows = [(i, f"{prose(i % 7, 6)} {'bad! word' if i % 3 == 0 else 'good. line'} {prose(i, 4)}") for i in range(90)] + [(500, None), (501, "")]
    labelled = docs(rows).select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") < 80, 0).alias("label"))
    rates = ftrl.Rates(alpha=0.5, beta=1.0, l1=0.2, l2=1.0)
    model = ftrl.train(labelled, module.GRAMS, rates, max_rows=100, shard_rows=30, epochs=3)
    dealt = labelled.filter("label IS NOT NULL").select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(3)).alias("s"), F.xxhash64("doc_id", F.lit(17)).alias("k"))

    def grams(text):
        index, owner = ftrl.unique_features(*ftrl.features(pa.array([text]), module.GRAMS))
        return index.tolist()

    total = {}
    for shard in range(3):
        own = dealt.filter(F.col("s") == shard).orderBy("k", "text", "label").collect()
        z, n = {}, {}
        bias = 1 << ftrl.BITS

        def weight(i, z=z, n=n, bias=bias):
            rest = abs(z.get(i, 0.0)) - (0.0 if i == bias else rates.l1)
            return 0.0 if rest <= 0 else -math.copysign(rest, z[i]) / ((rates.beta + math.sqrt(n[i])) / rates.alpha + rates.l2)

        rng = np.random.default_rng(7)
        for _ in range(3):
            for r in rng.permutation(len(own)).tolist():
                at = [*grams(own[r]["text"]), bias]
                w = [weight(i) for i in at]
                g = 1 / (1 + math.exp(-sum(w))) - own[r]["label"]
                for i, wi in zip(at, w, strict=True):
                    old = n.get(i, 0.0)
                    z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / rates.alpha * wi
                    n[i] = old + g * g
        for i in z:
            total[i] = total.get(i, 0.0) + weight(i) / 3
    got = {r["doc_id"]: r["score"] for r in ftrl.score(docs(rows), model, module.GRAMS).collect()}
    for i, text in rows:
        want = 1 / (1 + math.exp(-sum(total.get(g, 0.0) for g in grams(text)) - total[1 << ftrl.BITS]))
        assert math.isclose(got[i], want, rel_tol=1e-9), i


def test_shards_get_a_task_each(spark):
    rows = spark.range(400).select((F.col("id") % 4).cast("int").alias("shard"))
    tasks = rows.repartition(4, ftrl._apart(rows, 4)).select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(tasks) == 4 == len({t["p"] for t in tasks})


def test_inner_losses_use_labelled_rows_only(spark, docs):
    rows = [(i, f"{'bad' if i % 2 else 'good'} {prose(i, 3)}") for i in range(80)]
    labelled = docs(rows).select("doc_id", "text", F.when(F.col("doc_id") < 60, F.col("doc_id") % 2).cast("int").alias("label"))
    losses = ftrl.inner_losses(labelled, toxicity.GRAMS, [ftrl.Rates(l1=0.1), ftrl.Rates(l1=1e6)])
    assert losses[0] < losses[1]
