import numpy as np
import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridspark.operators import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one key, many ties, heavy tail."""
    rng = np.random.default_rng(3)
    n = 900
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 20, n))
    value = np.round(np.exp(rng.normal(0, 3, n)), 1)
    value[rng.random(n) < 0.2] = 5.0
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "v": value, "w": rng.integers(1, 5, n).astype(float), "u": np.round(rng.normal(0, 1, n), 1)})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("limit", [30, 10_000])
def test_quantiles_match_numpy(skewed, limit):
    pdf, df = skewed
    got = {r["k"]: r for r in scale.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}, range_rows=limit).collect()}
    for k, g in pdf.groupby("k"):
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"]], np.quantile(g.v, [0.1, 0.5, 0.9]))
    whole = scale.exact_quantiles(df, [], "v", {"q": 0.85}, range_rows=limit).first()[0]
    assert np.isclose(whole, np.quantile(pdf.v, 0.85))


def test_ranges_are_used_and_bounded(skewed):
    _, df = skewed
    distinct = df.select("v").distinct()
    ranged = scale.value_ranges(distinct, "v", "r", scale.range_cuts(distinct, "v", 30))
    sizes = [r["count"] for r in ranged.groupBy("r").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 70


def test_weighted_quantile(skewed):
    pdf, df = skewed
    got = dict(rows(scale.weighted_quantile(df, ["k"], "v", "w", 0.7, "q", range_rows=25), "k", "q"))
    for k, g in pdf.groupby("k"):
        s = g.sort_values("v")
        expected = s.v[(s.w.cumsum() >= 0.7 * s.w.sum()).values].iloc[0]
        assert got[k] == expected


@pytest.mark.parametrize("limit", [20, 10_000])
def test_spearman_matches_ranks(skewed, limit):
    pdf, df = skewed
    got = dict(rows(scale.spearman(df, ["k"], "v", "u", range_rows=limit), "k", "spearman_r"))
    for k, g in pdf.groupby("k"):
        assert np.isclose(got[k], g.v.rank().corr(g.u.rank()))


@pytest.mark.parametrize("limit, known", [(1, True), (20, False), (10_000, True)])
@pytest.mark.parametrize("tied", [False, True])
def test_cuts_ties_go_to_small_ids(skewed, limit, known, tied):
    """A bracket of one row, of twenty, and no bracket at all; with a hot key of one value as well."""
    pdf, df = skewed
    if tied:
        pdf, df = pdf.assign(v=0.5), df.withColumn("v", F.lit(0.5))
    wanted = F.when(F.col("k") == 0, 150).otherwise(3)
    limits = df.groupBy("k").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")).withColumn("_limit", wanted)
    cuts = scale.lexicographic_cuts(df, ["k"], "v", "id", limits, range_rows=limit, rows=len(pdf) if known else None)
    expected = {}
    for k, g in pdf.groupby("k"):
        last = g.sort_values(["v", "id"], ascending=[False, True]).iloc[(150 if k == 0 else 3) - 1]
        expected[k] = (last.v, last.id)
    assert {r["k"]: (r["_cut"], r["_cut_id"]) for r in cuts.collect()} == expected


def test_keep_first_and_last(frame):
    df = frame([(1, 3, "c"), (1, 1, None), (1, 2, "b"), (2, 9, "z")], "k int, o int, v string")
    assert rows(scale.keep_first(df, ["k"], ["o"])) == [(1, 1, None), (2, 9, "z")]
    assert rows(scale.keep_last(df, ["k"], ["o"])) == [(1, 3, "c"), (2, 9, "z")]


def test_share_of_zero_total_and_null_keys(frame):
    df = frame([(1, 0.0), (1, 0.0), (None, 3.0), (None, 1.0)], "k int, v double")
    assert rows(scale.share_of(df, ["k"], "v", "s"), "k", "s") == [(1, 0.0), (1, 0.0), (None, 0.25), (None, 0.75)]


def test_literal_rows_quotes(spark):
    df = scale.literal_rows(spark, [("it's", 1, None), ("b\\c", 2, 0.5)], "a string, b int, c double")
    assert rows(df) == [("b\\c", 2, 0.5), ("it's", 1, None)]
