import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.operators import cascade, layers, together
from gridspark.operators.quantile_trees import TreeParams
from gridspark.operators.together import fit_together, leaf_quantiles

ONE = TreeParams(rounds=1, depth=1, rate=1.0, min_rows=5, bins=64, subsample=1.0)
SMALL = TreeParams(rounds=2, depth=2, rate=0.7, min_rows=5, bins=16, subsample=1.0)
PLAN = cascade.FoldPlan("time", 12, 36)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    months = pd.date_range("2000-01-01", periods=60, freq="MS")
    cell, time = np.repeat(np.arange(12), 60), np.tile(months, 12)
    n = len(cell)
    a, b = rng.random(n), rng.integers(0, 4, n).astype(float)
    region = cell % 3 + 1
    y = np.maximum(0, 5 * a + 3 * (region == 2) * b + rng.exponential(1, n))
    pdf = pd.DataFrame({"cell_id": cell, "time": time.astype("datetime64[us]"), "a": a, "b": b, "regiontype": region.astype("int32"), "y": y, "row_id": np.arange(n)})
    pdf.loc[::50, "a"] = np.nan
    return spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("date")).cache()


def in_group(df, n=1):
    """Every row trains the groups of its region: n groups for each of the three regions."""
    return df.withColumn("m", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.col("regiontype") - 1) * n + i))


def pinball(y, p, q):
    return np.mean(np.maximum(q * (y - p), (q - 1) * (y - p)))


def test_first_split_and_leaves_against_search(table):
    """One round of depth 1: the split with the greatest gain of all, and the quantile of each side."""
    model = fit_together(in_group(table), ["b", "cell_id"], "y", "m", [ONE] * 3, "regiontype", [1, 2, 3], quantiles=(0.3,))[1][0]
    pdf = table.where("regiontype = 2").toPandas()
    start = model.start
    assert abs((pdf.y <= start).mean() - 0.3) < 0.01
    g = 0.3 - (pdf.y < start)

    def gain(c, x):
        left, right = g[pdf[c] <= x], g[pdf[c] > x]
        return left.sum() ** 2 / len(left) + right.sum() ** 2 / len(right) if min(len(left), len(right)) >= 5 else -1

    best = max(gain(c, x) for c in ("b", "cell_id") for x in pdf[c].unique())
    split, below, value = model.trees[0]
    assert np.isclose(gain(model.features[split[1]], below[1]), best)
    low = pdf[model.features[split[1]]] <= below[1]
    for side, node in ((low, 2), (~low, 3)):
        assert split[node] == -1 and abs((pdf.y[side] - start <= value[node] + 1e-12).mean() - 0.3) <= 1.5 / side.sum()


def test_models_do_not_touch_each_other(table):
    """Three regions with two settings each grow the trees that they grow alone; penalties and depth are those of the group."""
    settings = [SMALL, TreeParams(rounds=1, depth=1, rate=0.5, min_rows=20, bins=16, subsample=1.0, leaf_l1=5.0, leaf_l2=50.0)]
    both = fit_together(in_group(table, 2), ["a", "b"], "y", "m", settings * 3, "regiontype", [1, 1, 2, 2, 3, 3], quantiles=(0.1, 0.9))
    for i, params in enumerate(settings):
        own = table.where("regiontype = 2").withColumn("m", F.array(F.lit(0)))
        alone = fit_together(own, ["a", "b"], "y", "m", [params], "regiontype", [2], quantiles=(0.1, 0.9))
        for x, z in zip(both[2 + i], alone[0]):
            a, b = (m.transform(own, "p").select("row_id", "p").toPandas().sort_values("row_id").p for m in (x, z))
            assert len(x.trees) == params.rounds and np.allclose(a, b) and a.nunique() > 1
    assert all((s[2:] == -1).all() for s, _, _ in both[3][0].trees)


def test_quantiles_squares_and_odds_improve(table):
    pdf = table.toPandas()
    for weight in (None, "w"):
        rows = in_group(table).withColumn("w", F.lit(3.0))
        found = fit_together(rows, ["a", "b"], "y", "m", [SMALL] * 3, "regiontype", [1, 2, 3], quantiles=(0.1, 0.5, 0.9), weight=weight)
        for key, models in zip((1, 2, 3), found):
            for q, m in zip((0.1, 0.5, 0.9), models):
                o = m.transform(table.where(F.col("regiontype") == key), "p").toPandas()
                assert pinball(o.y, o.p, q) < 0.95 * pinball(o.y, m.start, q) and abs((o.y <= o.p).mean() - q) < 0.1
                assert np.isclose(sum(m.importances().values()), 1)
    square = fit_together(in_group(table), ["b"], "y", "m", [ONE] * 3, "regiontype", [1, 2, 3], loss="squared")
    for key in (1, 2):
        o = square[key - 1][0].transform(table.where(F.col("regiontype") == key), "p").toPandas()
        assert np.isclose(square[key - 1][0].start, pdf.y[pdf.regiontype == key].mean())
        assert np.allclose(o.groupby("p").y.mean().index, o.groupby("p").y.mean())
    odds = fit_together(in_group(table).withColumn("hi", (F.col("y") > 6).cast("int")), ["a", "b"], "hi", "m", [SMALL] * 3, "regiontype", [1, 2, 3], loss="logistic", balance=True)
    o = odds[1][0].transform(table.where("regiontype = 2"), "p").toPandas()
    assert ((o.p > 0) == (o.y > 6)).mean() > 0.8 and np.isclose(odds[1][0].start, 0, atol=1e-9)
    with pytest.raises(ValueError):
        fit_together(in_group(table), ["a"], "y", "m", [ONE] * 3, "regiontype", [1, 2, 3], loss="other")


def test_sketched_quantiles_stay_within_their_error(spark):
    rng = np.random.default_rng(3)
    n = 60_000
    pdf = pd.DataFrame({"slot": rng.integers(0, 3, n), "r": rng.standard_cauchy(n), "w": rng.random(n)})
    pdf.loc[pdf.slot == 2, "r"] = np.where(rng.random((pdf.slot == 2).sum()) < 0.6, 0.0, -1.0)
    df, targets = spark.createDataFrame(pdf).repartition(7), (0.1, 0.5, 0.9)
    for i, q in enumerate(targets):
        for weighted in (False, True):
            for r in leaf_quantiles(df, targets, F.lit(i), weighted).collect():
                own = pdf[pdf.slot == r["slot"]]
                w = own.w if weighted else np.ones(len(own))
                slack = together.VALUE_ERROR * abs(r["value"]) * 1.01 if weighted else 0.0
                rank = 1e-9 if weighted else 1.0 / together.ACCURACY
                assert np.isclose(r["n"], w.sum())
                assert w[own.r < r["value"] - slack].sum() / w.sum() <= q + rank and w[own.r <= r["value"] + slack].sum() / w.sum() >= q - rank


def test_rows_without_group_target_or_weight(spark, table):
    extra = table.withColumns({"y": F.lit(float("nan")), "a": F.lit(None).cast("double")}).limit(40)
    lost = table.withColumn("y", F.lit(1e9)).limit(40)
    rows = in_group(table).unionByName(in_group(extra)).unionByName(lost.withColumn("m", F.lit(None).cast("array<int>")))
    rows = rows.unionByName(lost.withColumn("m", F.array().cast("array<int>"))).withColumn("_m", F.lit("clash"))
    how = {"member": "m", "groups": [SMALL] * 4, "key": "regiontype", "keys": [1, 2, 3, 4]}
    found = fit_together(rows, ["a", "b", "absent"], "y", **how)
    clean = fit_together(in_group(table), ["a", "b"], "y", **how)
    assert [m[0].start for m in found] == [m[0].start for m in clean] and found[3][0].start == 0.0
    # A group without rows, and a table without rows, predict 0.
    none = fit_together(rows.limit(0), ["a", "b"], "y", **how)
    assert none[0][0].transform(table, "p").where("p <> 0").count() == 0 and found[3][0].transform(table, "p").where("p <> 0").count() == 0


def test_jobs_do_not_grow_with_regions(spark, table):
    def jobs(regions):
        name = f"together-{regions}"
        rows = table.withColumns({"k": (F.col("cell_id") % regions).cast("int"), "m": F.array((F.col("cell_id") % regions).cast("int"))})
        spark.sparkContext.setJobGroup(name, name)
        fit_together(rows, ["a", "b"], "y", "m", [ONE] * regions, "k", list(range(regions)), quantiles=(0.1, 0.5, 0.9))
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setJobGroup("rest", "rest")
        return found

    few, many = jobs(1), jobs(12)
    assert 0 < few <= 40 and many <= few + 2


def test_layers_end_to_end(table):
    grid = {"rate": [0.0, 0.7], "min_rows": [5]}
    layer = layers.train_global_together(table, ["a"], "y", PLAN, SMALL, grid, "cell_id", inner_folds=2)
    # A rate of 0 learns nothing and is not chosen by any fold.
    assert np.isclose(layer.params.rate, 0.7)
    assert layer.fold_scores.count() == 2 and layer.oof.count() == 2 * 12 * 12 and layer.oof.where("y_pred < 0 or y_pred is null").count() == 0
    assert {f for f, _, _ in layer.importance} == {0, 1}
    wide = cascade.GlobalLayer(["a", "b"], layer.models, layer.oof, layer.fold_scores, layer.importance, layer.params)
    regional = layers.train_regional_together(table, wide, "y", plan=PLAN, params=SMALL, grid={"rate": [0.0, 0.7]}, min_samples=50)
    decisions = {r["region"]: r for r in regional.decisions.collect()}
    assert decisions[2]["adopted"] and set(regional.models) == {k for k, r in decisions.items() if r["adopted"]}
    assert regional.oof.count() == 3 * 2 * 4 * 12 and regional.oof.select("cell_id", "time").distinct().count() == regional.oof.count()
    scored = cascade.score_cascade(table, wide, regional, None, "row_id")
    err = scored.where("regiontype = 2").agg(F.avg(F.abs(F.col("g_q50") - F.col("y"))), F.avg(F.abs(F.col("gr_q50") - F.col("y")))).first()
    assert err[1] < err[0]
    again = layers.train_regional_together(table, wide, "y", params=SMALL, only=[3])
    assert set(again.models) == {3}
    none = layers.train_regional_together(table, wide, "y", plan=PLAN, params=SMALL, min_samples=10_000)
    assert not none.models and {r["reason"] for r in none.decisions.collect()} == {"insufficient_samples"}
    with pytest.raises(ValueError):
        layers.train_regional_together(table, wide, "y", plan=PLAN, params=SMALL, grid={"bins": [8]}, min_samples=50)


def test_extreme_layer(table):
    rows = table.withColumns({"y_true": F.col("y"), "base": F.when(F.col("b") == 3, F.col("y") * 0.5).otherwise(F.col("y"))})
    params = TreeParams(rounds=3, depth=2, rate=0.5, min_rows=1, subsample=1.0)
    layer = layers.train_extreme_together(rows, ["a", "b"], "base", "row_id", plan=PLAN, params=params, min_samples=50, min_extremes=5)
    decisions = {r["region"]: r for r in layer.decisions.collect()}
    assert set(decisions) == {1, 2, 3} and set(layer.detectors) == {k for k, r in decisions.items() if r["adopted"]}
    again = layers.train_extreme_together(rows, ["a", "b"], "base", "row_id", only=[2], params=params)
    fixed = again.transform(rows.withColumn("gr_q50", F.col("base")), "row_id")
    assert set(again.detectors) == {2} and fixed.where("regiontype <> 2 and gre_q50 <> gr_q50").count() == 0
    own = fixed.where("regiontype = 2").agg(F.sum((F.col("gre_q50") != F.col("gr_q50")).cast("int")), F.sum("gre_q50") / F.sum("gr_q50")).first()
    assert 0 < own[0] <= int(240 * 0.05) and own[1] <= 1.05 + 1e-9
    few = layers.train_extreme_together(rows, ["a"], "base", "row_id", plan=PLAN, params=params)
    assert not few.detectors and {r["decision"] for r in few.decisions.collect()} == {"insufficient_samples"}
