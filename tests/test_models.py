import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gridspark.functions import scores
from gridspark.operators import cascade
from gridspark.operators.features import assemble
from gridspark.operators.forest import Forest, walk, walker
from gridspark.operators.quantile_trees import MISSING, QuantileTrees, TreeParams, fit_quantile_trees
from gridspark.operators.scale import few_tasks
from gridspark.session import cut_lineage

PARAMS = TreeParams(rounds=3, depth=3, rate=0.6, min_rows=5, bins=16, subsample=1.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n_cells, months = 12, pd.date_range("2000-01-01", periods=48, freq="MS")
    cell, time = np.repeat(np.arange(n_cells), 48), np.tile(months, n_cells)
    n = len(cell)
    a, b = rng.random(n), rng.integers(0, 4, n).astype(float)
    region = cell % 2 + 1
    y = np.maximum(0, 5 * a + 3 * (region == 2) * b + rng.exponential(1, n))
    pdf = pd.DataFrame({"cell_id": cell, "time": time.astype("datetime64[us]"), "a": a, "b": b, "regiontype": region.astype("int32"), "y": y, "row_id": np.arange(n)})
    pdf.loc[::50, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("date")).withColumn("a", F.nanvl("a", F.lit(None)))
    return df.cache()


@pytest.mark.parametrize("q", [0.1, 0.9])
def test_quantile_trees_beat_the_constant(table, q):
    model = fit_quantile_trees(table, ["a", "b"], "y", q, PARAMS)
    r = model.transform(table, "p").agg(
        F.avg(scores.pinball(F.col("y"), F.col("p"), q)), F.avg(scores.pinball(F.col("y"), F.lit(model.start), q)), F.avg((F.col("y") <= F.col("p")).cast("double"))
    ).first()
    assert r[0] < r[1] * 0.95 and abs(r[2] - q) < 0.1
    assert sum(model.importances().values()) > 0.9


def test_leaf_values_are_leaf_quantiles(table):
    """One full-rate round: every leaf predicts the exact quantile of its rows."""
    model = fit_quantile_trees(table, ["b"], "y", 0.5, TreeParams(rounds=1, depth=2, rate=1.0, min_rows=5, subsample=1.0))
    pdf = model.transform(table, "p").select("b", "y", "p").toPandas()
    for _, g in pdf.groupby("p"):
        assert np.isclose(g.p.iloc[0], np.quantile(g.y, 0.5))
    assert pdf.p.nunique() > 1


def test_leaf_penalties_shrink_leaf_quantiles(table):
    """One round at full rate: the value of each leaf is its quantile, moved to the start value by hand-computed penalties."""
    plain = TreeParams(rounds=1, depth=2, rate=1.0, min_rows=5, subsample=1.0)
    penal = TreeParams(rounds=1, depth=2, rate=1.0, min_rows=5, subsample=1.0, leaf_l1=30.0, leaf_l2=50.0)
    a, b = (fit_quantile_trees(table, ["b"], "y", 0.5, p) for p in (plain, penal))
    pdf = b.transform(a.transform(table, "p"), "s").select("p", "s").toPandas()
    for value, g in pdf.groupby("p"):
        v, n = value - a.start, len(g)
        want = np.sign(v) * max(abs(v) - 30.0 / n, 0) * n / (n + 50.0)
        assert np.allclose(g.s, a.start + want)
    assert penal.shrunk(-2.0, 30) == -(2 - 1) * 30 / 80 and penal.shrunk(0.5, 30) == 0.0


def test_drawn_features(table, tmp_path):
    params = TreeParams(rounds=6, depth=2, rate=0.5, min_rows=5, subsample=1.0, columns=0.5)
    model = fit_quantile_trees(table, ["a", "b"], "y", 0.5, params)
    assert all(len(d) == 1 for d in model.drawn) and {d[0] for d in model.drawn} == {0, 1}
    assert all(t.numFeatures == 1 for t in model.trees) and set(model.importances()) == {"a", "b"}
    model.save(str(tmp_path / "m"))
    again = QuantileTrees.load(str(tmp_path / "m"))
    assert again.transform(model.transform(table, "p1"), "p2").where("p1 <> p2").count() == 0
    loss = model.transform(table, "p").agg(F.avg(scores.pinball(F.col("y"), F.col("p"), 0.5)), F.avg(scores.pinball(F.col("y"), F.lit(model.start), 0.5))).first()
    assert loss[0] < loss[1]


def test_save_and_load(table, tmp_path):
    model = fit_quantile_trees(table, ["a", "b"], "y", 0.5, TreeParams(rounds=2, depth=2, rate=0.5, min_rows=20, subsample=1.0))
    model.save(str(tmp_path / "m"))
    again = QuantileTrees.load(str(tmp_path / "m"))
    both = again.transform(model.transform(table, "p1"), "p2")
    assert both.where("p1 <> p2").count() == 0
    # A feature the table lacks counts as 0.
    assert again.transform(table.drop("b"), "p").count() == table.count()


def test_weights_pull_towards_heavy_rows(table):
    weighted = table.withColumn("w", F.when(F.col("y") > 5, 20.0).otherwise(1.0))
    light = fit_quantile_trees(weighted, ["a"], "y", 0.5, TreeParams(rounds=1, depth=1, min_rows=20, subsample=1.0))
    heavy = fit_quantile_trees(weighted, ["a"], "y", 0.5, TreeParams(rounds=1, depth=1, min_rows=20, subsample=1.0), weight="w")
    assert heavy.start > light.start


def test_cascade_end_to_end(table):
    plan = cascade.FoldPlan("time", 12, 36)
    small = TreeParams(rounds=1, depth=2, rate=1.0, min_rows=5, bins=16, subsample=1.0)
    layer = cascade.train_global(table, ["a"], "y", plan, small)
    assert layer.fold_scores.count() == 1
    assert layer.oof.count() == 12 * 12 and layer.oof.where("y_pred < 0").count() == 0
    regional = cascade.train_regional(table, layer_with(layer, ["a", "b"]), "y", plan=plan, params=small, min_samples=50)
    decisions = {r["region"]: r for r in regional.decisions.collect()}
    assert decisions[2]["adopted"] and set(regional.models) == {k for k, r in decisions.items() if r["adopted"]}
    scored = cascade.score_cascade(table, layer_with(layer, ["a", "b"]), regional, None, "row_id")
    assert scored.count() == table.count()
    if 1 not in regional.models:
        assert scored.where("regiontype = 1 and gr_q50 <> g_q50").count() == 0
    assert scored.where("gre_q50 <> gr_q50").count() == 0
    err = scored.where("regiontype = 2").agg(F.avg(F.abs(F.col("g_q50") - F.col("y"))), F.avg(F.abs(F.col("gr_q50") - F.col("y")))).first()
    assert err[1] < err[0]
    skipped = cascade.train_regional(table, layer, "y", plan=plan, params=small, min_samples=10_000)
    assert not skipped.models and {r["reason"] for r in skipped.decisions.collect()} == {"insufficient_samples"}


def layer_with(layer, features):
    """The same global models with the feature list the regional layer may use."""
    return cascade.GlobalLayer(features, layer.models, layer.oof, layer.fold_scores, layer.importance, layer.params)


def test_extreme_layer_limits(table):
    rows = table.withColumns({"y_true": F.col("y"), "base": F.when(F.col("b") == 3, F.col("y") * 0.5).otherwise(F.col("y"))})
    layer = cascade.train_extreme(rows, ["a", "b"], "base", "row_id", plan=cascade.FoldPlan("time", 12, 36), min_samples=50, min_extremes=5, depth=2, rounds=3)
    assert {r["region"] for r in layer.decisions.collect()} == {1, 2}
    again = cascade.train_extreme(rows, ["a", "b"], "base", "row_id", only=[2], depth=2, rounds=3)
    assert set(again.detectors) == {2}
    fixed = again.transform(rows.withColumn("gr_q50", F.col("base")), "row_id")
    assert fixed.where("regiontype = 1 and gre_q50 <> gr_q50").count() == 0
    changed = fixed.where("gre_q50 <> gr_q50").count()
    assert 0 < changed <= int(288 * 0.05)


def test_flat_trees_match_the_tree_models(table):
    """Regression trees and boosted models of the library, walked in the node table; rows without a model get none."""
    rows = assemble(table, ["a", "b"], "_vec", MISSING).withColumn("hi", (F.col("y") > 5).cast("double"))
    booster = GBTRegressor(featuresCol="_vec", labelCol="y", maxDepth=3, maxIter=4, predictionCol="want").fit(rows)
    classes = GBTClassifier(featuresCol="_vec", labelCol="hi", maxDepth=2, maxIter=3, predictionCol="c").fit(rows)
    nodes = Forest()
    numbers = [nodes.add_model([(t.toDebugString, None, w, ()) for t, w in zip(m.trees, m.treeWeights)]) for m in (booster, classes)]
    walked = walk(rows, nodes, ["a", "b"], {"v": {2: numbers[0]}, "m": numbers[1]}, MISSING, "regiontype")
    scored = classes.transform(booster.transform(rows)).withColumn("w", walked).toPandas()
    own = scored.regiontype == 2
    assert own.any() and np.allclose([r["v"] for r in scored.w[own]], scored.want[own], rtol=0, atol=1e-12)
    assert all(r["v"] is None or np.isnan(r["v"]) for r in scored.w[~own])
    assert np.allclose([1 / (1 + np.exp(-2 * r["m"])) for r in scored.w], [p[1] for p in scored.probability])
    x = np.random.default_rng(1).random((100, 2))
    assert (walker(7)(nodes.arrays(), 0, x) == walker()(nodes.arrays(), 0, x)).all() and len(walker()(nodes.arrays(), 0, x[:0])) == 0


def test_scoring_plan_does_not_grow_with_trees_and_regions(table):
    small = fit_quantile_trees(table, ["a", "b"], "y", 0.5, TreeParams(rounds=1, depth=2, min_rows=5, subsample=1.0))
    many = QuantileTrees(small.features, 0.5, small.start, small.params, small.trees * 40, small.leaves * 40, small.drawn * 40)

    def lines(model, regions):
        layer = cascade.RegionalLayer({r: dict.fromkeys(cascade.QUANTILES, model) for r in range(1, regions + 1)}, None, None)
        base = table.withColumns({f"g_q{q}": F.lit(1.0) for q in (10, 50, 90)})
        return len(layer.transform(base)._jdf.queryExecution().optimizedPlan().toString())

    assert abs(lines(small, 1) - lines(many, 20)) < 50


def test_sweep_and_combinations():
    grid = {"b": [1, 2], "a": [10, 20]}
    assert cascade.combinations(grid)[0] == {"a": 10, "b": 1} and len(cascade.combinations(grid)) == 4
    best, results = cascade.sweep(grid, lambda c: None if c["a"] == 10 else c["b"])
    assert best == {"a": 20, "b": 1} and len(results) == 4


def test_prediction_filters(frame):
    rows = frame([("wh", 1, 1), ("wh", 2, 1), ("wh", 1, 2), ("oac", 9, 1)], "crop string, cell_id int, month int")
    area = frame([("wh", 1, 5.0), ("wh", 2, 0.0)], "crop string, cell_id int, area double")
    seen = frame([("wh", 1, 2015, 1), ("oac", 9, 2015, 1), ("wh", 1, 1999, 2)], "crop string, cell_id int, year int, month int")
    out = cascade.prediction_filters(rows, area, seen, bypass=["oac"])
    assert sorted(tuple(r) for r in out.select("crop", "cell_id", "month").collect()) == [("oac", 9, 1), ("wh", 1, 1)]


def test_rows_of_a_fold_are_not_shuffled(spark, table):
    """A lookup of dates goes to the rows, whatever Catalyst takes its size for; tasks of a fit do not follow the shuffle partitions."""
    stored = cut_lineage(table.repartition(3))
    folds = cascade._folds(stored, cascade.FoldPlan("time", 12, 12))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = [(part, part._jdf.queryExecution().executedPlan().toString()) for part in cascade._parts(stored, folds, 1, "time")]
        assert all("SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan for _, plan in parts)
        months = [sorted(r[0].isoformat()[:7] for r in part.select("time").distinct().collect()) for part, _ in parts]
        assert [part.count() for part, _ in parts] == [24 * 12, 12 * 12]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert (months[0][0], months[0][-1], months[1][0], months[1][-1]) == ("2000-01", "2001-12", "2002-01", "2002-12")


def test_tasks_of_a_fit_follow_its_rows(spark, table):
    """A table in many small partitions: it is stored by as many tasks, but the passes of the rounds have a task for each core at most."""
    sc, cores = spark.sparkContext, spark.sparkContext.defaultParallelism
    many = cut_lineage(table.repartition(6 * cores))
    packed = few_tasks(many)
    assert packed.rdd.getNumPartitions() == cores and sorted(map(tuple, packed.select("row_id").collect())) == [(i,) for i in range(576)]
    wide = []
    for rounds in (1, 3):
        sc.setJobGroup(f"rounds {rounds}", "")
        try:
            fit_quantile_trees(many, ["b"], "y", 0.5, TreeParams(rounds=rounds, depth=2, min_rows=5, subsample=1.0))
        finally:
            sc.setJobGroup("other", "")
        found = sc.statusTracker()
        stages = {s for j in found.getJobIdsForGroup(f"rounds {rounds}") for s in found.getJobInfo(j).stageIds}
        tasks = [found.getStageInfo(s).numTasks for s in stages if found.getStageInfo(s)]
        assert len(tasks) > 8 * rounds
        wide.append(sum(n > cores for n in tasks))
    assert max(wide) <= 4, wide
