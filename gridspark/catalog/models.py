"""Model fitting and scoring. Iterative fits have no SQL; their rows are checked by tests on small data."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridspark.catalog.base import LINES, query
from gridspark.functions import scores
from gridspark.operators import cascade, correction, features, validation
from gridspark.operators.quantile_trees import TreeParams, fit_quantile_trees
from gridspark.operators.scale import few_tasks
from gridspark.session import cut_lineage

FEATURES = ["qty", "discount", "tax", "month", "n"]
SMALL = TreeParams(rounds=2, depth=3, rate=0.5, min_rows=10, subsample=1.0, bins=32)
PLAN = cascade.FoldPlan("time", 36, 24)


def table(t):
    """One row per cell and month with a skewed target and three regions."""
    rows = t.lines.groupBy("cell_id", "year", "month").agg(
        F.avg("qty").alias("qty"),
        F.avg("discount").alias("discount"),
        F.avg("tax").alias("tax"),
        F.count(F.lit(1)).cast("double").alias("n"),
        (F.sum("price") / 1e4).alias("y"),
    )
    dated = rows.withColumns(
        {
            "time": F.make_date("year", "month", F.lit(1)),
            "regiontype": (F.col("cell_id") % 3).cast("int"),
            "row_id": F.col("cell_id") * 10000 + F.col("year") * 12 + F.col("month"),
        }
    )
    # Fits read the table many times. Its partitions follow the shuffled lines, its rows do not.
    return few_tasks(cut_lineage(dated.withColumn("month", F.col("month").cast("double"))))


@query("quantile_trees_fit", "q:2 n:i coverage:4 pinball:6 constant_pinball:6")
def quantile_trees_fit(t):
    rows = table(t)
    out = None
    for q in (0.1, 0.9):
        model = fit_quantile_trees(rows, FEATURES, "y", q, SMALL)
        scored = model.transform(rows, "p").agg(
            F.lit(q).alias("q"),
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col("y") <= F.col("p")).cast("double")).alias("coverage"),
            F.avg(scores.pinball(F.col("y"), F.col("p"), q)).alias("pinball"),
            F.avg(scores.pinball(F.col("y"), F.lit(model.start), q)).alias("constant_pinball"),
        )
        out = scored if out is None else out.unionByName(scored)
    return out


@query("weighted_trees_fit", "n:i mean_y:4 mean_p:4")
def weighted_trees_fit(t):
    rows = cut_lineage(validation.sample_weights(table(t), "y"))
    model = fit_quantile_trees(rows, FEATURES, "y", 0.5, SMALL, weight="weight")
    return model.transform(rows, "p").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"), F.avg("p").alias("mean_p"))


@query("global_layer", "fold:i n_samples:i rmse:6 r2:6")
def global_layer(t):
    layer = cascade.train_global(table(t), FEATURES, "y", PLAN, SMALL, quantiles=(0.5,))
    return layer.fold_scores


@query("param_sweep", "depth:i rate:2 rmse:6")
def param_sweep(t):
    rows = table(t)
    folds = cut_lineage(validation.temporal_folds(rows, "time", (), 36, 24))
    grid = {"depth": [2, 3], "rate": [0.5]}
    _, results = cascade.sweep(
        grid, lambda c: cascade.cv_rmse(rows, folds, "time", FEATURES, "y", TreeParams(rounds=1, min_rows=10, bins=32, subsample=1.0, **c))
    )
    return t.spark.createDataFrame([(c["depth"], c["rate"], s) for c, s in results], "depth int, rate double, rmse double")


@query("regional_residual", "region:i n_samples:i improvement_pct:4 reason:s adopted:s")
def regional_residual(t):
    rows = table(t)
    one = cascade.GlobalLayer(
        FEATURES, {q: fit_quantile_trees(rows, ["month"], "y", q, TreeParams(rounds=1, depth=2, rate=0.5, min_rows=20, subsample=1.0)) for q in cascade.QUANTILES}, None, None, [], SMALL
    )
    layer = cascade.train_regional(rows, one, "y", plan=cascade.FoldPlan("time", 48, 24), params=TreeParams(rounds=1, depth=2, rate=0.5, min_rows=20, subsample=1.0), min_samples=100)
    return layer.decisions


@query("detector_corrector", "region:i adopted:s decision:s")
def detector_corrector(t):
    # Rows with many lines are predicted far too low.
    base = F.when(F.col("n") > 2, F.col("y") * 0.6).otherwise(F.col("y") * 1.02)
    rows = table(t).withColumns({"y_true": F.col("y"), "base": base})
    layer = cascade.train_extreme(
        rows, FEATURES, "base", "row_id", plan=cascade.FoldPlan("time", 48, 24), min_samples=100, min_extremes=20, depth=2, rounds=2
    )
    return layer.decisions


def fitted_cascade(t):
    """Scored rows and the regional and extreme layers."""
    rows = table(t)
    small = TreeParams(rounds=1, depth=2, rate=0.5, min_rows=20, subsample=1.0)
    models = {q: fit_quantile_trees(rows, FEATURES, "y", q, small) for q in cascade.QUANTILES}
    layer = cascade.GlobalLayer(FEATURES, models, None, None, [], small)
    # The retrain path: regions adopted earlier, fitted on the full record.
    regional = cascade.train_regional(rows, layer, "y", params=small, only=[1])
    base = cut_lineage(regional.transform(layer.transform(rows)).withColumn("y_true", F.col("y")))
    extreme = cascade.train_extreme(base, FEATURES, "gr_q50", "row_id", depth=2, rounds=2, only=[0, 2])
    return cascade.score_cascade(rows, layer, regional, extreme, "row_id"), regional, extreme


@query("cascade_score", "regiontype:i n:i g_q50:4 gr_q50:4 gre_q50:4")
def cascade_score(t):
    scored, _, _ = fitted_cascade(t)
    return scored.groupBy("regiontype").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("g_q50", "gr_q50", "gre_q50")])


# What every fit of these kinds must hold, beside the fitted numbers above; the counts come from the tables.
ROWS = f"WITH {LINES}, r AS (SELECT cell_id, year, month, cell_id % 3 AS regiontype FROM lines GROUP BY ALL)"


@query(
    "quantile_trees_hold",
    "q:2 n:i below_constant:s near_quantile:s",
    f"{ROWS} SELECT q, count(*) AS n, true AS below_constant, true AS near_quantile FROM r, (VALUES (0.1), (0.9)) v(q) GROUP BY q",
)
def quantile_trees_hold(t):
    """The loss falls below that of the constant, and the share of values below the prediction is near q."""
    found = quantile_trees_fit(t)
    return found.select("q", "n", (F.col("pinball") < F.col("constant_pinball")).alias("below_constant"), (F.abs(F.col("coverage") - F.col("q")) < 0.1).alias("near_quantile"))


@query(
    "penalised_trees_hold",
    "n:i nearer:s below_constant:s",
    f"{ROWS} SELECT count(*) AS n, true AS nearer, true AS below_constant FROM r",
)
def penalised_trees_hold(t):
    """Leaf penalties leave every prediction between the start value and that of the same tree without them."""
    rows = table(t)
    plain = TreeParams(rounds=1, depth=3, rate=1.0, min_rows=10, subsample=1.0, bins=32)
    a = fit_quantile_trees(rows, FEATURES, "y", 0.5, plain)
    b = fit_quantile_trees(rows, FEATURES, "y", 0.5, replace(plain, leaf_l1=0.5, leaf_l2=20.0))
    both = b.transform(a.transform(rows, "p"), "s")
    start, p, s = F.lit(a.start), F.col("p"), F.col("s")
    inside = (F.abs(s - start) <= F.abs(p - start)) & ((s - start) * (p - start) >= 0)
    loss = [F.avg(scores.pinball(F.col("y"), c, 0.5)) for c in (s, start)]
    return both.agg(F.count(F.lit(1)).alias("n"), F.min(inside).alias("nearer"), (loss[0] < loss[1]).alias("below_constant"))


@query(
    "weighted_trees_hold",
    "n:i inside:s",
    f"{ROWS} SELECT count(*) AS n, true AS inside FROM r",
)
def weighted_trees_hold(t):
    """Weighted leaf values keep every prediction inside the range of the target."""
    rows = cut_lineage(validation.sample_weights(table(t), "y"))
    scored = fit_quantile_trees(rows, FEATURES, "y", 0.5, SMALL, weight="weight").transform(rows, "p")
    return scored.agg(F.count(F.lit(1)).alias("n"), ((F.min("p") >= F.min("y")) & (F.max("p") <= F.max("y"))).alias("inside"))


@query("param_sweep_holds", "depth:i rate:2 scored:s", "SELECT * FROM (VALUES (2, 0.5, true), (3, 0.5, true)) v(depth, rate, scored) WHERE EXISTS (SELECT 1 FROM lineitem)")
def param_sweep_holds(t):
    """Every cell of the grid has an error of its own."""
    return param_sweep(t).select("depth", "rate", ((F.col("rmse") > 0) & ~F.isnan("rmse")).alias("scored"))


@query("regional_layer_holds", "region:i adopted_by_gain:s", f"{ROWS} SELECT regiontype AS region, true AS adopted_by_gain FROM r GROUP BY regiontype")
def regional_layer_holds(t):
    """Every region has a decision, and none is adopted without a gain."""
    found = regional_residual(t)
    return found.select("region", (~F.col("adopted").cast("boolean") | (F.col("improvement_pct") > 0)).alias("adopted_by_gain"))


@query(
    "cascade_holds",
    "regiontype:i n:i not_negative:s kept:s",
    f"{ROWS} SELECT regiontype, count(*) AS n, true AS not_negative, true AS kept FROM r GROUP BY regiontype",
)
def cascade_holds(t):
    """No layer predicts below 0, and regions that a layer did not adopt keep the value of the layer before."""
    scored, regional, extreme = fitted_cascade(t)
    region = F.col("regiontype")
    same = (region.isin(*regional.models) if regional.models else F.lit(False)) | (F.col("gr_q50") == F.col("g_q50"))
    kept = same & ((region.isin(*extreme.detectors) if extreme.detectors else F.lit(False)) | (F.col("gre_q50") == F.col("gr_q50")))
    low = F.least(*[F.col(c) for c in ("g_q10", "g_q50", "g_q90", "gr_q10", "gr_q50", "gr_q90", "gre_q50")])
    return scored.groupBy("regiontype").agg(F.count(F.lit(1)).alias("n"), F.min(low >= 0).alias("not_negative"), F.min(kept).alias("kept"))


@query(
    "min_max_scaling",
    "cell_id:i year:i month:i a:6 b:6",
    f"""WITH {LINES}, r AS (SELECT cell_id, year, month, sum(qty) AS a, sum(price) AS b FROM lines GROUP BY ALL),
    m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM r WHERE year < 1999)
    SELECT cell_id, year, month, (a - a0) / (a1 - a0) AS a, (b - b0) / (b1 - b0) AS b FROM r, m WHERE year >= 1999""",
)
def min_max_scaling(t):
    rows = t.lines.groupBy("cell_id", "year", "month").agg(F.sum("qty").alias("a"), F.sum("price").alias("b"))
    packed = features.assemble(rows, ["a", "b"])
    _, test = features.scale_min_max(packed.where(F.col("year") < 1999), [packed.where(F.col("year") >= 1999)])
    values = vector_to_array("scaled")
    return test.select("cell_id", "year", "month", values[0].alias("a"), values[1].alias("b"))
