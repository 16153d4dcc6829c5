"""Layers whose regions, folds and settings are fitted together: what every such fit must hold, against counts from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gridspark.catalog.base import query
from gridspark.catalog.models import FEATURES, ROWS, table
from gridspark.functions import scores
from gridspark.operators import cascade, layers
from gridspark.operators.quantile_trees import TreeParams
from gridspark.operators.together import fit_together

TREES = TreeParams(rounds=5, depth=3, rate=0.3, min_rows=10)
PLAN = cascade.FoldPlan("time", 24, 24)

# Distinct months, and the expanding folds over them: blocks of 24 months from the end, 24 months before the first.
FOLDS = """dates AS (SELECT {keys} year, month, row_number() OVER ({part} ORDER BY year, month) - 1 AS pos, count(*) OVER ({part}) AS n
           FROM (SELECT DISTINCT {keys} year, month FROM r)),
  tests AS (SELECT *, (n - 24) // 24 - 1 - (n - 1 - pos) // 24 AS fold FROM dates WHERE (n - 1 - pos) // 24 < (n - 24) // 24)"""


@query(
    "quantiles_together_hold",
    "region:i q:2 n:i below_constant:s near_quantile:s",
    f"""{ROWS} SELECT regiontype AS region, q, count(*) AS n, true AS below_constant, true AS near_quantile
    FROM r, (VALUES (0.1), (0.5), (0.9)) v(q) GROUP BY regiontype, q""",
)
def quantiles_together_hold(t):
    """Nine models in one fit: each loses less than its constant, and the share of values below is near its quantile."""
    rows = table(t).withColumn("member", F.array("regiontype"))
    found = fit_together(rows, FEATURES, "y", "member", [TREES] * 3, "regiontype", [0, 1, 2], quantiles=cascade.QUANTILES)
    out = []
    for region, models in enumerate(found):
        for q, model in zip(cascade.QUANTILES, models):
            p, y = F.col("p"), F.col("y")
            scored = model.transform(rows.where(F.col("regiontype") == region), "p").agg(
                F.lit(region).alias("region"),
                F.lit(q).alias("q"),
                F.count(F.lit(1)).alias("n"),
                (F.avg(scores.pinball(y, p, q)) < F.avg(scores.pinball(y, F.lit(model.start), q))).alias("below_constant"),
                (F.abs(F.avg((y <= p).cast("double")) - q) < 0.1).alias("near_quantile"),
            )
            out.append(scored)
    return reduce(lambda a, b: a.unionByName(b), out)


@query(
    "global_together_holds",
    "fold:i n:i ordered:s not_negative:s tuned:s",
    f"""{ROWS}, {FOLDS.format(keys="", part="")}
    SELECT fold, count(*) AS n, true AS ordered, true AS not_negative, true AS tuned FROM r JOIN tests USING (year, month) GROUP BY fold""",
)
def global_together_holds(t):
    """Three quantiles and a grid of four settings over all folds: every test row once, quantiles mostly in order, nothing below 0, settings from the grid."""
    grid = {"rate": [0.1, 0.3], "depth": [2, 3]}
    layer = layers.train_global_together(table(t), FEATURES, "y", PLAN, TREES, grid, "cell_id", inner_folds=2)
    inside = 0.1 <= layer.params.rate <= 0.3 and 2 <= layer.params.depth <= 3
    low, mid, high = (F.col(cascade.PREDICTIONS[q]) for q in cascade.QUANTILES)
    ordered = F.avg(((low <= mid) & (mid <= high)).cast("double")) > 0.9
    return layer.oof.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), ordered.alias("ordered"), (F.min(low) >= 0).alias("not_negative"), F.lit(inside).alias("tuned"))


@query(
    "regional_together_holds",
    "region:i n_samples:i tested:i adopted_by_gain:s kept:s",
    f"""{ROWS}, {FOLDS.format(keys="regiontype,", part="PARTITION BY regiontype")},
    s AS (SELECT regiontype, count(*) AS tested FROM r JOIN tests USING (regiontype, year, month) GROUP BY regiontype)
    SELECT regiontype AS region, count(*) AS n_samples, any_value(tested) AS tested, true AS adopted_by_gain, true AS kept FROM r JOIN s USING (regiontype) GROUP BY regiontype""",
)
def regional_together_holds(t):
    """Residual models of all regions and folds: every test row once, no region adopted without a gain, the others keep the global value."""
    rows = table(t)
    models = fit_together(rows.withColumn("member", F.array(F.lit(0))), ["month"], "y", "member", [TREES], quantiles=cascade.QUANTILES)[0]
    # The global layer knows the month only.
    layer = cascade.GlobalLayer(["month"], dict(zip(cascade.QUANTILES, models)), None, None, [], TREES)
    wide = cascade.GlobalLayer(FEATURES, layer.models, None, None, [], TREES)
    regional = layers.train_regional_together(rows, wide, "y", plan=PLAN, params=TREES, min_samples=50)
    region = F.col("regiontype")
    same = (region.isin(*regional.models) if regional.models else F.lit(False)) | (F.col("gr_q50") == F.col("g_q50"))
    scored = regional.transform(layer.transform(rows)).groupBy(region.alias("region")).agg(F.min(same).alias("kept"))
    tested = regional.oof.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("tested"))
    gain = ~F.col("adopted").cast("boolean") | (F.col("improvement_pct") > 0)
    return regional.decisions.select("region", "n_samples", gain.alias("adopted_by_gain")).join(tested, "region").join(scored, "region")


@query(
    "extreme_together_holds",
    "region:i n:i decided:s few_changed:s bounded:s",
    f"{ROWS} SELECT regiontype AS region, count(*) AS n, true AS decided, true AS few_changed, true AS bounded FROM r GROUP BY regiontype",
)
def extreme_together_holds(t):
    """Detectors and correctors of all regions and folds: a decision for each region, at most 5 % of its rows changed, its total moved by at most 5 %."""
    rows = table(t)
    # Rows with many lines are predicted far too low.
    base = F.when(F.col("n") > 2, F.col("y") * 0.6).otherwise(F.col("y") * 1.02)
    known = rows.withColumns({"y_true": F.col("y"), "base": base, "gr_q50": base})
    layer = layers.train_extreme_together(known, FEATURES, "base", "row_id", plan=PLAN, params=TREES, min_samples=50, min_extremes=5)
    fixed = layer.transform(known, "row_id")
    changed = F.sum((F.abs(F.col("gre_q50") - F.col("gr_q50")) > 1e-12).cast("int"))
    drift = F.abs(F.sum("gre_q50") / F.sum("gr_q50") - 1)
    decided = layer.decisions.select("region", F.col("decision").isNotNull().alias("decided"))
    found = fixed.groupBy(F.col("regiontype").alias("region")).agg(
        F.count(F.lit(1)).alias("n"), (changed <= F.floor(F.count(F.lit(1)) * 0.05)).alias("few_changed"), (drift <= 0.05 + 1e-9).alias("bounded")
    )
    return found.join(decided, "region")
