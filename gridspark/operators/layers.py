"""The layers of the model with all regions, folds and settings fitted together.

The same decisions as in ``cascade``, where regions and folds are fitted one after the other. Here each step is one fit of
``together`` and one pass of scoring, so that the number of jobs does not depend on the number of regions, folds or settings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import scores
from gridspark.operators import correction, validation
from gridspark.operators.cascade import (
    PREDICTIONS,
    QUANTILES,
    REGIONAL,
    ExtremeLayer,
    FoldPlan,
    GlobalLayer,
    RegionalLayer,
    average_settings,
    combinations,
    fold_changes,
    needed_improvement,
)
from gridspark.operators.features import fill_missing_features
from gridspark.operators.forest import Forest, walk
from gridspark.operators.quantile_trees import MISSING, TreeParams
from gridspark.operators.scale import literal_rows, lookup_join
from gridspark.operators.together import fit_together
from gridspark.session import cut_lineage

# Settings that may differ between the models of one fit.
TUNABLE = {"rounds", "depth", "rate", "min_rows", "subsample", "leaf_l1", "leaf_l2"}


def _settings(grid: dict[str, Sequence] | None, params: TreeParams) -> list[TreeParams]:
    if grid and not set(grid) <= TUNABLE:
        raise ValueError(f"one fit cannot differ in {sorted(set(grid) - TUNABLE)}")
    return [replace(params, **combo) for combo in combinations(grid or {})] or [params]


def _fold_lookup(df: DataFrame, region: str, plan: FoldPlan) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Folds of every region as ``region, date, fold, role, _pair`` and the list of their (region, fold), one row for each of them."""
    folds = cut_lineage(validation.temporal_folds(df, plan.date, [region], plan.test_months, plan.min_train))
    pairs = sorted((int(r[0]), int(r[1])) for r in folds.select(region, "fold").distinct().collect())
    table = [(r, f, i) for i, (r, f) in enumerate(pairs)] or [(0, 0, 0)]
    names = literal_rows(df.sparkSession, table, f"{region} int, fold int, _pair int")
    return cut_lineage(folds.withColumn(region, F.col(region).cast("int")).join(names, [region, "fold"])), pairs


def _members(folds: DataFrame, region: str, date: str, n: int) -> DataFrame:
    """The groups a date of a region trains: ``n`` settings for each of its folds."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.col("_pair") * n + c)
    listed = folds.where(F.col("role") == "train").groupBy(region, date).agg(F.flatten(F.collect_list(ids)).alias("_m"))
    return cut_lineage(listed)


def _scored(df: DataFrame, features: Sequence[str], models, names: Sequence[str], key: str) -> DataFrame:
    """Predictions of the models whose number stands in ``key``; ``models`` by number and target."""
    forest = Forest()
    numbers = {n: {g: row[i].add_to(forest) for g, row in enumerate(models)} for i, n in enumerate(names)}
    staged = fill_missing_features(df, features)
    found = staged.withColumn("_walked", walk(staged, forest, features, numbers, MISSING, key))
    return found.select(*df.columns, *[F.col("_walked")[n].alias(n) for n in names])


def _placed(df: DataFrame, folds: DataFrame, region: str, date: str, n: int) -> DataFrame:
    """Test rows with their fold, once for each setting: ``_set`` and the number of its model, ``_g``."""
    tests = cut_lineage(folds.where(F.col("role") == "test").select(region, date, "fold", "_pair"))
    rows = lookup_join(df, tests, [region, date], "inner", stored=True)
    return rows.withColumn("_set", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_g", F.col("_pair") * n + F.col("_set"))


def _fit_folds(df, folds, pairs, region, date, features, y, settings, **how):
    """A model for each (region, fold) and setting; ``settings``: a list for each pair, all of one length."""
    n = len(settings[0]) if settings else 1
    rows = lookup_join(df, _members(folds, region, date, n), [region, date], "inner", stored=True)
    groups = [s for row in settings for s in row]
    return fit_together(rows, features, y, "_m", groups, region, [pairs[i // n][0] for i in range(len(groups))], **how)


def _fit_whole(df, keys, region, features, y, settings, **how):
    """A model of all rows of each region of a list."""
    names = literal_rows(df.sparkSession, [(k, i) for i, k in enumerate(keys)], f"{region} int, _i int")
    rows = lookup_join(df, names, [region], "inner").withColumn("_m", F.array("_i"))
    return fit_together(rows, features, y, "_m", settings, region, keys, **how)


def _rmse(value: Column, truth: Column) -> Column:
    return F.sqrt(F.avg((value - truth) ** 2))


def train_global_together(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    plan: FoldPlan = FoldPlan(),
    params: TreeParams = TreeParams(),
    grid: dict[str, Sequence] | None = None,
    group: str | None = None,
    inner_folds: int = 3,
    weight: str | None = None,
    keep: Sequence[str] = ("cell_id", "regiontype"),
    quantiles: Sequence[float] = QUANTILES,
) -> GlobalLayer:
    """``cascade.train_global`` in at most three fits: the grid over inner and outer folds, the outer folds, all rows.

    ``df`` is read by every fit, so it should be a stored table. Rows without a target take no part.
    """
    features = list(features)
    one = df.withColumn("_all", F.lit(0)).where(F.col(y).isNotNull())
    folds, pairs = _fold_lookup(one, "_all", plan)
    if not pairs:
        raise ValueError("no temporal folds: the record is too short")
    settings = _settings(grid, params)
    chosen = [params] * len(pairs)
    if grid:
        chosen = _tuned(one, folds, pairs, plan, features, y, settings, group, inner_folds, weight)
    how = {"quantiles": quantiles, "weight": weight}
    models = _fit_folds(one, folds, pairs, "_all", plan.date, features, y, [[c] for c in chosen], **how)
    names = [PREDICTIONS[q] for q in quantiles]
    tests = _scored(_placed(one, folds, "_all", plan.date, 1), features, models, names, "_g")
    values = {n: F.greatest(F.col(n), F.lit(0.0)) for n in names}
    kept = [c for c in keep if c in df.columns]
    oof = tests.withColumns(values).select(
        "fold", plan.date, *kept, F.col(y).alias("y_true"), *names, (F.col(y) - F.col("y_pred")).alias("residual")
    )
    oof = cut_lineage(oof)
    fold_scores = oof.groupBy("fold").agg(*[e.alias(n) for n, e in scores.core_scores(F.col("y_true"), F.col("y_pred")).items()])
    middle = list(quantiles).index(0.5)
    importance = [(fold, f, v) for (_, fold), row in zip(pairs, models) for f, v in row[middle].importances().items()]
    final = average_settings(params, chosen, fold_scores) if grid else params
    whole = _fit_whole(one, [0], "_all", features, y, [final], **how)[0]
    return GlobalLayer(features, dict(zip(quantiles, whole)), oof, fold_scores, importance, final)


def _tuned(df, folds, pairs, plan, features, y, settings, group, inner_folds, weight):
    """The best setting of every outer fold by the error on inner spatial folds; all of them are fitted at once."""
    n, k = len(settings), inner_folds
    inner = (validation.digest_number(F.col(group).cast("string")) % k).cast("int")
    lists = cut_lineage(folds.where(F.col("role") == "train").groupBy("_all", plan.date).agg(F.sort_array(F.collect_list("_pair")).alias("_pairs")))
    rows = lookup_join(df.withColumn("_inner", inner), lists, ["_all", plan.date], "inner", stored=True)
    # The number of a group: (outer fold, setting, inner fold that is left out).
    sets = F.sequence(F.lit(0), F.lit(n * k - 1))
    others = F.filter(sets, lambda s: s % k != F.col("_inner"))
    member = F.flatten(F.transform("_pairs", lambda p: F.transform(others, lambda s: p * (n * k) + s)))
    groups = [s for _ in pairs for s in settings for _ in range(k)]
    models = fit_together(rows.withColumn("_m", member), features, y, "_m", groups, "_all", [0] * len(groups), weight=weight)
    tests = rows.withColumn("_pair", F.explode("_pairs")).withColumn("_set", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tests = tests.withColumn("_g", F.col("_pair") * (n * k) + F.col("_set") * k + F.col("_inner"))
    found = _scored(tests, features, models, ["_p"], "_g").groupBy("_pair", "_set", "_inner").agg(_rmse(F.greatest(F.col("_p"), F.lit(0.0)), F.col(y)).alias("e"))
    # One row for each fold and setting.
    errors = {(r["_pair"], r["_set"]): r["e"] for r in found.groupBy("_pair", "_set").agg(F.avg("e").alias("e")).collect()}
    return [settings[min(range(n), key=lambda s, i=i: errors.get((i, s), float("inf")))] for i in range(len(pairs))]


def train_regional_together(
    df: DataFrame,
    layer: GlobalLayer,
    y: str,
    region: str = "regiontype",
    plan: FoldPlan = FoldPlan(),
    params: TreeParams = REGIONAL,
    grid: dict[str, Sequence] | None = None,
    min_samples: int = 5000,
    threshold: float = 2.0,
    only: Sequence[int] | None = None,
    weight: str | None = None,
    keep: Sequence[str] = ("cell_id",),
) -> RegionalLayer:
    """``cascade.train_regional`` in two fits: folds of all regions and settings, then all rows of the adopted regions.

    Regions are whole numbers; rows without a region or a target take no part. With ``grid`` a region takes the setting with the least mean error over its folds.
    """
    features = list(layer.features)
    usable = df.withColumn(region, F.col(region).cast("int")).where(F.col(region).isNotNull() & F.col(y).isNotNull())
    base = cut_lineage(layer.transform(usable).withColumn("_res", F.col(y) - F.col("g_q50")))
    counts = base.groupBy(region).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == 0).cast("double")).alias("zeros"))
    facts = {r[region]: r for r in counts.collect()}
    how = {"quantiles": QUANTILES, "weight": weight}
    oof, found, best = None, {}, {}
    if only is None:
        enough = [k for k in sorted(facts) if facts[k]["n"] >= min_samples and facts[k]["zeros"] <= 0.9]
        mine = base.where(F.col(region).isin(enough))
        folds, pairs = _fold_lookup(mine, region, plan)
        settings = _settings(grid, params)
        models = _fit_folds(mine, folds, pairs, region, plan.date, features, "_res", [settings] * len(pairs), **how) if pairs else []
        oof, found, best = _regional_folds(mine, folds, models, settings, region, plan.date, features, y, keep, df.columns)
        adopted = [k for k in sorted(found) if _gain(found[k]) >= needed_improvement(found[k]["r2"], threshold)]
    else:
        adopted = [k for k in sorted(facts) if k in only]
    whole = _fit_whole(base, adopted, region, features, "_res", [best.get(k, params) for k in adopted], **how) if adopted else []
    if only is None:
        rows = [(k, r["n"], r["zeros"], *[found[k][c] if k in found else None for c in ("r2", "base", "new")]) for k, r in sorted(facts.items())]
    else:
        rows = [(k, facts[k]["n"], facts[k]["zeros"], None, 1.0, 0.0) for k in adopted]
    schema = "region int, n_samples bigint, zero_share double, base_r2 double, base_nrmse double, new_nrmse double"
    table = df.sparkSession.createDataFrame(rows, schema)
    decisions = correction.regional_decisions(table, min_samples if only is None else 0, 0.9, threshold)
    return RegionalLayer({k: dict(zip(QUANTILES, row)) for k, row in zip(adopted, whole)}, decisions, oof)


def _gain(record) -> float:
    if record["base"] is None or record["new"] is None or record["base"] <= 0:
        return 0.0
    return (record["base"] - record["new"]) / record["base"] * 100


def _regional_folds(mine, folds, models, settings, region, date, features, y, keep, columns):
    """Out-of-fold rows of the chosen settings, mean scores of every region, and its setting."""
    if not models:
        return None, {}, {}
    names = [f"_r{round(q * 100)}" for q in QUANTILES]
    tests = _scored(_placed(mine, folds, region, date, len(settings)), features, models, names, "_g")
    values = [F.greatest(F.col(f"g_q{round(q * 100)}") + F.col(n), F.lit(0.0)).alias(PREDICTIONS[q]) for q, n in zip(QUANTILES, names)]
    kept = [c for c in keep if c in columns]
    truth = [F.col(y).alias("y_true"), F.col("g_q50").alias("y_pred_global")]
    parts = cut_lineage(tests.select("fold", region, date, *kept, *truth, *values, "_set"))
    g, c = (scores.core_scores(F.col("y_true"), F.col(p)) for p in ("y_pred_global", "y_pred"))
    per_fold = parts.groupBy(region, "_set", "fold").agg(
        g["r2"].alias("r2"), g["nrmse_range"].alias("base"), c["nrmse_range"].alias("new"), c["rmse"].alias("rmse")
    )
    # One row for each region and setting.
    means = per_fold.groupBy(region, "_set").agg(*[F.avg(v).alias(v) for v in ("r2", "base", "new", "rmse")]).collect()
    first = {}
    for r in sorted(means, key=lambda r: (r[region], r["rmse"] if r["rmse"] is not None else float("inf"), r["_set"])):
        first.setdefault(r[region], r)
    chosen = literal_rows(mine.sparkSession, [(k, r["_set"]) for k, r in first.items()], f"{region} int, _set int")
    oof = cut_lineage(parts.join(chosen, [region, "_set"], "left_semi").drop("_set")) if len(settings) > 1 else parts.drop("_set")
    return oof, first, {k: settings[r["_set"]] for k, r in first.items()}


def train_extreme_together(
    df: DataFrame,
    features: Sequence[str],
    base: str,
    row_id: str,
    region: str = "regiontype",
    y: str = "y_true",
    plan: FoldPlan = FoldPlan(),
    params: TreeParams = TreeParams(rounds=50, depth=3, min_rows=1, subsample=1.0),
    min_samples: int = 5000,
    min_extremes: int = 100,
    min_base_r2: float = 0.0,
    only: Sequence[int] | None = None,
    **limits,
) -> ExtremeLayer:
    """``cascade.train_extreme`` with the detectors of all regions and folds in one fit and their correctors in another.

    Regions are whole numbers; rows without a region, truth or base prediction take no part. Folds whose training rows lack extremes, or hold nothing else, have no model.
    """
    features = list(features)
    floored = df.withColumns({base: F.greatest(F.col(base), F.lit(0.0)), region: F.col(region).cast("int")})
    floored = floored.where(F.col(region).isNotNull() & F.col(y).isNotNull() & F.col(base).isNotNull())
    labelled = correction.label_extremes(floored, [region], y, base)
    rows = cut_lineage(labelled.withColumns({"_res": F.col(y) - F.col(base), "_under": F.coalesce(F.col("is_under"), F.lit(False)).cast("int")}))
    summary = rows.groupBy(region).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_under").alias("under"), scores.core_scores(F.col(y), F.col(base))["r2"].alias("r2")
    )
    facts = {r[region]: r for r in summary.collect()}
    detect = {"loss": "logistic", "balance": True}
    verdicts, reasons = {}, {}
    if only is None:
        for k, f in facts.items():
            if f["n"] < min_samples:
                reasons[k] = "insufficient_samples"
            elif f["r2"] is None or f["r2"] < min_base_r2:
                reasons[k] = "low_base_r2"
            elif f["under"] < min_extremes:
                reasons[k] = "insufficient_extremes"
        mine = rows.where(F.col(region).isin([k for k in facts if k not in reasons]))
        folds, pairs = _fold_lookup(mine, region, plan)
        with_folds = {r for r, _ in pairs}
        reasons.update({k: "no_cv_splits" for k in facts if k not in reasons and k not in with_folds})
        if pairs:
            table = _extreme_changes(mine, folds, pairs, region, plan.date, features, row_id, y, base, params, detect, limits)
            verdicts = {r[region]: r for r in correction.adoption_scores(table, [region]).collect()}
        reasons.update({k: "no_cv_metrics" for k in facts if k not in reasons and k not in verdicts})
        adopted = sorted(k for k, v in verdicts.items() if v["adopted"])
        records = [(k, False, reasons[k], None) if k in reasons else (k, verdicts[k]["adopted"], verdicts[k]["decision"], verdicts[k]["score"]) for k in sorted(facts)]
    else:
        adopted = sorted(k for k, f in facts.items() if k in only and 0 < f["under"] < f["n"])
        records = [(k, True, "retrained", None) for k in adopted]
    detectors, correctors = {}, {}
    if adopted:
        same = [params] * len(adopted)
        found = _fit_whole(rows, adopted, region, features, "_under", same, **detect)
        repair = _fit_whole(rows.where("is_under"), adopted, region, features, "_res", same, loss="squared")
        # The layer reads half of the log odds.
        detectors = {k: m[0].times(0.5) for k, m in zip(adopted, found)}
        correctors = {k: m[0] for k, m in zip(adopted, repair)}
    decisions = df.sparkSession.createDataFrame(records, "region int, adopted boolean, decision string, score double")
    return ExtremeLayer(detectors, correctors, features, decisions, limits)


def _extreme_changes(mine, folds, pairs, region, date, features, row_id, y, base, params, detect, limits):
    """What the correction changes in every fold of every region that has models."""
    same = [[params]] * len(pairs)
    detectors = _fit_folds(mine, folds, pairs, region, date, features, "_under", same, **detect)
    correctors = _fit_folds(mine.where("is_under"), folds, pairs, region, date, features, "_res", same, loss="squared")
    train = lookup_join(mine, _members(folds, region, date, 1), [region, date], "inner", stored=True)
    sizes = train.select(F.explode("_m").alias("_g"), "_under").groupBy("_g").agg(F.sum("_under").alias("p"), F.count(F.lit(1)).alias("n"))
    fitted = cut_lineage(sizes.where((F.col("p") > 0) & (F.col("p") < F.col("n"))).select("_g"))
    tests = lookup_join(_placed(mine, folds, region, date, 1), fitted, ["_g"], "inner", stored=True)
    models = [[d[0], c[0]] for d, c in zip(detectors, correctors)]
    scored = _scored(tests, features, models, ["_margin", "_corr"], "_g").withColumn("_prob", 1 / (1 + F.exp(-F.col("_margin"))))
    fixed = correction.bounded_correction(scored, [region, "fold"], row_id, base, "_prob", "_corr", "_new", **limits)
    return cut_lineage(fixed.groupBy(region, "fold").agg(*fold_changes(y, base, "_new")))
