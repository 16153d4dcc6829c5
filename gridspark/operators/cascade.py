"""The layered model: a global layer, regional residual layers and an extreme corrector.

Driver loops run over folds and regions (a few dozen at most). Every fit, prediction and score is a
Spark job over the rows concerned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import scores, taxonomy
from gridspark.operators import correction, evaluation, validation
from gridspark.operators.features import assemble, fill_missing_features
from gridspark.operators.forest import Forest, walk
from gridspark.operators.quantile_trees import MISSING, QuantileTrees, TreeParams, fit_quantile_trees, fit_quantiles, predict_all
from gridspark.operators.scale import few_tasks, literal_rows, small_side
from gridspark.operators.together import GrownTrees
from gridspark.session import cut_lineage

QUANTILES = (0.1, 0.5, 0.9)
PREDICTIONS = {0.1: "y_pred_q10", 0.5: "y_pred", 0.9: "y_pred_q90"}


def crop_routing(spark) -> DataFrame:
    """Which variant and which regions a crop uses: ``crop, variant, region_scheme``."""
    rows = [
        (c, "unweighted" if c in taxonomy.UNWEIGHTED_CROPS else "weighted", 30 if c in taxonomy.CLIMATE_CLASS_CROPS else 9)
        for c in taxonomy.CROPS
    ]
    return literal_rows(spark, rows, "crop string, variant string, region_scheme int")


@dataclass(frozen=True)
class FoldPlan:
    date: str = "time"
    test_months: int = 24
    min_train: int = 12


@dataclass
class GlobalLayer:
    features: list[str]
    models: dict[float, QuantileTrees]
    oof: DataFrame
    fold_scores: DataFrame
    importance: list[tuple[int, str, float]]
    params: TreeParams

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``g_q10, g_q50, g_q90``, all at least 0."""
        features = next(iter(self.models.values())).features
        return predict_all(df, features, {f"g_q{round(q * 100)}": model for q, model in self.models.items()}, floor_zero=True)


@dataclass
class RegionalLayer:
    models: dict[int, dict[float, QuantileTrees]]
    decisions: DataFrame
    oof: DataFrame | None

    def transform(self, df: DataFrame, region: str = "regiontype") -> DataFrame:
        """Add ``gr_q10, gr_q50, gr_q90``: the global value plus the residual in adopted regions."""
        names = {q: f"q{round(q * 100)}" for q in QUANTILES}
        if not self.models:
            return df.withColumns({f"gr_{n}": F.col(f"g_{n}") for n in names.values()})
        # Each row walks the trees of its own region.
        forest, numbers = Forest(), {n: {} for n in names.values()}
        for key, models in self.models.items():
            for q, model in models.items():
                numbers[names[q]][key] = model.add_to(forest)
        features = next(iter(self.models.values()))[0.5].features
        staged = fill_missing_features(df, features)
        found = staged.withColumn("_walked", walk(staged, forest, features, numbers, MISSING, region))
        out = []
        for n in names.values():
            residual, base = F.col("_walked")[n], F.col(f"g_{n}")
            out.append(F.when(residual.isNull(), base).otherwise(F.greatest(base + residual, F.lit(0.0))).alias(f"gr_{n}"))
        return found.select(*df.columns, *out)


@dataclass
class ExtremeLayer:
    detectors: dict[int, object]
    correctors: dict[int, object]
    features: list[str]
    decisions: DataFrame
    limits: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, row_id: str, region: str = "regiontype", base: str = "gr_q50") -> DataFrame:
        """Add ``gre_q50``: the bounded correction of each adopted region."""
        rows = _predict_extreme(df, self.features, self.detectors, self.correctors, region)
        fixed = correction.bounded_correction(rows, [region], row_id, base, "_prob", "_corr", out="gre_q50", **self.limits)
        return fixed.drop("_prob", "_corr", "corrected")


def _predict_extreme(df, features, detectors, correctors, region):
    """Add the probability and the correction of the models of each row's region; 0 where there are none."""
    forest, numbers = Forest(), {"margin": {}, "step": {}}
    for key, detector in detectors.items():
        for name, model in (("margin", detector), ("step", correctors[key])):
            if isinstance(model, GrownTrees):
                numbers[name][key] = model.add_to(forest)
                continue
            trees = [(tree.toDebugString, None, weight, ()) for tree, weight in zip(model.trees, model.treeWeights)]
            numbers[name][key] = forest.add_model(trees)
    staged = fill_missing_features(df, features)
    found = staged.withColumn("_walked", walk(staged, forest, features, numbers, MISSING, region))
    # The classifier's trees add up to half of the log odds.
    chance = 1 / (1 + F.exp(-2 * F.col("_walked")["margin"]))
    zero = F.lit(0.0)
    return found.select(*df.columns, F.coalesce(chance, zero).alias("_prob"), F.coalesce(F.col("_walked")["step"], zero).alias("_corr"))


def _parts(df, folds, fold, date):
    """Training and test rows of one fold. ``folds`` is stored; its dates are sent to the rows, which stay in their partitions."""
    mine = small_side(folds.where(F.col("fold") == fold))
    train = df.join(mine.where(F.col("role") == "train").select(date), date, "left_semi")
    test = df.join(mine.where(F.col("role") == "test").select(date), date, "left_semi")
    return train, test


def _folds(df: DataFrame, plan: FoldPlan) -> DataFrame:
    """Temporal folds as a materialised lookup of dates."""
    return cut_lineage(validation.temporal_folds(df, plan.date, (), plan.test_months, plan.min_train))


def _fold_numbers(folds: DataFrame) -> list[int]:
    return sorted(r[0] for r in folds.select("fold").distinct().collect())


def combinations(grid: dict[str, Sequence]) -> list[dict]:
    """All combinations of a parameter grid in key order."""
    keys = sorted(grid)
    return [dict(zip(keys, values)) for values in product(*[grid[k] for k in keys])]


def sweep(grid: dict[str, Sequence], score: Callable[[dict], float], higher: bool = False, threads: int = 2):
    """Score every combination; returns the best one and all results. Fits run a few at a time."""
    combos = combinations(grid) or [{}]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        results = list(zip(combos, pool.map(score, combos)))
    usable = [r for r in results if r[1] is not None]
    if not usable:
        return combos[0], results
    best = max(usable, key=lambda r: r[1]) if higher else min(usable, key=lambda r: r[1])
    return best[0], results


def cv_rmse(df: DataFrame, folds: DataFrame, date: str, features, y: str, params: TreeParams, floor_zero=True) -> float | None:
    """Mean test RMSE of the median model over the folds."""
    values = []
    for fold in _fold_numbers(folds):
        train, test = _parts(df, folds, fold, date)
        model = fit_quantile_trees(train, features, y, 0.5, params)
        p = model.transform(test, "_p", floor_zero)
        values.append(p.agg(F.sqrt(F.avg((F.col("_p") - F.col(y)) ** 2))).first()[0])
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def train_global(
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
    """Fit per fold, predict out of fold, average the tuned parameters and fit on all rows.

    With ``grid`` every fold is tuned by spatial folds of ``group`` inside its training rows. ``df`` is
    read by every fold and fit, so it should be a stored table.
    """
    features = list(features)
    folds = _folds(df, plan)
    numbers = _fold_numbers(folds)
    oof, tuned, importance = None, [], []
    for fold in numbers:
        train, test = _parts(df, folds, fold, plan.date)
        best = params
        if grid:
            groups = validation.spatial_folds(train, group, inner_folds)
            placed = train.join(groups.withColumnRenamed("fold", "_inner"), group)
            chosen, _ = sweep(grid, lambda combo: _inner_rmse(placed, inner_folds, features, y, replace(params, **combo)))
            best = replace(params, **chosen)
        models = fit_quantiles(train, features, y, best, quantiles, weight)
        rows = test.withColumn("_y", F.col(y))
        rows = predict_all(rows, features, {PREDICTIONS[q]: model for q, model in models.items()}, floor_zero=True)
        kept = [c for c in keep if c in df.columns]
        named = [F.col(PREDICTIONS[q]) for q in quantiles]
        part = rows.select(
            F.lit(fold).alias("fold"), plan.date, *kept, F.col("_y").alias("y_true"), *named,
            (F.col("_y") - F.col("y_pred")).alias("residual"),
        )
        oof = part if oof is None else oof.unionByName(part)
        tuned.append(best)
        importance += [(fold, f, v) for f, v in models[0.5].importances().items()]
    if oof is None:
        raise ValueError("no temporal folds: the record is too short")
    oof = cut_lineage(oof)
    fold_scores = oof.groupBy("fold").agg(
        *[e.alias(n) for n, e in scores.core_scores(F.col("y_true"), F.col("y_pred")).items()]
    )
    final = average_settings(params, tuned, fold_scores) if grid else params
    return GlobalLayer(features, fit_quantiles(df, features, y, final, quantiles, weight), oof, fold_scores, importance, final)


def _inner_rmse(placed, inner_folds, features, y, params):
    values = []
    for k in range(inner_folds):
        train, test = placed.where(F.col("_inner") != k), placed.where(F.col("_inner") == k)
        model = fit_quantile_trees(train, features, y, 0.5, params)
        values.append(model.transform(test, "_p", True).agg(F.sqrt(F.avg((F.col("_p") - F.col(y)) ** 2))).first()[0])
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def average_settings(params, tuned, fold_scores):
    """Inverse-RMSE mean of the parameters of the three best folds."""
    rmse = {r["fold"]: r["rmse"] for r in fold_scores.select("fold", "rmse").collect()}
    names = ("rounds", "depth", "rate", "min_rows", "subsample")
    rows = [(*[float(getattr(t, n)) for n in names], float(max(rmse[i], 1e-12))) for i, t in enumerate(tuned)]
    table = literal_rows(fold_scores.sparkSession, rows, ", ".join(f"{n} double" for n in (*names, "rmse")))
    mean = validation.average_parameters(table, [], "rmse", names, ("rounds", "depth", "min_rows")).first()
    return replace(params, **{n: mean[n] for n in names})


# The middle of the tuned range of residual models.
REGIONAL = TreeParams(rounds=100, depth=4, rate=0.1, min_rows=5, subsample=0.8)


def train_regional(
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
    """Fit residual models per region and adopt those that improve the test NRMSE enough.

    ``only`` retrains just those regions on all rows without new decisions (the full-record retrain).
    """
    # Every region and fold reads these rows again.
    base = few_tasks(cut_lineage(layer.transform(df).withColumn("_res", F.col(y) - F.col("g_q50"))))
    counts = base.groupBy(region).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg((F.col(y) == 0).cast("double")).alias("zero_share")
    )
    # One row per region.
    facts = {r[region]: r for r in counts.where(F.col(region).isNotNull()).collect()}
    models, rows, oof = {}, [], None
    for key in sorted(facts):
        mine = base.where(F.col(region) == key)
        n, zeros = facts[key]["n_samples"], facts[key]["zero_share"]
        if only is not None:
            if key in only:
                models[key] = fit_quantiles(mine, layer.features, "_res", params, QUANTILES, weight)
            continue
        record = {"region": key, "n_samples": n, "zero_share": zeros, "base_r2": None, "base_nrmse": None, "new_nrmse": None}
        if n >= min_samples and zeros <= 0.9:
            folds = _folds(mine, plan)
            best = params
            if grid:
                chosen, _ = sweep(
                    grid,
                    lambda combo: cv_rmse(mine, folds, plan.date, layer.features, "_res", replace(params, **combo), False),
                )
                best = replace(params, **chosen)
            part = None
            for fold in _fold_numbers(folds):
                train, test = _parts(mine, folds, fold, plan.date)
                fitted = fit_quantiles(train, layer.features, "_res", best, QUANTILES, weight)
                test = predict_all(test, layer.features, {f"_r{round(q * 100)}": model for q, model in fitted.items()})
                combined = {
                    PREDICTIONS[q]: F.greatest(F.col(f"g_q{round(q * 100)}") + F.col(f"_r{round(q * 100)}"), F.lit(0.0))
                    for q in QUANTILES
                }
                kept = [c for c in keep if c in df.columns]
                cols = [F.lit(fold).alias("fold"), region, plan.date, *kept, F.col(y).alias("y_true"), F.col("g_q50").alias("y_pred_global")]
                piece = test.select(*cols, *[c.alias(n) for n, c in combined.items()])
                part = piece if part is None else part.unionByName(piece)
            if part is not None:
                part = cut_lineage(part)
                g = scores.core_scores(F.col("y_true"), F.col("y_pred_global"))
                c = scores.core_scores(F.col("y_true"), F.col("y_pred"))
                per_fold = part.groupBy("fold").agg(
                    g["r2"].alias("r2"), g["nrmse_range"].alias("base"), c["nrmse_range"].alias("new")
                )
                mean = per_fold.agg(F.avg("r2"), F.avg("base"), F.avg("new")).first()
                record.update(base_r2=mean[0], base_nrmse=mean[1], new_nrmse=mean[2])
                oof = part if oof is None else oof.unionByName(part)
        rows.append((key, n, zeros, record["base_r2"], record["base_nrmse"], record["new_nrmse"]))
        if record["base_nrmse"] is not None:
            gain = (record["base_nrmse"] - record["new_nrmse"]) / record["base_nrmse"] * 100 if record["base_nrmse"] > 0 else 0.0
            if gain >= needed_improvement(record["base_r2"], threshold):
                models[key] = fit_quantiles(mine, layer.features, "_res", best, QUANTILES, weight)
    if only is not None:
        rows = [(k, facts[k]["n_samples"], facts[k]["zero_share"], None, 1.0, 0.0) for k in sorted(models)]
    schema = "region int, n_samples bigint, zero_share double, base_r2 double, base_nrmse double, new_nrmse double"
    table = df.sparkSession.createDataFrame(rows, schema)
    return RegionalLayer(models, correction.regional_decisions(table, min_samples if only is None else 0, 0.9, threshold), oof)


def needed_improvement(base_r2: float | None, threshold: float) -> float:
    if base_r2 is not None and base_r2 < 0:
        return max(0.5, threshold / 4)
    if base_r2 is not None and base_r2 < 0.2:
        return max(1.0, threshold / 2)
    return threshold


def fit_detector(rows: DataFrame, label: str, depth: int = 4, rounds: int = 20, seed: int = 42):
    """Boosted classifier of rare rows, weighted by the ratio of negatives to positives."""
    n = rows.agg(F.sum(F.col(label).cast("int")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not n["p"] or n["p"] == n["n"]:
        return None
    ratio = (n["n"] - n["p"]) / n["p"]
    weighted = rows.withColumns({"_label": F.col(label).cast("double"), "_w": F.when(F.col(label), ratio).otherwise(1.0)})
    return GBTClassifier(
        featuresCol="_vec", labelCol="_label", weightCol="_w", maxDepth=depth, maxIter=rounds, seed=seed
    ).fit(weighted)


def fit_corrector(rows: DataFrame, residual: str, depth: int = 4, rounds: int = 20, seed: int = 42):
    """Boosted regression of residuals."""
    return GBTRegressor(featuresCol="_vec", labelCol=residual, maxDepth=depth, maxIter=rounds, seed=seed).fit(rows)


def detector_auc(model, rows: DataFrame, label: str) -> float:
    scored = model.transform(rows.withColumn("_label", F.col(label).cast("double")))
    return BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="_label").evaluate(scored)


def train_extreme(
    df: DataFrame,
    features: Sequence[str],
    base: str,
    row_id: str,
    region: str = "regiontype",
    y: str = "y_true",
    plan: FoldPlan = FoldPlan(),
    min_samples: int = 5000,
    min_extremes: int = 100,
    min_base_r2: float = 0.0,
    depth: int = 3,
    rounds: int = 50,
    grid: dict[str, Sequence] | None = None,
    corrector_grid: dict[str, Sequence] | None = None,
    only: Sequence[int] | None = None,
    **limits,
) -> ExtremeLayer:
    """Detector and corrector of underestimated extremes per region, adopted by their fold scores.

    ``df`` holds one averaged out-of-fold row per key with features, truth and base prediction.
    ``only`` retrains the given regions on all rows without new decisions.
    """
    features = list(features)
    floored = df.withColumn(base, F.greatest(F.col(base), F.lit(0.0)))
    labelled = correction.label_extremes(floored, [region], y, base)
    rows = few_tasks(cut_lineage(assemble(labelled, features, "_vec", MISSING).withColumn("_res", F.col(y) - F.col(base))))
    summary = rows.groupBy(region).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("is_under"), 1)).alias("n_under"),
        scores.core_scores(F.col(y), F.col(base))["r2"].alias("r2"),
    )
    facts = {r[region]: r for r in summary.where(F.col(region).isNotNull()).collect()}
    detectors, correctors, records = {}, {}, []
    for key in sorted(facts):
        fact, mine = facts[key], rows.where(F.col(region) == key)
        if only is not None:
            detector = fit_detector(mine, "is_under", depth, rounds) if key in only else None
            if detector is not None:
                detectors[key] = detector
                correctors[key] = fit_corrector(mine.where("is_under"), "_res", depth, rounds)
            continue
        reason = None
        if fact["n"] < min_samples:
            reason = "insufficient_samples"
        elif fact["r2"] is None or fact["r2"] < min_base_r2:
            reason = "low_base_r2"
        elif fact["n_under"] < min_extremes:
            reason = "insufficient_extremes"
        folds = None
        if reason is None:
            folds = _folds(mine, plan)
            if not _fold_numbers(folds):
                reason = "no_cv_splits"
        if reason is not None:
            records.append((key, False, reason, None))
            continue
        setting = {"depth": depth, "rounds": rounds}
        if grid:
            setting, _ = sweep(grid, lambda c: _detector_cv(mine, folds, plan.date, {**setting, **c}), higher=True)
            setting = {"depth": depth, "rounds": rounds, **setting}
        repair = setting
        if corrector_grid:
            repair, _ = sweep(corrector_grid, lambda c: _corrector_cv(mine, folds, plan.date, {**setting, **c}))
            repair = {**setting, **repair}
        table = _extreme_folds(mine, folds, plan.date, features, key, region, row_id, y, base, setting, repair, limits)
        if table is None:
            records.append((key, False, "no_cv_metrics", None))
            continue
        verdict = correction.adoption_scores(table, []).first()
        records.append((key, verdict["adopted"], verdict["decision"], verdict["score"]))
        if verdict["adopted"]:
            detectors[key] = fit_detector(mine, "is_under", **setting)
            correctors[key] = fit_corrector(mine.where("is_under"), "_res", **repair)
    if only is not None:
        records = [(k, True, "retrained", None) for k in sorted(detectors)]
    decisions = df.sparkSession.createDataFrame(records, "region int, adopted boolean, decision string, score double")
    return ExtremeLayer(detectors, correctors, features, decisions, limits)


def _detector_cv(mine, folds, date, setting):
    values = []
    for fold in _fold_numbers(folds):
        train, test = _parts(mine, folds, fold, date)
        model = fit_detector(train, "is_under", **setting)
        if model is not None and test.where("is_under").limit(1).count():
            values.append(detector_auc(model, test, "is_under"))
    return sum(values) / len(values) if values else None


def _corrector_cv(mine, folds, date, setting):
    """Mean root mean square error of the corrector over the folds."""
    values = []
    for fold in _fold_numbers(folds):
        train, test = (part.where("is_under") for part in _parts(mine, folds, fold, date))
        if train.limit(1).count() and test.limit(1).count():
            scored = fit_corrector(train, "_res", **setting).transform(test)
            values.append(scored.agg(F.sqrt(F.avg((F.col("prediction") - F.col("_res")) ** 2))).first()[0])
    return sum(values) / len(values) if values else None


def fold_changes(y: str, base: str, new: str) -> list:
    """What a correction does to a fold: the columns that ``correction.adoption_scores`` reads. High rows are marked by ``is_high``."""
    before, after = scores.core_scores(F.col(y), F.col(base)), scores.core_scores(F.col(y), F.col(new))
    old_tail, new_tail = (F.sqrt(F.avg(F.when(F.col("is_high"), (F.col(c) - F.col(y)) ** 2))) for c in (base, new))
    return [
        (-scores.improvement_pct(before["rmse"], after["rmse"])).alias("rmse_change_pct"),
        scores.improvement_pct(old_tail, new_tail).alias("extreme_improvement_pct"),
        F.when(F.sum(base) > 0, F.sum(new) / F.sum(base)).otherwise(1.0).alias("conservation_ratio"),
        before["r2"].alias("r2_base"),
        after["r2"].alias("r2_final"),
    ]


def _extreme_folds(mine, folds, date, features, key, region, row_id, y, base, setting, repair, limits):
    """Fold metrics of the corrected prediction."""
    out = None
    for fold in _fold_numbers(folds):
        train, test = _parts(mine, folds, fold, date)
        under = train.where("is_under")
        detector = fit_detector(train, "is_under", **setting)
        if detector is None or not under.limit(1).count():
            continue
        corrector = fit_corrector(under, "_res", **repair)
        scored = _predict_extreme(test.drop("_vec"), features, {key: detector}, {key: corrector}, region)
        fixed = correction.bounded_correction(scored, [region], row_id, base, "_prob", "_corr", "_new", **limits)
        part = fixed.agg(*fold_changes(y, base, "_new"))
        part = cut_lineage(part)
        out = part if out is None else out.unionByName(part)
    return out


def score_cascade(
    df: DataFrame, layer: GlobalLayer, regional: RegionalLayer | None, extreme: ExtremeLayer | None, row_id: str, region: str = "regiontype"
) -> DataFrame:
    """Global, then regional, then extreme predictions; outer quantiles end with the regional layer."""
    scored = layer.transform(df)
    if regional is not None:
        scored = regional.transform(scored, region)
    else:
        scored = scored.withColumns({f"gr_q{round(q * 100)}": F.col(f"g_q{round(q * 100)}") for q in QUANTILES})
    if extreme is not None and extreme.detectors:
        return extreme.transform(scored, row_id, region)
    return scored.withColumn("gre_q50", F.col("gr_q50"))


def prediction_filters(
    df: DataFrame,
    reference_area: DataFrame | None,
    history: DataFrame | None,
    bypass: Sequence[str] = (),
    years: Sequence[int] = tuple(range(2013, 2019)),
) -> DataFrame:
    """Keep rows on cells with reference irrigated area and on (cell, month) pairs seen in the mask years.

    ``reference_area``: crop, cell_id, area. ``history``: crop, cell_id, year, month. Crops in ``bypass``
    have no reference area and skip the first filter; without a history table the second is skipped.
    """
    kept = df
    if reference_area is not None:
        cells = reference_area.groupBy("crop", "cell_id").agg(F.sum("area").alias("area")).where(F.col("area") > 0)
        named = kept.where(~F.col("crop").isin(*bypass)) if bypass else kept
        kept_named = named.join(cells.select("crop", "cell_id"), ["crop", "cell_id"], "left_semi")
        kept = kept_named.unionByName(kept.where(F.col("crop").isin(*bypass))) if bypass else kept_named
    if history is not None:
        seen = history.where(F.col("year").isin(*years)).select("crop", "cell_id", "month").distinct()
        kept = kept.join(seen, ["crop", "cell_id", "month"], "left_semi")
    return kept


def prediction_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means of the three layers, changes between them and counts."""
    g, r, e = F.avg("g_q50"), F.avg("gr_q50"), F.avg("gre_q50")

    def change(a, b):
        return F.when(a != 0, (b - a) / a * 100).otherwise(0.0)

    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("cell_id").alias("n_cells"),
        g.alias("mean_global"),
        r.alias("mean_regional"),
        e.alias("mean_extreme"),
        change(g, r).alias("change_regional_pct"),
        change(r, e).alias("change_extreme_pct"),
    )
