"""Scores of predictions at several levels of aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import scores
from gridspark.operators.scale import exact_quantiles, lookup_join, null_safe_join
from gridspark.session import cut_lineage


def regression_scores(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Core scores and the median absolute error per key."""
    valid = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    core = valid.groupBy(*keys).agg(*[e.alias(n) for n, e in scores.core_scores(F.col(y), F.col(p)).items()])
    errors = valid.select(*keys, F.abs(F.col(p) - F.col(y)).alias("_e"))
    median = exact_quantiles(errors, keys, "_e", {"medae": 0.5})
    return null_safe_join(core, median, keys, "left")


def extreme_scores(
    df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred", percentiles=(90, 95), min_tail: int = 10
) -> DataFrame:
    """Tail scores above each percentile of the truth: errors, hit rate and false-alarm rate."""
    valid = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    truth = exact_quantiles(valid, keys, y, {f"_y{q}": q / 100 for q in percentiles})
    guess = exact_quantiles(valid, keys, p, {f"_p{q}": q / 100 for q in percentiles})
    joined = lookup_join(lookup_join(valid, truth, keys, "inner"), guess, keys, "inner")
    spread = F.max(y) - F.min(y)
    spread = F.when(spread == 0, 1.0).otherwise(spread)
    aggs = []
    for q in percentiles:
        tail = F.col(y) >= F.col(f"_y{q}")
        called = F.col(p) >= F.col(f"_p{q}")
        n = F.count(F.when(tail, 1))
        enough = n > min_tail
        sq = F.avg(F.when(tail, (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))))
        n_called = F.count(F.when(called, 1))
        aggs += [
            n.alias(f"n_extreme_p{q}"),
            F.when(enough, F.sqrt(sq)).alias(f"rmse_extreme_p{q}"),
            F.when(enough, F.sqrt(sq) / spread).alias(f"nrmse_extreme_p{q}"),
            F.when(enough, F.avg(F.when(tail, F.col(p) - F.col(y)))).alias(f"bias_extreme_p{q}"),
            F.when(enough, F.count(F.when(tail & called, 1)) / n).alias(f"hit_p{q}_own"),
            F.when(enough & (n_called > 0), F.count(F.when(called & ~tail, 1)) / n_called).alias(f"false_alarm_p{q}"),
        ]
    return joined.groupBy(*keys).agg(*aggs)


def interval_table(df: DataFrame, keys: Sequence[str], y: str, lo: str, mid: str, hi: str) -> DataFrame:
    """Coverage, width, calibration and the three-quantile CRPS."""
    parts = scores.interval_scores(F.col(y), F.col(lo), F.col(hi))
    loss = scores.crps(F.col(y), {0.1: F.col(lo), 0.5: F.col(mid), 0.9: F.col(hi)})
    return df.groupBy(*keys).agg(*[e.alias(n) for n, e in parts.items()], loss.alias("crps"))


def pinball_table(df: DataFrame, keys: Sequence[str], y: str, predictions: dict[float, str]) -> DataFrame:
    aggs = [F.avg(scores.pinball(F.col(y), F.col(c), q)).alias(f"pinball_q{round(q * 100)}") for q, c in predictions.items()]
    return df.groupBy(*keys).agg(*aggs)


def between_group_rmse(df: DataFrame, group: str, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    means = df.groupBy(*keys, group).agg(F.avg(y).alias("_y"), F.avg(p).alias("_p"))
    diff = F.col("_p") - F.col("_y")
    return means.groupBy(*keys).agg(F.sqrt(F.avg(diff * diff)).alias("between_rmse"))


def agreement(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Kling-Gupta efficiency and companions per key; fewer than 3 rows give NULL."""
    valid = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return valid.groupBy(*keys).agg(*[e.alias(n) for n, e in scores.agreement_scores(F.col(y), F.col(p)).items()])


def half_threshold_hits(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Share of true highs (P90 of positive truth) that reach half the threshold in the prediction."""
    positive = df.where(F.col(y) > 0)
    level = null_safe_join(
        exact_quantiles(positive, keys, y, {"_t": 0.9}), positive.groupBy(*keys).agg(F.count(F.lit(1)).alias("_np")), keys, "inner"
    )
    joined = lookup_join(df, level, keys, "left")
    high = F.col(y) >= F.col("_t")
    hit = high & (F.col(p) >= F.col("_t") * 0.5)
    enough = (F.count(F.lit(1)) > 10) & (F.max("_np") > 10)
    n_high = F.count(F.when(high, 1))
    return joined.groupBy(*keys).agg(F.when(enough & (n_high > 0), F.count(F.when(hit, 1)) / n_high).alias("hit_p90_half"))


def absolute_hits(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred", q: float = 0.9) -> DataFrame:
    """Share of true highs the prediction also puts above the truth's own threshold."""
    level = exact_quantiles(df, keys, y, {"_t": q})
    joined = lookup_join(df, level, keys, "inner")
    high = F.col(y) >= F.col("_t")
    n_high = F.count(F.when(high, 1))
    return joined.groupBy(*keys).agg(
        F.when(n_high > 0, F.count(F.when(high & (F.col(p) >= F.col("_t")), 1)) / n_high).alias("hit_p90_abs")
    )


LEVELS = {
    "monthly_grid": ["cell_id", "year", "month"],
    "yearly_grid": ["cell_id", "year"],
    "monthly_country": ["country", "year", "month"],
    "yearly_country": ["country", "year"],
    "yearly_global": ["year"],
}


def level_sums(df: DataFrame, layers: dict[str, str], y: str = "y_true", all_crops: bool = True) -> DataFrame:
    """Truth and every layer summed at the five levels: ``crop, level, <layer sums>, y_true``.

    The grid-month table is summed once and materialised; each coarser level is an aggregate of it. Rows without a
    country take no part in country levels. ``all_crops`` adds the sum over crops as crop ``all``.
    """
    values = [y, *layers.values()]
    sums = [F.sum(v).alias(v) for v in values]
    base = df.groupBy("crop", "country", "cell_id", "year", "month").agg(*sums)
    if all_crops:
        total = base.groupBy("country", "cell_id", "year", "month").agg(*sums).withColumn("crop", F.lit("all"))
        base = base.unionByName(total)
    base = cut_lineage(base)
    out = None
    for level, keys in LEVELS.items():
        rows = base.where(F.col("country").isNotNull()) if "country" in keys else base
        table = rows.groupBy("crop", *keys).agg(*sums).select("crop", F.lit(level).alias("level"), "year", *values)
        out = table if out is None else out.unionByName(table)
    return out


def multilevel(df: DataFrame, layers: dict[str, str], y: str = "y_true", all_crops: bool = True) -> DataFrame:
    """Agreement scores per crop, layer and level."""
    sums = level_sums(df, layers, y, all_crops)
    parts = []
    for layer, column in layers.items():
        for name, e in scores.agreement_scores(F.col(y), F.col(column)).items():
            parts.append((layer, name, e))
    wide = sums.groupBy("crop", "level").agg(*[e.alias(f"{layer}|{name}") for layer, name, e in parts])
    names = list(scores.agreement_scores(F.col(y), F.col(y)))
    rows = F.array(
        *[F.struct(F.lit(layer).alias("layer"), *[F.col(f"`{layer}|{n}`").alias(n) for n in names]) for layer in layers]
    )
    return wide.select("crop", "level", F.inline(rows))


def yearly_ratios(df: DataFrame, keys: Sequence[str], years: Sequence[int], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Predicted over true total of single years."""
    aggs = []
    for year in years:
        t, q = F.sum(F.when(F.col("year") == year, F.col(y))), F.sum(F.when(F.col("year") == year, F.col(p)))
        aggs.append(F.when(t > 0, q / t).alias(f"total_ratio_{year}"))
    return df.groupBy(*keys).agg(*aggs)


def country_scores(df: DataFrame, keys: Sequence[str] = ("crop",), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Scores of country-year sums and of grid rows; rows without a country are dropped."""
    matched = df.where(F.col("country").isNotNull())
    sums = matched.groupBy(*keys, "country", "year").agg(F.sum(y).alias("_y"), F.sum(p).alias("_p"))
    agree = scores.agreement_scores(F.col("_y"), F.col("_p"))
    by_country = sums.groupBy(*keys).agg(
        agree["n"].alias("n_country_years"),
        F.count_distinct("country").alias("n_countries"),
        agree["r2"].alias("country_year_r2"),
        agree["rmse"].alias("rmse"),
        agree["nrmse_mean"].alias("nrmse_mean"),
        agree["corr"].alias("correlation"),
    )
    grid = matched.groupBy(*keys).agg(scores.core_scores(F.col(y), F.col(p))["r2"].alias("grid_r2"))
    return null_safe_join(by_country, grid, keys, "inner")


def layer_table(df: DataFrame, layers: Sequence[str], metrics: Sequence[str], key: str = "crop", layer: str = "layer") -> DataFrame:
    """Wide ``metric_layer`` columns per crop."""
    picks = [
        F.max(F.when(F.col(layer) == name, F.col(m))).alias(f"{m}_{name}") for m in metrics for name in layers
    ]
    return df.groupBy(key).agg(*picks)


def log_scores(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """R2 and RMSE in log10 space on positive pairs, with the regression line and its band terms."""
    positive = df.where((F.col(y) > 0) & (F.col(p) > 0)).select(*keys, F.log10(y).alias("_x"), F.log10(p).alias("_z"))
    x, z = F.col("_x"), F.col("_z")
    core = scores.core_scores(x, z)
    sxx = F.var_pop(x) * F.count(x)
    residual = F.var_pop(z) * F.count(z) * (1 - F.corr(x, z) * F.corr(x, z))
    return positive.groupBy(*keys).agg(
        F.count(x).alias("n"),
        core["r2"].alias("r2_log"),
        core["rmse"].alias("rmse_log"),
        F.regr_slope(z, x).alias("slope"),
        F.regr_intercept(z, x).alias("intercept"),
        F.corr(x, z).alias("r"),
        F.avg(x).alias("x_mean"),
        sxx.alias("x_ss"),
        F.when(F.count(x) > 2, F.sqrt(residual / (F.count(x) - 2))).alias("residual_se"),
    )


def confidence_band(fit: DataFrame, t_value: float, points: Sequence[float]) -> DataFrame:
    """Confidence band of a log-log line at given log10 positions."""
    at = fit.withColumn("x_log", F.explode(F.array(*[F.lit(float(v)) for v in points])))
    centre = F.col("intercept") + F.col("slope") * F.col("x_log")
    gap = F.col("x_log") - F.col("x_mean")
    half = F.col("residual_se") * F.sqrt(1 / F.col("n") + gap * gap / F.col("x_ss")) * t_value
    return at.withColumns(
        {"fit": F.pow(F.lit(10.0), centre), "low": F.pow(F.lit(10.0), centre - half), "high": F.pow(F.lit(10.0), centre + half)}
    )


def largest_residuals(df: DataFrame, ids: Sequence[str], n: int = 10, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """The ``n`` largest over- and under-predictions by log residual."""
    positive = df.where((F.col(y) > 0) & (F.col(p) > 0))
    scored = positive.withColumn("log_residual", F.log10(p) - F.log10(y))
    over = scored.orderBy(F.desc("log_residual"), *ids).limit(n).withColumn("side", F.lit("over"))
    under = scored.orderBy(F.asc("log_residual"), *ids).limit(n).withColumn("side", F.lit("under"))
    return over.unionByName(under)


def combine_crops(df: DataFrame, groups: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Sum sub-crops into combined crops per cell and month. ``groups``: crop, combined."""
    return (
        df.join(groups, "crop")
        .groupBy("combined", "cell_id", "year", "month")
        .agg(F.sum(y).alias(y), F.sum(p).alias(p))
    )
