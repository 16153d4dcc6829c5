"""Out-of-fold bookkeeping, extreme labels, bounded corrections and adoption decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.scale import exact_quantiles, lexicographic_cuts, lookup_join, null_safe_join, plain
from gridspark.session import cut_lineage


def supplement(base: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``base`` plus the rows of ``extra`` whose key ``base`` lacks."""
    lacking = extra.join(base.select(*keys).distinct(), list(keys), "left_anti")
    return base.unionByName(lacking, allowMissingColumns=True)


def average_folds(df: DataFrame, keys: Sequence[str], predictions: Sequence[str], order: str = "fold") -> DataFrame:
    """Mean predictions per key; of the other columns the one of the first fold."""
    rest = [c for c in df.columns if c not in (*keys, *predictions, order)]
    return df.groupBy(*keys).agg(
        *[F.avg(p).alias(p) for p in predictions], *[F.min_by(c, order).alias(c) for c in rest]
    )


def label_extremes(
    df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred", q: float = 0.85, margin: float = 0.15
) -> DataFrame:
    """Flags of high truth, of high truth predicted too low and of high truth predicted too high."""
    level = exact_quantiles(df, keys, y, {"threshold": q})
    joined = lookup_join(df, level, keys, "inner")
    high = F.col(y) >= F.col("threshold")
    return joined.withColumns(
        {
            "is_high": high,
            "is_under": high & (F.col(p) < F.col(y) * (1 - margin)),
            "is_over": high & (F.col(p) > F.col(y) * (1 + margin)),
        }
    )


def label_summary(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.count(F.when(F.col("is_high"), 1))
    under = F.count(F.when(F.col("is_under"), 1))
    return labelled.groupBy(*keys).agg(
        F.max("threshold").alias("threshold"),
        n.alias("n_high"),
        under.alias("n_under"),
        F.count(F.when(F.col("is_over"), 1)).alias("n_over"),
        F.when(n > 0, under / n * 100).otherwise(0.0).alias("under_pct"),
    )


def bounded_correction(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    base: str,
    prob: str,
    correction: str,
    out: str = "y_corrected",
    threshold: float = 0.6,
    max_share: float = 0.05,
    max_relative: float = 0.5,
    tolerance: float = 0.05,
) -> DataFrame:
    """Apply corrections to the most likely rows within limits, per key.

    Rows at or above the probability threshold are eligible (NaN, infinity and NULL are not); beyond ``max_share`` of all rows only the
    most probable are corrected (ties by ``row_id``, a whole number). A correction is cut to a share of its base; if
    the total would move by more than ``tolerance`` all corrections shrink by one factor; negative
    results become 0 last. The input is materialised once, because totals, cut and result each read it. The last corrected row of a key
    is its cut; rows are chosen by comparing with it, so that nothing is joined back row by row.
    """
    df = cut_lineage(df)
    eligible = F.coalesce((F.col(prob) >= threshold) & (F.col(prob) < float("inf")), F.lit(False))
    chance = F.when(eligible, F.col(prob))
    counts = cut_lineage(
        df.groupBy(*keys).agg(
            F.floor(F.count(F.lit(1)) * max_share).alias("_limit"),
            F.sum(base).alias("_sum_base"),
            F.count(chance).alias("_eligible"),
            F.min(chance).alias("_lo"),
            F.max(chance).alias("_hi"),
        )
    )
    # Keys with more eligible rows than may be corrected.
    over = (F.col("_limit") > 0) & (F.col("_eligible") > F.col("_limit"))
    size = counts.where(over).agg(F.sum("_eligible")).first()[0] or 0
    if size:
        cuts = lexicographic_cuts(df.where(eligible), keys, prob, row_id, counts.where(over), rows=size)
        counts = cut_lineage(null_safe_join(counts, cuts, keys, "left"))
    else:
        counts = counts.withColumns({"_cut": F.lit(None).cast("double"), "_cut_id": F.lit(None).cast("bigint")})
    marked = lookup_join(df, counts.select(*keys, "_limit", "_cut", "_cut_id"), keys, "inner", stored=True)
    value = plain(F.col(prob))
    above = F.col("_cut").isNull() | (value > F.col("_cut")) | ((value == F.col("_cut")) & (F.col(row_id) <= F.col("_cut_id")))
    limit = F.abs(base) * max_relative
    bounded = F.greatest(-limit, F.least(limit, F.col(correction)))
    chosen = eligible & (F.col("_limit") > 0) & above
    staged = marked.select(*df.columns, F.coalesce(chosen, F.lit(False)).alias("corrected"))
    staged = staged.withColumn("_step", F.when(F.col("corrected"), bounded).otherwise(0.0))
    change = staged.groupBy(*keys).agg(F.sum("_step").alias("_change"))
    limits = null_safe_join(counts.select(*keys, "_sum_base"), change, keys, "inner")
    allowed = F.abs("_sum_base") * tolerance
    factor = F.when(
        (F.col("_sum_base") > 0) & (F.abs("_change") > allowed), allowed / F.abs("_change")
    ).otherwise(1.0)
    joined = lookup_join(staged, limits.select(*keys, factor.alias("_factor")), keys, "inner")
    value = F.greatest(F.col(base) + F.col("_step") * F.col("_factor"), F.lit(0.0))
    return joined.withColumn(out, value).select(*df.columns, out, "corrected")


def correction_summary(df: DataFrame, keys: Sequence[str], base: str, out: str, prob: str, threshold: float = 0.6) -> DataFrame:
    n = F.count(F.when(F.col("corrected"), 1))
    return df.groupBy(*keys).agg(
        F.count(F.when(F.col(prob) >= threshold, 1)).alias("n_eligible"),
        n.alias("n_corrected"),
        (n / F.count(F.lit(1)) * 100).alias("correction_pct"),
        F.coalesce(F.avg(F.when(F.col("corrected"), F.abs(F.col(out) - F.col(base)))), F.lit(0.0)).alias("mean_correction"),
        F.when(F.sum(base) > 0, F.sum(out) / F.sum(base)).otherwise(1.0).alias("conservation_ratio"),
    )


def adoption_scores(
    folds: DataFrame, keys: Sequence[str], max_rmse_rise: float = 5.0, max_drift: float = 0.10
) -> DataFrame:
    """Decide from fold metrics whether a correction is used.

    ``folds``: rmse_change_pct, extreme_improvement_pct, conservation_ratio, r2_base, r2_final. Two vetoes,
    then the sum of five components: at least 1 accepts, at least 3 accepts strongly.
    """
    m = folds.groupBy(*keys).agg(
        F.avg("rmse_change_pct").alias("rmse_change"),
        F.avg("extreme_improvement_pct").alias("gain"),
        F.stddev_pop("extreme_improvement_pct").alias("gain_sd"),
        F.avg("conservation_ratio").alias("conservation"),
        F.avg("r2_base").alias("r2_base"),
        F.avg("r2_final").alias("r2_final"),
    )
    needed = F.when(F.col("r2_base") >= 0.9, 0.3).when(F.col("r2_base") >= 0.7, 1.0).otherwise(2.0)
    drift = F.abs(F.col("conservation") - 1.0)
    delta = F.col("r2_final") - F.col("r2_base")
    rise = F.col("rmse_change")
    m = m.withColumns(
        {
            "c_improvement": F.least(F.lit(5.0), F.col("gain") / needed * 2.5),
            "c_rmse": F.when(rise <= 0, F.least(F.lit(2.0), -rise * 0.5)).otherwise(F.greatest(F.lit(-3.0), -rise * 0.3)),
            "c_conservation": F.when(drift <= 0.02, 1.0).when(drift <= 0.05, 0.5).otherwise(0.0),
            "c_r2": F.when(delta >= 0, F.least(F.lit(1.0), delta * 50)).otherwise(F.greatest(F.lit(-2.0), delta * 100)),
            "c_stability": F.greatest(
                F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("gain_sd") / F.greatest(F.lit(0.1), F.col("gain")))
            ),
        }
    )
    score = sum((F.col(c) for c in ("c_rmse", "c_conservation", "c_r2", "c_stability")), F.col("c_improvement"))
    decision = (
        F.when(rise > max_rmse_rise, "VETO_RMSE")
        .when(drift > max_drift, "VETO_CONSERVATION")
        .when(F.col("score") >= 3.0, "STRONG_ACCEPT")
        .when(F.col("score") >= 1.0, "ACCEPT")
        .otherwise("REJECT")
    )
    scored = m.withColumn("score", score).withColumn("decision", decision)
    return scored.withColumn("adopted", F.col("decision").isin("ACCEPT", "STRONG_ACCEPT"))


def regional_decisions(
    scores: DataFrame, min_samples: int = 5000, max_zero_share: float = 0.9, threshold: float = 2.0
) -> DataFrame:
    """Regional adoption: ``region, n_samples, zero_share, base_r2, base_nrmse, new_nrmse`` to a decision.

    The required improvement is halved below a base R2 of 0.2 (at least 1 %) and quartered below 0
    (at least 0.5 %).
    """
    needed = (
        F.when(F.col("base_r2") < 0, F.greatest(F.lit(threshold / 4), F.lit(0.5)))
        .when(F.col("base_r2") < 0.2, F.greatest(F.lit(threshold / 2), F.lit(1.0)))
        .otherwise(F.lit(threshold))
    )
    gain = F.when(F.col("base_nrmse") > 0, (F.col("base_nrmse") - F.col("new_nrmse")) / F.col("base_nrmse") * 100).otherwise(0.0)
    reason = (
        F.when(F.col("n_samples") < min_samples, "insufficient_samples")
        .when(F.col("zero_share") > max_zero_share, "zero_stress_region")
        .when(F.col("improvement_pct") >= F.col("needed_pct"), "adopted")
        .otherwise("below_threshold")
    )
    staged = scores.withColumns({"improvement_pct": gain, "needed_pct": needed}).withColumn("reason", reason)
    return staged.withColumn("adopted", F.col("reason") == "adopted")
