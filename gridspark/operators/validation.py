"""Cross-validation splits, sample weights and hyper-parameter averaging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.operators.scale import average_rank, cumulative_mass, exact_quantiles, lookup_join, null_safe_join


def temporal_folds(
    df: DataFrame, date: str, keys: Sequence[str] = (), test_months: int = 24, min_train: int = 12, n_splits: int | None = None
) -> DataFrame:
    """Expanding-window folds as a lookup ``keys, date, fold, role``, oldest fold 0.

    Test blocks of ``test_months`` distinct dates are cut from the end; a block starting before
    ``min_train`` dates is not made. The windows span distinct dates only.
    """
    dates = df.select(*keys, date).distinct()
    order = Window.partitionBy(*keys).orderBy(date) if keys else Window.partitionBy(F.lit(0)).orderBy(date)
    total = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = dates.withColumns({"_pos": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(total)})
    wanted = F.greatest(F.lit(1), F.floor((F.col("_n") - min_train) / test_months)) if n_splits is None else F.lit(n_splits)
    feasible = F.floor((F.col("_n") - min_train) / test_months)
    folds = F.least(wanted, feasible).cast("int")
    numbered = ranked.where(folds > 0).select("*", F.explode(F.sequence(F.lit(0), folds - 1)).alias("fold"), folds.alias("_folds"))
    start = F.col("_n") - (F.col("_folds") - F.col("fold")) * test_months
    role = F.when(F.col("_pos") < start, "train").when(F.col("_pos") < start + test_months, "test")
    return numbered.withColumn("role", role).where(F.col("role").isNotNull()).select(*keys, date, "fold", "role")


def assign_folds(df: DataFrame, folds: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with their (fold, role); a training row appears once per later fold."""
    return df.join(folds, list(on))


def digest_number(text):
    """A 32-bit number from the MD5 digest of a text: the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def spatial_folds(df: DataFrame, group: str, n_folds: int = 5, balanced: bool = False) -> DataFrame:
    """Whole groups per fold: ``group, fold``.

    By default the fold is a hash of the group. ``balanced`` deals groups out by falling size in
    snake order (0..k-1, k-1..0, ...), so fold sizes stay close however uneven the groups are.
    """
    if not balanced:
        return df.select(group).distinct().withColumn("fold", (digest_number(F.col(group).cast("string")) % n_folds).cast("int"))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    by_size = cumulative_mass(sizes, [], "_n", descending=True).select("_n", "before")
    sizes = sizes.join(by_size, "_n")
    # Groups of one size are interchangeable; their order is their rank among groups of that size.
    names = sizes.withColumn("_g", F.xxhash64(group).cast("double"))
    inner = average_rank(names, ["_n"], "_g", "_r")
    placed = names.join(inner, ["_n", "_g"]).withColumn("_pos", F.col("before") + F.floor("_r") - 1)
    turn, seat = F.floor(F.col("_pos") / n_folds), F.pmod(F.col("_pos"), F.lit(n_folds))
    fold = F.when(turn % 2 == 0, seat).otherwise(n_folds - 1 - seat).cast("int")
    return placed.select(group, fold.alias("fold"))


def year_splits(df: DataFrame, splits: Sequence[tuple[Sequence[int], Sequence[int]]], year: str = "year") -> DataFrame:
    """Fixed (train years, evaluation years) lists as ``(fold, role)`` rows."""
    hits = []
    for i, (train, test) in enumerate(splits):
        for years, role in ((train, "train"), (test, "test")):
            tag = F.struct(F.lit(i).alias("fold"), F.lit(role).alias("role"))
            hits.append(F.when(F.col(year).isin(*years), tag))
    return df.select("*", F.explode(F.array_compact(F.array(*hits))).alias("_t")).select("*", "_t.*").drop("_t")


def sample_weights(
    df: DataFrame, y: str, alpha: float = 1.0, q: float = 0.9, cap: float = 10.0, keys: Sequence[str] = (), out: str = "weight"
) -> DataFrame:
    """Weights that rise with the target: clip(1 + alpha * y / quantile of positive y, 1, cap)."""
    level = exact_quantiles(df.where(F.col(y) > 0), keys, y, {"_q": q})
    if keys:
        joined = lookup_join(df, level, keys, "left")
    else:
        joined = df.withColumn("_q", level.select("_q").scalar())
    reference = F.when(F.col("_q") > 0, F.col("_q")).otherwise(1.0)
    raw = 1.0 + F.greatest(F.col(y), F.lit(0.0)) / reference * alpha
    return joined.withColumn(out, F.greatest(F.lit(1.0), F.least(F.lit(cap), raw))).drop("_q")


def average_parameters(
    params: DataFrame, keys: Sequence[str], score: str, names: Sequence[str], integers: Sequence[str] = (), top: int = 3
) -> DataFrame:
    """Inverse-score mean of the best ``top`` parameter rows; integer parameters are rounded.

    One row per trained fold, so the per-key window is small.
    """
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    best = params.withColumn("_r", F.row_number().over(order.orderBy(score, *names))).where(F.col("_r") <= top)
    weight = 1.0 / F.col(score)
    means = []
    for n in names:
        mean = F.sum(weight * F.coalesce(F.col(n), F.lit(0))) / F.sum(weight)
        means.append((F.bround(mean, 0).cast("bigint") if n in integers else mean).alias(n))
    return best.groupBy(*keys).agg(*means)


def bootstrap_mean(df: DataFrame, keys: Sequence[str], value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """2.5 and 97.5 percentiles of resampled means of a short list of scores per key.

    The input has one row per fold. Draws come from hashes of (draw, slot, seed): repeatable and
    without a random stream.
    """
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    drawn = lists.select(*keys, "_v", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    size = F.size("_v")
    picks = F.transform(
        F.sequence(F.lit(1), size),
        lambda slot: F.element_at("_v", (digest_number(F.concat_ws(",", F.col("draw"), slot, F.lit(seed))) % size + 1).cast("int")),
    )
    means = drawn.select(*keys, (F.aggregate(picks, F.lit(0.0), lambda a, x: a + x) / size).alias("mean"))
    interval = exact_quantiles(means, keys, "mean", {"ci_low": 0.025, "ci_high": 0.975})
    centre = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return null_safe_join(centre, interval, keys, "inner") if keys else centre.select(
        "mean", *[interval.select(c).scalar().alias(c) for c in ("ci_low", "ci_high")]
    )
