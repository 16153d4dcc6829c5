"""Publication grids, shares, flow tables and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.functions import taxonomy
from gridspark.operators.scale import null_safe_join, one_row, share_of, spearman


# So many categories can be columns of one table.
MAX_CATEGORIES = 1000


def wide_grid(df: DataFrame, keys: Sequence[str], value: str = "waterstress", crops: Sequence[str] = tuple(taxonomy.BAND_ORDER)) -> DataFrame:
    """One column per crop in the fixed order of published grids; absent crops are NULL."""
    return df.groupBy(*keys).agg(*[F.first(F.when(F.col("crop") == c, F.col(value)), ignorenulls=True).alias(c) for c in crops])


def yearly_by_crop(df: DataFrame, value: str = "waterstress") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy("year", "crop", "cell_id").agg(F.sum(value).alias(value))


def yearly_total(df: DataFrame, value: str = "waterstress") -> DataFrame:
    """Sum over crops where any crop has data."""
    return df.where(F.col(value).isNotNull()).groupBy("year", "cell_id").agg(F.sum(value).alias(value))


def region_year_totals(df: DataFrame, lookup: DataFrame, value: str = "waterstress") -> DataFrame:
    """Country and global totals with counts of non-zero cells.

    The global rows include cells outside every country. ``lookup``: cell_id, country.
    """
    cells = yearly_by_crop(df, value).where(F.col(value) != 0).join(lookup.select("cell_id", "country"), "cell_id", "left")
    parts = cells.groupBy("year", "crop", "country").agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n_cells"))
    world = parts.groupBy("year", "crop").agg(F.sum(value).alias(value), F.sum("n_cells").alias("n_cells"))
    return parts.where(F.col("country").isNotNull()).unionByName(world.withColumn("country", F.lit("GLOBAL")))


def monthly_profile(df: DataFrame, keys: Sequence[str], value: str = "waterstress") -> DataFrame:
    """Total per month with all 12 months, 0 where there is none."""
    months = [F.sum(F.when(F.col("month") == m, F.col(value)).otherwise(0.0)).alias(f"m{m}") for m in range(1, 13)]
    wide = df.groupBy(*keys).agg(*months)
    return wide.select(*keys, F.posexplode(F.array(*[f"m{m}" for m in range(1, 13)])).alias("_p", value)).select(
        *keys, (F.col("_p") + 1).alias("month"), value
    )


PANELS = {
    "crop": "Crop",
    "production_country": "Production country",
    "consumption_country": "Consumption country",
    "target_sector": "Target sector",
}


def share_tables(flows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Value, total, percent and label of each category per scope and panel.

    Scope ``global`` takes all flows, ``trade`` those between different countries. Flows are summed
    over the four dimensions once; scopes and panels are written out from that small table.
    """
    keys = list(keys)
    base = flows.groupBy(*keys, *PANELS).agg(F.sum("value").alias("value"))
    trade = F.col("production_country") != F.col("consumption_country")
    scopes = F.when(trade, F.array(F.lit("global"), F.lit("trade"))).otherwise(F.array(F.lit("global")))
    scoped = base.select("*", F.explode(scopes).alias("scope"))
    panels = F.array(*[F.struct(F.lit(label).alias("panel"), F.col(c).alias("cat")) for c, label in PANELS.items()])
    long = scoped.select(*keys, "scope", "value", F.inline(panels))
    sums = long.groupBy(*keys, "scope", "panel", "cat").agg(F.sum("value").alias("value"))
    totals = sums.groupBy(*keys, "scope", "panel").agg(F.sum("value").alias("total_value"))
    joined = null_safe_join(sums, totals, [*keys, "scope", "panel"], "inner")
    percent = F.when(F.col("total_value") != 0, F.col("value") / F.col("total_value") * 100)
    return joined.withColumn("percent", percent).withColumn(
        "percent_label", F.concat(F.expr("format_number(round(percent, 1), '0.#')"), F.lit("%"))
    )


def share_pivot(shares: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """One percent column per category, 0 where absent. Without a list, every category found gets its column; more than
    ``MAX_CATEGORIES`` are an error."""
    if categories is None:
        categories = [r["cat"] for r in shares.select("cat").distinct().orderBy("cat").limit(MAX_CATEGORIES + 1).collect()]
        if len(categories) > MAX_CATEGORIES:
            raise ValueError(f"more than {MAX_CATEGORIES} categories; name those that are wanted")
    picks = [F.sum(F.when(F.col("cat") == c, F.col("percent")).otherwise(0.0)).alias(c) for c in categories]
    return shares.groupBy("scope", "panel").agg(*picks)


def flow_pairs(flows: DataFrame) -> DataFrame:
    """Flows between neighbouring layers: crop, producer, consumer, target."""
    base = flows.groupBy(*PANELS).agg(F.sum("value").alias("value"))
    pairs = F.array(
        *[
            F.struct(F.lit(stage).alias("stage"), F.col(a).alias("source"), F.col(b).alias("target"))
            for stage, a, b in (
                ("crop_producer", "crop", "production_country"),
                ("producer_consumer", "production_country", "consumption_country"),
                ("consumer_target", "consumption_country", "target_sector"),
            )
        ]
    )
    return base.select("value", F.inline(pairs)).groupBy("stage", "source", "target").agg(F.sum("value").alias("value"))


def country_order(flows: DataFrame) -> DataFrame:
    """Countries by produced plus consumed volume."""
    made = F.struct(F.col("production_country").alias("country"), F.col("value").alias("vp"), F.lit(0.0).alias("vc"))
    used = F.struct(F.col("consumption_country").alias("country"), F.lit(0.0).alias("vp"), F.col("value").alias("vc"))
    sums = flows.select(F.inline(F.array(made, used))).groupBy("country").agg(F.sum("vp").alias("vp"), F.sum("vc").alias("vc"))
    return sums.withColumn("v_total", F.col("vp") + F.col("vc")).orderBy(F.desc("v_total"), "country")


def sector_layers(flows: DataFrame, sector: str) -> DataFrame:
    """Layer shares of one target sector with running offsets by falling value.

    The window runs over the categories of one layer.
    """
    sub = flows.where(F.col("target_sector") == sector)
    layers = ("crop", "production_country", "consumption_country")
    rows = F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("label")) for c in layers])
    sums = sub.select("value", F.inline(rows)).groupBy("layer", "label").agg(F.sum("value").alias("value"))
    shares = share_of(sums, ["layer"], "value", "share")
    run = Window.partitionBy("layer").orderBy(F.desc("value"), "label").rowsBetween(Window.unboundedPreceding, 0)
    return shares.withColumn("offset", F.sum("share").over(run) - F.col("share"))


def top_and_rest(df: DataFrame, name: str, value: str, keys: Sequence[str], n: int, rest: str = "Remaining") -> DataFrame:
    """Keep the ``n`` names with the largest mean and sum all others as ``rest``."""
    means = df.groupBy(name).agg(F.avg(value).alias("_m")).orderBy(F.desc("_m"), name).limit(n)
    marked = df.join(means.select(name, F.lit(True).alias("_top")), name, "left")
    group = F.when(F.col("_top"), F.col(name)).otherwise(F.lit(rest)).alias("group")
    return marked.groupBy(group, *keys).agg(F.sum(value).alias(value))


def metric_pivot(df: DataFrame, metrics: Sequence[str], models: Sequence[str] = ("G", "GW")) -> DataFrame:
    """``metric_model`` columns per crop from ``crop, model, <metrics>``."""
    picks = [F.max(F.when(F.col("model") == m, F.col(x))).alias(f"{x}_{m}") for x in metrics for m in models]
    return df.groupBy("crop").agg(*picks)


def adoption_table(decisions: DataFrame) -> DataFrame:
    """Adopted and total regions with the sorted list of adopted ones per crop and layer.

    ``decisions``: crop, layer, region, adopted. A layer has at most a few dozen regions.
    """
    adopted = F.collect_list(F.when(F.col("adopted"), F.col("region")))
    return decisions.groupBy("crop", "layer").agg(
        F.count(F.when(F.col("adopted"), 1)).alias("n_adopted"),
        F.count(F.lit(1)).alias("n_total"),
        F.array_join(F.transform(F.array_sort(adopted), lambda r: r.cast("string")), ", ").alias("regions"),
    )


def weighted_comparison(unweighted: DataFrame, weighted: DataFrame) -> DataFrame:
    """Unweighted and weighted scores side by side with the selected variant."""
    joined = unweighted.join(weighted, "crop", "full")
    selected = F.when(F.col("crop").isin(*taxonomy.UNWEIGHTED_CROPS), "G+R").otherwise("GW+RW")
    return joined.withColumns({"selected": selected, "ctry_diff": F.col("ctry_GWR") - F.col("ctry_GR")})


def select_best(df: DataFrame, unweighted: str, weighted: str, out: str) -> DataFrame:
    """Metric of the variant a crop is routed to; a missing weighted value falls back."""
    routed = F.col("crop").isin(*taxonomy.UNWEIGHTED_CROPS)
    return df.withColumns(
        {
            "selected": F.when(routed, "G+R").otherwise("GW+RW"),
            out: F.when(routed, F.col(unweighted)).otherwise(F.coalesce(F.col(weighted), F.col(unweighted))),
        }
    )


def region_schemes(decisions: DataFrame, crops: Sequence[str] = taxonomy.CLIMATE_CLASS_CROPS) -> DataFrame:
    """Adopted regions of the climate-class crops with the scheme their layer used."""
    sizes = decisions.groupBy("crop", "layer").agg(F.count(F.lit(1)).alias("n_regions"))
    joined = decisions.where(F.col("crop").isin(*crops) & F.col("adopted")).join(sizes, ["crop", "layer"])
    return joined.withColumn("regime", F.when(F.col("n_regions") > 9, "30-class").otherwise("9-class"))


def predicted_vs_history(history: DataFrame, prediction: DataFrame) -> DataFrame:
    """Mean yearly totals of two periods and their ratio per crop."""
    h = history.groupBy("crop", "year").agg(F.sum("value").alias("v")).groupBy("crop").agg(F.avg("v").alias("hist_mean"))
    p = prediction.groupBy("crop", "year").agg(F.sum("value").alias("v")).groupBy("crop").agg(F.avg("v").alias("pred_mean"))
    joined = h.join(p, "crop", "full").fillna(0.0, ["hist_mean", "pred_mean"])
    return joined.withColumn("ratio", F.when(F.col("hist_mean") > 0, F.col("pred_mean") / F.col("hist_mean")).otherwise(0.0))


def correlation_tier(df: DataFrame, rho: str, out: str = "tier") -> DataFrame:
    """Strong from 0.5, moderate from 0.3, weak below or unknown."""
    return df.withColumn(out, F.when(F.col(rho) >= 0.5, "Strong").when(F.col(rho) >= 0.3, "Moderate").otherwise("Weak"))


def event_class(df: DataFrame, event: str = "event", indirect: Sequence[str] = tuple(taxonomy.INDIRECT_EVENTS)) -> DataFrame:
    label = F.when(F.col(event).isin(*indirect), "Indirect/Averaged").otherwise("Direct Water Stress")
    return df.withColumn("event_type", label)


def totals_vs_base(df: DataFrame, base_year: int = 2018, value: str = "value") -> DataFrame:
    """Yearly totals, change against a base year and whether a year is observed or predicted."""
    yearly = df.groupBy("year").agg(F.sum(value).alias("global_total"))
    found = yearly.where(F.col("year") == base_year)
    base = one_row(found, F.max("global_total").alias("b"))["b"]
    safe = F.when(base != 0, base).otherwise(1.0)
    return yearly.withColumns(
        {
            "vs_base_pct": (F.col("global_total") - safe) / safe * 100,
            "source": F.when(F.col("year") <= base_year, "historical").otherwise("predicted"),
        }
    )


def top_regions(df: DataFrame, years: Sequence[int], n: int = 30, top_crops: int = 3, name: str = "country", value: str = "value") -> DataFrame:
    """Largest regions by mean yearly value: yearly columns, mean, global percentage and leading crops.

    The ranking of crops is limited before it is gathered, and a region has a few dozen crops.
    """
    sums = df.where(F.col("year").isin(*years)).groupBy(name, "year", "crop").agg(F.sum(value).alias("v"))
    # A year no region has any value in is no column of the record.
    n_years = one_row(sums, F.count_distinct("year").alias("n"))["n"]
    columns = [F.sum(F.when(F.col("year") == y, F.col("v")).otherwise(0.0)).alias(f"y{y}") for y in years]
    wide = sums.groupBy(name).agg(*columns, F.sum("v").alias("_all")).withColumn("mean", F.col("_all") / n_years)
    world = one_row(wide, F.sum("mean").alias("t"))["t"]
    best = wide.orderBy(F.desc("mean"), name).limit(n).withColumn("pct_global", F.col("mean") / world * 100).drop("_all")
    per_crop = sums.join(best.select(name), name, "left_semi").groupBy(name, "crop").agg(F.sum("v").alias("v"))
    order = Window.partitionBy(name).orderBy(F.desc("v"), "crop")
    leading = per_crop.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_crops)
    lists = leading.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("_r", "crop"))).alias("_l"))
    labels = lists.select(name, F.array_join(F.transform("_l", lambda s: s["crop"]), ", ").alias("top_crops"))
    return best.join(labels, name)


def year_transition(df: DataFrame, name: str, before: int, after: int, value: str = "value") -> DataFrame:
    """Change of each name from one year to the next; names lacking either year are left out."""
    pair = df.where(F.col("year").isin(before, after)).groupBy(name).agg(
        F.sum(F.when(F.col("year") == before, F.col(value))).alias("val_before"),
        F.sum(F.when(F.col("year") == after, F.col(value))).alias("val_after"),
    )
    both = pair.where(F.col("val_before").isNotNull() & F.col("val_after").isNotNull())
    change = F.col("val_after") - F.col("val_before")
    return both.withColumns(
        {"abs_change": change, "change_pct": F.when(F.col("val_before") != 0, change / F.col("val_before") * 100)}
    )


def largest_changes(transition: DataFrame, name: str, n: int = 10) -> DataFrame:
    """The ``n`` largest rises and the ``n`` lowest changes."""
    up = transition.orderBy(F.desc("abs_change"), name).limit(n).withColumn("direction", F.lit("increase"))
    down = transition.orderBy(F.asc("abs_change"), F.desc(name)).limit(n).withColumn("direction", F.lit("decrease"))
    return up.unionByName(down)


def seasonality(history: DataFrame, prediction: DataFrame, key: str = "crop", value: str = "value", min_months: int = 4) -> DataFrame:
    """Rank agreement of mean monthly values, peak months and whether they are within one month."""

    def monthly(df: DataFrame, name: str) -> DataFrame:
        sums = df.groupBy(key, "year", "month").agg(F.sum(value).alias("_s"))
        return sums.groupBy(key, "month").agg(F.avg("_s").alias(name))

    h, p = monthly(history, "h"), monthly(prediction, "p")
    common = h.join(p, [key, "month"])
    counted = common.groupBy(key).agg(F.count(F.lit(1)).alias("n_common"))
    rho = spearman(common, [key], "h", "p", "seasonal_rho")

    def peak(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.groupBy(key).agg(F.max(F.struct(F.col(col), (-F.col("month")).alias("m"))).alias("_x")).select(
            key, (-F.col("_x.m")).alias(out)
        )

    joined = (
        counted.where(F.col("n_common") >= min_months)
        .join(rho, key)
        .join(peak(h, "h", "peak_month_hist"), key)
        .join(peak(p, "p", "peak_month_pred"), key)
    )
    near = F.abs(F.col("peak_month_hist") - F.col("peak_month_pred")) <= 1
    return joined.withColumn("peak_match", F.when(near, "yes").otherwise("no")).drop("n_common")


def contribution_table(contributions: DataFrame, top: int = 20) -> DataFrame:
    """Mean absolute contribution per feature, normalised within the crop, for the top features overall.

    ``contributions``: crop, feature, value. Features are ranked by their mean share over crops.
    """
    means = contributions.groupBy("crop", "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    shares = share_of(means, ["crop"], "mean_abs", "share")
    best = shares.groupBy("feature").agg(F.avg("share").alias("_m")).orderBy(F.desc("_m"), "feature").limit(top)
    return shares.join(best.select("feature"), "feature", "left_semi")


def importance_ranking(importance: DataFrame) -> DataFrame:
    """Mean normalised importance of each feature over crops, with rank and share.

    ``importance``: crop, feature, importance. One row per feature, which bounds the window.
    """
    shares = share_of(importance, ["crop"], "importance", "_norm")
    means = shares.groupBy("feature").agg(
        F.avg("_norm").alias("mean_importance"), F.stddev("_norm").alias("std_importance"), F.count(F.lit(1)).alias("n_crops")
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_importance"), "feature")
    ranked = means.withColumn("rank", F.row_number().over(order))
    return share_of(ranked, [], "mean_importance", "share")
