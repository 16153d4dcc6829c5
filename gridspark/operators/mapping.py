"""Country and sector mapping: history merge, split weights, allocation, accounts."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import taxonomy
from gridspark.operators.scale import exact_quantiles, literal_rows, null_safe_join, one_row, share_of, spearman
from gridspark.session import cut_lineage


def merge_history(history: DataFrame, prediction: DataFrame, rule: str = "keep_historical") -> DataFrame:
    """Union of both with the overlapping years taken from one side only."""
    if rule not in ("keep_historical", "keep_prediction"):
        raise ValueError(f"unknown overlap rule {rule!r}")
    columns = ["year", "country", "crop", "value"]
    if rule == "keep_historical":
        kept = history.select(columns)
        other = prediction.select(columns).join(history.select("year").distinct(), "year", "left_anti")
    else:
        kept = prediction.select(columns)
        other = history.select(columns).join(prediction.select("year").distinct(), "year", "left_anti")
    return kept.unionByName(other.select(columns))


def discontinuity(merged: DataFrame, history: DataFrame) -> DataFrame:
    """Change of the global total, in percent, from the last historical year to the next."""
    last = one_row(history, F.max("year").alias("y"))["y"]
    edge = merged.where(F.col("year").between(last, last + 1))
    before = F.sum(F.when(F.col("year") == last, F.col("value")))
    after = F.sum(F.when(F.col("year") == last + 1, F.col("value")))
    return edge.agg(((after - before) / before * 100).alias("change_pct"))


def sector_lookup(spark) -> DataFrame:
    """``(crop, sector)`` of the crops that belong to one sector."""
    return literal_rows(spark, list(taxonomy.CROP_SECTOR.items()), "crop string, sector string")


def concordance_rows() -> list[tuple[str, str, str]]:
    """The fixed concordance (statistics crop, crop code, sector); a few kilobytes beside this package, read by the driver."""
    with (Path(__file__).parents[1] / "data" / "crop_concordance.csv").open(newline="", encoding="utf-8") as file:
        lines = [line for line in file if not line.startswith("#")]
    return [(r["crop_175"], r["crop_27"], r["sector_14"]) for r in csv.DictReader(lines)]


def crop_concordance(spark) -> DataFrame:
    """``(crop, crop_group, sector)`` as ``sector_values`` takes it."""
    return literal_rows(spark, concordance_rows(), "crop string, crop_group string, sector string")


def match_items(items: DataFrame, item: str, names: str) -> DataFrame:
    """Statistics item to grid crop names; the names column may list several, separated by ``;``.

    Only ``;`` separates: a name may hold commas.
    """
    return items.select(F.col(item).alias("item"), F.explode(F.split(F.col(names), r"\s*;\s*")).alias("crop")).where(
        F.trim("crop") != ""
    )


def sector_values(crops: DataFrame, crop_map: DataFrame, country_map: DataFrame) -> DataFrame:
    """Sum of detailed crops per (country, crop group, sector, year).

    ``crops``: country, crop, year, value. ``crop_map``: crop, crop_group, sector. ``country_map``:
    country, region. Values are summed per country and crop before the two lookups.
    """
    sums = crops.groupBy("country", "crop", "year").agg(F.sum("value").alias("value"))
    joined = sums.join(crop_map, "crop").join(country_map, "country")
    return joined.groupBy("region", "crop_group", "sector", "year").agg(F.sum("value").alias("value"))


def rolling_weights(values: DataFrame, window: int = 5) -> DataFrame:
    """Sector shares per year from a centred window, cut at the ends of the record.

    Each row joins the mean of every year whose window covers it, over the rows that exist, and the
    means are turned into shares of (region, crop group, year).
    """
    half = window // 2
    span = one_row(values, F.min("year").alias("lo"), F.max("year").alias("hi"))
    covered = F.sequence(F.greatest(F.col("year") - half, span["lo"]), F.least(F.col("year") + half, span["hi"]))
    offers = values.select("region", "crop_group", "sector", "value", F.explode(covered).alias("year"))
    means = offers.groupBy("region", "crop_group", "sector", "year").agg(F.avg("value").alias("_mean"))
    return share_of(means, ["region", "crop_group", "year"], "_mean", "weight").drop("_mean")


def recent_weights(values: DataFrame, first: int = 2015, last: int = 2018) -> DataFrame:
    """Sector shares of the mean over a fixed period."""
    means = (
        values.where(F.col("year").between(first, last))
        .groupBy("region", "crop_group", "sector")
        .agg(F.avg("value").alias("_mean"))
    )
    return share_of(means, ["region", "crop_group"], "_mean", "weight").drop("_mean")


def check_weights(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of groups and of groups whose weights do not add up to 1."""
    sums = weights.groupBy(*keys).agg(F.sum("weight").alias("s"))
    off = (F.col("s") < 0.999) | (F.col("s") > 1.001)
    return sums.agg(F.count(F.lit(1)).alias("n_groups"), F.count(F.when(off, 1)).alias("n_bad"))


def map_regions(values: DataFrame, regions: DataFrame) -> DataFrame:
    """Values with their region; unmapped countries drop out (see ``unmapped``)."""
    return values.join(regions, "country")


def unmapped(values: DataFrame, regions: DataFrame) -> DataFrame:
    """Countries without a region and what they add up to."""
    lost = values.join(regions, "country", "left_anti")
    return lost.groupBy("country").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("value"))


def allocate_direct(values: DataFrame, sectors: DataFrame) -> DataFrame:
    """Crops of one sector, summed: ``year, region, sector, allocated``."""
    return (
        values.join(sectors, "crop").groupBy("year", "region", "sector").agg(F.sum("value").alias("allocated"))
    )


def allocate_split(values: DataFrame, rolling: DataFrame, recent: DataFrame) -> DataFrame:
    """Crops split by weights: years with rolling weights use those, later years the recent ones.

    Values are summed per (year, region, crop) first. A group without weights allocates nothing.
    """
    sums = values.groupBy("year", "region", "crop").agg(F.sum("value").alias("value"))
    known = rolling.select("year").distinct()
    parts = []
    for rows, weights, on in (
        (sums.join(known, "year", "left_semi"), rolling, ["region", "crop", "year"]),
        (sums.join(known, "year", "left_anti"), recent, ["region", "crop"]),
    ):
        named = weights.withColumnRenamed("crop_group", "crop")
        joined = rows.join(named, on)
        parts.append(joined.select("year", "region", "sector", (F.col("value") * F.col("weight")).alias("allocated")))
    return parts[0].unionByName(parts[1]).groupBy("year", "region", "sector").agg(F.sum("allocated").alias("allocated"))


def lost_mass(values: DataFrame, rolling: DataFrame, recent: DataFrame) -> DataFrame:
    """Value of split crops for which no weights exist."""
    known = rolling.select("year").distinct()
    sums = values.groupBy("year", "region", "crop").agg(F.sum("value").alias("value"))
    total = rolling.groupBy("region", F.col("crop_group").alias("crop"), "year").agg(F.sum("weight").alias("_w"))
    past = sums.join(known, "year", "left_semi").join(total, ["region", "crop", "year"], "left")
    later_total = recent.groupBy("region", F.col("crop_group").alias("crop")).agg(F.sum("weight").alias("_w"))
    later = sums.join(known, "year", "left_anti").join(later_total, ["region", "crop"], "left")
    both = past.unionByName(later).where(F.coalesce("_w", F.lit(0.0)) == 0)
    return both.groupBy("year", "region", "crop").agg(F.sum("value").alias("lost"))


def complete_table(
    allocated: DataFrame, regions: DataFrame, years: Sequence[int], sectors: Sequence[str], out: str = "waterstress"
) -> DataFrame:
    """All years x regions x sectors with their order numbers; absent combinations are 0.

    ``regions``: region, region_ord. Years and sectors are short fixed lists and expand each region.
    """
    skeleton = regions.select("region", "region_ord", F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("year"))
    names = F.posexplode(F.array(*[F.lit(s) for s in sectors])).alias("sector_ord", "sector")
    skeleton = skeleton.select("*", names)
    sums = allocated.groupBy("year", "region", "sector").agg(F.sum("allocated").alias(out))
    return skeleton.join(sums, ["year", "region", "sector"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def conservation(original: DataFrame, mapped: DataFrame, value: str = "value", out: str = "waterstress") -> DataFrame:
    """Total before and after the mapping, difference in percent and NULL count."""
    before = one_row(original, F.sum(value).alias("t"))["t"]
    after = mapped.agg(F.sum(out).alias("mapped_total"), F.count(F.when(F.col(out).isNull(), 1)).alias("n_null"))
    diff = F.abs(F.col("mapped_total") - F.col("original_total")) / F.col("original_total") * 100
    return after.withColumn("original_total", before).withColumn(
        "diff_pct", F.when(F.col("original_total") > 0, diff).otherwise(0.0)
    )


def flat_account(table: DataFrame, n_sectors: int = 120, value: str = "waterstress") -> DataFrame:
    """Position ``region * n_sectors + sector`` of every non-zero value; zeros are left out."""
    kept = table.where(F.col(value) != 0)
    return kept.select("year", (F.col("region_ord") * n_sectors + F.col("sector_ord")).alias("idx"), F.col(value).alias("value"))


def supply_use_blocks(cells: DataFrame, block: int = 240, half: int = 120) -> DataFrame:
    """Region-sector flows from supply-use cells: product rows and industry columns of each block."""
    kept = cells.where((F.col("row") % block >= half) & (F.col("col") % block < half))
    return kept.select(
        F.floor(F.col("row") / block).alias("from_region"),
        (F.col("row") % block - half).alias("from_sector"),
        F.floor(F.col("col") / block).alias("to_region"),
        (F.col("col") % block).alias("to_sector"),
        "value",
    )


def demand_rows(cells: DataFrame, block: int = 240, half: int = 120) -> DataFrame:
    """Final-demand cells of product rows: ``from_region, from_sector, col, value``."""
    kept = cells.where(F.col("row") % block >= half)
    return kept.select(
        F.floor(F.col("row") / block).alias("from_region"), (F.col("row") % block - half).alias("from_sector"), "col", "value"
    )


def value_added_columns(cells: DataFrame, block: int = 240, half: int = 120) -> DataFrame:
    """Value-added cells of industry columns: ``row, to_region, to_sector, value``."""
    kept = cells.where(F.col("col") % block < half)
    return kept.select("row", F.floor(F.col("col") / block).alias("to_region"), (F.col("col") % block).alias("to_sector"), "value")


def demand_by_region(demand: DataFrame, categories: int = 6) -> DataFrame:
    """Final demand summed over the categories of each destination region."""
    region = F.floor(F.col("col") / categories)
    return demand.groupBy("from_region", "from_sector", region.alias("to_region")).agg(F.sum("value").alias("value"))


def supply_columns(cells: DataFrame, n_sectors: int = 120) -> DataFrame:
    """Account cells in supply columns as ``row, region, sector, value``."""
    return value_added_columns(cells, 2 * n_sectors, n_sectors).select(
        "row", F.col("to_region").alias("region"), F.col("to_sector").alias("sector"), "value"
    )


def hybrid_account(
    ours: DataFrame,
    reference: DataFrame,
    own_sectors: int = 14,
    agri_row: int = 390,
    other_row: int = 391,
    include_other: bool = False,
    unit: float = 1e6,
) -> DataFrame:
    """Own values for the first sectors, reference rows for the rest.

    ``ours``: year, region, sector, value. ``reference``: year, row, region, sector, value.
    """
    own = ours.where(F.col("sector") < own_sectors).select("year", "region", "sector", (F.col("value") / unit).alias("value"))
    rows = [agri_row, other_row] if include_other else [agri_row]
    rest = reference.where(F.col("row").isin(rows) & (F.col("sector") >= own_sectors))
    # Years without an own account are not built.
    rest = rest.join(ours.select("year").distinct(), "year", "left_semi")
    both = own.unionByName(rest.select("year", "region", "sector", "value"))
    return both.groupBy("year", "region", "sector").agg(F.sum("value").alias("value"))


def account_agreement(ours: DataFrame, theirs: DataFrame, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Agreement of two accounts per key at cell and region level.

    Both tables have ``keys, region, sector, value`` and may leave zeros out, but the pair must be
    complete between them: RMSE runs over the cells either side lists.
    """
    keys = list(keys)
    a = ours.select(*keys, "region", "sector", F.col("value").alias("a"))
    b = theirs.select(*keys, "region", "sector", F.col("value").alias("b"))
    cells = (
        a.unionByName(b, allowMissingColumns=True)
        .groupBy(*keys, "region", "sector")
        .agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("b"))
    )
    # Both levels are read by every score.
    cells = cut_lineage(cells)
    regions = cut_lineage(cells.groupBy(*keys, "region").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    either = (F.col("a") > 0) | (F.col("b") > 0)
    both = (F.col("a") > 0) & (F.col("b") > 0)

    def safe_corr(x: Column, y: Column, when: Column) -> Column:
        return F.when(F.count(F.when(when, 1)) > 2, F.corr(F.when(when, x), F.when(when, y)))

    diff = F.col("a") - F.col("b")
    at_cell = cells.groupBy(*keys).agg(
        F.sum("a").alias("our_total"),
        F.sum("b").alias("reference_total"),
        F.when(F.sum("b") > 0, F.sum("a") / F.sum("b")).alias("ratio_total"),
        safe_corr(F.col("a"), F.col("b"), either).alias("pearson_cell"),
        F.sqrt(F.avg(diff * diff)).alias("rmse_cell"),
        (F.avg(F.when(F.col("b") > 0, F.abs(diff / F.col("b")))) * 100).alias("mape_cell_pct"),
    )
    ratio = F.when(both, F.col("a") / F.col("b"))
    at_region = regions.groupBy(*keys).agg(
        F.count(F.when(both, 1)).alias("country_ratio_n_total"),
        F.count(F.when((ratio > 0.5) & (ratio < 2.0), 1)).alias("country_ratio_n_within_2x"),
        safe_corr(F.col("a"), F.col("b"), either).alias("pearson_country"),
        safe_corr(F.log1p("a"), F.log1p("b"), either).alias("pearson_country_log1p"),
    )
    quartiles = exact_quantiles(
        regions.select(*keys, ratio.alias("_r")),
        keys,
        "_r",
        {"country_ratio_p25": 0.25, "country_ratio_median": 0.5, "country_ratio_p75": 0.75},
    )
    out = null_safe_join(at_cell, at_region, keys, "inner")
    for part, how in (
        (quartiles, "left"),
        (spearman(cells.where(either), keys, "a", "b", "spearman_cell"), "left"),
        (spearman(regions.where(either), keys, "a", "b", "spearman_country"), "left"),
    ):
        out = null_safe_join(out, part, keys, how)
    return out


def composition(ours: DataFrame, theirs: DataFrame, keys: Sequence[str] = ("year",), own: int = 14, wide: int = 20) -> DataFrame:
    """Share of the own sectors in the wider agricultural total, and the same share in the reference."""
    keys = list(keys)
    a = ours.groupBy(*keys).agg(F.sum(F.when(F.col("sector") < own, F.col("value"))).alias("our_own"))
    b = theirs.groupBy(*keys).agg(
        F.sum(F.when(F.col("sector").between(own, wide - 1), F.col("value"))).alias("reference_rest"),
        F.sum(F.when(F.col("sector") < own, F.col("value"))).alias("reference_own"),
        F.sum(F.when(F.col("sector") < wide, F.col("value"))).alias("reference_wide"),
    )
    joined = null_safe_join(a, b, keys, "inner")
    hybrid = F.coalesce("our_own", F.lit(0.0)) + F.coalesce("reference_rest", F.lit(0.0))
    return joined.withColumns(
        {
            "hybrid_total": hybrid,
            "pct_own_in_hybrid": F.when(hybrid > 0, F.col("our_own") / hybrid * 100),
            "pct_own_in_reference": F.when(F.col("reference_wide") > 0, F.col("reference_own") / F.col("reference_wide") * 100),
        }
    )


def region_groups(groups: DataFrame, members: str = "members") -> DataFrame:
    """Bridge ``(region_group, country)`` from a map of group to member list."""
    return groups.select(F.explode(members).alias("region_group", "_list")).select("region_group", F.explode("_list").alias("country"))
