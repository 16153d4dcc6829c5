"""Harvested area: shares, scaling factors, allocation, seasonal split, roll-ups and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import calendar, taxonomy
from gridspark.operators.scale import keep_last, literal_rows, null_safe_join, share_of, spearman


def functional_types(spark) -> DataFrame:
    """Lookup ``(crop, cft)``."""
    rows = [(crop, cft) for cft, crops in taxonomy.FUNCTIONAL_TYPES.items() for crop in crops]
    return literal_rows(spark, rows, "crop string, cft string")


def group_members(spark, groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Bridge ``(code, crop)``; one crop may feed several codes."""
    groups = {**taxonomy.CODE_CROPS, **taxonomy.GROUP_CROPS} if groups is None else groups
    return literal_rows(spark, [(code, crop) for code, crops in groups.items() for crop in crops], "code string, crop string")


def decode_years(df: DataFrame, raw: str, first: int = 2000, last: int = 2024) -> DataFrame:
    """Years from an offset axis, limited to a window."""
    return df.withColumn("year", calendar.half_even_years(F.col(raw))).where(F.col("year").between(first, last))


def sanitise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL, NaN, infinite and non-positive values become 0."""

    def clean(c: Column) -> Column:
        good = c.isNotNull() & ~F.isnan(c.cast("double")) & (c > 0) & (c < F.lit(float("inf")))
        return F.when(good, c).otherwise(F.lit(0.0))

    return df.withColumns({c: clean(F.col(c)) for c in columns})


def crop_shares(area: DataFrame, types: DataFrame, value: str = "harvarea") -> DataFrame:
    """Share of each crop in the area of its functional type per cell; 0/0 gives 0."""
    typed = sanitise(area, [value]).join(types, "crop")
    return share_of(typed, ["cell_id", "cft"], value, "share")


def scaling_factors(base: DataFrame, update: DataFrame | None = None, crop: str = "CROPGRIDS") -> DataFrame:
    """Factor per (crop, country, year) from two tables of which the second may miss columns.

    Rows of unusable crop names go, factors are clipped to 0..10, the last duplicate in table order
    wins and a missing country is -1. Both tables carry ``line`` for their row order.
    """
    both = base.withColumn("_table", F.lit(0))
    if update is not None:
        renamed = update.withColumnsRenamed({"area_ha": "area_y", "bbase_area": "base_area"})
        both = both.unionByName(renamed.withColumn("_table", F.lit(1)), allowMissingColumns=True)
    # Crop names without a counterpart.
    usable = both.where(F.col(crop).isNotNull() & ~F.col(crop).isin("other", "yautia", "No", "No "))
    keyed = usable.select(
        F.col(crop).alias("crop"),
        F.coalesce(F.col("country_code").cast("int"), F.lit(-1)).alias("country_code"),
        F.col("year").cast("int").alias("year"),
        F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("change_prop"))).alias("factor"),
        "_table",
        "line",
    )
    return keep_last(keyed, ["crop", "country_code", "year"], ["_table", "line"]).drop("_table", "line")


def allocate_area(
    fractions: DataFrame, shares: DataFrame, cells: DataFrame, factors: DataFrame
) -> DataFrame:
    """Area per crop, year and cell = type fraction x cell area x crop share x factor, split by irrigation.

    ``fractions``: year, cell_id, cft, frac, irrig_frac. ``shares``: crop, cft, cell_id, share.
    ``cells``: cell_id, country_code, area_ha. A missing factor is 1.
    """
    joined = (
        shares.where(F.col("share") > 0)
        .join(cells, "cell_id")
        .join(fractions, ["cell_id", "cft"])
        .join(factors, ["crop", "country_code", "year"], "left")
    )
    total = F.col("frac") * F.col("area_ha") * F.col("share") * F.coalesce(F.col("factor"), F.lit(1.0))
    irrigated = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("irrig_frac"), F.lit(0.0))))
    return joined.select(
        "crop",
        "year",
        "cell_id",
        total.alias("harvested_area"),
        (total * irrigated).alias("harvested_area_irrigated"),
        (total * (1 - irrigated)).alias("harvested_area_rainfed"),
    )


def area_summary(area: DataFrame) -> DataFrame:
    """Mean yearly total in million hectares and mean irrigated percentage per crop."""
    yearly = area.groupBy("crop", "year").agg(
        F.sum("harvested_area").alias("total"), F.sum("harvested_area_irrigated").alias("irrigated")
    )
    percent = F.when(F.col("total") > 0, F.col("irrigated") / F.col("total") * 100).otherwise(0.0)
    return yearly.groupBy("crop").agg(
        (F.avg("total") / 1e6).alias("mean_total_mha"), F.avg(percent).alias("mean_irrigated_pct")
    )


def season_months(calendars: DataFrame, keys: Sequence[str], table=calendar.SEASON_MONTHS) -> DataFrame:
    """Month weights of a planting and maturity day: ``keys, month, weight``."""
    weights = calendar.season_weights(F.col("planting_day"), F.col("maturity_day"), table)
    return calendars.select(*keys, F.posexplode(weights).alias("_p", "weight")).select(
        *keys, (F.col("_p") + 1).alias("month"), "weight"
    )


def annual_to_months(annual: DataFrame, calendars: DataFrame, table=calendar.SEASON_MONTHS) -> DataFrame:
    """Spread yearly irrigated and rainfed area over the months of their own seasons.

    ``annual``: crop, year, cell_id, harvested_area_irrigated, harvested_area_rainfed. ``calendars``:
    crop, system ('ir' or 'rf'), cell_id, planting_day, maturity_day. A missing season gives 0; a crop
    without any calendar is left out. Both seasons travel in one row per cell, so the area table is
    joined once and the 12 months come from an array.
    """

    def day(system: str, name: str) -> Column:
        return F.max(F.when(F.col("system") == system, F.col(name))).alias(f"{system}_{name}")

    seasons = calendars.groupBy("crop", "cell_id").agg(
        *[day(s, n) for s in ("ir", "rf") for n in ("planting_day", "maturity_day")]
    )
    known = calendars.select("crop").distinct()
    joined = annual.join(known, "crop", "left_semi").join(seasons, ["crop", "cell_id"], "left")
    pairs = F.arrays_zip(
        calendar.season_weights(F.col("ir_planting_day"), F.col("ir_maturity_day"), table).alias("ir"),
        calendar.season_weights(F.col("rf_planting_day"), F.col("rf_maturity_day"), table).alias("rf"),
    )
    months = joined.select(
        "crop", "year", "cell_id", "harvested_area_irrigated", "harvested_area_rainfed", F.posexplode(pairs).alias("_p", "_w")
    )
    irrigated = F.coalesce("harvested_area_irrigated", F.lit(0.0)) * F.col("_w.ir")
    rainfed = F.coalesce("harvested_area_rainfed", F.lit(0.0)) * F.col("_w.rf")
    return months.select(
        "crop",
        "year",
        (F.col("_p") + 1).alias("month"),
        "cell_id",
        irrigated.alias("harvested_area_irrigated"),
        rainfed.alias("harvested_area_rainfed"),
        (irrigated + rainfed).alias("harvested_area_total"),
    )


def roll_up(df: DataFrame, members: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sum member crops into codes; missing values count as 0.

    Rows are summed per crop before the bridge multiplies them.
    """
    sums = [F.sum(F.coalesce(F.col(v), F.lit(0.0))).alias(v) for v in values]
    per_crop = df.groupBy("crop", *keys).agg(*sums)
    return per_crop.join(members, "crop").groupBy("code", *keys).agg(*[F.sum(v).alias(v) for v in values])


def missing_members(df: DataFrame, members: DataFrame) -> DataFrame:
    """Member crops that have no data."""
    return members.join(df.select("crop").distinct(), "crop", "left_anti")


def validate_area(ours: DataFrame, theirs: DataFrame, block: Column, min_cells: int = 10) -> DataFrame:
    """Totals, non-zero counts, ratio and correlations of two areas per crop.

    Both tables have ``crop, cell_id, area``. Correlations use coarse cells (``block`` of ``cell_id``)
    where either side is positive, and only beyond ``min_cells`` of them.
    """

    def tidy(df: DataFrame, name: str) -> DataFrame:
        clean = sanitise(df, ["area"])
        return clean.select("crop", "cell_id", F.col("area").alias(name))

    a, b = tidy(ours, "a"), tidy(theirs, "b")
    cells = a.unionByName(b, allowMissingColumns=True).groupBy("crop", "cell_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    coarse = cells.groupBy("crop", block.alias("block")).agg(
        F.sum(F.coalesce("a", F.lit(0.0))).alias("a"),
        F.sum(F.coalesce("b", F.lit(0.0))).alias("b"),
        F.sum((F.col("a") > 0).cast("int")).alias("na"),
        F.sum((F.col("b") > 0).cast("int")).alias("nb"),
        F.max(F.col("a").isNotNull()).alias("ha"),
        F.max(F.col("b").isNotNull()).alias("hb"),
    )
    either = (F.col("a") > 0) | (F.col("b") > 0)
    totals = coarse.groupBy("crop").agg(
        (F.sum("a") / 1e6).alias("pipeline_total_mha"),
        F.coalesce(F.sum("na"), F.lit(0)).alias("pipeline_nonzero_cells"),
        (F.sum("b") / 1e6).alias("reference_total_mha"),
        F.coalesce(F.sum("nb"), F.lit(0)).alias("reference_nonzero_cells"),
        F.max("ha").alias("_ha"),
        F.max("hb").alias("_hb"),
        F.count(F.when(either, 1)).alias("_cells"),
        F.corr(F.when(either, F.col("a")), F.when(either, F.col("b"))).alias("_pearson"),
    )
    ranks = spearman(coarse.where(either), ["crop"], "a", "b", "_spearman")
    status = (
        F.when(~F.col("_ha"), "pipeline_missing")
        .when(~F.col("_hb"), "reference_missing")
        .when(F.col("reference_total_mha") == 0, "reference_zero")
        .otherwise("ok")
    )
    enough = (status == "ok") & (F.col("_cells") > min_cells)
    return (
        totals.join(ranks, "crop", "left")
        .withColumns(
            {
                "status": status,
                "ratio": F.when(status == "ok", F.col("pipeline_total_mha") / F.col("reference_total_mha")),
                "pearson_r": F.when(enough & ~F.isnan("_pearson"), F.col("_pearson")),
                "spearman_r": F.when(enough, F.col("_spearman")),
            }
        )
        .drop("_ha", "_hb", "_cells", "_pearson", "_spearman")
    )


def flag_ratios(df: DataFrame, ratio: str = "ratio") -> DataFrame:
    r = F.col(ratio)
    flag = F.when((r > 0.3) & (r < 3.0), "ok").when((r > 0.1) & (r < 10.0), "warn").otherwise("bad")
    return df.withColumn("flag", F.when(r.isNotNull(), flag))


def correlation_range(df: DataFrame, name: str = "crop", r: str = "pearson_r") -> DataFrame:
    """Mean, lowest and highest correlation with the crops they belong to."""
    low = F.min(F.when(F.col(r).isNotNull(), F.struct(F.col(r).alias("r"), F.col(name).alias("n"))))
    high = F.min(F.when(F.col(r).isNotNull(), F.struct((-F.col(r)).alias("r"), F.col(name).alias("n"))))
    return df.agg(
        F.avg(r).alias("mean_r"),
        low["r"].alias("min_r"),
        low["n"].alias("min_name"),
        (-high["r"]).alias("max_r"),
        high["n"].alias("max_name"),
    )
