"""Model tables: the order of steps from raw rows to features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import taxonomy
from gridspark.operators import features
from gridspark.session import cut_lineage


def build_features(
    rows: DataFrame,
    indices: Sequence[DataFrame],
    coarse: DataFrame,
    regions: DataFrame,
    history: DataFrame | None = None,
    start_year: int | None = None,
    lag_columns: Sequence[str] = tuple(taxonomy.LAG_COLUMNS),
    roll_columns: Sequence[str] = tuple(taxonomy.ROLL_COLUMNS),
) -> DataFrame:
    """Features of all crops at once; rows have ``crop, cell_id, time, lat, lon`` and predictors.

    History first, then cleaning, calendar and location columns, monthly indices, coarse ids,
    imputation of the storage anomaly, lags, rolling means, regions, and the trim to the first year.
    ``coarse``: cell_id, grid50_id. ``regions``: cell_id, regiontype.
    """
    keys = ["crop", "cell_id"]
    if history is not None:
        rows = features.prepend_history(rows, history, keys, "time", start_year)
    df = features.drop_incomplete(rows)
    df = features.add_location(features.add_time_features(df, "time"))
    df = features.join_lookup(features.join_indices(df, indices), coarse)
    if "twsan" in df.columns:
        # Read for the medians and for the rows that get them.
        df = features.impute_medians(cut_lineage(df), "twsan", [keys, ["crop", "year", "month"], ["crop"]])
    df = features.add_lags(df, keys, "time", lag_columns)
    df = features.add_rolling(df, keys, "time", roll_columns)
    df = features.join_lookup(df, regions)
    return df if history is None else features.trim_years(df, start_year)


def add_area(rows: DataFrame, monthly: DataFrame, annual: DataFrame, groups: Sequence[str] = taxonomy.SPLIT_CROPS) -> DataFrame:
    """Irrigated area per row: monthly tables for single crops, yearly ones for crop groups."""
    single, grouped = ~F.col("crop").isin(*groups), F.col("crop").isin(*groups)
    keys = ["crop", "month", "cell_id"]
    a = features.asof_area(rows.where(single), monthly, keys, "harvested_area_irrigated")
    b = features.annual_area(rows.where(grouped), annual, ["crop", "cell_id"], "harvested_area_irrigated")
    return a.unionByName(b.select(a.columns))
