"""Irrigated harvested area, from type fractions to monthly areas per crop code."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridspark.functions import taxonomy
from gridspark.operators import area, regrid

AREAS = ["harvested_area_irrigated", "harvested_area_rainfed"]


def yearly_area(crop_area: DataFrame, fractions: DataFrame, cells: DataFrame, factors: DataFrame) -> DataFrame:
    """Yearly area per crop and cell of the fine grid."""
    shares = area.crop_shares(crop_area, area.functional_types(crop_area.sparkSession))
    return area.allocate_area(fractions, shares, cells, factors)


def coarse_area(yearly: DataFrame, cells: DataFrame, step: float = 5 / 60) -> DataFrame:
    """Area of single-crop codes on the target grid, total kept. ``cells``: cell_id, lat, lon.

    Crops are rolled up into codes before cells are moved, so fewer rows are shuffled twice.
    """
    members = area.group_members(yearly.sparkSession, taxonomy.CODE_CROPS)
    codes = area.roll_up(yearly, members, ["year", "cell_id"], AREAS).join(cells, "cell_id")
    n_lat, n_lon = round(180 / step), round(360 / step)
    binned = regrid.sum_bins(codes, ["code", "year"], AREAS, step, n_lat, n_lon)
    return binned.selectExpr("code AS crop", "year", f"lat_idx * {n_lon} + lon_idx AS cell_id", *AREAS)


def monthly_area(yearly: DataFrame, cells: DataFrame, calendars: DataFrame, step: float = 5 / 60) -> DataFrame:
    """Monthly irrigated, rainfed and total area per code. ``calendars`` are on the target grid."""
    return area.annual_to_months(coarse_area(yearly, cells, step), calendars)


def group_area(yearly: DataFrame) -> DataFrame:
    """Yearly area of the three crop groups on the fine grid."""
    members = area.group_members(yearly.sparkSession, taxonomy.GROUP_CROPS)
    return area.roll_up(yearly, members, ["year", "cell_id"], ["harvested_area", *AREAS])
