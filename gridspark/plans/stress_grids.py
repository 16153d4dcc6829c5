"""From footprint and weights to published grids and country tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import taxonomy
from gridspark.operators import polygons, report, stress
from gridspark.sources import writers


def build_stress(
    footprint: DataFrame, weights: DataFrame, path: str, crops: Sequence[str] = tuple(taxonomy.CROPS), overwrite: bool = False
) -> None:
    """Write stress partitioned by crop and year; finished crop-years are skipped."""
    wanted = footprint.where(F.col("crop").isin(*crops)).select("crop", "year").distinct()
    due = writers.missing_keys(wanted, path, overwrite=overwrite)
    rows = footprint.join(due, ["crop", "year"], "left_semi")
    writers.write_partitions(stress.water_stress(rows, weights), path)


def publication(stress_table: DataFrame, lookup: DataFrame) -> dict[str, DataFrame]:
    """The published tables: wide monthly and yearly grids, yearly totals and country-years."""
    yearly = report.yearly_by_crop(stress_table)
    return {
        "monthly_grid": report.wide_grid(stress_table, ["year", "month", "cell_id"]),
        "yearly_grid": report.wide_grid(yearly, ["year", "cell_id"]),
        "yearly_total": report.yearly_total(stress_table),
        "country_year": report.region_year_totals(stress_table, lookup),
        "country_month": polygons.country_months(stress_table, lookup),
    }
