"""From country-crop values to the complete sector account."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import taxonomy
from gridspark.operators import mapping
from gridspark.session import cut_lineage


def sector_account(
    values: DataFrame,
    detailed: DataFrame,
    crop_map: DataFrame,
    detailed_countries: DataFrame,
    countries: DataFrame,
    regions: DataFrame,
    years: Sequence[int],
    recent: tuple[int, int] = (2015, 2018),
) -> dict[str, DataFrame]:
    """Complete table, conservation check, unmapped countries and lost mass.

    ``values``: year, country, crop, value. ``detailed``: country, crop, year, value. ``crop_map``: crop,
    crop_group, sector. The two country maps: country, region. ``regions``: region, region_ord.
    """
    split_map = crop_map.where(F.col("crop_group").isin(*taxonomy.SPLIT_CROPS))
    base = cut_lineage(mapping.sector_values(detailed, split_map, detailed_countries))
    rolling, last = cut_lineage(mapping.rolling_weights(base)), cut_lineage(mapping.recent_weights(base, *recent))
    mapped = cut_lineage(mapping.map_regions(values, countries))
    split = mapped.where(F.col("crop").isin(*taxonomy.SPLIT_CROPS))
    direct = mapping.allocate_direct(mapped, mapping.sector_lookup(values.sparkSession))
    both = direct.unionByName(mapping.allocate_split(split, rolling, last))
    table = cut_lineage(mapping.complete_table(both, regions, years, taxonomy.SECTORS))
    return {
        "account": table,
        "conservation": mapping.conservation(mapped, table),
        "unmapped": mapping.unmapped(values, countries),
        "lost": mapping.lost_mass(split, rolling, last),
    }
