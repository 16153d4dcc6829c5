"""Attribution of several years and indicators in one run.

A node number carries its year, so the years are blocks of one network that never touch. All of them
share every round of the series, and a hot year is spread over its nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators import attribution
from gridspark.session import cut_lineage


def node(year: Column, region: Column, sector: Column, n_regions: int, n_sectors: int) -> Column:
    return (year.cast("bigint") * n_regions + region) * n_sectors + sector


def attribute_years(
    flows: DataFrame,
    demand: DataFrame,
    accounts: DataFrame,
    targets: Sequence[int],
    n_regions: int,
    n_sectors: int,
    groups="individual",
    **series,
) -> dict[str, DataFrame]:
    """Footprints, remaining part and balance per year and indicator.

    ``flows``: year, from_region, from_sector, to_region, to_sector, value. ``demand``: year, from_region,
    from_sector, to_region, value. ``accounts``: year, indicator, region, sector, value. Years without an
    account are left out.
    """

    def at(region: str, sector: str) -> Column:
        return node(F.col("year"), F.col(region), F.col(sector), n_regions, n_sectors)

    due = accounts.select("year").distinct()
    source, goal = at("from_region", "from_sector"), at("to_region", "to_sector")
    edges = flows.join(due, "year", "left_semi").select(source.alias("i"), goal.alias("j"), "value")
    final = demand.join(due, "year", "left_semi").select(source.alias("i"), F.col("to_region").alias("k"), "value")
    final = attribution.demand_groups(final, groups)
    load = accounts.groupBy(at("region", "sector").alias("i"), "indicator").agg(F.sum("value").alias("value"))
    output = cut_lineage(attribution.gross_output(edges, final if groups == "individual" else final_once(demand, due, source)))
    a = cut_lineage(attribution.technical_coefficients(edges, output))
    ratio = F.greatest(F.col("value") / F.when(F.col("x") > 0, F.col("x")).otherwise(1.0), F.lit(0.0))
    d = cut_lineage(load.join(output, "i", "left").select("i", "indicator", ratio.alias("d")))
    block = n_regions * n_sectors
    inside = F.col("i") % block
    nodes = cut_lineage(
        output.select(
            "i",
            F.floor(F.col("i") / block).alias("year"),
            F.floor(inside / n_sectors).alias("region"),
            (inside % n_sectors).alias("sector"),
        ).withColumn("is_target", F.col("sector").isin(*targets))
    )
    final = cut_lineage(final)
    # Years never touch, so each is judged on its own.
    series = {"block": F.floor(F.col("i") / block)} | series
    supply = attribution.others_supply(a, final, nodes, **series)
    target = cut_lineage(attribution.footprints(a, final, nodes, d, supply, **series))
    rest = cut_lineage(attribution.remaining(a, final, nodes, d, supply))
    expected = d.join(output, "i").join(nodes.select("i", "year"), "i").select("year", "indicator", (F.col("d") * F.col("x")).alias("value"))
    return {
        "target": target,
        "remaining": rest,
        "balance": attribution.balance_by(["year", "indicator"], target, rest, expected),
    }


def final_once(demand: DataFrame, due: DataFrame, source: Column) -> DataFrame:
    """Final demand counted once, for groups that may overlap."""
    return demand.join(due, "year", "left_semi").select(source.alias("i"), "value")
