"""Assigning grid cells to polygons by scanlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cells_in_polygons(edges: DataFrame, step: float, west: float = -180.0, north: float = 90.0) -> DataFrame:
    """Cells whose centre lies inside a polygon: ``(cell_lat, cell_lon, poly_id)``, first polygon wins.

    ``edges``: poly_id, x1, y1, x2, y2 of every ring, holes included. Each edge is cut by the latitude
    rows it spans (upper end excluded, so a shared vertex counts once); along a row the crossings
    alternate between entering and leaving, and the stretches inside are written out as cell numbers.
    The work grows with edges and covered cells. Points never meet edges.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    # Row k has its centre at north - (k + 0.5) * step.
    first = F.greatest(F.ceil((F.lit(north) - high) / step - 0.5) - 1, F.lit(0))
    last = F.ceil((F.lit(north) - low) / step - 0.5) + 1
    rows = edges.where(F.col("y1") != F.col("y2")).withColumn("cell_lat", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    lat = F.lit(north) - (F.col("cell_lat") + 0.5) * step
    rows = rows.where((lat >= low) & (lat < high))
    cross = F.col("x1") + (lat - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    hits = rows.select("poly_id", "cell_lat", cross.alias("x"))
    # One polygon's crossings of one latitude row.
    line = Window.partitionBy("poly_id", "cell_lat").orderBy("x")
    paired = hits.withColumns({"_n": F.row_number().over(line), "_next": F.lead("x").over(line)})
    spans = paired.where(F.col("_n") % 2 == 1)
    start = F.ceil((F.col("x") - west) / step - 0.5)
    stop = F.ceil((F.col("_next") - west) / step - 0.5) - 1
    cells = spans.where(start <= stop).select(
        "poly_id", "cell_lat", F.explode(F.sequence(start.cast("bigint"), stop.cast("bigint"))).alias("cell_lon")
    )
    return cells.groupBy("cell_lat", "cell_lon").agg(F.min("poly_id").alias("poly_id"))


def country_lookup(edges: DataFrame, names: DataFrame, step: float, n_lon: int) -> DataFrame:
    """``cell_id`` to country name and code. ``names``: poly_id, country, iso3."""
    cells = cells_in_polygons(edges, step)
    return cells.join(names, "poly_id").select(
        (F.col("cell_lat") * n_lon + F.col("cell_lon")).alias("cell_id"), "country", "iso3"
    )


def country_months(df: DataFrame, lookup: DataFrame, value: str = "waterstress") -> DataFrame:
    """Country sums per month; cells outside every country drop out.

    Cells are summed per month before the lookup join. The lookup has a row per cell and is shuffled.
    """
    keys = [c for c in ("crop", "year", "month") if c in df.columns]
    per_cell = df.groupBy("cell_id", *keys).agg(F.sum(value).alias(value))
    return per_cell.join(lookup.hint("merge"), "cell_id").groupBy("iso3", "country", *keys).agg(F.sum(value).alias(value))
