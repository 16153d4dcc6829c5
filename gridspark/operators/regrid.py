"""Moving values between regular grids.

Source and target axes are regular, so target cells are computed from a source cell by arithmetic.
Each source cell is scattered to the targets it contributes to and contributions are added up: one
shuffle with map-side combine, no join with a target grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.scale import null_safe_join


@dataclass(frozen=True)
class Axis:
    """A regular axis of cell centres."""

    first: float
    step: float
    n: int


def positions_between(source: Axis, target: Axis) -> tuple[float, float]:
    """Linear map ``a + b * target_index`` to a fractional source index."""
    return (target.first - source.first) / source.step, target.step / source.step


def endpoint_positions(n_source: int, n_target: int) -> tuple[float, float]:
    """Index map that puts the first and last centres of both axes on each other."""
    return 0.0, (n_source - 1) / (n_target - 1) if n_target > 1 else 0.0


def _candidates(index: Column, a: float, b: float, reach: float, n_target: int) -> Column:
    """Target indices whose position may lie within ``reach`` of a source index (slack of one)."""
    if b == 0:
        return F.sequence(F.lit(0), F.lit(n_target - 1))
    low = F.floor((index - reach - a) / b) if b > 0 else F.floor((index + reach - a) / b)
    high = F.ceil((index + reach - a) / b) if b > 0 else F.ceil((index - reach - a) / b)
    low = F.greatest(low - 1, F.lit(0))
    high = F.least(high + 1, F.lit(n_target - 1))
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))


def _lower_corner(position: Column, n_source: int) -> Column:
    """Left neighbour of a position; the last interval also owns the last node."""
    return F.least(F.floor(position), F.lit(n_source - 2))


def _linear_weight(index: Column, target: Column, a: float, b: float, n_source: int) -> Column:
    """Weight of a source node for a target, NULL when it is not one of its two neighbours."""
    # Snap positions that miss a node by rounding only.
    position = F.round(F.lit(a) + target * F.lit(b), 9)
    inside = (position >= 0) & (position <= n_source - 1)
    lower = _lower_corner(position, n_source)
    share = position - lower
    return F.when(inside & (index == lower), 1 - share).when(inside & (index == lower + 1), share)


def bilinear(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    source: tuple[int, int],
    target: tuple[int, int],
    lat_map: tuple[float, float],
    lon_map: tuple[float, float],
    missing_is_zero: bool = False,
) -> DataFrame:
    """Bilinear values on the target grid; a target with a missing corner stays absent.

    ``df`` has ``keys, lat_idx, lon_idx, value``; ``lat_map`` and ``lon_map`` turn target indices into
    source positions. With ``missing_is_zero`` absent source cells count as 0.
    """
    valid = df.where(F.col(value).isNotNull())
    rows = valid.withColumn("_ti", F.explode(_candidates(F.col("lat_idx"), *lat_map, 1.0, target[0])))
    rows = rows.withColumn("_wi", _linear_weight(F.col("lat_idx"), F.col("_ti"), *lat_map, source[0]))
    rows = rows.where(F.col("_wi").isNotNull())
    rows = rows.withColumn("_tj", F.explode(_candidates(F.col("lon_idx"), *lon_map, 1.0, target[1])))
    rows = rows.withColumn("_wj", _linear_weight(F.col("lon_idx"), F.col("_tj"), *lon_map, source[1]))
    rows = rows.where(F.col("_wj").isNotNull())
    out = rows.groupBy(*keys, F.col("_ti").cast("bigint").alias("lat_idx"), F.col("_tj").cast("bigint").alias("lon_idx")).agg(
        F.sum(F.col(value) * F.col("_wi") * F.col("_wj")).alias(value), F.count(F.lit(1)).alias("_corners")
    )
    if not missing_is_zero:
        out = out.where(F.col("_corners") == 4)
    return out.drop("_corners")


def nearest(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    target: tuple[int, int],
    lat_map: tuple[float, float],
    lon_map: tuple[float, float],
) -> DataFrame:
    """Nearest source cell for every target cell; no shuffle. Half-way positions go up."""

    def owns(index: Column, t: Column, a: float, b: float) -> Column:
        return F.floor(F.round(F.lit(a) + t * F.lit(b), 9) + 0.5) == index

    rows = df.withColumn("_ti", F.explode(_candidates(F.col("lat_idx"), *lat_map, 0.5, target[0])))
    rows = rows.where(owns(F.col("lat_idx"), F.col("_ti"), *lat_map))
    rows = rows.withColumn("_tj", F.explode(_candidates(F.col("lon_idx"), *lon_map, 0.5, target[1])))
    rows = rows.where(owns(F.col("lon_idx"), F.col("_tj"), *lon_map))
    return rows.select(
        *keys, F.col("_ti").cast("bigint").alias("lat_idx"), F.col("_tj").cast("bigint").alias("lon_idx"), *values
    )


def upsample(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    source: tuple[int, int],
    ratio: int,
    align: str = "containment",
    flip_lat: bool = False,
) -> DataFrame:
    """Copy each cell to its ratio x ratio children; no shuffle.

    ``containment`` gives child ``i`` the parent ``i // ratio``; ``endpoint`` maps the outer centres of
    both grids on each other.
    """
    n_lat, n_lon = source[0] * ratio, source[1] * ratio
    rows = df
    if flip_lat:
        rows = rows.withColumn("lat_idx", F.lit(source[0] - 1) - F.col("lat_idx"))
    if align == "endpoint":
        return nearest(
            rows, keys, values, (n_lat, n_lon), endpoint_positions(source[0], n_lat), endpoint_positions(source[1], n_lon)
        )
    if align != "containment":
        raise ValueError(f"unknown alignment {align!r}")
    steps = F.sequence(F.lit(0), F.lit(ratio - 1))
    rows = rows.select("*", F.explode(steps).alias("_di"))
    rows = rows.select("*", F.explode(steps).alias("_dj"))
    return rows.select(
        *keys,
        (F.col("lat_idx") * ratio + F.col("_di")).cast("bigint").alias("lat_idx"),
        (F.col("lon_idx") * ratio + F.col("_dj")).cast("bigint").alias("lon_idx"),
        *values,
    )


def sum_bins(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    step: float,
    n_lat: int,
    n_lon: int,
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Add each source cell to the target cell its centre lies in; totals are kept."""
    # Guards against centres that sit on a cell edge up to rounding.
    i = F.greatest(F.lit(0), F.least(F.lit(n_lat - 1), F.floor(F.round((F.lit(90.0) - F.col(lat)) / step, 9))))
    j = F.greatest(F.lit(0), F.least(F.lit(n_lon - 1), F.floor(F.round((F.col(lon) + 180.0) / step, 9))))
    sums = [F.sum(F.coalesce(F.col(v), F.lit(0.0))).alias(v) for v in values]
    return df.groupBy(*keys, i.cast("bigint").alias("lat_idx"), j.cast("bigint").alias("lon_idx")).agg(*sums)


def bilinear_keep_total(
    df: DataFrame, keys: Sequence[str], value: str, source: tuple[int, int], target: tuple[int, int]
) -> DataFrame:
    """Endpoint-aligned bilinear values rescaled so that each key keeps its source total."""
    if source == target:
        return df.select(*keys, "lat_idx", "lon_idx", value)
    lat_map, lon_map = endpoint_positions(source[0], target[0]), endpoint_positions(source[1], target[1])
    moved = bilinear(df, keys, value, source, target, lat_map, lon_map, missing_is_zero=True)
    before = df.groupBy(*keys).agg(F.sum(value).alias("_src"))
    after = moved.groupBy(*keys).agg(F.sum(value).alias("_dst"))
    factor = null_safe_join(before, after, keys, "inner").select(
        *keys, F.when((F.col("_src") > 0) & (F.col("_dst") > 0), F.col("_src") / F.col("_dst")).otherwise(1.0).alias("_f")
    )
    scaled = null_safe_join(moved, factor, keys, "inner")
    return scaled.select(*keys, "lat_idx", "lon_idx", (F.col(value) * F.col("_f")).alias(value))


def block_sums(
    df: DataFrame, keys: Sequence[str], value: str, factor: int, n_lat: int, n_lon: int, lat: Axis, lon: Axis
) -> DataFrame:
    """Sums over factor x factor blocks of whole blocks only, with the block centres."""
    inside = df.where((F.col("lat_idx") < n_lat // factor * factor) & (F.col("lon_idx") < n_lon // factor * factor))
    i, j = F.floor(F.col("lat_idx") / factor), F.floor(F.col("lon_idx") / factor)
    sums = inside.groupBy(*keys, i.alias("block_i"), j.alias("block_j")).agg(F.sum(value).alias(value))
    mid = (factor - 1) / 2
    return sums.withColumns(
        {
            "lat": F.lit(lat.first) + (F.col("block_i") * factor + mid) * lat.step,
            "lon": F.lit(lon.first) + (F.col("block_j") * factor + mid) * lon.step,
        }
    )
