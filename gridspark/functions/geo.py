"""Column expressions for coordinates, cells and classes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius in km for cell areas, and in m for the sinusoidal projection.
EARTH_RADIUS_KM = 6371.0
SINUSOIDAL_RADIUS_M = 6371007.181
# Sinusoidal tiling, 36 x 18 tiles of 2400 pixels.
TILE_PIXELS = 2400
TILE_SIZE_M = 2 * math.pi * SINUSOIDAL_RADIUS_M / 36


def normalise_lon(lon: Column) -> Column:
    """Longitude folded into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def cell_id(lat_idx: Column, lon_idx: Column, n_lon: int) -> Column:
    """Row-major integer cell key."""
    return lat_idx.cast("bigint") * F.lit(n_lon).cast("bigint") + lon_idx.cast("bigint")


def lat_index(cell: Column, n_lon: int) -> Column:
    return F.floor(cell / F.lit(n_lon))


def lon_index(cell: Column, n_lon: int) -> Column:
    return F.pmod(cell, F.lit(n_lon).cast("bigint"))


def coarse_id(lat_idx: Column, lon_idx: Column, factor: int, n_lon: int) -> Column:
    """Id of the factor x factor block a cell lies in; unique for any ``n_lon``."""
    n_coarse = -(-n_lon // factor)
    return F.floor(lat_idx / factor) * F.lit(n_coarse) + F.floor(lon_idx / factor)


def axis_index(coord: Column, first: float, step: float, n: int) -> Column:
    """Index of the nearest centre on a regular axis, clipped to it. ``step`` may be negative."""
    raw = F.floor((coord - F.lit(first)) / F.lit(step) + 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), raw)).cast("bigint")


def cell_area_ha(lat: Column, dlat: float, dlon: float) -> Column:
    """Area of a dlat x dlon degree cell in hectares."""
    height = EARTH_RADIUS_KM * math.radians(dlat)
    width = F.lit(EARTH_RADIUS_KM * math.radians(dlon)) * F.cos(F.radians(lat))
    return width * F.lit(height) * 100.0


def sinusoidal_lat_lon(h: Column, v: Column, row: Column, col: Column) -> tuple[Column, Column]:
    """Centre of a sinusoidal tile pixel in degrees."""
    pixel = TILE_SIZE_M / TILE_PIXELS
    x = F.lit(-18 * TILE_SIZE_M) + h * F.lit(TILE_SIZE_M) + (col + 0.5) * F.lit(pixel)
    y = F.lit(9 * TILE_SIZE_M) - v * F.lit(TILE_SIZE_M) - (row + 0.5) * F.lit(pixel)
    lat = y / F.lit(SINUSOIDAL_RADIUS_M)
    cos = F.cos(lat)
    cos = F.when(F.abs(cos) < 1e-10, F.lit(1e-10)).otherwise(cos)
    lon = F.degrees(x / (F.lit(SINUSOIDAL_RADIUS_M) * cos))
    return F.degrees(lat), F.greatest(F.lit(-180.0), F.least(F.lit(180.0), lon))


def tile_hv(name: Column) -> tuple[Column, Column]:
    """The ``hXXvYY`` token of a file name as two integers."""
    token = r"(?:^|\.)h(\d{2})v(\d{2})(?:\.|$)"
    return (
        F.try_to_number(F.regexp_extract(name, token, 1), F.lit("99")).cast("int"),
        F.try_to_number(F.regexp_extract(name, token, 2), F.lit("99")).cast("int"),
    )


def region_class(thermal: Column, moisture: Column) -> Column:
    """Nine classes: three thermal bands times three moisture bands, NULL outside."""
    t = F.when(thermal <= 3, 0).when((thermal >= 4) & (thermal <= 7), 1).when(thermal >= 8, 2)
    m = F.when(moisture <= 2, 1).when((moisture >= 3) & (moisture <= 5), 2).when(moisture >= 6, 3)
    return t * 3 + m


def location_encoding(lat: Column, lon: Column) -> dict[str, Column]:
    return {
        "lat_sin": F.sin(F.radians(lat)),
        "lat_cos": F.cos(F.radians(lat)),
        "lon_sin": F.sin(F.radians(lon)),
        "lon_cos": F.cos(F.radians(lon)),
    }
