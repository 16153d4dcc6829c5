"""Decoding of stored raster values and plausibility ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """How one stored variable turns into a physical value."""

    fill: float | None = None
    low: float | None = None
    high: float | None = None
    scale: float | None = None
    offset: float = 0.0
    multiply: float | None = None


# Fill values, accepted ranges and factors of the source products.
RULES = {
    "vegetation_index": Rule(fill=-3000.0),
    "greenness": Rule(fill=-28672.0, low=-100.0, high=16000.0, multiply=1e-4),
    "phenology": Rule(fill=32767.0),
    "land_class": Rule(fill=255.0),
    "soil_anomaly": Rule(high=1e20),
    "station_factor": Rule(fill=-99999.0),
    "grid_default": Rule(fill=-9999.0),
}

# Global-mean ranges of the accumulated flux variables.
FLUX_RANGES = {
    "ssr": (1e5, 3e7),
    "ssrd": (1e5, 4e7),
    "tp": (1e-6, 0.02),
    "ro": (1e-7, 0.01),
    "evabs": (-0.005, -1e-7),
    "evavt": (-0.01, -1e-7),
}


def decode(raw: Column, rule: Rule) -> Column:
    """Physical value, NULL for NaN, fill values and values outside the accepted range."""
    keep = ~F.isnan(raw.cast("double"))
    if rule.fill is not None:
        keep = keep & (raw != rule.fill)
    if rule.low is not None:
        keep = keep & (raw >= rule.low)
    if rule.high is not None:
        keep = keep & (raw < rule.high if rule.high >= 1e20 else raw <= rule.high)
    value = raw.cast("double")
    if rule.scale is not None:
        value = (value - rule.offset) / rule.scale
    if rule.multiply is not None:
        value = value * rule.multiply
    return F.when(keep, value)


def widened(low: float, high: float, headroom: float = 3.0) -> tuple[float, float]:
    """An accepted range with headroom: the lower end times it, a negative upper end over it."""
    return low * headroom, high * headroom if high > 0 else high / headroom
