"""Column expressions on dates, months and growing seasons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# First and last day of each month in a 365-day year, as the area data define them.
SEASON_MONTHS = [
    (1, 31), (32, 59), (60, 90), (91, 120), (121, 151), (152, 181),
    (182, 212), (213, 243), (244, 273), (274, 304), (305, 335), (336, 365),
]
# The civil month table, for callers that want true November and December limits.
CIVIL_MONTHS = [*SEASON_MONTHS[:10], (305, 334), (335, 365)]


def months() -> Column:
    return F.sequence(F.lit(1), F.lit(12))


def time_features(date: Column) -> dict[str, Column]:
    """Calendar features of a date or timestamp."""
    doy = F.dayofyear(date)
    angle = doy * F.lit(2 * math.pi) / F.lit(365.25)
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day_of_year": doy,
        "quarter": F.quarter(date),
        "half_year": (F.month(date) > 6).cast("int"),
        "cos_doy": F.cos(angle),
        "sin_doy": F.sin(angle),
        "decade": (F.floor(F.year(date) / 10) * 10).cast("int"),
    }


def season_weights(plant: Column, mature: Column, table=SEASON_MONTHS) -> Column:
    """Array of 12 shares of the growing season per month; all 0 for an invalid season.

    A season that ends before it starts runs over the turn of the year. An overlap is never more
    than the days of its month.
    """
    valid = plant.isNotNull() & mature.isNotNull() & (plant > 0) & (mature > 0)
    wraps = plant > mature
    length = F.greatest(F.when(wraps, 365 - plant + 1 + mature).otherwise(mature - plant + 1), F.lit(1))

    def overlap(first, last, start, end):
        days = F.least(F.lit(last), end) - F.greatest(F.lit(first), start) + 1
        return F.greatest(days, F.lit(0))

    shares = []
    for first, last in table:
        inside = overlap(first, last, plant, mature)
        around = overlap(first, last, plant, F.lit(365)) + overlap(first, last, F.lit(1), mature)
        days = F.least(F.when(wraps, around).otherwise(inside), F.lit(last - first + 1))
        shares.append(F.when(valid, days / length).otherwise(0.0).cast("double"))
    return F.array(*shares)


def julian_file_date(name: Column) -> Column:
    """Date of an ``A{year}{day-of-year}`` token in a file name."""
    token = F.regexp_extract(name, r"A(\d{7})", 1)
    first = F.make_date(F.substring(token, 1, 4).cast("int"), F.lit(1), F.lit(1))
    return F.when(token != "", F.date_add(first, F.substring(token, 5, 3).cast("int") - 1))


def half_even_years(raw: Column) -> Column:
    """Years from an offset axis: a raw value below 100 counts from the year 850."""
    whole = F.bround(raw, 0).cast("int")
    return F.when(whole < 100, whole + 850).otherwise(whole)
