"""Cell-wise operators on long grid tables: cleaning, merging, time completion, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridspark.functions import calendar, geo, quality
from gridspark.operators.scale import exact_quantiles, keep_first, keep_last

# Spellings accepted for each coordinate, first match wins.
COORDINATE_NAMES = {
    "lon": ["lon", "longitude", "x", "X", "LON", "Lon", "Longitude"],
    "lat": ["lat", "latitude", "y", "Y", "LAT", "Lat", "Latitude"],
    "time": ["time", "valid_time"],
}


def standardise_coordinates(df: DataFrame) -> DataFrame:
    """Rename the first known spelling of each coordinate to ``lon``, ``lat`` and ``time``."""
    renames = {}
    for target, names in COORDINATE_NAMES.items():
        found = [n for n in names if n in df.columns]
        if target not in df.columns and found:
            renames[found[0]] = target
    return df.withColumnsRenamed(renames)


def normalise_longitude(df: DataFrame, lon: str = "lon") -> DataFrame:
    """Fold longitudes into [-180, 180); nothing stays at or above 180."""
    return df.withColumn(lon, geo.normalise_lon(F.col(lon))).where(F.col(lon) < 180)


def grid_cells(spark, step: float) -> DataFrame:
    """All cell centres of a global grid, north to south and west to east."""
    n_lat, n_lon = round(180 / step), round(360 / step)
    cells = spark.range(n_lat * n_lon).withColumnRenamed("id", "cell_id")
    i, j = geo.lat_index(F.col("cell_id"), n_lon), geo.lon_index(F.col("cell_id"), n_lon)
    return cells.select(
        "cell_id",
        i.alias("lat_idx"),
        j.alias("lon_idx"),
        (F.lit(90 - step / 2) - i * step).alias("lat"),
        (F.lit(-180 + step / 2) + j * step).alias("lon"),
    )


def to_float32(df: DataFrame) -> DataFrame:
    """Cast every double column to float."""
    return df.select(*[F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name for f in df.schema])


def decode_columns(df: DataFrame, rules: dict[str, quality.Rule]) -> DataFrame:
    """Decode the columns named in ``rules`` that exist in ``df``."""
    return df.withColumns({c: quality.decode(F.col(c), r) for c, r in rules.items() if c in df.columns})


def yearly_to_monthly(df: DataFrame) -> DataFrame:
    """Repeat yearly rows for the 12 months; rows that carry a month already stay as they are."""
    if "month" in df.columns:
        return df
    return df.withColumn("month", F.explode(calendar.months()))


def monthly_composite(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Mean of the valid days per month; a month of a year with data but no valid day is NULL."""
    days = df.select(*keys, F.year(date).alias("year"), F.month(date).alias("month"), value)
    means = days.groupBy(*keys, "year", "month").agg(F.avg(value).alias(value))
    return complete_months(means, keys, [value])


def complete_months(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Give every (keys, year) its 12 months; added months carry NULL values.

    ``df`` holds at most one row per month, so the 12 rows come from one array per (keys, year).
    """
    slots = df.groupBy(*keys, "year").agg(F.map_from_entries(F.collect_list(F.struct("month", F.struct(*values)))).alias("_m"))
    filled = slots.select(*keys, "year", F.explode(calendar.months()).alias("month"), "_m")
    entry = F.try_element_at("_m", F.col("month"))
    return filled.select(*keys, "year", "month", *[entry[v].alias(v) for v in values])


def fill_gaps(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Complete each year to 12 months, carry values forward, then backward for leading gaps.

    Windows span the 12 months of one (keys, year).
    """
    full = complete_months(df, keys, values)
    year = Window.partitionBy(*keys, "year").orderBy("month")
    back, ahead = year.rowsBetween(Window.unboundedPreceding, 0), year.rowsBetween(0, Window.unboundedFollowing)
    return full.withColumns(
        {v: F.coalesce(F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead)) for v in values}
    )


def prefer_version(df: DataFrame, keys: Sequence[str], version: str, values: Sequence[str]) -> DataFrame:
    """Per value the first non-NULL one in version order."""
    picks = [F.min_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(version))).alias(v) for v in values]
    return df.groupBy(*keys).agg(*picks)


def patch_window(
    df: DataFrame, fixed: DataFrame, keys: Sequence[str], values: Sequence[str], in_window: Column
) -> DataFrame:
    """Inside the window take the corrected values wholesale wherever the key was corrected."""
    marked = fixed.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(True).alias("_hit"))
    joined = df.join(marked, list(keys), "left")
    use = in_window & F.coalesce(F.col("_hit"), F.lit(False))
    patched = joined.withColumns({v: F.when(use, F.col(f"_new_{v}")).otherwise(F.col(v)) for v in values})
    return patched.select(*df.columns)


def patch_ratio(df: DataFrame, fixed: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean corrected value over mean original value per variable, on the corrected keys."""
    renamed = fixed.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values])
    means = df.join(renamed, list(keys)).agg(*[(F.avg(f"_new_{v}") / F.avg(v)).alias(v) for v in values])
    return means.unpivot([], list(values), "variable", "mean_ratio")


def check_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Global mean of each known variable against its widened range."""
    ranges = quality.FLUX_RANGES if ranges is None else ranges
    known = {v: r for v, r in ranges.items() if v in df.columns}
    if not known:
        return df.select(F.lit("").alias("variable"), F.lit(0.0).alias("mean"), F.lit(True).alias("ok")).limit(0)
    means = df.agg(*[F.avg(v).cast("double").alias(v) for v in known])
    long = means.unpivot([], list(known), "variable", "mean")
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, limits in known.items():
        lo, hi = quality.widened(*limits)
        low = F.when(F.col("variable") == name, F.lit(lo)).otherwise(low)
        high = F.when(F.col("variable") == name, F.lit(hi)).otherwise(high)
    return long.withColumn("ok", F.col("mean").between(low, high))


def keep_first_per_month(df: DataFrame, keys: Sequence[str], date: str, file: str) -> DataFrame:
    """Of several acquisitions in a month keep the first in file order."""
    staged = df.withColumns({"year": F.year(date), "month": F.month(date)})
    return keep_first(staged, [*keys, "year", "month"], [file, date])


def latest_file(df: DataFrame, key: str, path: str) -> DataFrame:
    """Lexicographically last path per key."""
    return df.groupBy(key).agg(F.max(path).alias(path))


def slots_to_columns(df: DataFrame, keys: Sequence[str], day: str, value: str, prefix: str, days=(1, 11, 21)) -> DataFrame:
    """Ten-day slots of a month as columns; a missing slot is NULL."""
    slots = [F.first(F.when(F.col(day) == d, F.col(value)), ignorenulls=True).alias(f"{prefix}_{d:02d}") for d in days]
    return df.where(F.col(day).isin(*days)).groupBy(*keys).agg(*slots)


def merge_sources(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Outer merge on the keys.

    Sources are stacked and folded by one aggregation: a single shuffle however many there are,
    with map-side combine, where chained outer joins would shuffle once per source. Of several values for a
    key the one of the earliest source stays.
    """
    numbered = [source.withColumn("_source", F.lit(n)) for n, source in enumerate(sources)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    values = [c for c in stacked.columns if c not in keys and c != "_source"]
    return stacked.groupBy(*keys).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col("_source"))).alias(v) for v in values])


def merge_available(
    sources: dict[str, DataFrame | None],
    keys: Sequence[str],
    year: int | None = None,
    first_year: dict[str, int] | None = None,
    enabled: Sequence[str] | None = None,
    require_all: bool = False,
    static: Sequence[DataFrame] = (),
) -> DataFrame | None:
    """Merge the sources that exist and have begun: all years in one aggregation, or one ``year``.

    With ``require_all``, years in which an enabled source should exist but is absent are left out. None without any source.
    """
    names = list(sources) if enabled is None else [n for n in enabled if n in sources]
    begin = {n: (first_year or {}).get(n) for n in names}
    present = [n for n in names if sources[n] is not None]
    ends = [begin[n] for n in names if require_all and sources[n] is None]  # the first year that lacks a source
    if not present or None in ends or (year is not None and any(year >= e for e in ends)):
        return None
    wanted = F.lit(True) if year is None else F.col("year") == year
    for e in ends:
        wanted = wanted & (F.col("year") < e)
    due = [sources[n].where(wanted if begin[n] is None else wanted & (F.col("year") >= begin[n])) for n in present]
    merged = merge_sources([yearly_to_monthly(d) for d in due], keys)
    for extra in static:
        on = [k for k in keys if k in extra.columns]
        merged = merged.join(extra, on, "left")
    return merged


def describe_variables(df: DataFrame, variables: Sequence[str], time: str) -> DataFrame:
    """Count, minimum, maximum and time range of each variable."""
    long = df.select(time, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(
        [time], list(variables), "variable", "value"
    )
    has = F.col("value").isNotNull()
    return long.groupBy("variable").agg(
        F.count("value").alias("n_valid"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min(F.when(has, F.col(time))).alias("first_time"),
        F.max(F.when(has, F.col(time))).alias("last_time"),
    )


def period_change(df: DataFrame, keys: Sequence[str], value: str, first: int, last: int, years: int = 1) -> DataFrame:
    """Mean of the last years minus mean of the first years, in millions; NULL when both are empty or zero."""
    late = F.avg(F.when(F.col("year").between(last - years + 1, last), F.col(value)))
    early = F.avg(F.when(F.col("year").between(first, first + years - 1), F.col(value)))
    wide = df.groupBy(*keys).agg(late.alias("late"), early.alias("early"))
    empty = (F.coalesce("late", F.lit(0.0)) == 0) & (F.coalesce("early", F.lit(0.0)) == 0)
    return wide.withColumn("change", F.when(~empty, (F.col("late") - F.col("early")) / 1e6))


def clip_boxes(df: DataFrame, boxes: dict[str, tuple[float, float, float, float]], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside named (lon_min, lon_max, lat_min, lat_max) windows, one row per matching window."""
    hits = [
        F.when(F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1), F.lit(name))
        for name, (x0, x1, y0, y1) in boxes.items()
    ]
    return df.withColumn("box", F.explode(F.array_compact(F.array(*hits))))


def zonal_profile(
    df: DataFrame, keys: Sequence[str], lat_idx: str, value: str, n_lat: int, n_lon: int, width: int = 5
) -> DataFrame:
    """Mean over the full latitude circle, then a centred moving mean with mirrored edges.

    Every latitude hands its mean to the targets whose window covers it, so the smoothing is an
    aggregation over ``width`` copies and needs no ordered window. Latitudes no data reaches are 0.
    """
    half = width // 2
    positive = F.when(F.col(value) > 0, F.col(value)).otherwise(0.0)
    zonal = df.groupBy(*keys, lat_idx).agg((F.sum(positive) / n_lon).alias("zonal_mean"))
    offsets = F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_o")
    spread = zonal.select("*", offsets)
    i, o = F.col(lat_idx), F.col("_o")
    mirrored = F.array(i - o, -i - 1 - o, F.lit(2 * n_lat - 1) - i - o)
    targets = spread.select(*keys, "zonal_mean", F.explode(mirrored).alias(lat_idx), (o == 0).alias("_own"), i.alias("_src"))
    inside = targets.where((F.col(lat_idx) >= 0) & (F.col(lat_idx) < n_lat))
    own = F.col("_own") & (F.col("_src") == F.col(lat_idx))
    return inside.groupBy(*keys, lat_idx).agg(
        F.sum(F.when(own, F.col("zonal_mean")).otherwise(0.0)).alias("zonal_mean"),
        (F.sum("zonal_mean") / width).alias("zonal_smooth"),
    )


def clip_level(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.98, out: str = "clip_level") -> DataFrame:
    """Symmetric colour limit: a high quantile of the absolute values."""
    return exact_quantiles(df.select(*keys, F.abs(value).alias("_abs")), keys, "_abs", {out: q})


def mosaic(df: DataFrame, keys: Sequence[str], cell: str, value: str, order: Sequence[str]) -> DataFrame:
    """Last valid pixel per cell in (tile, row, column) order."""
    valid = df.where(F.col(value).isNotNull()).select(*keys, cell, *order, value)
    return keep_last(valid, [*keys, cell], list(order)).select(*keys, cell, value)


def sinusoidal_mosaic(df: DataFrame, keys: Sequence[str], value: str, fill: float, step: float = 0.05) -> DataFrame:
    """Project tile pixels (file, tile_h, tile_v, row, col) to the global grid; later pixels overwrite earlier ones."""
    lat, lon = geo.sinusoidal_lat_lon(F.col("tile_h"), F.col("tile_v"), F.col("row"), F.col("col"))
    n_lat, n_lon = round(180 / step), round(360 / step)
    i = geo.axis_index(lat, 90 - step / 2, -step, n_lat)
    j = geo.axis_index(lon, -180 + step / 2, step, n_lon)
    cells = df.where(F.col(value) != fill).withColumn("cell_id", geo.cell_id(i, j, n_lon))
    return mosaic(cells, keys, "cell_id", value, ["file", "row", "col"])
