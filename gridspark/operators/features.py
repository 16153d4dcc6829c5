"""Masks, joins and time-series features of the model tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.functions import calendar, geo, taxonomy
from gridspark.operators.scale import exact_quantiles, keep_last, lookup_join, null_safe_join, one_row, small_side
from gridspark.session import cut_lineage


def month_mask(target: DataFrame, value: str = "waterstress") -> DataFrame:
    """Months and cells with any valid target, per crop."""
    return target.where(F.col(value).isNotNull()).select("crop", "month", "cell_id").distinct()


def training_rows(
    predictors: DataFrame, target: DataFrame, mask: DataFrame, variables: Sequence[str], value: str = "waterstress"
) -> DataFrame:
    """Predictors joined to the target on masked cells, without rows that lack every predictor."""
    rows = predictors.join(target, ["year", "month", "cell_id"]).join(mask, ["crop", "month", "cell_id"], "left_semi")
    present = [v for v in variables if v in predictors.columns]
    return rows.dropna("all", subset=present) if present else rows


def prediction_rows(predictors: DataFrame, mask: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Predictors on the masked months and cells of every crop."""
    rows = predictors.join(mask, ["month", "cell_id"])
    present = [v for v in variables if v in predictors.columns]
    return rows.dropna("all", subset=present) if present else rows


def asof_area(
    wanted: DataFrame, area: DataFrame, keys: Sequence[str], value: str, tolerance: int = 3, out: str = "ha_irrigated"
) -> DataFrame:
    """Value of the wanted year, else of the latest of the ``tolerance`` years before it, else 0.

    Every area row offers itself to the years it may serve, which makes the as-of join an equi-join.
    """
    offer = area.select(
        *keys,
        F.col("year").alias("_from"),
        F.explode(F.sequence(F.col("year"), F.col("year") + tolerance)).alias("year"),
        F.col(value).alias("_v"),
    )
    best = offer.groupBy(*keys, "year").agg(F.max_by("_v", "_from").alias(out))
    return wanted.join(best, [*keys, "year"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def annual_area(wanted: DataFrame, area: DataFrame, keys: Sequence[str], value: str, out: str = "ha_irrigated") -> DataFrame:
    """Value of the wanted year if that year is in the table, else of the table's last year, else 0."""
    years = area.select("year").distinct()
    last = one_row(area, F.max("year").alias("y"))["y"]
    staged = wanted.join(years.withColumn("_has", F.lit(True)), "year", "left")
    staged = staged.withColumn("_use", F.when(F.col("_has"), F.col("year")).otherwise(last))
    source = area.select(*keys, F.col("year").alias("_use"), F.col(value).alias(out))
    joined = staged.join(source, [*keys, "_use"], "left").drop("_has", "_use")
    return joined.withColumn(out, F.coalesce(out, F.lit(0.0)))


def prepend_history(rows: DataFrame, history: DataFrame, keys: Sequence[str], time: str, start_year: int, months: int = 6) -> DataFrame:
    """Put the last months of history before the first year; a key present in both keeps ``rows``."""
    cutoff = F.add_months(F.make_date(F.lit(start_year), F.lit(1), F.lit(1)), -months)
    early = history.where(F.col(time).cast("date") >= cutoff).withColumn("_source", F.lit(0))
    stacked = early.unionByName(rows.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    return keep_last(stacked, [*keys, time], ["_source"]).drop("_source")


def trim_years(rows: DataFrame, start_year: int) -> DataFrame:
    return rows.where(F.col("year") >= start_year)


def drop_incomplete(df: DataFrame, core: Sequence[str] = tuple(taxonomy.CORE_COLUMNS)) -> DataFrame:
    """Drop rows with a NULL in any core column the table has."""
    present = [c for c in core if c in df.columns]
    return df.dropna("any", subset=present) if present else df


def impute_medians(df: DataFrame, value: str, levels: Sequence[Sequence[str]], fit: Column | None = None) -> DataFrame:
    """Fill NULLs by the median of each level in turn, each computed on the values filled so far.

    ``levels`` are key lists; an empty list is the global median. ``fit`` restricts the rows the
    medians are taken from.

    The rows are read once as distinct values with counts per combination of all keys. Medians of every level come from these counts,
    where missing values are filled level by level; the rows themselves are read once more, to meet the medians of all levels.
    """
    names = list(dict.fromkeys(k for keys in levels for k in keys))
    fits = F.lit(1) if fit is None else F.coalesce(fit, F.lit(False)).cast("int")
    held = df.select(*names, F.col(value).cast("double").alias("_value"), fits.alias("_fit"))
    counts = cut_lineage(held.groupBy(*names, "_value").agg(F.sum("_fit").alias("_n")))
    size, found = counts.count(), []

    def fill(rows: DataFrame, column: str) -> DataFrame:
        columns = rows.columns
        for i, (keys, medians) in enumerate(found):
            rows = null_safe_join(rows, medians.withColumnRenamed("_median", f"_median{i}"), keys, "left")
        first = F.coalesce(column, *[f"_median{i}" for i in range(len(found))])
        return rows.select(*[first.alias(c) if c == column else F.col(c) for c in columns])

    for level, keys in enumerate(levels, 1):
        basis = fill(counts, "_value").where(F.col("_value").isNotNull() & (F.col("_n") > 0))
        medians = exact_quantiles(basis, keys, "_value", {"_median": 0.5}, rows=size, count="_n")
        if keys or level < len(levels):
            medians = cut_lineage(medians)
        found.append((keys, small_side(medians) if keys else medians))
    return fill(df, value)


def add_time_features(df: DataFrame, date: str) -> DataFrame:
    return df.withColumns(calendar.time_features(F.col(date)))


def add_location(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumns(geo.location_encoding(F.col(lat), F.col(lon)))


def unpivot_months(wide: DataFrame, year: str, out: str) -> DataFrame:
    """Wide monthly index to ``(year, month, out)``. Month columns carry a number or an English name."""
    columns = [c for c in wide.columns if c != year]
    numbers = {}
    for c in columns:
        digits = "".join(ch for ch in c if ch.isdigit())
        name = c.strip().lower()[:3]
        if digits:
            numbers[c] = int(digits)
        elif name in MONTHS:
            numbers[c] = MONTHS.index(name) + 1
    values = wide.select(F.col(year).cast("int").alias("year"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in numbers])
    long = values.unpivot(["year"], list(numbers), "_c", out)
    month = F.create_map(*[x for c, m in numbers.items() for x in (F.lit(c), F.lit(m))])
    return long.select("year", F.element_at(month, F.col("_c")).alias("month"), out)


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def long_index(df: DataFrame, value: str, out: str, year: str = "YEAR", month: str = "MONTH") -> DataFrame:
    """Long monthly index with an explicit value column."""
    return df.select(F.col(year).cast("int").alias("year"), F.col(month).cast("int").alias("month"), F.col(value).cast("double").alias(out))


def join_indices(df: DataFrame, indices: Sequence[DataFrame]) -> DataFrame:
    """Left join monthly index series on year and month."""
    for index in indices:
        df = df.join(index, ["year", "month"], "left")
    return df


def join_lookup(df: DataFrame, lookup: DataFrame, key: str = "cell_id") -> DataFrame:
    return df.join(lookup, key, "left")


def miss_rate(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(F.col(column).isNull().cast("double")).alias("miss_rate"))


def assign_regions(zones: DataFrame) -> DataFrame:
    """Nine-class regions of thermal and moisture zones, without unclassified cells."""
    classed = zones.withColumn("regiontype", geo.region_class(F.col("thz"), F.col("mst")))
    return classed.where(F.col("regiontype").isNotNull())


def override_regions(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Replace region types by the class of the cell; a cell without class becomes 0."""
    named = classes.select("cell_id", F.col("class").alias("_class"))
    return df.drop("regiontype").join(named, "cell_id", "left").withColumn("regiontype", F.coalesce("_class", F.lit(0))).drop("_class")


def class_distribution(df: DataFrame, column: str = "regiontype") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def add_lags(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], lags=(1, 2, 3)) -> DataFrame:
    """Values of the previous rows of the same series, by row and not by calendar.

    A series has one row per time step, which bounds the window.
    """
    series = Window.partitionBy(*keys).orderBy(order)
    present = [c for c in columns if c in df.columns]
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(series) for c in present for k in lags})


def add_calendar_lags(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lags=(1, 2, 3)) -> DataFrame:
    """Values of the calendar months before; a missing month gives NULL."""
    index = F.col("year") * 12 + F.col("month")
    series = Window.partitionBy(*keys).orderBy("_index")
    out = df.withColumn("_index", index)
    present = [c for c in columns if c in df.columns]
    exact = {f"{c}_lag{k}": F.first(c).over(series.rangeBetween(-k, -k)) for c in present for k in lags}
    return out.withColumns(exact).drop("_index")


def add_rolling(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], windows=(3,)) -> DataFrame:
    """Mean of the last ``w`` rows of the series, skipping NULLs."""
    series = Window.partitionBy(*keys).orderBy(order)
    present = [c for c in columns if c in df.columns]
    return df.withColumns({f"{c}_roll{w}": F.avg(c).over(series.rowsBetween(1 - w, 0)) for c in present for w in windows})


def feature_columns(df: DataFrame, exclude: Sequence[str], target: str, drop: Sequence[str] = ()) -> list[str]:
    """Columns left after the excluded ones, the target and the dropped ones."""
    skip = {*exclude, target, *drop}
    return [c for c in df.columns if c not in skip]


def fill_missing_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the features a model needs and the table lacks, as 0."""
    return df.withColumns({f: F.lit(0.0) for f in features if f not in df.columns})


def assemble(df: DataFrame, features: Sequence[str], out: str = "features", missing: float = float("nan")) -> DataFrame:
    """Feature vector; a NULL or NaN feature becomes ``missing`` so that no row is lost."""
    filled = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(missing)).alias(f"_f_{f}") for f in features]
    inputs = [f"_f_{f}" for f in features]
    return VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep").transform(df.select("*", *filled)).drop(*inputs)


def scale_min_max(train: DataFrame, others: Sequence[DataFrame], column: str = "features", out: str = "scaled"):
    """Min-max scaling fitted on ``train`` and applied to all tables."""
    model = MinMaxScaler(inputCol=column, outputCol=out).fit(train)
    return [model.transform(d) for d in (train, *others)]
