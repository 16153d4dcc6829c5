"""Readers: yearly tables, crop tables, index series, matrices, accounts, country files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.features import long_index, unpivot_months
from gridspark.operators.scale import number_rows
from gridspark.session import cut_lineage


def read_optional(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame | None:
    """The table at ``path``, or None when it is absent or holds no readable file."""
    try:
        return spark.read.options(**options).format(fmt).load(path)
    except AnalysisException:
        return None


def read_years(spark: SparkSession, path: str, first: int, last: int) -> DataFrame | None:
    """Yearly partitions between two years; the filter prunes partitions."""
    table = read_optional(spark, path, mergeSchema="true")
    return None if table is None else table.where(F.col("year").between(first, last))


def read_crops(spark: SparkSession, path: str, crop: str | Sequence[str], first: int, last: int) -> DataFrame:
    """Crop tables partitioned by crop and year; an empty selection is an error."""
    table = read_years(spark, path, first, last)
    crops = [crop] if isinstance(crop, str) else list(crop)
    picked = None if table is None else table.where(F.col("crop").isin(*crops))
    if picked is None or picked.limit(1).count() == 0:
        raise FileNotFoundError(f"no rows for {crops} in {path} ({first}-{last})")
    return picked


def key_from_path(path: Column, pattern: str) -> Column:
    """First capture group of a file-name pattern, NULL where it does not match."""
    name = F.element_at(F.split(path, "/"), -1)
    key = F.regexp_extract(name, pattern, 1)
    return F.when(key != "", key)


def read_keyed(spark: SparkSession, path: str, pattern: str, key: str = "crop", fmt: str = "parquet", **options) -> DataFrame:
    """Rows of all matching files with the key their file name carries; other files are skipped."""
    table = spark.read.options(**options).format(fmt).load(path)
    return table.withColumn(key, key_from_path(F.input_file_name(), pattern)).where(F.col(key).isNotNull())


def read_long_index(spark: SparkSession, path: str, value: str, name: str) -> DataFrame:
    """Long index CSV with an explicit value column."""
    return long_index(spark.read.option("header", True).csv(path), value, name)


def read_wide_index(spark: SparkSession, path: str, name: str, year: str = "Year") -> DataFrame:
    """Wide index CSV: a year column and twelve month columns."""
    return unpivot_months(spark.read.option("header", True).csv(path), year, name)


def parse_index_lines(lines: DataFrame, name: str, column: str = "value") -> DataFrame:
    """Text rows of a four-digit year and twelve values; other rows are skipped."""
    parts = F.split(F.trim(column), r"\s+")
    year = F.element_at(parts, 1)
    good = lines.select(parts.alias("p"), year.alias("y")).where(F.col("y").rlike(r"^\d{4}$") & (F.size("p") >= 13))
    long = good.select(F.col("y").cast("int").alias("year"), F.posexplode(F.slice("p", 2, 12)).alias("m", "v"))
    return long.select("year", (F.col("m") + 1).alias("month"), F.expr("try_cast(v as double)").alias(name))


def read_index_text(spark: SparkSession, path: str, name: str) -> DataFrame:
    return parse_index_lines(spark.read.text(path), name)


def read_matrix(spark: SparkSession, path: str, rows: Sequence[int] | None = None) -> DataFrame:
    """Headerless matrix CSV as ``(row, col, value)``, zeros left out; several files follow each other by path.

    Lines are counted per part of a file, and the parts put in order. Unwanted rows go before any line is split.
    """
    read = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    lines = number_rows(cut_lineage(read), ["_path", "_start"], "_id", "row")
    if rows is not None:
        lines = lines.where(F.col("row").isin(list(rows)))
    cells = lines.select("row", F.posexplode(F.split("line", ",")).alias("col", "_v"))
    return cells.select("row", F.col("col").cast("bigint"), F.expr("try_cast(_v as double)").alias("value")).where(F.col("value") != 0)


def read_account(spark: SparkSession, folder: str, year: int, n_regions: int, n_sectors: int) -> tuple[DataFrame, DataFrame | None]:
    """Account of a year and the optional household account.

    Tried in order: ``satellite_{year}``, ``Q_{year}``, ``{year}``, each as Parquet or CSV with columns
    ``idx, value``; the household account is ``Q_Y_{year}`` with ``region, value``. Positions outside
    the region-sector range are an error.
    """
    found = None
    for name in (f"satellite_{year}", f"Q_{year}", f"{year}"):
        found = _table(spark, f"{folder}/{name}")
        if found is not None:
            break
    if found is None:
        raise FileNotFoundError(f"no account for {year} in {folder}")
    flat = found.select(F.col("idx").cast("bigint").alias("idx"), F.col("value").cast("double").alias("value"))
    size = n_regions * n_sectors
    bad = flat.where((F.col("idx") < 0) | (F.col("idx") >= size) | F.col("idx").isNull()).limit(1).count()
    if bad:
        raise ValueError(f"account of {year} has positions outside 0..{size - 1}")
    account = flat.select(
        F.lit(year).alias("year"),
        F.floor(F.col("idx") / n_sectors).alias("region"),
        (F.col("idx") % n_sectors).alias("sector"),
        "value",
    )
    home = _table(spark, f"{folder}/Q_Y_{year}")
    if home is not None:
        home = home.select(F.col("region").cast("bigint").alias("region"), F.col("value").cast("double").alias("value"))
    return account, home


def _table(spark, stem):
    parquet = read_optional(spark, f"{stem}.parquet")
    return parquet if parquet is not None else read_optional(spark, f"{stem}.csv", "csv", header="true")


def read_country_history(spark: SparkSession, glob: str) -> DataFrame:
    """Country files ``{year}/{crop}_country_{year}.csv`` as ``year, crop`` and their columns."""
    table = spark.read.option("header", True).csv(glob)
    name = F.input_file_name()
    return table.withColumns(
        {
            "crop": key_from_path(name, r"^(.+)_country_\d{4}\.csv$"),
            "year": key_from_path(name, r"_country_(\d{4})\.csv$").cast("int"),
            "waterstress": F.expr("try_cast(waterstress as double)"),
        }
    ).where(F.col("crop").isNotNull())


def sum_country_history(table: DataFrame) -> DataFrame:
    return table.groupBy("crop", "year").agg(F.sum("waterstress").alias("value"))
