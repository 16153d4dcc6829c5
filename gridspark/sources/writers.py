"""Writers: partitioned Parquet, sorted CSV, missing-partition selection, prediction export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.sources.readers import read_optional


def write_partitions(df: DataFrame, path: str, by: Sequence[str] = ("crop", "year")) -> None:
    """Zstandard Parquet partitioned by the keys; only partitions present in ``df`` are replaced.

    The adaptive planner merges small keys into one task and splits a large one over several (``rebalance``).
    """
    (
        df.hint("rebalance", *[F.col(c) for c in by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*by)
        .parquet(path)
    )


def missing_keys(wanted: DataFrame, path: str, by: Sequence[str] = ("crop", "year"), overwrite: bool = False) -> DataFrame:
    """The wanted partition keys that are not written yet."""
    existing = None if overwrite else read_optional(wanted.sparkSession, path)
    if existing is None:
        return wanted
    return wanted.join(existing.select(*by).distinct(), list(by), "left_anti")


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Sorted CSV with a header. The sort is a range partitioning, so files follow each other in order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def prediction_rows(df: DataFrame, prediction: str) -> DataFrame:
    """The published prediction columns: time, lat, lon, year, y_pred."""
    renamed = df.withColumn("y_pred", F.col(prediction)).withColumn("year", F.year("time"))
    lacking = [c for c in ("time", "lat", "lon") if c not in df.columns]
    if lacking:
        raise ValueError(f"prediction table lacks {lacking}")
    return renamed.select("time", "lat", "lon", "year", "y_pred")
