"""Registration of queries and the output form shared by the Spark and the SQL side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.session import tune

MODULES = ["grids", "areas", "feature_tables", "model_scores", "accounts", "chains", "reports", "models", "together", "sources"]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def entries() -> dict[str, Entry]:
    """All registered queries."""
    for module in MODULES:
        import_module(f"gridspark.catalog.{module}")
    return CATALOG


def _shape(out: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in out.split()]


def finish(df: DataFrame, out: str) -> DataFrame:
    """Select the output columns: ``name:i`` integer, ``name:s`` as is, ``name:4`` rounded to 4 digits."""
    cols = []
    for name, kind in _shape(out):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind != "s":
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        cols.append(c.alias(name))
    return df.select(*cols)


def finish_sql(sql: str, out: str) -> str:
    cols = []
    for name, kind in _shape(out):
        if kind == "i":
            cols.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind == "s":
            cols.append(f'"{name}"')
        else:
            cols.append(f'round(CAST("{name}" AS DOUBLE), {kind}) + 0.0 AS "{name}"')
    return f"SELECT {', '.join(cols)} FROM ({sql}) AS result"


def query(name: str, out: str, sql: str | None = None):
    """Register a query; ``sql`` computes the same columns before rounding."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(Tables(tune(spark), sf_dir)), out)

        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Entry(name, run, None if sql is None else finish_sql(sql, out))
        return fn

    return register


class Tables:
    """The given tables and the grid views the queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def lines(self) -> DataFrame:
        """Order lines on a 12 x 12 grid: crop = return flag, month of shipping, part and supplier as axes."""
        i, j = F.col("l_partkey") % 12, F.col("l_suppkey") % 12
        return self.lineitem.select(
            F.col("l_returnflag").alias("crop"),
            F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month"),
            i.alias("lat_idx"),
            j.alias("lon_idx"),
            (i * 12 + j).alias("cell_id"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_orderkey").alias("orderkey"),
            F.col("l_partkey").alias("partkey"),
            F.col("l_suppkey").alias("suppkey"),
            F.col("l_linenumber").alias("linenumber"),
            F.col("l_linestatus").alias("status"),
        )

    @property
    def grid(self) -> DataFrame:
        """Quantity per cell and year."""
        return self.lines.groupBy("year", "lat_idx", "lon_idx").agg(F.sum("qty").alias("v"))


# The same views for the SQL side.
LINES = """lines AS (
  SELECT l_returnflag AS crop, year(l_shipdate) AS year, month(l_shipdate) AS month,
         l_partkey % 12 AS lat_idx, l_suppkey % 12 AS lon_idx, (l_partkey % 12) * 12 + l_suppkey % 12 AS cell_id,
         l_quantity AS qty, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_orderkey AS orderkey,
         l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS linenumber, l_linestatus AS status
  FROM lineitem)"""
GRID = LINES + """, grid AS (SELECT year, lat_idx, lon_idx, sum(qty) AS v FROM lines GROUP BY ALL)"""
