"""Registered queries against their SQL on the smallest data; tools/check_oracle.py runs all of them."""

import os

import duckdb
import pytest
from helpers import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridspark.catalog import entries

QUERIES = {name: e.run for name, e in entries().items()}
SQL = {name: e.sql for name, e in entries().items() if e.sql is not None}
SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = [
    "stress_by_region_month", "gap_fill_months", "outer_merge_sources", "bilinear_regrid", "nearest_station", "point_in_polygon",
    "area_allocation", "annual_to_month", "scaling_factors", "lag_features", "median_impute", "asof_year_fallback", "temporal_cv",
    "bounded_correction", "kge_multilevel", "sector_allocation", "account_agreement", "footprint_indirect", "trade_shares",
    "top_regions_with_crops", "group_kfold", "group_hash_folds", "bootstrap_ci", "attribution_of_years", "footprint_balance", "yearly_scan",
    "written_keys", "crop_concordance", "share_pivot", "positional_concat",
]
# Iterative fits: no SQL says the same.
WITHOUT_SQL = {
    "quantile_trees_fit", "weighted_trees_fit", "global_layer", "param_sweep", "regional_residual",
    "detector_corrector", "cascade_score",
}

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@needs_data
def test_all_sql_runs(con):
    for name, sql in SQL.items():
        assert con.execute(sql).description, name


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = df.select(*names).collect(), cur.fetchall()
    assert len(got) == len(want) > 0
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@needs_data
@pytest.mark.parametrize("name", ["stress_by_region_month", "group_kfold", "importance_ranking", "mass_rescale_regrid", "totals_vs_base", "positional_concat", "extreme_labels", "median_impute"])
def test_plans_have_no_pairwise_joins(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "EvalPython" not in plan and "MapIn" not in plan


@needs_data
def test_scans_are_pruned(spark):
    """The flagship reads only the columns it uses."""
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.split("ReadSchema: ")[1:]]
    assert all("l_comment" not in s for s in schemas)
    lineitem = next(s for s in schemas if "l_quantity" in s).split("\n")[0]
    assert "l_tax" not in lineitem and "l_extendedprice" not in lineitem


def test_crop_years_broadcast_nothing(spark, tmp_path):
    """Orders, and the weights of customers: both grow with the data and are shuffled, however small their files are."""
    spark.range(1, 401).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    orders = spark.range(800).select(F.col("id").alias("o_orderkey"), (F.col("id") % 400 + 1).alias("o_custkey"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit("A").alias("l_returnflag"), F.lit(3.0).alias("l_quantity"), F.lit("1997-05-02").cast("timestamp").alias("l_shipdate"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QUERIES["stress_of_crop_years"](spark, str(tmp_path))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == [("A", 1997, 5, c, round(6.0 * ((c * 7 + 15) % 10 + 1) / 10, 4)) for c in range(1, 401)]
