import math

import numpy as np
import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridspark.functions import calendar, taxonomy
from gridspark.operators import area, features, validation


def weights(frame, plant, mature, table=calendar.SEASON_MONTHS):
    df = frame([(1, plant, mature)], "k int, planting_day int, maturity_day int")
    return [r["weight"] for r in area.season_months(df, ["k"], table).orderBy("month").collect()]


def test_season_wrap(frame):
    w = weights(frame, 305, 59)
    assert [round(x * 120) for x in w] == [31, 28, 0, 0, 0, 0, 0, 0, 0, 0, 31, 30]
    civil = weights(frame, 305, 59, calendar.CIVIL_MONTHS)
    assert [round(x * 120) for x in civil][10:] == [30, 31]


@pytest.mark.parametrize("season", [(100, 100), (1, 365), (365, 1), (200, 199), (45, 300)])
def test_season_weights_sum_to_one(frame, season):
    assert math.isclose(sum(weights(frame, *season)), 1.0)


def test_season_invalid(frame):
    assert sum(weights(frame, 0, 50)) == 0 and sum(weights(frame, None, 50)) == 0
    assert weights(frame, 100, 100)[3] == 1.0


def test_factors(frame):
    base = frame([("maize", 5, 2001, 37.0, 1), ("maize", 5, 2001, 2.0, 2), ("other", 5, 2001, 1.0, 3), ("rice", None, 2001, -4.0, 4)], "CROPGRIDS string, country_code int, year int, change_prop double, line int")
    new = frame([("maize", 6, 2024, 37.0, 1)], "CROPGRIDS string, country_code int, year int, change_prop double, line int")
    assert rows(area.scaling_factors(base, new)) == [("maize", 5, 2001, 2.0), ("maize", 6, 2024, 10.0), ("rice", -1, 2001, 0.0)]


def test_allocation_defaults_factor_to_one(frame):
    f = frame([(2000, 1, "c4ann", 0.5, 1.7)], "year int, cell_id int, cft string, frac double, irrig_frac double")
    s = frame([("maize", "c4ann", 1, 0.25)], "crop string, cft string, cell_id int, share double")
    c = frame([(1, 5, 1000.0)], "cell_id int, country_code int, area_ha double")
    none = frame([], "crop string, country_code int, year int, factor double")
    assert rows(area.allocate_area(f, s, c, none)) == [("maize", 2000, 1, 125.0, 125.0, 0.0)]


def test_taxonomy_sizes(spark):
    assert [len(taxonomy.GROUP_CROPS[c]) for c in ("oac", "pec", "pdc")] == [43, 33, 26]
    assert len(taxonomy.CROPS) == 27 and len(taxonomy.CODE_CROPS) == 24 and len(taxonomy.SECTORS) == 14
    assert area.group_members(spark).where("crop = 'rice'").count() == 2


def test_sanitise(frame):
    df = frame([(float("nan"),), (float("inf"),), (-1.0,), (None,), (2.0,)], "v double")
    assert [r[0] for r in area.sanitise(df, ["v"]).collect()] == [0.0, 0.0, 0.0, 0.0, 2.0]


def test_validation_statuses(frame):
    schema = "crop string, cell_id int, area double"
    ours = frame([("a", 1, 5.0), ("b", 1, 5.0), ("c", 1, 5.0)], schema)
    theirs = frame([("a", 1, 4.0), ("b", 1, 0.0), ("d", 1, 3.0)], schema)
    out = rows(area.validate_area(ours, theirs, F.col("cell_id")), "crop", "status", "pearson_r")
    assert out == [("a", "ok", None), ("b", "reference_zero", None), ("c", "reference_missing", None), ("d", "pipeline_missing", None)]


def test_rolling_skips_nulls(frame):
    df = frame([(1, 1, 1.0), (1, 2, None), (1, 3, None), (1, 4, 4.0)], "c int, t int, v double")
    assert [r[0] for r in features.add_rolling(df, ["c"], "t", ["v"]).orderBy("t").select("v_roll3").collect()] == [1.0, 1.0, 1.0, 4.0]


def test_imputation_order(frame):
    df = frame([(1, 1, 1.0), (1, 2, 3.0), (1, 3, None), (2, 1, None), (3, 9, None)], "c int, m int, v double")
    out = dict(((r[0], r[1]), r[2]) for r in rows(features.impute_medians(df, "v", [["c"], ["m"], []])))
    # Cell median, month median of what is filled by then, global median.
    assert out[(1, 3)] == 2.0 and out[(2, 1)] == 1.0 and out[(3, 9)] == 1.5


@pytest.mark.parametrize("fitted", [False, True])
def test_imputation_brute_force(spark, fitted):
    """Levels that do not nest, null keys, rows outside of the fit; every level sees what the ones before filled."""
    rng = np.random.default_rng(7)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 40, n), "b": rng.integers(0, 6, n), "v": np.round(rng.normal(0, 5, n), 1), "f": rng.random(n) < 0.5})
    pdf.loc[(rng.random(n) < 0.3) | (pdf.a % 5 == 0) | ((pdf.b == 5) & (pdf.a % 2 == 0)), "v"] = np.nan
    table = [(r.id, None if r.a == 7 else int(r.a), int(r.b), None if np.isnan(r.v) else r.v, bool(r.f)) for r in pdf.itertuples()]
    df = spark.createDataFrame(table, "id bigint, a int, b int, v double, f boolean")
    levels = [["a", "b"], ["a"], ["b"], []]
    got = dict(rows(features.impute_medians(df, "v", levels, F.col("f") if fitted else None), "id", "v"))
    values = [r[3] for r in table]
    for keys in levels:
        groups = {}
        key = [tuple(dict(a=r[1], b=r[2])[k] for k in keys) for r in table]
        for k, v, r in zip(key, values, table):
            if v is not None and (r[4] or not fitted):
                groups.setdefault(k, []).append(v)
        values = [v if v is not None else (float(np.median(groups[k])) if k in groups else None) for k, v in zip(key, values)]
    assert len(got) == n and all(v is not None and abs(got[i] - v) < 1e-9 for i, v in enumerate(values))


def test_asof(frame):
    ref = frame([(1, 2015, 5.0), (1, 2018, 8.0)], "cell_id int, year int, ha double")
    want = frame([(1, 2019), (1, 2017), (1, 2014), (1, 2022)], "cell_id int, year int")
    assert rows(features.asof_area(want, ref, ["cell_id"], "ha"), "year", "ha_irrigated") == [(2014, 0.0), (2017, 5.0), (2019, 8.0), (2022, 0.0)]
    assert rows(features.annual_area(want, ref, ["cell_id"], "ha"), "year", "ha_irrigated") == [(2014, 8.0), (2017, 8.0), (2019, 8.0), (2022, 8.0)]


def test_temporal_folds(spark):
    df = spark.range(60).selectExpr("cast(id + 1 as int) as time")
    out = rows(validation.temporal_folds(df, "time").groupBy("fold", "role").agg(F.min("time").alias("a"), F.max("time").alias("b")), "fold", "role", "a", "b")
    assert out == [(0, "test", 13, 36), (0, "train", 1, 12), (1, "test", 37, 60), (1, "train", 1, 36)]
    assert validation.temporal_folds(df.where("time <= 30"), "time").count() == 0


def test_spatial_folds_balanced(spark):
    sizes = [50, 40, 30, 20, 10, 9, 8, 7, 6, 5]
    df = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "g int")
    folds = validation.spatial_folds(df, "g", 5, balanced=True)
    assert folds.count() == 10 and folds.groupBy("fold").count().where("count <> 2").count() == 0
    hashed = validation.spatial_folds(df, "g", 3)
    assert hashed.select("g").distinct().count() == hashed.count() == 10


def test_sample_weights(frame):
    df = frame([(0.0,), (1.0,), (100.0,), (-5.0,)], "y double")
    got = [r[0] for r in validation.sample_weights(df, "y").select("weight").collect()]
    assert got[0] == 1.0 and got[3] == 1.0 and 1 < got[1] < got[2] <= 10


def test_bootstrap_is_inside_range(frame):
    df = frame([("a", float(v)) for v in (1, 2, 3, 4)], "k string, v double")
    r = validation.bootstrap_mean(df, ["k"], "v").first()
    assert r["mean"] == 2.5 and 1 <= r["ci_low"] < 2.5 < r["ci_high"] <= 4


def test_unpivot_months_names_and_stars(frame):
    df = frame([("2000", "***", "2.5")], "Year string, Jan string, Feb string")
    assert rows(features.unpivot_months(df, "Year", "x")) == [(2000, 1, None), (2000, 2, 2.5)]


def test_prepend_keeps_new_rows(frame):
    new = frame([(1, "2019-01-01", 9.0)], "c int, t string, v double").withColumn("t", F.col("t").cast("date"))
    old = frame([(1, "2018-06-01", 1.0), (1, "2018-07-01", 2.0), (1, "2019-01-01", 3.0)], "c int, t string, v double").withColumn("t", F.col("t").cast("date"))
    out = rows(features.prepend_history(new, old, ["c"], "t", 2019).selectExpr("cast(t as string) t", "v"))
    assert out == [("2018-07-01", 2.0), ("2019-01-01", 9.0)]


def test_month_mask_and_rows(frame):
    y = frame([("wh", 2000, 1, 1, 5.0), ("wh", 2000, 2, 1, None)], "crop string, year int, month int, cell_id int, waterstress double")
    x = frame([(2000, 1, 1, 1.0, None), (2000, 2, 1, 1.0, None)], "year int, month int, cell_id int, a double, b double")
    mask = features.month_mask(y)
    assert features.training_rows(x, y, mask, ["a", "b"]).count() == 1
    assert features.prediction_rows(x, mask, ["b"]).count() == 0


def test_assemble_fills_missing(frame):
    df = frame([(1.0, None), (float("nan"), 2.0)], "a double, b double")
    out = [list(r[0]) for r in features.assemble(df, ["a", "b"], missing=-1.0).select("features").collect()]
    assert out == [[1.0, -1.0], [-1.0, 2.0]]
