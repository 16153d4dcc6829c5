import math

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridspark.functions import calendar, geo, quality
from gridspark.operators import grid, polygons, regrid, stress


def test_fill_gaps(frame):
    df = frame([(1, 2000, 2, 2.0), (1, 2000, 3, 3.0), (1, 2000, 5, 5.0)], "c int, year int, month int, v double")
    got = [r[0] for r in grid.fill_gaps(df, ["c"], ["v"]).orderBy("month").select("v").collect()]
    assert got == [2.0, 2.0, 3.0, 3.0] + [5.0] * 8


def test_fill_gaps_inside_present_months(frame):
    df = frame([(1, 2000, 1, 1.0), (1, 2000, 2, None)], "c int, year int, month int, v double")
    assert {r[0] for r in grid.fill_gaps(df, ["c"], ["v"]).select("v").collect()} == {1.0}


def test_monthly_composite_missing_month_is_null(frame):
    df = frame([("2000-02-01", 1.0), ("2000-02-09", 3.0), ("2000-03-01", None)], "d string, v double").selectExpr("1 as c", "cast(d as date) d", "v")
    got = dict(rows(grid.monthly_composite(df, ["c"], "d", "v"), "month", "v"))
    assert got[2] == 2.0 and got[3] is None and got[1] is None and len(got) == 12


def test_sum_bins_keep_total(spark):
    step = 0.05
    cells = spark.range(225).select(
        (F.lit(50 + step / 2) + F.floor(F.col("id") / 15) * step).alias("lat"), (F.lit(10 + step / 2) + F.col("id") % 15 * step).alias("lon"), F.lit(1.0).alias("v")
    )
    out = regrid.sum_bins(cells, [], ["v"], 5 / 60, 2160, 4320)
    assert out.agg(F.sum("v")).first()[0] == 225.0
    assert out.count() == 81


def dense(spark, values):
    n, m = values.shape
    return spark.createDataFrame([(i, j, float(values[i, j])) for i in range(n) for j in range(m) if not np.isnan(values[i, j])], "lat_idx int, lon_idx int, v double")


def test_bilinear_matches_numpy(spark):
    src = np.arange(20, dtype=float).reshape(4, 5) ** 1.5
    src[1, 2] = np.nan
    axis = regrid.positions_between(regrid.Axis(0.0, 1.0, 4), regrid.Axis(0.0, 0.5, 8))
    got = {(r[0], r[1]): r[2] for r in regrid.bilinear(dense(spark, src), [], "v", (4, 5), (8, 10), axis, axis).collect()}
    for ti in range(8):
        for tj in range(10):
            p, q = ti * 0.5, tj * 0.5
            if p > 3 or q > 4:
                assert (ti, tj) not in got
                continue
            i, j = min(int(p), 2), min(int(q), 3)
            a, b = p - i, q - j
            want = (src[i, j] * (1 - a) + src[i + 1, j] * a) * (1 - b) + (src[i, j + 1] * (1 - a) + src[i + 1, j + 1] * a) * b
            if np.isnan(want):
                assert (ti, tj) not in got
            else:
                assert math.isclose(got[ti, tj], want, abs_tol=1e-9)


def test_descending_source_axis(spark):
    src = np.array([[1.0, 2.0], [3.0, 4.0]])
    lat = regrid.positions_between(regrid.Axis(10.0, -10.0, 2), regrid.Axis(0.0, 5.0, 3))
    lon = regrid.positions_between(regrid.Axis(0.0, 1.0, 2), regrid.Axis(0.0, 1.0, 2))
    got = {(r[0], r[1]): r[2] for r in regrid.bilinear(dense(spark, src), [], "v", (2, 2), (3, 2), lat, lon).collect()}
    assert got == {(0, 0): 3.0, (0, 1): 4.0, (1, 0): 2.0, (1, 1): 3.0, (2, 0): 1.0, (2, 1): 2.0}


def test_upsample_alignments(spark):
    src = np.array([[1.0, 2.0, 3.0]])
    inside = regrid.upsample(dense(spark, src), [], ["v"], (1, 3), 5)
    assert inside.count() == 75 and dict(rows(inside.where("lat_idx = 0"), "lon_idx", "v"))[5] == 2.0
    line = dense(spark, np.array([[1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]))
    ends = dict(rows(regrid.upsample(line, [], ["v"], (2, 3), 5, align="endpoint").where("lat_idx = 0"), "lon_idx", "v"))
    assert [ends[i] for i in range(15)] == [float(1 + math.floor(i * 2 / 14 + 0.5)) for i in range(15)]
    with pytest.raises(ValueError):
        regrid.upsample(line, [], ["v"], (2, 3), 5, align="other")


def test_mass_is_kept(spark):
    src = np.random.default_rng(0).random((6, 6))
    out = regrid.bilinear_keep_total(dense(spark, src), [], "v", (6, 6), (9, 13))
    assert math.isclose(out.agg(F.sum("v")).first()[0], src.sum())


def test_zonal_smoothing_mirrors_edges(spark):
    values = np.zeros((6, 2))
    values[0] = 10.0
    out = [r[0] for r in grid.zonal_profile(dense(spark, values), [], "lat_idx", "v", 6, 2).orderBy("lat_idx").select("zonal_smooth").collect()]
    padded = np.array([0, 10, 10, 0, 0, 0, 0, 0, 0, 0.0])
    assert np.allclose(out, [padded[i : i + 5].mean() for i in range(6)])


def test_decode_rules(frame):
    df = frame([(-28672.0,), (-200.0,), (5000.0,), (20000.0,), (float("nan"),)], "g double")
    out = [r[0] for r in grid.decode_columns(df, {"g": quality.RULES["greenness"]}).collect()]
    assert out == [None, None, 0.5, None, None]


def test_range_check_flags(frame):
    df = frame([(1.0e6, -0.2)], "ssr double, evabs double")
    assert rows(grid.check_ranges(df), "variable", "ok") == [("evabs", False), ("ssr", True)]
    assert grid.check_ranges(frame([(1.0,)], "other double")).count() == 0


def test_longitudes(frame):
    df = frame([(190.0,), (-180.0,), (180.0,), (359.0,)], "lon double")
    assert rows(grid.normalise_longitude(df)) == [(-180.0,), (-180.0,), (-170.0,), (-1.0,)]


def test_merge_available(frame):
    a = frame([(2000, 1, 1, 5.0)], "year int, month int, cell_id int, a double")
    y = frame([(2000, 1, 7.0)], "year int, cell_id int, y double")
    static = frame([(1, 9.0)], "cell_id int, s double")
    keys = ["year", "month", "cell_id"]
    out = grid.merge_available({"a": a, "y": y}, keys, 2000, static=[static])
    assert out.count() == 12 and out.where("month = 1").select("a", "y", "s").first() == (5.0, 7.0, 9.0)
    assert grid.merge_available({"a": a, "b": None}, keys, 2000, require_all=True) is None
    assert grid.merge_available({"a": a, "b": None}, keys, 2000, {"b": 2010}, require_all=True) is not None


def test_mosaic_last_pixel_wins(frame):
    df = frame([("f1", 18, 9, 0, 0, 1), ("f2", 18, 9, 0, 0, 2), ("f3", 18, 9, 0, 0, 32767)], "file string, tile_h int, tile_v int, row int, col int, v int")
    assert [r["v"] for r in grid.sinusoidal_mosaic(df, [], "v", 32767).collect()] == [2]


def test_tile_and_date_tokens(frame):
    df = frame([("MCD12Q2.A2005032.h08v05.006.hdf",)], "f string")
    h, v = geo.tile_hv(F.col("f"))
    assert df.select(h, v, calendar.julian_file_date(F.col("f")).cast("string")).first() == (8, 5, "2005-02-01")


def test_polygon_hole(frame):
    def ring(*points):
        return [(1, *map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1])]

    edges = ring((0, 0), (1, 0), (1, 1), (0, 1)) + ring((0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6))
    df = frame(edges, "poly_id int, x1 double, y1 double, x2 double, y2 double")
    step = 0.1
    cells = {(r[0], r[1]) for r in polygons.cells_in_polygons(df, step).select("cell_lat", "cell_lon").collect()}

    def cell(x, y):
        return math.floor((90 - y) / step), math.floor((x + 180) / step)

    assert cell(0.25, 0.25) in cells and cell(0.55, 0.55) not in cells and cell(2, 2) not in cells
    assert len(cells) == 96


@pytest.mark.parametrize("crowded", [False, True])
def test_nearest_station_brute_force(spark, crowded):
    rng = np.random.default_rng(5)
    s, p = rng.random((300, 2)) * 100, rng.random((400, 2)) * 100
    if crowded:
        s[:120] = 40 + s[:120] / 1000
        p[:150] = 40 + p[:150] / 1000
        s[120:130] = s[130:140]
    stations = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(s)], "sid int, x double, y double")
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "pid int, x double, y double")
    got = dict(rows(stress.nearest_station(points, stations, "pid", "sid"), "pid", "sid"))
    d2 = ((p[:, None, :] - s[None, :, :]) ** 2).sum(axis=2)
    assert [got[i] for i in range(400)] == list(d2.argmin(axis=1))


def test_stress_multiplies_month_weight(frame):
    fp = frame([("wh", 2000, 1, 7, 2.0), ("wh", 2001, 1, 7, 3.0), ("bar", 2000, 2, 7, 5.0)], "crop string, year int, month int, cell_id bigint, wfp_blue_ir float")
    w = frame([(1, 7, 10.0), (2, 7, 0.5)], "month int, cell_id bigint, monthly_weight float")
    assert rows(stress.water_stress(fp, w, years=(2000, 2000)), "crop", "waterstress") == [("bar", 2.5), ("wh", 20.0)]
    assert stress.water_stress(fp, w, crops=["wh"]).count() == 2


def test_station_grid(frame):
    cells = frame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "cell_id int, lon double, lat double")
    stations = frame([(5, 1.0, 1.0), (6, 9.0, 9.0)], "station_id int, lon double, lat double")
    factors = frame([(5, 1, 0.5), (6, 1, 2.0)], "station_id int, month int, factor double")
    assert rows(stress.station_grid(cells, stations, factors)) == [(1, 1, 0.5), (1, 2, 2.0)]


def test_stress_broadcasts_no_cells(spark, tmp_path):
    """Weights of many cells and months in a small file, and a lookup of cells: neither is gathered on the driver."""
    spark.range(1, 3001).withColumnRenamed("id", "cell_id").coalesce(1).write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    months = cells.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    weights = months.withColumn("monthly_weight", F.col("month") * 0.5)
    footprint = months.select(F.lit("wh").alias("crop"), F.lit(2000).alias("year"), "month", "cell_id", F.lit(2.0).alias("wfp_blue_ir"))
    lookup = cells.select("cell_id", (F.col("cell_id") % 2).cast("string").alias("iso3"), F.lit("x").alias("country"))
    out = polygons.country_months(stress.water_stress(footprint, weights), lookup)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    assert rows(out, "iso3", "month", "waterstress") == [(i, m, 1500.0 * m) for i in "01" for m in range(1, 13)]
