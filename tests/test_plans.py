import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridspark.plans import attribution_years, crop_area, feature_tables, sector_accounts, stress_grids


def test_attribution_of_two_years(spark):
    rng = np.random.default_rng(4)
    n_reg, n_sec = 2, 3
    flows, demand, accounts = [], [], []
    # The second year is 1e12 times smaller and must not be taken for finished with the first.
    for year, unit in ((2000, 1.0), (2001, 1e-12)):
        for r in range(n_reg):
            for s in range(n_sec):
                for r2 in range(n_reg):
                    demand.append((year, r, s, r2, float(rng.random() * 10 * unit)))
                    for s2 in range(n_sec):
                        flows.append((year, r, s, r2, s2, float(rng.random() * unit)))
                accounts += [(year, ind, r, s, float(rng.random())) for ind in (0, 1)]
    demand.append((1990, 0, 0, 0, 5.0))
    out = attribution_years.attribute_years(
        spark.createDataFrame(flows, "year int, from_region int, from_sector int, to_region int, to_sector int, value double"),
        spark.createDataFrame(demand, "year int, from_region int, from_sector int, to_region int, value double"),
        spark.createDataFrame(accounts, "year int, indicator int, region int, sector int, value double"),
        [1], n_reg, n_sec, tolerance=1e-10,
    )
    balance = out["balance"].collect()
    assert {(r["year"], r["indicator"]) for r in balance} == {(y, i) for y in (2000, 2001) for i in (0, 1)}
    for r in balance:
        want = sum(a[4] for a in accounts if a[0] == r["year"] and a[1] == r["indicator"])
        assert r["ok"] and np.isclose(r["expected"], want, rtol=1e-9) and r["rel_error"] < 1e-8


def test_feature_table(frame):
    rows_in = [("wh", 1, f"2000-{m:02d}-01", 10.0, 20.0, float(m), None if m == 2 else float(m)) for m in (1, 2, 3, 4)]
    history = [("wh", 1, "1999-12-01", 10.0, 20.0, 0.5, 9.0), ("wh", 1, "1999-01-01", 10.0, 20.0, 7.0, 9.0)]
    schema = "crop string, cell_id int, t string, lat double, lon double, sp double, twsan double"
    now, old = (frame(r, schema).withColumn("time", F.col("t").cast("date")).drop("t") for r in (rows_in, history))
    nao = frame([(2000, 1, 0.1)], "year int, month int, nao double")
    coarse, regions = frame([(1, 77)], "cell_id int, grid50_id int"), frame([(1, 5)], "cell_id int, regiontype int")
    out = feature_tables.build_features(now, [nao], coarse, regions, old, 2000).orderBy("time").collect()
    assert len(out) == 4 and out[0]["sp_lag1"] == 0.5 and out[0]["sp_lag2"] is None
    assert out[0]["nao"] == 0.1 and out[1]["nao"] is None and out[0]["grid50_id"] == 77 and out[0]["regiontype"] == 5
    # Median of 9, 1, 3, 4.
    assert out[1]["twsan"] == 3.5 and out[1]["twsan_roll3"] == pytest.approx((9 + 1 + 3.5) / 3)


def test_area_join_routes_groups(frame):
    r = frame([("wh", 2001, 1, 1), ("oac", 2001, 1, 1)], "crop string, year int, month int, cell_id int")
    monthly = frame([("wh", 2000, 1, 1, 5.0)], "crop string, year int, month int, cell_id int, harvested_area_irrigated double")
    annual = frame([("oac", 1999, 1, 7.0)], "crop string, year int, cell_id int, harvested_area_irrigated double")
    assert rows(feature_tables.add_area(r, monthly, annual), "crop", "ha_irrigated") == [("oac", 7.0), ("wh", 5.0)]


def test_stress_build_resumes(frame, spark, tmp_path):
    path = str(tmp_path / "s")
    fp = frame([("wh", 2000, 1, 7, 2.0), ("bar", 2000, 1, 7, 1.0)], "crop string, year int, month int, cell_id bigint, wfp_blue_ir float")
    w = frame([(1, 7, 10.0)], "month int, cell_id bigint, monthly_weight float")
    stress_grids.build_stress(fp.where("crop = 'wh'"), w, path)
    stress_grids.build_stress(fp, w.withColumn("monthly_weight", F.lit(0.5).cast("float")), path)
    table = spark.read.parquet(path)
    assert rows(table, "crop", "waterstress") == [("bar", 0.5), ("wh", 20.0)]
    lookup = frame([(7, "A", "AAA")], "cell_id bigint, country string, iso3 string")
    out = stress_grids.publication(table, lookup)
    assert rows(out["country_year"], "country", "crop", "waterstress") == [("A", "bar", 0.5), ("A", "wh", 20.0), ("GLOBAL", "bar", 0.5), ("GLOBAL", "wh", 20.0)]
    assert out["yearly_grid"].select("wh", "bar", "soy").first() == (20.0, 0.5, None)


def test_monthly_area_keeps_totals(frame):
    yearly = frame([("wheat", 2000, 1, 10.0, 6.0, 4.0), ("rice", 2000, 1, 8.0, 8.0, 0.0)], "crop string, year int, cell_id int, harvested_area double, harvested_area_irrigated double, harvested_area_rainfed double")
    cells = frame([(1, 45.025, 7.025)], "cell_id int, lat double, lon double")
    target = (int((90 - 45.025) / (5 / 60))) * 4320 + int((7.025 + 180) / (5 / 60))
    cal = frame([(c, s, target, 305, 59) for c in ("wh", "ri1", "ri2") for s in ("ir", "rf")], "crop string, system string, cell_id bigint, planting_day int, maturity_day int")
    out = crop_area.monthly_area(yearly, cells, cal).groupBy("crop").agg(F.sum("harvested_area_irrigated").alias("a"), F.sum("harvested_area_total").alias("b"))
    assert [(c, round(a, 6), round(b, 6)) for c, a, b in rows(out)] == [("ri1", 8.0, 8.0), ("ri2", 8.0, 8.0), ("wh", 6.0, 10.0)]
    assert crop_area.group_area(yearly).count() == 0


def test_sector_account(frame):
    values = frame([(2018, "A", "wh", 5.0), (2018, "A", "oac", 8.0), (2019, "A", "oac", 8.0), (2018, "Z", "wh", 1.0)], "year int, country string, crop string, value double")
    detailed = frame([("A", "d1", 2018, 3.0), ("A", "d2", 2018, 1.0)], "country string, crop string, year int, value double")
    crop_map = frame([("d1", "oac", "Growing tobacco"), ("d2", "oac", "Growing grapes")], "crop string, crop_group string, sector string")
    country = frame([("A", "R0")], "country string, region string")
    out = sector_accounts.sector_account(values, detailed, crop_map, country, country, frame([("R0", 0)], "region string, region_ord int"), [2018, 2019])
    positive = rows(out["account"].where("waterstress > 0"), "year", "sector", "waterstress")
    assert positive == [(2018, "Growing grapes", 2.0), (2018, "Growing tobacco", 6.0), (2018, "Growing wheat", 5.0), (2019, "Growing grapes", 2.0), (2019, "Growing tobacco", 6.0)]
    assert out["account"].count() == 28 and out["conservation"].first()["diff_pct"] == 0.0
    assert rows(out["unmapped"], "country") == [("Z",)] and out["lost"].count() == 0
