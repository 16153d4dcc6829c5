import pytest
from helpers import rows

from gridspark.sources import readers, writers


def test_partitioned_round_trip_and_resume(frame, tmp_path, spark):
    path = str(tmp_path / "t")
    df = frame([("wh", 2000, 1.0), ("wh", 2001, 2.0), ("bar", 2000, 3.0)], "crop string, year int, v double")
    writers.write_partitions(df, path)
    assert readers.read_crops(spark, path, "wh", 2001, 2005).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_crops(spark, path, "soy", 2000, 2001)
    # Only the partitions at hand are replaced.
    writers.write_partitions(frame([("wh", 2000, 9.0)], "crop string, year int, v double"), path)
    assert rows(readers.read_years(spark, path, 2000, 2001), "v") == [(2.0,), (3.0,), (9.0,)]
    wanted = frame([("wh", 2000), ("wh", 2002)], "crop string, year int")
    assert rows(writers.missing_keys(wanted, path)) == [("wh", 2002)]
    assert writers.missing_keys(wanted, path, overwrite=True).count() == 2
    assert writers.missing_keys(wanted, str(tmp_path / "none")).count() == 2


def test_absent_tables_are_none(spark, tmp_path):
    assert readers.read_optional(spark, str(tmp_path / "no.parquet")) is None
    assert readers.read_years(spark, str(tmp_path / "no"), 2000, 2001) is None


def test_partition_filter_reaches_the_scan(frame, tmp_path, spark):
    path = str(tmp_path / "p")
    writers.write_partitions(frame([("wh", 2000, 1.0)], "crop string, year int, v double"), path)
    plan = readers.read_crops(spark, path, "wh", 2000, 2000)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_keys_from_file_names(spark, tmp_path):
    for name in ("wfp_wh_2000.csv", "wfp_bar_2000.csv", "notes.csv"):
        (tmp_path / name).write_text("v\n1\n")
    got = readers.read_keyed(spark, str(tmp_path), r"^wfp_([a-z0-9]+)_\d+\.csv$", fmt="csv", header="true")
    assert rows(got, "crop") == [("bar",), ("wh",)]


def test_index_sources(spark, tmp_path):
    (tmp_path / "nao.csv").write_text("YEAR,MONTH,INDEX\n2000,1,0.5\n")
    assert rows(readers.read_long_index(spark, str(tmp_path / "nao.csv"), "INDEX", "nao")) == [(2000, 1, 0.5)]
    (tmp_path / "pdo.csv").write_text("Year,Month_1,Month_2\n2000,1.5,***\n")
    assert rows(readers.read_wide_index(spark, str(tmp_path / "pdo.csv"), "pdo")) == [(2000, 1, 1.5), (2000, 2, None)]
    (tmp_path / "x.tim").write_text("header line\n2000 " + " ".join(str(i) for i in range(12)) + "\n2001 1 2\n")
    assert readers.read_index_text(spark, str(tmp_path / "x.tim"), "x").count() == 12


def test_matrix_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("0,1.5,2\n3,0,4\n5,6,7\n")
    assert rows(readers.read_matrix(spark, str(tmp_path / "t.csv"), [1])) == [(1, 0, 3.0), (1, 2, 4.0)]
    assert readers.read_matrix(spark, str(tmp_path / "t.csv")).count() == 7


def test_account_candidates(frame, spark, tmp_path):
    frame([(5, 2.0)], "idx int, value double").write.parquet(str(tmp_path / "Q_2000.parquet"))
    frame([(1, 4.0)], "region int, value double").write.option("header", True).csv(str(tmp_path / "Q_Y_2000.csv"))
    account, home = readers.read_account(spark, str(tmp_path), 2000, 2, 4)
    assert rows(account) == [(2000, 1, 1, 2.0)] and rows(home) == [(1, 4.0)]
    with pytest.raises(ValueError):
        readers.read_account(spark, str(tmp_path), 2000, 1, 4)
    with pytest.raises(FileNotFoundError):
        readers.read_account(spark, str(tmp_path), 2001, 2, 4)


def test_country_history(spark, tmp_path):
    for year in (2000, 2001):
        (tmp_path / str(year)).mkdir()
        (tmp_path / str(year) / f"wh_country_{year}.csv").write_text("country,waterstress\nA,1.5\nB,2\n")
    table = readers.read_country_history(spark, str(tmp_path / "*" / "*_country_*.csv"))
    assert rows(readers.sum_country_history(table)) == [("wh", 2000, 3.5), ("wh", 2001, 3.5)]


def test_csv_and_prediction_export(frame, spark, tmp_path):
    df = frame([("2020-01-01", 1.0, 2.0, 5.0)], "time string, lat double, lon double, gre_q50 double").selectExpr("cast(time as date) time", "lat", "lon", "gre_q50")
    out = writers.prediction_rows(df, "gre_q50")
    assert out.columns == ["time", "lat", "lon", "year", "y_pred"] and out.first()["year"] == 2020
    with pytest.raises(ValueError):
        writers.prediction_rows(df.drop("lat"), "gre_q50")
    writers.write_csv(out, str(tmp_path / "c"), ["time"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
