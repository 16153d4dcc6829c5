import math

import numpy as np
import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridspark.functions import scores
from gridspark.operators import correction, evaluation, mapping, report


def test_kge_perfect(frame):
    df = frame([(float(v), float(v)) for v in (1, 2, 5, 9)], "y_true double, y_pred double")
    r = evaluation.agreement(df, []).first()
    assert r["kge"] == 1.0 and r["r2"] == 1.0 and r["pbias"] == 0.0
    assert evaluation.agreement(df.limit(2), []).first()["kge"] is None


def test_pinball(frame):
    df = frame([(10.0, 8.0)], "y double, p double")
    got = df.select(scores.pinball(F.col("y"), F.col("p"), 0.9), scores.pinball(F.col("p"), F.col("y"), 0.9), scores.pinball(F.col("y"), F.col("p"), 0.1)).first()
    assert [round(v, 9) for v in got] == [1.8, 0.2, 0.2]


def test_constant_truth(frame):
    df = frame([(2.0, 1.0)] * 4, "y_true double, y_pred double")
    r = evaluation.regression_scores(df, []).first()
    assert r["nrmse_range"] == 1.0 and r["r2"] is None and r["medae"] == 1.0


def bounded(y, prob, corr, cap, threshold=0.6, rel=0.5, tol=0.05):
    """Plain restatement for small inputs; ties by position."""
    eligible = [i for i in range(len(y)) if prob[i] >= threshold]
    eligible = sorted(eligible, key=lambda i: (-prob[i], i))[: int(len(y) * cap)]
    step = np.zeros(len(y))
    for i in eligible:
        step[i] = np.clip(corr[i], -abs(y[i]) * rel, abs(y[i]) * rel)
    if y.sum() > 0 and abs(step.sum()) > y.sum() * tol:
        step *= y.sum() * tol / abs(step.sum())
    return np.maximum(y + step, 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_correction_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 200
    pdf = pd.DataFrame({"id": np.arange(n), "r": np.where(rng.random(n) < 0.5, 1, 2), "y": rng.random(n) * 100, "p": np.round(rng.random(n), 1), "c": rng.normal(60, 50, n)})
    out = correction.bounded_correction(spark.createDataFrame(pdf), ["r"], "id", "y", "p", "c", "z", max_share=0.2, tolerance=0.02)
    got = dict(rows(out, "id", "z"))
    for _, g in pdf.groupby("r"):
        want = bounded(g.y.values, g.p.values, g.c.values, 0.2, tol=0.02)
        assert np.allclose([got[i] for i in g.id], want)


def test_bounded_correction_cap(spark):
    df = spark.range(40).selectExpr("1 as r", "id", "100.0d as y", "case when id < 5 then 0.9 else 0.1 end as p", "400.0d as c")
    out = correction.bounded_correction(df, ["r"], "id", "y", "p", "c", "z")
    changed = [r["z"] for r in out.where("z <> y").collect()]
    assert changed == [150.0, 150.0]
    assert abs(out.agg(F.sum("z")).first()[0] - 4000) <= 200


def test_regional_thresholds(frame):
    df = frame([(1, 10, 0.0, 0.5, 1.0, 0.5), (2, 9000, 0.95, 0.5, 1.0, 0.5), (3, 9000, 0.0, 0.5, 1.0, 0.99), (4, 9000, 0.0, 0.1, 1.0, 0.99), (5, 9000, 0.0, -1.0, 1.0, 0.994)], "region int, n_samples int, zero_share double, base_r2 double, base_nrmse double, new_nrmse double")
    assert rows(correction.regional_decisions(df), "region", "reason") == [(1, "insufficient_samples"), (2, "zero_stress_region"), (3, "below_threshold"), (4, "adopted"), (5, "adopted")]


def test_split_weights_with_missing_year(frame):
    df = frame([("R", "oac", "a", y, 10.0) for y in (2003, 2004, 2006, 2007)] + [("R", "oac", "b", 2005, 30.0)], "region string, crop_group string, sector string, year int, value double")
    w = dict(((r["sector"], r["year"]), r["weight"]) for r in mapping.rolling_weights(df).collect())
    assert math.isclose(w["a", 2005], 0.25) and math.isclose(w["b", 2005], 0.75)
    assert mapping.check_weights(mapping.rolling_weights(df), ["region", "crop_group", "year"]).first() == (5, 0)


def test_complete_skeleton(frame):
    regions = frame([("X", 0), ("Y", 1), ("Z", 2)], "region string, region_ord int")
    one = frame([(2001, "Y", "s1", 5.0)], "year int, region string, sector string, allocated double")
    out = mapping.complete_table(one, regions, [2000, 2001], ["s0", "s1"])
    assert out.count() == 12 and out.where("waterstress = 0").count() == 11


def test_supply_use_block(frame):
    df = frame([(125, 3, 1.0), (5, 3, 2.0), (125, 130, 3.0), (360, 243, 4.0)], "row int, col int, value double")
    assert rows(mapping.supply_use_blocks(df)) == [(0, 5, 0, 3, 1.0), (1, 0, 1, 3, 4.0)]


def test_merge_rules(frame):
    schema = "year int, country string, crop string, value double"
    h, p = frame([(2018, "A", "wh", 1.0)], schema), frame([(2018, "A", "wh", 9.0), (2019, "A", "wh", 2.0)], schema)
    assert rows(mapping.merge_history(h, p), "year", "value") == [(2018, 1.0), (2019, 2.0)]
    assert rows(mapping.merge_history(h, p, "keep_prediction"), "year", "value") == [(2018, 9.0), (2019, 2.0)]
    assert mapping.discontinuity(mapping.merge_history(h, p), h).first()[0] == 100.0
    with pytest.raises(ValueError):
        mapping.merge_history(h, p, "other")


def test_items_keep_commas(frame):
    df = frame([("x", "beans, dry; peas;")], "item string, names string")
    assert rows(mapping.match_items(df, "item", "names"), "crop") == [("beans, dry",), ("peas",)]


def test_share_labels(frame):
    df = frame([("a", "P", "P", "t", 1.0), ("b", "P", "Q", "t", 2.0)], "crop string, production_country string, consumption_country string, target_sector string, value double")
    out = {(r["scope"], r["panel"], r["cat"]): r["percent_label"] for r in report.share_tables(df).collect()}
    assert out["global", "Crop", "a"] == "33.3%" and out["trade", "Crop", "b"] == "100%" and ("trade", "Crop", "a") not in out


def test_tiers_and_adoption_list(frame):
    df = frame([(0.6,), (0.3,), (None,)], "rho double")
    assert [r["tier"] for r in report.correlation_tier(df, "rho").collect()] == ["Strong", "Moderate", "Weak"]
    d = frame([("wh", "R", 10, True), ("wh", "R", 2, True), ("wh", "R", 3, False)], "crop string, layer string, region int, adopted boolean")
    assert rows(report.adoption_table(d)) == [("wh", "R", 2, 3, "2, 10")]
