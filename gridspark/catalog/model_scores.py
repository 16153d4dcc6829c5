"""Splits, weights, corrections and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.base import LINES, query
from gridspark.operators import cascade, correction, evaluation, validation
from gridspark.operators.scale import literal_rows, spearman
from gridspark.session import cut_lineage


def predictions(t):
    """Truth and three layers of predictions per crop, country, cell and month."""
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("suppkey"), F.when(F.col("n_nationkey") % 12 != 0, F.col("n_name")).alias("country")
    )
    # Summed per supplier before the lookup.
    sums = t.lines.groupBy("crop", "suppkey", "cell_id", "year", "month").agg(F.sum("price").alias("p"), F.sum("qty").alias("q"))
    named = sums.join(suppliers, "suppkey").groupBy("crop", "country", "cell_id", "year", "month").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q")
    )
    y = F.when(F.col("cell_id") % 9 == 0, 0.0).otherwise(F.col("p") / 1e4)
    g = F.round(F.col("q") * 0.11 * ((F.col("cell_id") % 5) * 0.1 + 0.8), 6)
    r = g + (F.col("month") - 6) * 0.05
    table = named.select(
        "crop", "country", "cell_id", "year", "month", y.alias("y_true"), g.alias("y_pred"), r.alias("y_gr"),
        (r + F.col("cell_id") % 3).alias("y_gre"), (g * 0.7).alias("q10"), (g * 1.25).alias("q90"),
    )
    # Scores read the prediction table several times, as they would a written one.
    return cut_lineage(table)


PRED = f"""{LINES}, raw AS (SELECT crop, CASE WHEN n_nationkey % 12 <> 0 THEN n_name END AS country, cell_id, year, month, sum(price) AS p, sum(qty) AS q
      FROM lines JOIN supplier ON suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
    base AS (SELECT *, CASE WHEN cell_id % 9 = 0 THEN 0.0 ELSE p / 1e4 END AS y_true, round(q * 0.11 * ((cell_id % 5) * 0.1 + 0.8), 6) AS y_pred FROM raw),
    pred AS (SELECT crop, country, cell_id, year, month, y_true, y_pred, y_pred + (month - 6) * 0.05 AS y_gr,
      y_pred + (month - 6) * 0.05 + cell_id % 3 AS y_gre, y_pred * 0.7 AS q10, y_pred * 1.25 AS q90 FROM base)"""


@query(
    "temporal_cv",
    "time:s fold:i role:s n:i",
    """WITH d AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS time FROM orders),
    p AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS pos, count(*) OVER () AS n FROM d),
    f AS (SELECT time, pos, n, fold, greatest(1, (n - 12) // 24) AS k FROM p, range(0, 20) AS r(fold)),
    s AS (SELECT time, fold, pos, n - (k - fold) * 24 AS start FROM f WHERE fold < k),
    x AS (SELECT time, fold, CASE WHEN pos < start THEN 'train' WHEN pos < start + 24 THEN 'test' END AS role FROM s WHERE start >= 12)
    SELECT time, fold, role, count(*) AS n FROM x JOIN orders ON CAST(date_trunc('month', o_orderdate) AS DATE) = time WHERE role IS NOT NULL GROUP BY ALL""",
)
def temporal_cv(t):
    rows = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("time")).agg(F.count(F.lit(1)).alias("n"))
    return validation.assign_folds(rows, validation.temporal_folds(rows, "time"), ["time"])


@query(
    "group_kfold",
    "fold:i n_groups:i n_rows:i largest:i smallest:i n_split:i",
    """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL),
    p AS (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS pos FROM g),
    f AS (SELECT n, CASE WHEN pos // 5 % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS fold FROM p)
    SELECT fold, count(*) AS n_groups, sum(n) AS n_rows, max(n) AS largest, min(n) AS smallest, 0 AS n_split FROM f GROUP BY fold""",
)
def group_kfold(t):
    folds = validation.spatial_folds(t.orders, "o_custkey", 5, balanced=True)
    split = folds.groupBy("o_custkey").agg(F.count_distinct("fold").alias("in_folds"))
    sizes = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).join(split, "o_custkey")
    return folds.join(sizes, "o_custkey").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n").alias("n_rows"),
        F.max("n").alias("largest"),
        F.min("n").alias("smallest"),
        F.count_if(F.col("in_folds") > 1).alias("n_split"),
    )


@query(
    "group_hash_folds",
    "o_custkey:i fold:i n:i",
    """SELECT o_custkey, CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS fold, count(*) AS n FROM orders GROUP BY ALL""",
)
def group_hash_folds(t):
    folds = validation.spatial_folds(t.orders, "o_custkey", 5)
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).join(folds, "o_custkey")


@query(
    "year_splits",
    "fold:i role:s n:i",
    """SELECT 0 AS fold, 'train' AS role, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997
    UNION ALL SELECT 0, 'test', count(*) FROM orders WHERE year(o_orderdate) = 1998
    UNION ALL SELECT 1, 'train', count(*) FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998
    UNION ALL SELECT 1, 'test', count(*) FROM orders WHERE year(o_orderdate) IN (1999, 2000)""",
)
def year_splits(t):
    rows = t.orders.select(F.year("o_orderdate").alias("year"))
    split = validation.year_splits(rows, [((1995, 1996, 1997), (1998,)), ((1996, 1997, 1998), (1999, 2000))])
    return split.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sample_weights",
    "crop:s cell_id:i year:i month:i weight:6",
    f"""WITH {PRED}, y AS (SELECT crop, cell_id, year, month, sum(y_true) AS y FROM pred GROUP BY ALL),
    q AS (SELECT quantile_cont(y, 0.9) AS q FROM y WHERE y > 0)
    SELECT crop, cell_id, year, month, greatest(1.0, least(10.0, 1 + greatest(y, 0) / q * 4)) AS weight FROM y, q""",
)
def sample_weights(t):
    rows = predictions(t).groupBy("crop", "cell_id", "year", "month").agg(F.sum("y_true").alias("y"))
    return validation.sample_weights(rows, "y", alpha=4.0)


@query(
    "param_average",
    "crop:s depth:i rate:8",
    f"""WITH {PRED}, s AS (SELECT crop, year, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, count(*) % 7 + 3 AS depth, (year - 1990) / 40.0 AS rate FROM pred GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY rmse, depth, rate) AS r FROM s)
    SELECT crop, round_even(sum(depth / rmse) / sum(1 / rmse), 0) AS depth, sum(rate / rmse) / sum(1 / rmse) AS rate FROM b WHERE r <= 3 GROUP BY crop""",
)
def param_average(t):
    err = F.col("y_pred") - F.col("y_true")
    rows = predictions(t).groupBy("crop", "year").agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), (F.count(F.lit(1)) % 7 + 3).alias("depth")
    ).withColumn("rate", (F.col("year") - 1990) / 40.0)
    return validation.average_parameters(rows, ["crop"], "rmse", ["depth", "rate"], ["depth"])


@query(
    "bootstrap_ci",
    "crop:s mean:6 ci_low:6 ci_high:6",
    f"""WITH {PRED}, e AS (SELECT crop, year, sqrt(avg((y_pred - y_true) ^ 2)) AS rmse FROM pred GROUP BY ALL),
    l AS (SELECT crop, list(rmse ORDER BY rmse) AS v, avg(rmse) AS mean FROM e GROUP BY crop),
    d AS (SELECT crop, mean, v, draw, slot FROM l, range(0, 1000) AS a(draw), range(1, 100) AS b(slot) WHERE slot <= len(v)),
    m AS (SELECT crop, mean, avg(v[CAST('0x' || substr(md5(draw || ',' || slot || ',42'), 1, 8) AS BIGINT) % len(v) + 1]) AS m FROM d GROUP BY crop, mean, draw)
    SELECT crop, mean, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY crop, mean""",
)
def bootstrap_ci(t):
    err = F.col("y_pred") - F.col("y_true")
    rows = predictions(t).groupBy("crop", "year").agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    return validation.bootstrap_mean(rows, ["crop"], "rmse")


@query(
    "oof_supplement",
    "source:s n:i total:4",
    f"""WITH {PRED}, a AS (SELECT cell_id, year, month, sum(y_pred) AS y_pred FROM pred WHERE crop = 'A' GROUP BY ALL), b AS (SELECT cell_id, year, month, sum(y_pred) AS v FROM pred WHERE crop <> 'A' GROUP BY ALL)
    SELECT 'base' AS source, count(*) AS n, sum(y_pred) AS total FROM a
    UNION ALL SELECT 'extra', count(*), sum(v) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.cell_id = b.cell_id AND a.year = b.year AND a.month = b.month)""",
)
def oof_supplement(t):
    p = predictions(t)
    base = p.where(F.col("crop") == "A").groupBy("cell_id", "year", "month").agg(F.sum("y_pred").alias("v")).withColumn("source", F.lit("base"))
    extra = p.where(F.col("crop") != "A").groupBy("cell_id", "year", "month").agg(F.sum("y_pred").alias("v")).withColumn("source", F.lit("extra"))
    joined = correction.supplement(base, extra, ["cell_id", "year", "month"])
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query(
    "fold_average",
    "cell_id:i year:i y_pred:6 y_gr:6 y_true:6",
    f"""WITH {PRED}, f AS (SELECT cell_id, year, month AS fold, sum(y_pred) AS y_pred, sum(y_gr) AS y_gr, sum(y_true) AS y_true FROM pred GROUP BY ALL)
    SELECT cell_id, year, avg(y_pred) AS y_pred, avg(y_gr) AS y_gr, arg_min(y_true, fold) AS y_true FROM f GROUP BY ALL""",
)
def fold_average(t):
    rows = predictions(t).groupBy("cell_id", "year", F.col("month").alias("fold")).agg(
        F.sum("y_pred").alias("y_pred"), F.sum("y_gr").alias("y_gr"), F.sum("y_true").alias("y_true")
    )
    return correction.average_folds(rows, ["cell_id", "year"], ["y_pred", "y_gr"])


@query(
    "extreme_labels",
    "crop:s threshold:6 n_high:i n_under:i n_over:i under_pct:6",
    f"""WITH {PRED}, q AS (SELECT crop, quantile_cont(y_true, 0.85) AS threshold FROM pred GROUP BY crop),
    l AS (SELECT crop, threshold, y_true, y_pred FROM pred JOIN q USING (crop) WHERE y_true >= threshold)
    SELECT crop, max(threshold) AS threshold, count(*) AS n_high, count(*) FILTER (y_pred < y_true * 0.85) AS n_under,
      count(*) FILTER (y_pred > y_true * 1.15) AS n_over, count(*) FILTER (y_pred < y_true * 0.85) / count(*) * 100 AS under_pct FROM l GROUP BY crop""",
)
def extreme_labels(t):
    return correction.label_summary(correction.label_extremes(predictions(t), ["crop"]), ["crop"])


CORR_SQL = f"""{LINES}, rows_in AS (SELECT crop, orderkey * 10 + linenumber AS id, sum(qty) AS base, max(discount * 10) AS prob, sum(price) / 1000 - 20 AS c
      FROM lines GROUP BY ALL),
    n AS (SELECT crop, floor(count(*) * 0.05) AS cap, sum(base) AS total FROM rows_in GROUP BY crop),
    e AS (SELECT crop, id, row_number() OVER (PARTITION BY crop ORDER BY prob DESC, id) AS r FROM rows_in WHERE prob >= 0.6),
    s AS (SELECT i.crop, i.id, base, prob, CASE WHEN r <= cap THEN greatest(-abs(base) * 0.5, least(abs(base) * 0.5, c)) ELSE 0.0 END AS step,
            coalesce(r <= cap, false) AS corrected, total FROM rows_in i JOIN n USING (crop) LEFT JOIN e ON e.crop = i.crop AND e.id = i.id),
    f AS (SELECT crop, CASE WHEN max(total) > 0 AND abs(sum(step)) > max(total) * 0.01 THEN max(total) * 0.01 / abs(sum(step)) ELSE 1.0 END AS f FROM s GROUP BY crop),
    fixed AS (SELECT s.crop, id, base, prob, corrected, greatest(base + step * f, 0) AS y FROM s JOIN f USING (crop))"""


def corrected(t):
    rows = t.lines.groupBy("crop", (F.col("orderkey") * 10 + F.col("linenumber")).alias("id")).agg(
        F.sum("qty").alias("base"), F.max(F.col("discount") * 10).alias("prob"), (F.sum("price") / 1000 - 20).alias("c")
    )
    return correction.bounded_correction(rows, ["crop"], "id", "base", "prob", "c", "y", tolerance=0.01)


@query("bounded_correction", "crop:s id:i y:5 corrected:s", f"WITH {CORR_SQL} SELECT crop, id, y, corrected FROM fixed")
def bounded_correction(t):
    return corrected(t)


@query(
    "correction_summary",
    "crop:s n_eligible:i n_corrected:i correction_pct:6 mean_correction:6 conservation_ratio:8",
    f"""WITH {CORR_SQL} SELECT crop, count(*) FILTER (prob >= 0.6) AS n_eligible, count(*) FILTER (corrected) AS n_corrected,
    count(*) FILTER (corrected) / count(*) * 100 AS correction_pct, coalesce(avg(abs(y - base)) FILTER (corrected), 0) AS mean_correction,
    sum(y) / sum(base) AS conservation_ratio FROM fixed GROUP BY crop""",
)
def correction_summary(t):
    return correction.correction_summary(corrected(t), ["crop"], "base", "y", "prob")


FOLD_METRICS = f"""{PRED}, fm AS (SELECT cell_id % 12 AS region, year,
      (sqrt(avg((y_gr - y_true) ** 2)) - sqrt(avg((y_pred - y_true) ** 2))) / sqrt(avg((y_pred - y_true) ** 2)) * 100 AS rc,
      avg(y_gr - y_pred) * 20 + any_value(cell_id % 12) % 4 AS gain, sum(y_gr) / sum(y_pred) AS cons,
      1 - sum((y_pred - y_true) ** 2) / (var_pop(y_true) * count(*)) AS r2b, 1 - sum((y_gr - y_true) ** 2) / (var_pop(y_true) * count(*)) AS r2f
      FROM pred GROUP BY ALL)"""


@query(
    "adoption_score",
    "region:i score:6 decision:s adopted:s",
    f"""WITH {FOLD_METRICS}, m AS (SELECT region, avg(rc) AS rise, avg(gain) AS gain, stddev_pop(gain) AS sd, avg(cons) AS cons, avg(r2b) AS rb, avg(r2f) AS rf FROM fm GROUP BY region),
    c AS (SELECT *, least(5.0, gain / CASE WHEN rb >= 0.9 THEN 0.3 WHEN rb >= 0.7 THEN 1.0 ELSE 2.0 END * 2.5)
       + CASE WHEN rise <= 0 THEN least(2.0, -rise * 0.5) ELSE greatest(-3.0, -rise * 0.3) END
       + CASE WHEN abs(cons - 1) <= 0.02 THEN 1.0 WHEN abs(cons - 1) <= 0.05 THEN 0.5 ELSE 0 END
       + CASE WHEN rf - rb >= 0 THEN least(1.0, (rf - rb) * 50) ELSE greatest(-2.0, (rf - rb) * 100) END
       + greatest(0, 1 - least(1.0, sd / greatest(0.1, gain))) AS score FROM m),
    d AS (SELECT region, score, CASE WHEN rise > 5 THEN 'VETO_RMSE' WHEN abs(cons - 1) > 0.1 THEN 'VETO_CONSERVATION'
       WHEN score >= 3 THEN 'STRONG_ACCEPT' WHEN score >= 1 THEN 'ACCEPT' ELSE 'REJECT' END AS decision FROM c)
    SELECT region, score, decision, decision IN ('ACCEPT', 'STRONG_ACCEPT') AS adopted FROM d""",
)
def adoption_score(t):
    a, b = F.col("y_pred") - F.col("y_true"), F.col("y_gr") - F.col("y_true")
    sst = F.var_pop("y_true") * F.count(F.lit(1))
    before, after = F.sqrt(F.avg(a * a)), F.sqrt(F.avg(b * b))
    folds = predictions(t).groupBy((F.col("cell_id") % 12).alias("region"), "year").agg(
        ((after - before) / before * 100).alias("rmse_change_pct"),
        (F.avg(F.col("y_gr") - F.col("y_pred")) * 20 + F.first(F.col("cell_id") % 12) % 4).alias("extreme_improvement_pct"),
        (F.sum("y_gr") / F.sum("y_pred")).alias("conservation_ratio"),
        (1 - F.sum(a * a) / sst).alias("r2_base"),
        (1 - F.sum(b * b) / sst).alias("r2_final"),
    )
    return correction.adoption_scores(folds, ["region"])


@query(
    "regional_decisions",
    "region:i improvement_pct:6 needed_pct:2 reason:s adopted:s",
    f"""WITH {PRED}, s AS (SELECT cell_id % 18 AS region, count(*) AS n, avg(CASE WHEN y_true = 0 THEN 1.0 ELSE 0.0 END) AS z,
      1 - sum((y_pred - y_true) ** 2) / nullif(var_pop(y_true) * count(*), 0) AS r2,
      sqrt(avg((y_pred - y_true) ** 2)) AS a, sqrt(avg((y_gr - y_true) ** 2)) AS b FROM pred GROUP BY ALL),
    d AS (SELECT region, n, z, (a - b) / a * 100 AS gain, CASE WHEN r2 < 0 THEN 0.5 WHEN r2 < 0.2 THEN 1.0 ELSE 2.0 END AS need FROM s),
    e AS (SELECT *, CASE WHEN n < 2000 THEN 'insufficient_samples' WHEN z > 0.9 THEN 'zero_stress_region' WHEN gain >= need THEN 'adopted' ELSE 'below_threshold' END AS reason FROM d)
    SELECT region, gain AS improvement_pct, need AS needed_pct, reason, reason = 'adopted' AS adopted FROM e""",
)
def regional_decisions(t):
    a, b = F.col("y_pred") - F.col("y_true"), F.col("y_gr") - F.col("y_true")
    sst = F.var_pop("y_true") * F.count(F.lit(1))
    facts = predictions(t).groupBy((F.col("cell_id") % 18).alias("region")).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg((F.col("y_true") == 0).cast("double")).alias("zero_share"),
        F.when(sst > 0, 1 - F.sum(a * a) / sst).alias("base_r2"),
        F.sqrt(F.avg(a * a)).alias("base_nrmse"),
        F.sqrt(F.avg(b * b)).alias("new_nrmse"),
    )
    return correction.regional_decisions(facts, min_samples=2000)


@query(
    "regression_metrics",
    "crop:s year:i n_samples:i rmse:6 nrmse_range:8 mae:6 medae:8 r2:6 bias:6",
    f"""WITH {PRED} SELECT crop, year, count(*) AS n_samples, sqrt(avg((y_pred - y_true) ** 2)) AS rmse,
    sqrt(avg((y_pred - y_true) ** 2)) / (max(y_true) - min(y_true)) AS nrmse_range, avg(abs(y_pred - y_true)) AS mae, median(abs(y_pred - y_true)) AS medae,
    1 - sum((y_pred - y_true) ** 2) / (var_pop(y_true) * count(*)) AS r2, avg(y_pred - y_true) AS bias FROM pred GROUP BY ALL""",
)
def regression_metrics(t):
    return evaluation.regression_scores(predictions(t), ["crop", "year"])


@query(
    "extreme_metrics",
    "crop:s n_extreme_p90:i rmse_extreme_p90:6 nrmse_extreme_p90:8 bias_extreme_p90:6 hit_p90_own:8 false_alarm_p90:8 n_extreme_p95:i hit_p95_own:8",
    f"""WITH {PRED}, q AS (SELECT crop, quantile_cont(y_true, 0.9) AS y90, quantile_cont(y_true, 0.95) AS y95, quantile_cont(y_pred, 0.9) AS p90, quantile_cont(y_pred, 0.95) AS p95,
      max(y_true) - min(y_true) AS spread FROM pred GROUP BY crop)
    SELECT crop, count(*) FILTER (y_true >= y90) AS n_extreme_p90, sqrt(avg((y_pred - y_true) ** 2) FILTER (y_true >= y90)) AS rmse_extreme_p90,
      sqrt(avg((y_pred - y_true) ** 2) FILTER (y_true >= y90)) / max(spread) AS nrmse_extreme_p90, avg(y_pred - y_true) FILTER (y_true >= y90) AS bias_extreme_p90,
      count(*) FILTER (y_true >= y90 AND y_pred >= p90) / count(*) FILTER (y_true >= y90) AS hit_p90_own,
      count(*) FILTER (y_true < y90 AND y_pred >= p90) / count(*) FILTER (y_pred >= p90) AS false_alarm_p90,
      count(*) FILTER (y_true >= y95) AS n_extreme_p95, count(*) FILTER (y_true >= y95 AND y_pred >= p95) / count(*) FILTER (y_true >= y95) AS hit_p95_own
    FROM pred JOIN q USING (crop) GROUP BY crop""",
)
def extreme_metrics(t):
    return evaluation.extreme_scores(predictions(t), ["crop"])


@query(
    "interval_metrics",
    "crop:s picp_80:8 piw_80:6 below_q10:8 above_q90:8 crps:6",
    f"""WITH {PRED}, l AS (SELECT *, CASE WHEN y_true >= q10 THEN 0.1 * (y_true - q10) ELSE -0.9 * (y_true - q10) END AS l1,
      CASE WHEN y_true >= y_pred THEN 0.5 * (y_true - y_pred) ELSE -0.5 * (y_true - y_pred) END AS l5,
      CASE WHEN y_true >= q90 THEN 0.9 * (y_true - q90) ELSE -0.1 * (y_true - q90) END AS l9 FROM pred)
    SELECT crop, avg(CASE WHEN y_true BETWEEN q10 AND q90 THEN 1.0 ELSE 0 END) AS picp_80, avg(q90 - q10) AS piw_80,
      avg(CASE WHEN y_true < q10 THEN 1.0 ELSE 0 END) AS below_q10, avg(CASE WHEN y_true > q90 THEN 1.0 ELSE 0 END) AS above_q90,
      (avg(l1) + avg(l5) + avg(l9)) / 3 AS crps FROM l GROUP BY crop""",
)
def interval_metrics(t):
    return evaluation.interval_table(predictions(t), ["crop"], "y_true", "q10", "y_pred", "q90")


@query(
    "pinball_loss",
    "year:i pinball_q10:6 pinball_q90:6",
    f"""WITH {PRED} SELECT year, avg(CASE WHEN y_true >= q10 THEN 0.1 * (y_true - q10) ELSE -0.9 * (y_true - q10) END) AS pinball_q10,
    avg(CASE WHEN y_true >= q90 THEN 0.9 * (y_true - q90) ELSE -0.1 * (y_true - q90) END) AS pinball_q90 FROM pred GROUP BY year""",
)
def pinball_loss(t):
    return evaluation.pinball_table(predictions(t), ["year"], "y_true", {0.1: "q10", 0.9: "q90"})


@query(
    "between_group_rmse",
    "crop:s between_rmse:6",
    f"""WITH {PRED}, m AS (SELECT crop, cell_id, avg(y_true) AS y, avg(y_pred) AS p FROM pred GROUP BY ALL)
    SELECT crop, sqrt(avg((p - y) ** 2)) AS between_rmse FROM m GROUP BY crop""",
)
def between_group_rmse(t):
    return evaluation.between_group_rmse(predictions(t), "cell_id", ["crop"])


@query(
    "layer_improvement",
    "crop:s improvement_pct:6",
    f"""WITH {PRED} SELECT crop, (sqrt(avg((y_pred - y_true) ** 2)) - sqrt(avg((y_gr - y_true) ** 2))) / sqrt(avg((y_pred - y_true) ** 2)) * 100 AS improvement_pct FROM pred GROUP BY crop""",
)
def layer_improvement(t):
    from gridspark.functions.scores import core_scores, improvement_pct

    base, new = (core_scores(F.col("y_true"), F.col(c))["rmse"] for c in ("y_pred", "y_gr"))
    return predictions(t).groupBy("crop").agg(improvement_pct(base, new).alias("improvement_pct"))


KGE_COLS = """count(*) AS n, 1 - sum((p - y) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((p - y) ** 2)) AS rmse, sqrt(avg((p - y) ** 2)) / avg(y) AS nrmse_mean,
      corr(y, p) AS corr, 1 - sqrt((corr(y, p) - 1) ** 2 + (stddev_pop(p) / stddev_pop(y) - 1) ** 2 + (avg(p) / avg(y) - 1) ** 2) AS kge,
      sum(p - y) / sum(y) * 100 AS pbias, sum(p) / sum(y) AS total_ratio"""


@query(
    "kge_multilevel",
    "crop:s layer:s level:s n:i r2:6 rmse:5 nrmse_mean:6 corr:6 kge:6 pbias:6 total_ratio:6",
    f"""WITH {PRED}, al AS (SELECT * FROM pred UNION ALL BY NAME SELECT 'all' AS crop, country, cell_id, year, month, sum(y_true) AS y_true, sum(y_pred) AS y_pred, sum(y_gr) AS y_gr, sum(y_gre) AS y_gre
      FROM pred GROUP BY country, cell_id, year, month),
    un AS (SELECT crop, country, cell_id, year, month, y_true AS y, 'global' AS layer, y_pred AS p FROM al UNION ALL SELECT crop, country, cell_id, year, month, y_true, 'regional', y_gr FROM al
      UNION ALL SELECT crop, country, cell_id, year, month, y_true, 'extreme', y_gre FROM al),
    lv AS (SELECT crop, layer, 'monthly_grid' AS level, sum(y) AS y, sum(p) AS p FROM un GROUP BY crop, layer, cell_id, year, month
      UNION ALL SELECT crop, layer, 'yearly_grid', sum(y), sum(p) FROM un GROUP BY crop, layer, cell_id, year
      UNION ALL SELECT crop, layer, 'monthly_country', sum(y), sum(p) FROM un WHERE country IS NOT NULL GROUP BY crop, layer, country, year, month
      UNION ALL SELECT crop, layer, 'yearly_country', sum(y), sum(p) FROM un WHERE country IS NOT NULL GROUP BY crop, layer, country, year
      UNION ALL SELECT crop, layer, 'yearly_global', sum(y), sum(p) FROM un GROUP BY crop, layer, year)
    SELECT crop, layer, level, {KGE_COLS} FROM lv GROUP BY crop, layer, level""",
)
def kge_multilevel(t):
    return evaluation.multilevel(predictions(t), {"global": "y_pred", "regional": "y_gr", "extreme": "y_gre"})


@query(
    "half_threshold_hits",
    "crop:s hit_p90_half:8 hit_p90_abs:8",
    f"""WITH {PRED}, a AS (SELECT crop, quantile_cont(y_true, 0.9) FILTER (y_true > 0) AS h, quantile_cont(y_true, 0.9) AS b FROM pred GROUP BY crop)
    SELECT crop, count(*) FILTER (y_true >= h AND y_pred >= h * 0.5) / count(*) FILTER (y_true >= h) AS hit_p90_half,
      count(*) FILTER (y_true >= b AND y_pred >= b) / count(*) FILTER (y_true >= b) AS hit_p90_abs FROM pred JOIN a USING (crop) GROUP BY crop""",
)
def half_threshold_hits(t):
    p = predictions(t)
    return evaluation.half_threshold_hits(p, ["crop"]).join(evaluation.absolute_hits(p, ["crop"]), "crop")


@query(
    "yearly_ratios",
    "crop:s total_ratio_1997:6 total_ratio_1998:6",
    f"""WITH {PRED} SELECT crop, sum(y_pred) FILTER (year = 1997) / sum(y_true) FILTER (year = 1997) AS total_ratio_1997,
    sum(y_pred) FILTER (year = 1998) / sum(y_true) FILTER (year = 1998) AS total_ratio_1998 FROM pred GROUP BY crop""",
)
def yearly_ratios(t):
    return evaluation.yearly_ratios(predictions(t), ["crop"], [1997, 1998])


@query(
    "country_scores",
    "crop:s n_country_years:i n_countries:i country_year_r2:6 rmse:5 nrmse_mean:6 correlation:6 grid_r2:6",
    f"""WITH {PRED}, m AS (SELECT * FROM pred WHERE country IS NOT NULL), c AS (SELECT crop, country, year, sum(y_true) AS y, sum(y_pred) AS p FROM m GROUP BY ALL),
    g AS (SELECT crop, 1 - sum((y_pred - y_true) ** 2) / (var_pop(y_true) * count(*)) AS grid_r2 FROM m GROUP BY crop)
    SELECT crop, count(*) AS n_country_years, count(DISTINCT country) AS n_countries, 1 - sum((p - y) ** 2) / (var_pop(y) * count(*)) AS country_year_r2,
      sqrt(avg((p - y) ** 2)) AS rmse, sqrt(avg((p - y) ** 2)) / avg(y) AS nrmse_mean, corr(y, p) AS correlation, max(grid_r2) AS grid_r2 FROM c JOIN g USING (crop) GROUP BY crop""",
)
def country_scores(t):
    return evaluation.country_scores(predictions(t))


@query(
    "layer_pivot",
    "crop:s r2_global:6 r2_regional:6 kge_global:6 kge_regional:6",
    f"""WITH {PRED}, un AS (SELECT crop, y_true AS y, 'global' AS layer, y_pred AS p FROM pred UNION ALL SELECT crop, y_true, 'regional', y_gr FROM pred),
    s AS (SELECT crop, layer, {KGE_COLS} FROM un GROUP BY ALL)
    SELECT crop, max(r2) FILTER (layer = 'global') AS r2_global, max(r2) FILTER (layer = 'regional') AS r2_regional,
      max(kge) FILTER (layer = 'global') AS kge_global, max(kge) FILTER (layer = 'regional') AS kge_regional FROM s GROUP BY crop""",
)
def layer_pivot(t):
    p = predictions(t)
    layers = F.array(
        F.struct(F.lit("global").alias("layer"), F.col("y_pred").alias("p")), F.struct(F.lit("regional").alias("layer"), F.col("y_gr").alias("p"))
    )
    scored = evaluation.agreement(p.select("crop", "y_true", F.inline(layers)), ["crop", "layer"], "y_true", "p")
    return evaluation.layer_table(scored, ["global", "regional"], ["r2", "kge"])


@query(
    "log_fit",
    "crop:s n:i r2_log:6 rmse_log:6 slope:6 intercept:6 r:6 residual_se:6",
    f"""WITH {PRED}, l AS (SELECT crop, log10(y_true) AS x, log10(y_pred) AS z FROM pred WHERE y_true > 0 AND y_pred > 0)
    SELECT crop, count(*) AS n, 1 - sum((z - x) ** 2) / (var_pop(x) * count(*)) AS r2_log, sqrt(avg((z - x) ** 2)) AS rmse_log, regr_slope(z, x) AS slope,
      regr_intercept(z, x) AS intercept, corr(x, z) AS r, sqrt(var_pop(z) * count(*) * (1 - corr(x, z) ** 2) / (count(*) - 2)) AS residual_se FROM l GROUP BY crop""",
)
def log_fit(t):
    return evaluation.log_scores(predictions(t), ["crop"])


@query(
    "confidence_band",
    "crop:s x_log:2 fit:6 low:6 high:6",
    f"""WITH {PRED}, l AS (SELECT crop, log10(y_true) AS x, log10(y_pred) AS z FROM pred WHERE y_true > 0 AND y_pred > 0),
    f AS (SELECT crop, count(*) AS n, regr_slope(z, x) AS s, regr_intercept(z, x) AS i, avg(x) AS m, var_pop(x) * count(*) AS ss,
      sqrt(var_pop(z) * count(*) * (1 - corr(x, z) ** 2) / (count(*) - 2)) AS se FROM l GROUP BY crop)
    SELECT crop, x AS x_log, 10 ** (i + s * x) AS fit, 10 ** (i + s * x - 1.96 * se * sqrt(1 / n + (x - m) ** 2 / ss)) AS low,
      10 ** (i + s * x + 1.96 * se * sqrt(1 / n + (x - m) ** 2 / ss)) AS high FROM f, (VALUES (-0.5), (0.0), (0.5), (1.0)) AS v(x)""",
)
def confidence_band(t):
    return evaluation.confidence_band(evaluation.log_scores(predictions(t), ["crop"]), 1.96, [-0.5, 0.0, 0.5, 1.0])


@query(
    "largest_residuals",
    "side:s country:s crop:s year:i log_residual:6",
    f"""WITH {PRED}, c AS (SELECT country, crop, year, sum(y_true) AS y, sum(y_gre) AS p FROM pred GROUP BY ALL),
    r AS (SELECT country, crop, year, log10(p) - log10(y) AS log_residual FROM c WHERE y > 0 AND p > 0)
    (SELECT 'over' AS side, * FROM r ORDER BY log_residual DESC, country, crop, year LIMIT 10) UNION ALL
    (SELECT 'under' AS side, * FROM r ORDER BY log_residual, country, crop, year LIMIT 10)""",
)
def largest_residuals(t):
    sums = predictions(t).groupBy("country", "crop", "year").agg(
        F.sum("y_true").alias("y_true"), F.sum("y_gre").alias("y_pred")
    )
    return evaluation.largest_residuals(sums, ["country", "crop", "year"])


@query(
    "combined_crops",
    "combined:s n:i r2:6 kge:6",
    f"""WITH {PRED}, c AS (SELECT CASE WHEN crop = 'N' THEN 'single' ELSE 'pair' END AS combined, cell_id, year, month, sum(y_true) AS y, sum(y_pred) AS p FROM pred GROUP BY ALL),
    s AS (SELECT combined, {KGE_COLS} FROM c GROUP BY combined) SELECT combined, n, r2, kge FROM s""",
)
def combined_crops(t):
    groups = literal_rows(t.spark, [("A", "pair"), ("R", "pair"), ("N", "single")], "crop string, combined string")
    return evaluation.agreement(evaluation.combine_crops(predictions(t), groups), ["combined"])


@query(
    "spearman",
    "crop:s spearman_r:8",
    f"""WITH {LINES}, r AS (SELECT crop, rank() OVER (PARTITION BY crop ORDER BY qty) + (count(*) OVER (PARTITION BY crop, qty) - 1) / 2 AS a,
      rank() OVER (PARTITION BY crop ORDER BY price) + (count(*) OVER (PARTITION BY crop, price) - 1) / 2 AS b FROM lines)
    SELECT crop, corr(a, b) AS spearman_r FROM r GROUP BY crop""",
)
def spearman_query(t):
    return spearman(t.lines, ["crop"], "qty", "price")


@query(
    "prediction_filters",
    "crop:s n_rows:i n_cells:i mean_global:6 change_regional_pct:6 change_extreme_pct:6",
    f"""WITH {PRED}, ref AS (SELECT crop, cell_id FROM lines WHERE crop <> 'N' GROUP BY ALL HAVING sum(CASE WHEN discount > 0.095 AND status = 'O' AND suppkey % 5 = 0 THEN qty ELSE 0 END) > 0),
    seen AS (SELECT DISTINCT crop, cell_id, month FROM lines WHERE year IN (1996, 1997)),
    k AS (SELECT p.* FROM pred p WHERE (crop = 'N' OR EXISTS (SELECT 1 FROM ref WHERE ref.crop = p.crop AND ref.cell_id = p.cell_id))
      AND EXISTS (SELECT 1 FROM seen s WHERE s.crop = p.crop AND s.cell_id = p.cell_id AND s.month = p.month))
    SELECT crop, count(*) AS n_rows, count(DISTINCT cell_id) AS n_cells, avg(y_pred) AS mean_global, (avg(y_gr) - avg(y_pred)) / avg(y_pred) * 100 AS change_regional_pct,
      (avg(y_gre) - avg(y_gr)) / avg(y_gr) * 100 AS change_extreme_pct FROM k GROUP BY crop""",
)
def prediction_filters(t):
    irrigated = F.when((F.col("discount") > 0.095) & (F.col("status") == "O") & (F.col("suppkey") % 5 == 0), F.col("qty")).otherwise(0.0)
    reference = t.lines.where(F.col("crop") != "N").select("crop", "cell_id", irrigated.alias("area"))
    kept = cascade.prediction_filters(predictions(t), reference, t.lines, bypass=["N"], years=(1996, 1997))
    named = kept.withColumnsRenamed({"y_pred": "g_q50", "y_gr": "gr_q50", "y_gre": "gre_q50"})
    return cascade.prediction_summary(named, ["crop"])
