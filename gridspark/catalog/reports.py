"""Publication grids, shares, flow tables and summary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.base import LINES, query
from gridspark.functions import taxonomy
from gridspark.operators import cascade, report


def stress_rows(t):
    """Quantities as stress per crop, cell and month; some values are missing or 0."""
    v = F.when(F.col("cell_id") % 11 == 0, 0.0).otherwise(F.col("qty"))
    rows = t.lines.groupBy("crop", "year", "month", "cell_id").agg(F.sum(v).alias("v"))
    return rows.select("crop", "year", "month", "cell_id", F.when(F.col("cell_id") % 13 != 0, F.col("v")).alias("waterstress"))


STRESS = f"""{LINES}, ws AS (SELECT crop, year, month, cell_id, sum(CASE WHEN cell_id % 13 = 0 THEN NULL WHEN cell_id % 11 = 0 THEN 0 ELSE qty END) AS v FROM lines GROUP BY ALL)"""


@query(
    "wide_crop_grid",
    "year:i month:i cell_id:i A:2 N:2 R:2 Z:2",
    f"""WITH {STRESS} SELECT year, month, cell_id, max(v) FILTER (crop = 'A') AS A, max(v) FILTER (crop = 'N') AS N, max(v) FILTER (crop = 'R') AS R, CAST(NULL AS DOUBLE) AS Z
    FROM ws GROUP BY ALL""",
)
def wide_crop_grid(t):
    return report.wide_grid(stress_rows(t), ["year", "month", "cell_id"], crops=["A", "N", "R", "Z"])


BANDS = taxonomy.BAND_ORDER


@query(
    "published_grid",
    "band_order:s year:i cell_id:i " + " ".join(f"{b}:2" for b in BANDS),
    f"""WITH {LINES}, c AS (SELECT year, cell_id, partkey % {len(BANDS) + 1} AS b, sum(qty) AS v FROM lines GROUP BY ALL)
    SELECT '{",".join(BANDS)}' AS band_order, year, cell_id, {", ".join(f"max(v) FILTER (b = {i}) AS {b}" for i, b in enumerate(BANDS))} FROM c GROUP BY year, cell_id""",
)
def published_grid(t):
    """All bands of a published grid in their fixed order, which is stated in a column; one crop has no band."""
    band = F.element_at(F.array(*map(F.lit, [*BANDS, "other"])), (F.col("partkey") % (len(BANDS) + 1) + 1).cast("int"))
    sums = t.lines.groupBy("year", "cell_id", band.alias("crop")).agg(F.sum("qty").alias("waterstress"))
    wide = report.wide_grid(sums, ["year", "cell_id"])
    return wide.withColumn("band_order", F.lit(",".join(wide.columns[2:])))


@query(
    "yearly_by_group",
    "year:i crop:s cell_id:i waterstress:2",
    f"WITH {STRESS} SELECT year, crop, cell_id, sum(v) AS waterstress FROM ws WHERE v IS NOT NULL GROUP BY ALL",
)
def yearly_by_group(t):
    return report.yearly_by_crop(stress_rows(t))


@query(
    "yearly_total",
    "year:i cell_id:i waterstress:2",
    f"WITH {STRESS} SELECT year, cell_id, sum(v) AS waterstress FROM ws WHERE v IS NOT NULL GROUP BY ALL",
)
def yearly_total(t):
    return report.yearly_total(stress_rows(t))


@query(
    "region_year_totals",
    "year:i crop:s country:s waterstress:2 n_cells:i",
    f"""WITH {STRESS}, c AS (SELECT year, crop, cell_id, sum(v) AS v FROM ws WHERE v IS NOT NULL GROUP BY ALL HAVING sum(v) <> 0),
    j AS (SELECT c.*, n_name AS country FROM c LEFT JOIN nation ON n_nationkey = cell_id % 30)
    SELECT year, crop, country, sum(v) AS waterstress, count(*) AS n_cells FROM j WHERE country IS NOT NULL GROUP BY ALL
    UNION ALL SELECT year, crop, 'GLOBAL', sum(v), count(*) FROM j GROUP BY ALL""",
)
def region_year_totals(t):
    cells = t.lines.select("cell_id").distinct()
    lookup = cells.join(t.nation, F.col("cell_id") % 30 == F.col("n_nationkey")).select("cell_id", F.col("n_name").alias("country"))
    return report.region_year_totals(stress_rows(t), lookup)


@query(
    "monthly_profile",
    "crop:s year:i month:i waterstress:2",
    f"""WITH {STRESS}, s AS (SELECT crop, year, m.month, coalesce(sum(v) FILTER (ws.month = m.month), 0) AS v FROM ws, range(1, 13) AS m(month) GROUP BY ALL)
    SELECT crop, year, month, v AS waterstress FROM s""",
)
def monthly_profile(t):
    return report.monthly_profile(stress_rows(t), ["crop", "year"])


def flows(t):
    """Trade flows: return flag, supplier nation, customer nation, part type."""
    sums = t.lineitem.groupBy("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("value"))
    makers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("production_country")
    )
    buyers = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("l_orderkey"), F.col("n_name").alias("consumption_country"), F.year("o_orderdate").alias("year"))
    )
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("target_sector"))
    return (
        sums.join(buyers, "l_orderkey")
        .join(makers, "l_suppkey")
        .join(parts, "l_partkey")
        .groupBy(F.col("l_returnflag").alias("crop"), "production_country", "consumption_country", "target_sector", "year")
        .agg(F.sum("value").alias("value"))
    )


FLOWS = """fl AS (SELECT l_returnflag AS crop, pn.n_name AS production_country, cn.n_name AS consumption_country, p_type AS target_sector, year(o_orderdate) AS year, sum(l_quantity) AS value
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation pn ON pn.n_nationkey = s_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
SCOPES = """sc AS (SELECT 'global' AS scope, * FROM fl UNION ALL SELECT 'trade', * FROM fl WHERE production_country <> consumption_country),
    long AS (SELECT scope, year, 'Crop' AS panel, crop AS cat, value FROM sc UNION ALL SELECT scope, year, 'Production country', production_country, value FROM sc
      UNION ALL SELECT scope, year, 'Consumption country', consumption_country, value FROM sc UNION ALL SELECT scope, year, 'Target sector', target_sector, value FROM sc)"""


@query(
    "trade_shares",
    "scope:s panel:s cat:s value:2 total_value:2 percent:6 percent_label:s",
    f"""WITH {FLOWS}, {SCOPES}, c AS (SELECT scope, panel, cat, sum(value) AS value FROM long GROUP BY ALL), s AS (SELECT *, sum(value) OVER (PARTITION BY scope, panel) AS total_value FROM c)
    SELECT scope, panel, cat, value, total_value, value / total_value * 100 AS percent,
      regexp_replace(CAST(round(value / total_value * 100, 1) AS VARCHAR), '\\.0$', '') || '%' AS percent_label FROM s""",
)
def trade_shares(t):
    return report.share_tables(flows(t))


@query(
    "yearly_shares",
    "year:i scope:s panel:s cat:s percent:6",
    f"""WITH {FLOWS}, {SCOPES}, c AS (SELECT year, scope, panel, cat, sum(value) AS value FROM long GROUP BY ALL)
    SELECT year, scope, panel, cat, value / sum(value) OVER (PARTITION BY year, scope, panel) * 100 AS percent FROM c""",
)
def yearly_shares(t):
    return report.share_tables(flows(t), ["year"])


# All return flags, nations and part types.
CATEGORIES = ["A", "N", "R", *(f"NATION_{i}" for i in range(25)), "ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "share_pivot",
    "scope:s panel:s " + " ".join(f"{c}:6" for c in CATEGORIES),
    f"""WITH {FLOWS}, {SCOPES}, c AS (SELECT scope, panel, cat, sum(value) AS value FROM long GROUP BY ALL), s AS (SELECT *, value / sum(value) OVER (PARTITION BY scope, panel) * 100 AS p FROM c)
    SELECT scope, panel, {', '.join(f"coalesce(sum(p) FILTER (cat = '{c}'), 0) AS {c}" for c in CATEGORIES)} FROM s GROUP BY ALL""",
)
def share_pivot(t):
    return report.share_pivot(report.share_tables(flows(t)))


@query(
    "flow_pairs",
    "stage:s source:s target:s value:2",
    f"""WITH {FLOWS} SELECT 'crop_producer' AS stage, crop AS source, production_country AS target, sum(value) AS value FROM fl GROUP BY ALL
    UNION ALL SELECT 'producer_consumer', production_country, consumption_country, sum(value) FROM fl GROUP BY ALL
    UNION ALL SELECT 'consumer_target', consumption_country, target_sector, sum(value) FROM fl GROUP BY ALL""",
)
def flow_pairs(t):
    return report.flow_pairs(flows(t))


@query(
    "country_order",
    "country:s vp:2 vc:2 v_total:2",
    f"""WITH {FLOWS}, p AS (SELECT production_country AS country, sum(value) AS vp FROM fl GROUP BY ALL), c AS (SELECT consumption_country AS country, sum(value) AS vc FROM fl GROUP BY ALL)
    SELECT country, coalesce(vp, 0) AS vp, coalesce(vc, 0) AS vc, coalesce(vp, 0) + coalesce(vc, 0) AS v_total FROM p FULL JOIN c USING (country)""",
)
def country_order(t):
    return report.country_order(flows(t))


@query(
    "cumulative_share",
    "layer:s label:s value:2 share:8 offset:8",
    f"""WITH {FLOWS}, u AS (SELECT 'crop' AS layer, crop AS label, value FROM fl WHERE target_sector = 'ECONOMY' UNION ALL SELECT 'production_country', production_country, value FROM fl WHERE target_sector = 'ECONOMY'
      UNION ALL SELECT 'consumption_country', consumption_country, value FROM fl WHERE target_sector = 'ECONOMY'),
    s AS (SELECT layer, label, sum(value) AS value FROM u GROUP BY ALL), h AS (SELECT *, value / sum(value) OVER (PARTITION BY layer) AS share FROM s)
    SELECT layer, label, value, share, sum(share) OVER (PARTITION BY layer ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING) - share AS "offset" FROM h""",
)
def cumulative_share(t):
    return report.sector_layers(flows(t), "ECONOMY")


@query(
    "topn_remaining",
    "group:s year:i value:2",
    f"""WITH {FLOWS}, s AS (SELECT production_country AS country, year, sum(value) AS value FROM fl GROUP BY ALL),
    b AS (SELECT country FROM s GROUP BY country ORDER BY avg(value) DESC, country LIMIT 5)
    SELECT CASE WHEN country IN (SELECT country FROM b) THEN country ELSE 'Remaining' END AS "group", year, sum(value) AS value FROM s GROUP BY ALL""",
)
def topn_remaining(t):
    sums = flows(t).groupBy(F.col("production_country").alias("country"), "year").agg(F.sum("value").alias("value"))
    return report.top_and_rest(sums, "country", "value", ["year"], 5)


def crop_values(t):
    """Values per country, crop code and year or month, from supplier nations and part brands."""
    from gridspark.catalog.accounts import country_values

    return country_values(t)


def crop_sql() -> str:
    from gridspark.catalog.accounts import VALUES

    return VALUES


@query(
    "predicted_vs_history",
    "crop:s hist_mean:5 pred_mean:5 ratio:6",
    f"""WITH {crop_sql()}, y AS (SELECT crop, year, sum(value) AS v FROM cv GROUP BY ALL)
    SELECT crop, coalesce(avg(v) FILTER (year BETWEEN 1995 AND 1998), 0) AS hist_mean, coalesce(avg(v) FILTER (year >= 1999), 0) AS pred_mean,
      coalesce(avg(v) FILTER (year >= 1999) / avg(v) FILTER (year BETWEEN 1995 AND 1998), 0) AS ratio FROM y GROUP BY crop""",
)
def predicted_vs_history(t):
    v = crop_values(t)
    return report.predicted_vs_history(v.where(F.col("year").between(1995, 1998)), v.where(F.col("year") >= 1999))


@query(
    "totals_vs_base",
    "year:i global_total:2 vs_base_pct:6 source:s",
    f"""WITH {crop_sql()}, y AS (SELECT year, sum(value) AS v FROM cv GROUP BY year), b AS (SELECT v AS b FROM y WHERE year = 1998)
    SELECT year, v AS global_total, (v - b) / b * 100 AS vs_base_pct, CASE WHEN year <= 1998 THEN 'historical' ELSE 'predicted' END AS source FROM y, b""",
)
def totals_vs_base(t):
    return report.totals_vs_base(crop_values(t), 1998)


# All years of the orders.
RECORD = list(range(1995, 2002))


@query(
    "top_regions_with_crops",
    "country:s " + " ".join(f"y{y}:2" for y in RECORD) + " mean:3 pct_global:6 top_crops:s",
    f"""WITH {crop_sql()}, s AS (SELECT * FROM cv),
    w AS (SELECT country, {', '.join(f"coalesce(sum(value) FILTER (year = {y}), 0) AS y{y}" for y in RECORD)}, sum(value) / {len(RECORD)} AS mean FROM s GROUP BY country),
    b AS (SELECT *, mean / (SELECT sum(mean) FROM w) * 100 AS pct_global FROM w ORDER BY mean DESC, country LIMIT 7),
    c AS (SELECT country, crop, sum(value) AS v FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY v DESC, crop) AS r FROM c)
    SELECT b.*, (SELECT string_agg(crop, ', ' ORDER BY r.r) FROM r WHERE r.country = b.country AND r.r <= 3) AS top_crops FROM b""",
)
def top_regions_with_crops(t):
    return report.top_regions(crop_values(t), RECORD, n=7)


TRANSITION = f"""{crop_sql()}, p AS (SELECT country, sum(value) FILTER (year = 1998) AS val_before, sum(value) FILTER (year = 1999) AS val_after FROM cv GROUP BY country),
    tr AS (SELECT *, val_after - val_before AS abs_change, (val_after - val_before) / val_before * 100 AS change_pct FROM p WHERE val_before IS NOT NULL AND val_after IS NOT NULL)"""


@query(
    "year_transition",
    "country:s direction:s abs_change:2 change_pct:6",
    f"""WITH {TRANSITION} (SELECT country, 'increase' AS direction, abs_change, change_pct FROM tr ORDER BY abs_change DESC, country LIMIT 10)
    UNION ALL (SELECT country, 'decrease', abs_change, change_pct FROM tr ORDER BY abs_change, country DESC LIMIT 10)""",
)
def year_transition(t):
    return report.largest_changes(report.year_transition(crop_values(t), "country", 1998, 1999), "country")


@query(
    "crop_transition",
    "crop:s val_before:2 val_after:2 change_pct:6",
    f"""WITH {crop_sql()}, p AS (SELECT crop, sum(value) FILTER (year = 1998) AS val_before, sum(value) FILTER (year = 1999) AS val_after FROM cv GROUP BY crop)
    SELECT crop, val_before, val_after, (val_after - val_before) / val_before * 100 AS change_pct FROM p WHERE val_before IS NOT NULL AND val_after IS NOT NULL""",
)
def crop_transition(t):
    return report.year_transition(crop_values(t), "crop", 1998, 1999)


@query(
    "seasonality_peak",
    "crop:s seasonal_rho:6 peak_month_hist:i peak_month_pred:i peak_match:s",
    f"""WITH {LINES}, b AS (SELECT p_brand AS crop, year, month, sum(price) AS v FROM lines JOIN part ON partkey = p_partkey GROUP BY ALL),
    h AS (SELECT crop, month, avg(v) AS h FROM b WHERE year < 1999 GROUP BY ALL), p AS (SELECT crop, month, avg(v) AS p FROM b WHERE year >= 1999 GROUP BY ALL),
    j AS (SELECT crop, month, rank() OVER (PARTITION BY crop ORDER BY h) + (count(*) OVER (PARTITION BY crop, h) - 1) / 2 AS a, rank() OVER (PARTITION BY crop ORDER BY p) + (count(*) OVER (PARTITION BY crop, p) - 1) / 2 AS b
      FROM h JOIN p USING (crop, month)),
    s AS (SELECT crop, corr(a, b) AS rho FROM j GROUP BY crop HAVING count(*) >= 4),
    ph AS (SELECT crop, arg_min(month, (-h, month)) AS m FROM h GROUP BY crop), pp AS (SELECT crop, arg_min(month, (-p, month)) AS m FROM p GROUP BY crop)
    SELECT crop, rho AS seasonal_rho, ph.m AS peak_month_hist, pp.m AS peak_month_pred, CASE WHEN abs(ph.m - pp.m) <= 1 THEN 'yes' ELSE 'no' END AS peak_match
    FROM s JOIN ph USING (crop) JOIN pp USING (crop)""",
)
def seasonality_peak(t):
    parts = t.part.select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("crop"))
    sums = t.lines.groupBy("partkey", "year", "month").agg(F.sum("price").alias("value"))
    rows = sums.join(parts, "partkey").select("crop", "year", "month", "value")
    return report.seasonality(rows.where(F.col("year") < 1999), rows.where(F.col("year") >= 1999))


@query(
    "tiers",
    "crop:s rho:6 tier:s event_type:s",
    f"""WITH {LINES}, b AS (SELECT p_brand AS crop, corr(qty, discount) * 8 AS rho FROM lines JOIN part ON partkey = p_partkey GROUP BY ALL)
    SELECT crop, rho, CASE WHEN rho >= 0.5 THEN 'Strong' WHEN rho >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS tier,
      CASE WHEN crop = 'Brand#3' THEN 'Indirect/Averaged' ELSE 'Direct Water Stress' END AS event_type FROM b""",
)
def tiers(t):
    parts = t.part.select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("crop"))
    rho = t.lines.select("partkey", "qty", "discount").join(parts, "partkey").groupBy("crop").agg((F.corr("qty", "discount") * 8).alias("rho"))
    return report.event_class(report.correlation_tier(rho, "rho"), "crop", ["Brand#3"])


def model_table(t):
    """Scores per crop code and model variant."""
    code = F.element_at(F.array(*[F.lit(c) for c in taxonomy.CROPS]), F.substring("p_brand", 7, 4).cast("int") % 27 + 1)
    parts = t.part.select(F.col("p_partkey").alias("partkey"), code.alias("crop"))
    model = F.when(F.col("suppkey") % 4 == 0, "G").otherwise("GW")
    lines = t.lines.groupBy("partkey", model.alias("model")).agg(F.sum("discount").alias("d"), F.sum("tax").alias("x"), F.count(F.lit(1)).alias("n"))
    return lines.join(parts, "partkey").groupBy("crop", "model").agg(
        (F.sum("d") / F.sum("n")).alias("r2"), (F.sum("x") / F.sum("n")).alias("rmse")
    )


def model_sql() -> str:
    from gridspark.catalog.accounts import CODE

    return f"""{LINES}, mt AS (SELECT {CODE} AS crop, CASE WHEN suppkey % 4 = 0 THEN 'G' ELSE 'GW' END AS model, avg(discount) AS r2, avg(tax) AS rmse FROM lines JOIN part ON partkey = p_partkey GROUP BY ALL)"""


@query(
    "metric_pivot",
    "crop:s r2_G:8 r2_GW:8 rmse_G:8 rmse_GW:8",
    f"""WITH {model_sql()} SELECT crop, max(r2) FILTER (model = 'G') AS r2_G, max(r2) FILTER (model = 'GW') AS r2_GW, max(rmse) FILTER (model = 'G') AS rmse_G, max(rmse) FILTER (model = 'GW') AS rmse_GW
    FROM mt GROUP BY crop""",
)
def metric_pivot(t):
    return report.metric_pivot(model_table(t), ["r2", "rmse"])


@query(
    "weighted_comparison",
    "crop:s ctry_GR:8 ctry_GWR:8 selected:s ctry_diff:8",
    f"""WITH {model_sql()}, u AS (SELECT crop, r2 AS ctry_GR FROM mt WHERE model = 'G'), w AS (SELECT crop, r2 AS ctry_GWR FROM mt WHERE model = 'GW')
    SELECT crop, ctry_GR, ctry_GWR, CASE WHEN crop IN ('soy', 'sor', 'sgb', 'rap') THEN 'G+R' ELSE 'GW+RW' END AS selected, ctry_GWR - ctry_GR AS ctry_diff FROM u FULL JOIN w USING (crop)""",
)
def weighted_comparison(t):
    m = model_table(t)
    unweighted = m.where(F.col("model") == "G").select("crop", F.col("r2").alias("ctry_GR"))
    weighted = m.where(F.col("model") == "GW").select("crop", F.col("r2").alias("ctry_GWR"))
    return report.weighted_comparison(unweighted, weighted)


@query(
    "best_layer",
    "crop:s selected:s best:8",
    f"""WITH {model_sql()}, w AS (SELECT crop, max(r2) FILTER (model = 'G') AS g, max(r2) FILTER (model = 'GW') AS gw FROM mt GROUP BY crop)
    SELECT crop, CASE WHEN crop IN ('soy', 'sor', 'sgb', 'rap') THEN 'G+R' ELSE 'GW+RW' END AS selected, CASE WHEN crop IN ('soy', 'sor', 'sgb', 'rap') THEN g ELSE coalesce(gw, g) END AS best FROM w""",
)
def best_layer(t):
    wide = report.metric_pivot(model_table(t), ["r2"])
    return report.select_best(wide, "r2_G", "r2_GW", "best")


@query(
    "crop_routing",
    "variant:s region_scheme:i n:i r2:8",
    f"""WITH {model_sql()} SELECT CASE WHEN crop IN ('soy', 'sor', 'sgb', 'rap') THEN 'unweighted' ELSE 'weighted' END AS variant, CASE WHEN crop IN ('wh', 'mai') THEN 30 ELSE 9 END AS region_scheme,
      count(*) AS n, max(r2) AS r2 FROM mt GROUP BY ALL""",
)
def crop_routing(t):
    routed = model_table(t).join(cascade.crop_routing(t.spark), "crop")
    return routed.groupBy("variant", "region_scheme").agg(F.count(F.lit(1)).alias("n"), F.max("r2").alias("r2"))


def decisions(t):
    """Adoption per crop, layer and region."""
    code = F.element_at(F.array(*[F.lit(c) for c in taxonomy.CROPS]), F.substring("p_brand", 7, 4).cast("int") % 27 + 1)
    parts = t.part.select(F.col("p_partkey").alias("partkey"), code.alias("crop"), (F.col("p_size") % 12).alias("region"))
    lines = t.lines.groupBy("partkey", F.when(F.col("status") == "O", "R").otherwise("RW").alias("layer")).agg(F.sum("discount").alias("d"), F.count(F.lit(1)).alias("n"))
    sums = lines.join(parts, "partkey").groupBy("crop", "layer", "region").agg((F.sum("d") / F.sum("n")).alias("m"), F.sum("n").alias("n_samples"))
    return sums.withColumn("adopted", F.col("m") > 0.0501)


def decision_sql() -> str:
    from gridspark.catalog.accounts import CODE

    return f"""{LINES}, dc AS (SELECT {CODE} AS crop, CASE WHEN status = 'O' THEN 'R' ELSE 'RW' END AS layer, p_size % 12 AS region, sum(discount) / count(*) > 0.0501 AS adopted, count(*) AS n_samples
      FROM lines JOIN part ON partkey = p_partkey GROUP BY ALL)"""


@query(
    "adoption_table",
    "crop:s layer:s n_adopted:i n_total:i regions:s",
    f"""WITH {decision_sql()} SELECT crop, layer, count(*) FILTER (adopted) AS n_adopted, count(*) AS n_total, coalesce(string_agg(CAST(region AS VARCHAR), ', ' ORDER BY region) FILTER (adopted), '') AS regions
    FROM dc GROUP BY ALL""",
)
def adoption_table(t):
    return report.adoption_table(decisions(t))


@query(
    "region_schemes",
    "crop:s layer:s region:i n_samples:i regime:s",
    f"""WITH {decision_sql()}, n AS (SELECT crop, layer, count(*) AS n FROM dc GROUP BY ALL)
    SELECT crop, layer, region, n_samples, CASE WHEN n > 9 THEN '30-class' ELSE '9-class' END AS regime FROM dc JOIN n USING (crop, layer) WHERE crop IN ('wh', 'mai') AND adopted""",
)
def region_schemes(t):
    return report.region_schemes(decisions(t))


def contributions(t):
    long = t.lineitem.select("l_returnflag", "l_linestatus", (F.col("l_quantity") - 25).alias("qty"), (F.col("l_discount") * 100 - 5).alias("discount"), (F.col("l_tax") * 50).alias("tax"))
    crop = F.concat("l_returnflag", "l_linestatus").alias("crop")
    return long.withColumn("crop", crop).unpivot(["crop"], ["qty", "discount", "tax"], "feature", "value")


CONTRIB = """co AS (SELECT l_returnflag || l_linestatus AS crop, 'qty' AS feature, l_quantity - 25 AS value FROM lineitem UNION ALL SELECT l_returnflag || l_linestatus, 'discount', l_discount * 100 - 5 FROM lineitem
      UNION ALL SELECT l_returnflag || l_linestatus, 'tax', l_tax * 50 FROM lineitem),
    ma AS (SELECT crop, feature, avg(abs(value)) AS mean_abs FROM co GROUP BY ALL), sh AS (SELECT *, mean_abs / sum(mean_abs) OVER (PARTITION BY crop) AS share FROM ma)"""


@query(
    "contribution_table",
    "crop:s feature:s mean_abs:6 share:8",
    f"""WITH {CONTRIB}, b AS (SELECT feature FROM sh GROUP BY feature ORDER BY avg(share) DESC, feature LIMIT 2) SELECT * FROM sh WHERE feature IN (SELECT feature FROM b)""",
)
def contribution_table(t):
    return report.contribution_table(contributions(t), 2)


@query(
    "importance_ranking",
    "feature:s mean_importance:8 std_importance:8 n_crops:i rank:i share:8",
    f"""WITH {CONTRIB}, m AS (SELECT feature, avg(share) AS mean_importance, stddev_samp(share) AS std_importance, count(*) AS n_crops FROM sh GROUP BY feature)
    SELECT *, row_number() OVER (ORDER BY mean_importance DESC, feature) AS rank, mean_importance / sum(mean_importance) OVER () AS share FROM m""",
)
def importance_ranking(t):
    rows = contributions(t).groupBy("crop", "feature").agg(F.avg(F.abs("value")).alias("importance"))
    return report.importance_ranking(rows)
