"""Masks, as-of joins, imputation, encodings and time-series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.base import LINES, query
from gridspark.functions import calendar, geo
from gridspark.operators import features
from gridspark.sources.readers import key_from_path, parse_index_lines

SERIES_SQL = """series AS (SELECT c_nationkey, date_trunc('month', o_orderdate) AS time, sum(o_totalprice) AS v, count(*) AS n,
    sum(CASE WHEN o_orderkey % 7 < 2 THEN o_totalprice END) AS w
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def series(t):
    """Monthly order totals per nation; ``w`` has gaps."""
    rare = F.when(F.col("o_orderkey") % 7 < 2, F.col("o_totalprice"))
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.date_trunc("month", "o_orderdate").cast("date").alias("time"))
        .agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"), F.sum(rare).alias("w"))
    )


@query(
    "lag_features",
    "c_nationkey:i time:s v_lag1:2 v_lag2:2 v_lag3:2 n_lag1:i n_lag2:i n_lag3:i",
    f"""WITH {SERIES_SQL} SELECT c_nationkey, CAST(time AS DATE) AS time, """
    + ", ".join(f"lag({c}, {k}) OVER (PARTITION BY c_nationkey ORDER BY time) AS {c}_lag{k}" for c in "vn" for k in (1, 2, 3))
    + " FROM series",
)
def lag_features(t):
    return features.add_lags(series(t), ["c_nationkey"], "time", ["v", "n", "absent"])


@query(
    "calendar_lags",
    "c_nationkey:i time:s v_lag1:2 v_lag3:2",
    f"""WITH {SERIES_SQL}, some_months AS (SELECT * FROM series WHERE (month(time) + c_nationkey) % 5 <> 0)
    SELECT a.c_nationkey, CAST(a.time AS DATE) AS time, b.v AS v_lag1, c.v AS v_lag3 FROM some_months a
    LEFT JOIN some_months b ON b.c_nationkey = a.c_nationkey AND b.time = a.time - INTERVAL 1 MONTH
    LEFT JOIN some_months c ON c.c_nationkey = a.c_nationkey AND c.time = a.time - INTERVAL 3 MONTH""",
)
def calendar_lags(t):
    kept = series(t).where((F.month("time") + F.col("c_nationkey")) % 5 != 0)
    dated = kept.withColumns({"year": F.year("time"), "month": F.month("time")})
    return features.add_calendar_lags(dated, ["c_nationkey"], ["v"], (1, 3))


@query(
    "rolling_mean3",
    "c_nationkey:i time:s v_roll3:4 w_roll3:4",
    f"""WITH {SERIES_SQL} SELECT c_nationkey, CAST(time AS DATE) AS time,
    avg(v) OVER (PARTITION BY c_nationkey ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v_roll3,
    avg(w) OVER (PARTITION BY c_nationkey ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS w_roll3 FROM series""",
)
def rolling_mean3(t):
    return features.add_rolling(series(t), ["c_nationkey"], "time", ["v", "w"])


@query(
    "training_rows",
    "crop:s year:i month:i cell_id:i a:2 b:2 waterstress:2",
    f"""WITH {LINES}, p AS (SELECT year, month, cell_id, sum(CASE WHEN crop = 'N' THEN qty END) AS a, sum(CASE WHEN discount > 0.08 THEN price END) AS b FROM lines GROUP BY ALL),
    y AS (SELECT crop, year, month, cell_id, sum(CASE WHEN tax > 0.01 THEN qty END) AS waterstress FROM lines WHERE crop <> 'N' GROUP BY ALL),
    m AS (SELECT DISTINCT crop, month, cell_id FROM y WHERE waterstress IS NOT NULL AND year < 1999)
    SELECT y.crop, p.year, p.month, p.cell_id, a, b, waterstress FROM p JOIN y USING (year, month, cell_id)
    WHERE EXISTS (SELECT 1 FROM m WHERE m.crop = y.crop AND m.month = y.month AND m.cell_id = y.cell_id) AND (a IS NOT NULL OR b IS NOT NULL)""",
)
def training_rows(t):
    predictors, target = feature_inputs(t)
    mask = features.month_mask(target.where(F.col("year") < 1999))
    return features.training_rows(predictors, target, mask, ["a", "b", "absent"])


def feature_inputs(t):
    predictors = t.lines.groupBy("year", "month", "cell_id").agg(
        F.sum(F.when(F.col("crop") == "N", F.col("qty"))).alias("a"), F.sum(F.when(F.col("discount") > 0.08, F.col("price"))).alias("b")
    )
    target = t.lines.where(F.col("crop") != "N").groupBy("crop", "year", "month", "cell_id").agg(
        F.sum(F.when(F.col("tax") > 0.01, F.col("qty"))).alias("waterstress")
    )
    return predictors, target


@query(
    "prediction_rows",
    "crop:s year:i n:i a:2 b:2",
    f"""WITH {LINES}, p AS (SELECT year, month, cell_id, sum(CASE WHEN crop = 'N' THEN qty END) AS a, sum(CASE WHEN discount > 0.08 THEN price END) AS b FROM lines GROUP BY ALL),
    y AS (SELECT crop, year, month, cell_id, sum(CASE WHEN tax > 0.01 THEN qty END) AS waterstress FROM lines WHERE crop <> 'N' GROUP BY ALL),
    m AS (SELECT DISTINCT crop, month, cell_id FROM y WHERE waterstress IS NOT NULL AND year < 1997)
    SELECT crop, year, count(*) AS n, sum(a) AS a, sum(b) AS b FROM p JOIN m USING (month, cell_id) WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY ALL""",
)
def prediction_rows(t):
    predictors, target = feature_inputs(t)
    rows = features.prediction_rows(predictors, features.month_mask(target.where(F.col("year") < 1997)), ["a", "b"])
    return rows.groupBy("crop", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


@query(
    "asof_year_fallback",
    "c_custkey:i year:i ha_irrigated:2",
    """WITH r AS (SELECT o_custkey AS c, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders
      WHERE year(o_orderdate) % 2 = 0 AND o_orderstatus <> 'P' GROUP BY ALL),
    q AS (SELECT DISTINCT o_custkey AS c, year(o_orderdate) + 1 AS y FROM orders)
    SELECT q.c AS c_custkey, q.y AS year, coalesce(arg_max(r.v, r.y), 0) AS ha_irrigated
    FROM q LEFT JOIN r ON r.c = q.c AND r.y <= q.y AND r.y >= q.y - 3 GROUP BY ALL""",
)
def asof_year_fallback(t):
    table = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"), "o_totalprice", "o_orderstatus")
    area = table.where((F.col("year") % 2 == 0) & (F.col("o_orderstatus") != "P")).groupBy("c_custkey", "year").agg(
        F.sum("o_totalprice").alias("v")
    )
    wanted = table.select("c_custkey", (F.col("year") + 1).alias("year")).distinct()
    return features.asof_area(wanted, area, ["c_custkey"], "v")


@query(
    "annual_area_fallback",
    "c_custkey:i year:i ha_irrigated:2",
    """WITH r AS (SELECT o_custkey AS c, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1999) GROUP BY ALL),
    q AS (SELECT DISTINCT o_custkey AS c, year(o_orderdate) AS y FROM orders)
    SELECT q.c AS c_custkey, q.y AS year, coalesce(r.v, 0) AS ha_irrigated FROM q LEFT JOIN r ON r.c = q.c
      AND r.y = CASE WHEN q.y IN (SELECT y FROM r) THEN q.y ELSE (SELECT max(y) FROM r) END""",
)
def annual_area_fallback(t):
    table = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"), "o_totalprice")
    area = table.where(F.col("year").isin(1996, 1997, 1999)).groupBy("c_custkey", "year").agg(F.sum("o_totalprice").alias("v"))
    return features.annual_area(table.select("c_custkey", "year").distinct(), area, ["c_custkey"], "v")


@query(
    "history_prepend_dedupe",
    "c_nationkey:i time:s v:2 year:i v_lag1:2",
    f"""WITH {SERIES_SQL}, h AS (SELECT c_nationkey, time, v, 0 AS s FROM series WHERE time < TIMESTAMP '1999-03-01' AND time >= TIMESTAMP '1998-07-01'),
    r AS (SELECT c_nationkey, time, v * 2 AS v, 1 AS s FROM series WHERE time >= TIMESTAMP '1999-01-01'),
    u AS (SELECT c_nationkey, time, arg_max(v, s) AS v FROM (SELECT * FROM h UNION ALL SELECT * FROM r) GROUP BY ALL),
    l AS (SELECT *, year(time) AS year, lag(v) OVER (PARTITION BY c_nationkey ORDER BY time) AS v_lag1 FROM u)
    SELECT c_nationkey, CAST(time AS DATE) AS time, v, year, v_lag1 FROM l WHERE year >= 1999""",
)
def history_prepend_dedupe(t):
    base = series(t).select("c_nationkey", "time", "v")
    history = base.where(F.col("time") < F.lit("1999-03-01").cast("date"))
    rows = base.where(F.col("time") >= F.lit("1999-01-01").cast("date")).withColumn("v", F.col("v") * 2)
    joined = features.prepend_history(rows, history, ["c_nationkey"], "time", 1999).withColumn("year", F.year("time"))
    return features.trim_years(features.add_lags(joined, ["c_nationkey"], "time", ["v"], (1,)), 1999)


@query(
    "core_null_filter",
    "event_type:s n:i",
    """SELECT event_type, count(*) AS n FROM events WHERE event_id % 7 <> 0 AND user_id % 5 <> 0 GROUP BY event_type""",
)
def core_null_filter(t):
    rows = t.events.select(
        "event_type",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("t2m"),
        F.when(F.col("user_id") % 5 != 0, F.col("value")).alias("NDVI"),
        F.lit(None).cast("double").alias("other"),
    )
    return features.drop_incomplete(rows).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "median_impute",
    "event_id:i value:6",
    """WITH b AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 <> 0 AND user_id % 4 <> 0 AND NOT (event_type = 'error') THEN value END AS value FROM events),
    m1 AS (SELECT user_id, median(value) AS m FROM b GROUP BY user_id),
    s1 AS (SELECT event_id, event_type, coalesce(value, m) AS value FROM b JOIN m1 USING (user_id)),
    m2 AS (SELECT event_type, median(value) AS m FROM s1 GROUP BY event_type),
    s2 AS (SELECT event_id, coalesce(value, m) AS value FROM s1 JOIN m2 USING (event_type))
    SELECT event_id, coalesce(value, (SELECT median(value) FROM s2)) AS value FROM s2""",
)
def median_impute(t):
    keep = (F.col("event_id") % 7 != 0) & (F.col("user_id") % 4 != 0) & (F.col("event_type") != "error")
    rows = t.events.select("event_id", "user_id", "event_type", F.when(keep, F.col("value")).alias("value"))
    return features.impute_medians(rows, "value", [["user_id"], ["event_type"], []])


@query(
    "time_features",
    "o_orderkey:i year:i month:i day_of_year:i quarter:i half_year:i cos_doy:8 sin_doy:8 decade:i",
    """SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, dayofyear(o_orderdate) AS day_of_year,
    quarter(o_orderdate) AS quarter, CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END AS half_year,
    cos(2 * pi() * dayofyear(o_orderdate) / 365.25) AS cos_doy, sin(2 * pi() * dayofyear(o_orderdate) / 365.25) AS sin_doy,
    year(o_orderdate) // 10 * 10 AS decade FROM orders""",
)
def time_features(t):
    return features.add_time_features(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")


@query(
    "location_encoding",
    "c_custkey:i lat_sin:8 lat_cos:8 lon_sin:8 lon_cos:8",
    """SELECT c_custkey, sin(radians(c_acctbal / 120)) AS lat_sin, cos(radians(c_acctbal / 120)) AS lat_cos,
    sin(radians(c_custkey % 360 - 180)) AS lon_sin, cos(radians(c_custkey % 360 - 180)) AS lon_cos FROM customer""",
)
def location_encoding(t):
    rows = t.customer.select("c_custkey", (F.col("c_acctbal") / 120).alias("lat"), (F.col("c_custkey") % 360 - 180).alias("lon"))
    return features.add_location(rows)


WIDE_SQL = "wide AS (SELECT year(o_orderdate) AS y, " + ", ".join(
    f"sum(o_totalprice) FILTER (month(o_orderdate) = {m}) / 1e6 AS m{m}" for m in range(1, 13)
) + " FROM orders GROUP BY ALL)"


@query(
    "index_unpivot_join",
    "o_orderkey:i pdo:6 gmsst:6",
    f"""WITH {WIDE_SQL}, long AS (SELECT y, m.month, [{', '.join(f'm{m}' for m in range(1, 13))}][m.month] AS v FROM wide, range(1, 13) AS m(month))
    SELECT o_orderkey, a.v AS pdo, CASE WHEN a.month <> 5 THEN a.v * 2 END AS gmsst FROM orders
    LEFT JOIN long a ON a.y = year(o_orderdate) AND a.month = month(o_orderdate) AND a.y <> 1999""",
)
def index_unpivot_join(t):
    months = [F.sum(F.when(F.month("o_orderdate") == m, F.col("o_totalprice"))) / 1e6 for m in range(1, 13)]
    numbered = t.orders.groupBy(F.year("o_orderdate").alias("Year")).agg(*[c.alias(f"Month_{m}") for m, c in enumerate(months, 1)])
    # The second table names its months and marks missing values with stars, so its values are text.
    named = t.orders.groupBy(F.year("o_orderdate").alias("Year")).agg(
        *[(F.lit("***") if m == 4 else (c * 2).cast("string")).alias(features.MONTHS[m].title()) for m, c in enumerate(months)]
    )
    keep = F.col("Year") != 1999
    indices = [
        features.unpivot_months(numbered.where(keep), "Year", "pdo"),
        features.unpivot_months(named.where(keep), "Year", "gmsst"),
    ]
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return features.join_indices(rows, indices)


@query(
    "index_text_rows",
    "year:i month:i nao:4",
    """WITH l AS (SELECT 1950 + s_suppkey % 70 AS y, s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 <> 0)
    SELECT y AS year, m AS month, CASE WHEN m <> 7 THEN round(v + m, 2) END AS nao FROM l, range(1, 13) AS r(m)""",
)
def index_text_rows(t):
    values = [F.lit("n/a") if m == 7 else F.format_string("%.2f", F.col("s_acctbal") + m) for m in range(1, 13)]
    year = F.when(F.col("s_suppkey") % 3 != 0, (F.col("s_suppkey") % 70 + 1950).cast("string")).otherwise(F.lit("year"))
    return parse_index_lines(t.supplier.select(F.concat(F.lit("  "), F.concat_ws("   ", year, *values)).alias("value")), "nao")


@query(
    "lookup_join_misses",
    "regiontype:i n:i miss_rate:8",
    """WITH j AS (SELECT l.l_orderkey, p_size % 9 + 1 AS rt FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey)
    SELECT rt AS regiontype, count(*) AS n, (SELECT avg(CASE WHEN rt IS NULL THEN 1.0 ELSE 0.0 END) FROM j) AS miss_rate FROM j GROUP BY rt""",
)
def lookup_join_misses(t):
    lookup = t.part.where(F.col("p_size") > 10).select(F.col("p_partkey").alias("cell_id"), (F.col("p_size") % 9 + 1).alias("regiontype"))
    joined = features.join_lookup(t.lineitem.select(F.col("l_partkey").alias("cell_id")), lookup)
    misses = features.miss_rate(joined, "regiontype").select("miss_rate").scalar()
    return features.class_distribution(joined).withColumn("miss_rate", misses)


@query(
    "region9_classes",
    "regiontype:i n:i",
    """WITH z AS (SELECT p_partkey % 13 AS thz, p_size % 9 AS mst FROM part)
    SELECT CASE WHEN thz <= 3 THEN 0 WHEN thz <= 7 THEN 3 ELSE 6 END + CASE WHEN mst <= 2 THEN 1 WHEN mst <= 5 THEN 2 ELSE 3 END AS regiontype, count(*) AS n
    FROM z GROUP BY ALL""",
)
def region9_classes(t):
    zones = t.part.select(
        F.col("p_partkey").alias("cell_id"), (F.col("p_partkey") % 13).cast("int").alias("thz"), (F.col("p_size") % 9).alias("mst")
    )
    return features.class_distribution(features.assign_regions(zones))


@query(
    "region_override",
    "regiontype:i n:i",
    """SELECT coalesce(c.k, 0) AS regiontype, count(*) AS n FROM lineitem LEFT JOIN
    (SELECT p_partkey, p_size % 30 + 1 AS k FROM part WHERE p_partkey % 4 <> 0) c ON c.p_partkey = l_partkey GROUP BY ALL""",
)
def region_override(t):
    classes = t.part.where(F.col("p_partkey") % 4 != 0).select(
        F.col("p_partkey").alias("cell_id"), (F.col("p_size") % 30 + 1).alias("class")
    )
    rows = t.lineitem.select(F.col("l_partkey").alias("cell_id"), F.lit(5).alias("regiontype"))
    return features.class_distribution(features.override_regions(rows, classes))


@query(
    "feature_selection",
    "feature:s n:i total:2",
    """SELECT 'l_discount' AS feature, count(*) AS n, sum(l_discount) AS total FROM lineitem
    UNION ALL SELECT 'l_quantity', count(*), sum(l_quantity) FROM lineitem
    UNION ALL SELECT 'l_tax', count(*), sum(l_tax) FROM lineitem
    UNION ALL SELECT 'absent', count(*), 0.0 FROM lineitem""",
)
def feature_selection(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    names = features.feature_columns(t.lineitem, keys, "l_extendedprice", ["l_shipdate"])
    rows = features.fill_missing_features(t.lineitem.select(*names), [*names, "absent"])
    long = rows.unpivot([], [*names, "absent"], "feature", "v")
    return long.groupBy("feature").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


@query(
    "file_name_key",
    "crop:s n:i",
    """SELECT substr(lower(p_type), 1, 3) AS crop, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY ALL""",
)
def file_name_key(t):
    path = F.concat(F.lit("/data/in/wfp_"), F.substring(F.lower("p_type"), 1, 3), F.when(F.col("p_size") % 2 == 0, "_2000.nc").otherwise(".txt"))
    keyed = t.part.select(key_from_path(path, r"^wfp_([a-z0-9]+)_\d{4}\.nc$").alias("crop")).where(F.col("crop").isNotNull())
    return keyed.groupBy("crop").agg(F.count(F.lit(1)).alias("n"))
