"""Grid algebra, regridding, stress and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.base import GRID, LINES, query
from gridspark.functions import calendar, geo, quality
from gridspark.operators import grid, polygons, regrid, stress
from gridspark.operators.features import month_mask

WEIGHTS_SQL = """
  SELECT c_custkey AS cell_id, m.month, CAST((c_custkey * 7 + m.month * 3) % 10 + 1 AS DOUBLE) / 10 AS w
  FROM customer, range(1, 13) AS m(month)"""


def cell_weights(t):
    """Monthly scarcity weights of customer cells."""
    monthly = t.customer.select(F.col("c_custkey").alias("cell_id"), F.explode(calendar.months()).alias("month"))
    weight = ((F.col("cell_id") * 7 + F.col("month") * 3) % 10 + 1).cast("double") / 10
    return monthly.withColumn("monthly_weight", weight)


def footprint(t):
    """Quantities per crop, month and customer cell. Orders grow with their lines, so both are shuffled."""
    placed = t.lineitem.join(t.orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return placed.groupBy(
        F.col("l_returnflag").alias("crop"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.col("o_custkey").alias("cell_id"),
    ).agg(F.sum("l_quantity").alias("wfp_blue_ir"))


FOOTPRINT_SQL = """
  SELECT l_returnflag AS crop, year(l_shipdate) AS year, month(l_shipdate) AS month, o_custkey AS cell_id,
         sum(l_quantity) AS wfp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""


def countries(t):
    """Cell to country lookup."""
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(
        F.col("c_custkey").alias("cell_id"),
        F.col("n_name").alias("country"),
        F.format_string("%03d", "n_nationkey").alias("iso3"),
    )


@query(
    "stress_by_region_month",
    "iso3:s country:s crop:s year:i month:i waterstress:4",
    f"""WITH fp AS ({FOOTPRINT_SQL}), w AS ({WEIGHTS_SQL})
    SELECT format('{{:03d}}', n_nationkey) AS iso3, n_name AS country, crop, fp.year, fp.month, sum(wfp * w) AS waterstress
    FROM fp JOIN w USING (month, cell_id) JOIN customer ON c_custkey = cell_id JOIN nation ON c_nationkey = n_nationkey
    GROUP BY ALL""",
)
def stress_by_region_month(t):
    return polygons.country_months(stress.water_stress(footprint(t), cell_weights(t)), countries(t))


@query(
    "stress_of_crop_years",
    "crop:s year:i month:i cell_id:i waterstress:4",
    f"""WITH fp AS ({FOOTPRINT_SQL}), w AS ({WEIGHTS_SQL})
    SELECT crop, fp.year, fp.month, fp.cell_id, wfp * w AS waterstress FROM fp JOIN w USING (month, cell_id)
    WHERE crop IN ('A', 'R') AND fp.year BETWEEN 1996 AND 1998""",
)
def stress_of_crop_years(t):
    return stress.water_stress(footprint(t), cell_weights(t), crops=["A", "R"], years=(1996, 1998))


@query(
    "cell_month_mask",
    "crop:s month:i cell_id:i",
    f"WITH {LINES} SELECT DISTINCT crop, month, cell_id FROM lines WHERE qty IS NOT NULL AND discount > 0.02",
)
def cell_month_mask(t):
    target = t.lines.withColumn("waterstress", F.when(F.col("discount") > 0.02, F.col("qty")))
    return month_mask(target)


@query(
    "coordinate_names",
    "lon:2 lat:2 time:s",
    "SELECT s_acctbal / 100 AS lon, s_acctbal / 200 AS lat, s_name AS time FROM supplier",
)
def coordinate_names(t):
    raw = t.supplier.select(
        (F.col("s_acctbal") / 100).alias("longitude"),
        (F.col("s_acctbal") / 200).alias("y"),
        F.col("s_name").alias("valid_time"),
    )
    return grid.standardise_coordinates(raw)


@query(
    "lon_normalise",
    "c_custkey:i lon:6",
    """SELECT c_custkey, lon FROM (SELECT c_custkey,
       ((c_acctbal / 20 + 180) % 360 + 360) % 360 - 180 AS lon FROM customer) WHERE lon < 180""",
)
def lon_normalise(t):
    return grid.normalise_longitude(t.customer.select("c_custkey", (F.col("c_acctbal") / 20).alias("lon")))


@query(
    "grid_cells",
    "lat:3 lon:3 n:i",
    """WITH ax AS (SELECT CAST(floor((9999.99 - c_acctbal) / 11000 * 18) AS BIGINT) AS i, c_custkey % 36 AS j FROM customer)
    SELECT 85 - 10 * i AS lat, -175 + 10 * j AS lon, count(*) AS n FROM ax WHERE i BETWEEN 0 AND 17 GROUP BY ALL""",
)
def grid_cells(t):
    rows = t.customer.select(
        F.floor((F.lit(9999.99) - F.col("c_acctbal")) / 11000 * 18).alias("lat_idx"), (F.col("c_custkey") % 36).alias("lon_idx")
    )
    counts = rows.groupBy("lat_idx", "lon_idx").agg(F.count(F.lit(1)).alias("n"))
    return grid.grid_cells(t.spark, 10.0).join(counts, ["lat_idx", "lon_idx"])


@query(
    "cell_area",
    "s_suppkey:i area_ha:4",
    """SELECT s_suppkey, 6371.0 * radians(0.05) * cos(radians(s_acctbal / 112)) * (6371.0 * radians(0.05)) * 100 AS area_ha
    FROM supplier""",
)
def cell_area(t):
    return t.supplier.select("s_suppkey", geo.cell_area_ha(F.col("s_acctbal") / 112, 0.05, 0.05).alias("area_ha"))


@query(
    "coarse_grid_id",
    "coarse:i n:i",
    """SELECT ((l_partkey % 100) // 6) * 17 + (l_suppkey % 100) // 6 AS coarse, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def coarse_grid_id(t):
    ids = geo.coarse_id(F.col("l_partkey") % 100, F.col("l_suppkey") % 100, 6, 100)
    return t.lineitem.groupBy(ids.alias("coarse")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "qc_decode",
    "event_id:i greenness:6 anomaly:4 scaled:6",
    """SELECT event_id,
      CASE WHEN raw <> -28672 AND raw >= -100 AND raw <= 16000 THEN raw * 1e-4 END AS greenness,
      CASE WHEN big < 1e20 THEN big END AS anomaly,
      CASE WHEN raw <> -3000 AND raw BETWEEN 0 AND 20000 THEN (raw - 5.0) / 10000 END AS scaled
    FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN -28672 WHEN event_id % 13 = 0 THEN -3000 ELSE value * 300 - 150 END AS raw,
                 CASE WHEN event_id % 17 = 0 THEN 1e20 ELSE value END AS big FROM events)""",
)
def qc_decode(t):
    e = F.col("event_id")
    raw = F.when(e % 11 == 0, -28672.0).when(e % 13 == 0, -3000.0).otherwise(F.col("value") * 300 - 150)
    rows = t.events.select(
        "event_id", raw.alias("greenness"), F.when(e % 17 == 0, 1e20).otherwise(F.col("value")).alias("anomaly"), raw.alias("scaled")
    )
    rules = {
        "greenness": quality.RULES["greenness"],
        "anomaly": quality.RULES["soil_anomaly"],
        "scaled": quality.Rule(fill=-3000.0, low=0.0, high=20000.0, scale=10000.0, offset=5.0),
    }
    return grid.decode_columns(rows, rules)


@query(
    "float32_cast",
    "crop:s n:i total:1",
    f"WITH {LINES} SELECT crop, count(*) AS n, sum(CAST(CAST(qty AS FLOAT) AS DOUBLE)) AS total FROM lines GROUP BY crop",
)
def float32_cast(t):
    small = grid.to_float32(t.lines.select("crop", "qty"))
    return small.groupBy("crop").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("total"))


@query(
    "year_to_month",
    "cell_id:i year:i month:i v:2",
    f"WITH {GRID} SELECT lat_idx * 12 + lon_idx AS cell_id, year, m.month, v FROM grid, range(1, 13) AS m(month)",
)
def year_to_month(t):
    return grid.yearly_to_monthly(t.grid.select((F.col("lat_idx") * 12 + F.col("lon_idx")).alias("cell_id"), "year", "v"))


@query(
    "daily_composite",
    "event_type:s year:i month:i value:6",
    """WITH d AS (SELECT event_type, year(ts) AS year, month(ts) AS month,
                         CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events),
    a AS (SELECT event_type, year, month, avg(value) AS value FROM d GROUP BY ALL),
    k AS (SELECT DISTINCT event_type, year, m.month FROM a, range(1, 13) AS m(month))
    SELECT k.event_type, k.year, k.month, a.value FROM k LEFT JOIN a USING (event_type, year, month)""",
)
def daily_composite(t):
    valid = t.events.withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return grid.monthly_composite(valid, ["event_type"], "ts", "value")


@query(
    "gap_fill_months",
    "c_nationkey:i year:i month:i total:2",
    """WITH s AS (SELECT c_nationkey, year(o_orderdate) AS year, month(o_orderdate) AS month,
             sum(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 THEN o_totalprice END) AS total
      FROM orders JOIN customer ON o_custkey = c_custkey
      WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0 GROUP BY ALL),
    k AS (SELECT c_nationkey, year, m.month FROM (SELECT DISTINCT c_nationkey, year FROM s), range(1, 13) AS m(month)),
    f AS (SELECT k.c_nationkey, k.year, k.month, s.total FROM k LEFT JOIN s USING (c_nationkey, year, month))
    SELECT c_nationkey, year, month, coalesce(
      last_value(total IGNORE NULLS) OVER (PARTITION BY c_nationkey, year ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(total IGNORE NULLS) OVER (PARTITION BY c_nationkey, year ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS total
    FROM f""",
)
def gap_fill_months(t):
    kept = t.orders.where((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 2 == 0))
    rare = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 3 == 0), F.col("o_totalprice"))
    series = (
        kept.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
        .agg(F.sum(rare).alias("total"))
    )
    return grid.fill_gaps(series, ["c_nationkey"], ["total"])


@query(
    "version_coalesce",
    "l_orderkey:i price:2 qty:2",
    """WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN l_extendedprice END AS price,
                         CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS qty FROM lineitem)
    SELECT l_orderkey, arg_min(price, l_linenumber * 1000000 + price) FILTER (price IS NOT NULL) AS price,
           arg_min(qty, l_linenumber * 1000000 + qty) FILTER (qty IS NOT NULL) AS qty FROM v GROUP BY l_orderkey""",
)
def version_coalesce(t):
    price = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))
    qty = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", price.alias("price"), qty.alias("qty"))
    # Line numbers repeat within an order here, so the smaller value goes first among equal versions.
    best = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min("price").alias("price"), F.min("qty").alias("qty"))
    return grid.prefer_version(best, ["l_orderkey"], "l_linenumber", ["price", "qty"])


@query(
    "patch_window",
    "cell_id:i year:i month:i qty:2 tax:4",
    f"""WITH {LINES}, base AS (SELECT cell_id, year, month, sum(qty) AS qty, sum(tax) AS tax FROM lines GROUP BY ALL),
    fix AS (SELECT cell_id, year, month, CASE WHEN count(*) > 3 THEN sum(qty) * 2 END AS qty FROM lines WHERE status = 'O' GROUP BY ALL)
    SELECT b.cell_id, b.year, b.month,
      CASE WHEN b.year BETWEEN 1997 AND 1999 AND f.cell_id IS NOT NULL THEN f.qty ELSE b.qty END AS qty, b.tax
    FROM base b LEFT JOIN fix f USING (cell_id, year, month)""",
)
def patch_window(t):
    keys = ["cell_id", "year", "month"]
    base = t.lines.groupBy(*keys).agg(F.sum("qty").alias("qty"), F.sum("tax").alias("tax"))
    fixed = t.lines.where(F.col("status") == "O").groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > 3, F.sum("qty") * 2).alias("qty")
    )
    return grid.patch_window(base, fixed, keys, ["qty"], F.col("year").between(1997, 1999))


@query(
    "patch_ratio",
    "variable:s mean_ratio:6",
    f"""WITH {LINES}, base AS (SELECT cell_id, year, month, sum(qty) AS qty, sum(tax) AS tax FROM lines GROUP BY ALL),
    fix AS (SELECT cell_id, year, month, sum(qty) AS qty, sum(tax) AS tax FROM lines WHERE status = 'O' GROUP BY ALL),
    j AS (SELECT avg(f.qty) / avg(b.qty) AS qty, avg(f.tax) / avg(b.tax) AS tax FROM base b JOIN fix f USING (cell_id, year, month))
    SELECT 'qty' AS variable, qty AS mean_ratio FROM j UNION ALL SELECT 'tax', tax FROM j""",
)
def patch_ratio(t):
    keys = ["cell_id", "year", "month"]
    sums = [F.sum("qty").alias("qty"), F.sum("tax").alias("tax")]
    base = t.lines.groupBy(*keys).agg(*sums)
    return grid.patch_ratio(base, t.lines.where(F.col("status") == "O").groupBy(*keys).agg(*sums), keys, ["qty", "tax"])


@query(
    "range_check",
    "variable:s mean:8 ok:s",
    """WITH m AS (SELECT avg(l_extendedprice * 100) AS ssr, avg(l_tax / 1000) AS tp, avg(-l_discount) AS evabs FROM lineitem)
    SELECT 'ssr' AS variable, ssr AS mean, ssr BETWEEN 3e5 AND 9e7 AS ok FROM m
    UNION ALL SELECT 'tp', tp, tp BETWEEN 3e-6 AND 0.06 FROM m
    UNION ALL SELECT 'evabs', evabs, evabs BETWEEN -0.015 AND -1e-7 / 3 FROM m""",
)
def range_check(t):
    rows = t.lineitem.select(
        (F.col("l_extendedprice") * 100).alias("ssr"), (F.col("l_tax") / 1000).alias("tp"), (-F.col("l_discount")).alias("evabs")
    )
    return grid.check_ranges(rows)


@query(
    "first_per_month",
    "user_id:i year:i month:i event_id:i value:2",
    """SELECT user_id, year(ts) AS year, month(ts) AS month, arg_min(event_id, (event_type, event_id)) AS event_id,
       arg_min(value, (event_type, event_id)) AS value FROM events GROUP BY ALL""",
)
def first_per_month(t):
    rows = t.events.select("user_id", "event_id", "value", "event_type", F.struct("event_type", "event_id").alias("file"), "ts")
    return grid.keep_first_per_month(rows, ["user_id"], "ts", "file")


@query(
    "julian_date",
    "s_suppkey:i day:s",
    """SELECT s_suppkey, CAST(make_date(CAST(2000 + s_suppkey % 20 AS INTEGER), 1, 1) + CAST((s_suppkey * 37) % 366 AS INTEGER) AS DATE) AS day
    FROM supplier""",
)
def julian_date(t):
    name = F.format_string("MOD13.A%04d%03d.h08v05.hdf", 2000 + F.col("s_suppkey") % 20, F.col("s_suppkey") * 37 % 366 + 1)
    return t.supplier.select("s_suppkey", calendar.julian_file_date(name).alias("day"))


@query(
    "latest_file",
    "year:i path:s",
    """SELECT year(o_orderdate) AS year, max(o_orderpriority || '/' || o_orderstatus || '.nc') AS path FROM orders GROUP BY ALL""",
)
def latest_file(t):
    path = F.concat("o_orderpriority", F.lit("/"), "o_orderstatus", F.lit(".nc"))
    return grid.latest_file(t.orders.select(F.year("o_orderdate").alias("year"), path.alias("path")), "year", "path")


@query(
    "pivot_slots",
    "user_id:i smia_01:2 smia_11:2 smia_21:2",
    """WITH d AS (SELECT user_id, day(ts) AS day, max(value) AS v FROM events GROUP BY ALL)
    SELECT user_id, max(v) FILTER (day = 1) AS smia_01, max(v) FILTER (day = 11) AS smia_11, max(v) FILTER (day = 21) AS smia_21
    FROM d WHERE day IN (1, 11, 21) GROUP BY user_id""",
)
def pivot_slots(t):
    daily = t.events.groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.max("value").alias("v"))
    return grid.slots_to_columns(daily, ["user_id"], "day", "v", "smia")


@query(
    "outer_merge_sources",
    "year:i month:i cell_id:i qty:2 price:2 late:2",
    f"""WITH {LINES}, a AS (SELECT year, month, cell_id, sum(qty) AS qty FROM lines WHERE crop = 'A' GROUP BY ALL),
    b AS (SELECT year, month, cell_id, sum(price) AS price FROM lines WHERE crop = 'R' GROUP BY ALL),
    c AS (SELECT year, cell_id, sum(qty) AS late FROM lines WHERE crop = 'N' GROUP BY ALL),
    cm AS (SELECT year, m.month, cell_id, late FROM c, range(1, 13) AS m(month))
    SELECT year, month, cell_id, qty, price, late FROM a FULL JOIN b USING (year, month, cell_id)
    FULL JOIN cm USING (year, month, cell_id)""",
)
def outer_merge_sources(t):
    monthly = ["year", "month", "cell_id"]
    sources = {
        "a": t.lines.where(F.col("crop") == "A").groupBy(*monthly).agg(F.sum("qty").alias("qty")),
        "b": t.lines.where(F.col("crop") == "R").groupBy(*monthly).agg(F.sum("price").alias("price")),
        "c": t.lines.where(F.col("crop") == "N").groupBy("year", "cell_id").agg(F.sum("qty").alias("late")),
        "d": None,
    }
    return grid.merge_available(sources, monthly, first_year={"a": 1990, "d": 2010})


@query(
    "variable_summary",
    "variable:s n_valid:i min_value:2 max_value:2 first_time:s last_time:s",
    """SELECT 'o_totalprice' AS variable, count(o_totalprice) AS n_valid, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value,
      min(CAST(o_orderdate AS DATE)) AS first_time, max(CAST(o_orderdate AS DATE)) AS last_time FROM orders
    UNION ALL SELECT 'urgent', count(*), min(o_totalprice), max(o_totalprice), min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))
    FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def variable_summary(t):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))
    rows = t.orders.select(F.col("o_orderdate").cast("date").alias("time"), "o_totalprice", urgent.alias("urgent"))
    return grid.describe_variables(rows, ["o_totalprice", "urgent"], "time")


@query(
    "period_change",
    "cell_id:i late:4 early:4 change:8",
    f"""WITH {LINES}, y AS (SELECT cell_id, year, sum(CASE WHEN partkey % 3 = 0 THEN qty ELSE 0 END) AS v FROM lines GROUP BY ALL),
    w AS (SELECT cell_id, avg(v) FILTER (year BETWEEN 1999 AND 2001) AS late, avg(v) FILTER (year BETWEEN 1995 AND 1997) AS early
          FROM y GROUP BY cell_id)
    SELECT cell_id, late, early,
      CASE WHEN NOT (coalesce(late, 0) = 0 AND coalesce(early, 0) = 0) THEN (late - early) / 1e6 END AS change FROM w""",
)
def period_change(t):
    v = F.when(F.col("partkey") % 3 == 0, F.col("qty")).otherwise(0.0)
    yearly = t.lines.groupBy("cell_id", "year").agg(F.sum(v).alias("v"))
    return grid.period_change(yearly, ["cell_id"], "v", 1995, 2001, 3)


@query(
    "box_clip",
    "box:s n:i total:2",
    """WITH c AS (SELECT c_acctbal / 60 AS lon, (c_custkey % 180) - 90 AS lat, c_acctbal FROM customer),
    b(box, x0, x1, y0, y1) AS (VALUES ('west', -10, 60, 0, 40), ('east', 50, 130, -30, 30))
    SELECT box, count(*) AS n, sum(c_acctbal) AS total FROM c JOIN b ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY box""",
)
def box_clip(t):
    points = t.customer.select((F.col("c_acctbal") / 60).alias("lon"), (F.col("c_custkey") % 180 - 90).alias("lat"), "c_acctbal")
    clipped = grid.clip_boxes(points, {"west": (-10, 60, 0, 40), "east": (50, 130, -30, 30)})
    return clipped.groupBy("box").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total"))


@query(
    "zonal_smooth",
    "year:i lat_idx:i zonal_mean:6 zonal_smooth:6",
    f"""WITH {GRID}, ax AS (SELECT i AS lat_idx FROM range(0, 12) AS r(i)),
    y AS (SELECT DISTINCT year FROM grid),
    z AS (SELECT y.year, ax.lat_idx, coalesce(sum(CASE WHEN v > 0 THEN v ELSE 0 END), 0) / 12 AS m
          FROM y CROSS JOIN ax LEFT JOIN grid g ON g.year = y.year AND g.lat_idx = ax.lat_idx GROUP BY ALL),
    k AS (SELECT year, lat_idx, o, CASE WHEN lat_idx + o < 0 THEN -(lat_idx + o) - 1 WHEN lat_idx + o > 11 THEN 23 - (lat_idx + o) ELSE lat_idx + o END AS src
          FROM z, range(-2, 3) AS r(o))
    SELECT k.year, k.lat_idx, max(s.m) FILTER (k.o = 0) AS zonal_mean, sum(s.m) / 5 AS zonal_smooth
    FROM k JOIN z s ON s.year = k.year AND s.lat_idx = k.src GROUP BY ALL""",
)
def zonal_smooth(t):
    return grid.zonal_profile(t.grid, ["year"], "lat_idx", "v", 12, 12)


@query(
    "clip_level",
    "crop:s clip_level:4",
    f"""WITH {LINES} SELECT crop, quantile_cont(abs(price - 40000), 0.98) AS clip_level FROM lines GROUP BY crop""",
)
def clip_level(t):
    return grid.clip_level(t.lines.select("crop", (F.col("price") - 40000).alias("v")), ["crop"], "v")


@query(
    "tile_mosaic",
    "year:i cell_id:i v:2",
    """WITH p AS (SELECT year(l_shipdate) AS year, l_suppkey % 3 AS h, l_partkey % 4 + 6 AS v, l_partkey % 240 * 10 AS r, l_suppkey % 240 * 10 AS c,
             l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <> 7),
    xy AS (SELECT *, (-18 + h + (c + 0.5) / 2400) * (2 * pi() * 6371007.181 / 36) AS x, (9 - v - (r + 0.5) / 2400) * (2 * pi() * 6371007.181 / 36) AS y FROM p),
    ll AS (SELECT *, degrees(y / 6371007.181) AS lat,
             greatest(-180, least(180, degrees(x / (6371007.181 * CASE WHEN abs(cos(y / 6371007.181)) < 1e-10 THEN 1e-10 ELSE cos(y / 6371007.181) END)))) AS lon FROM xy),
    cell AS (SELECT year, CAST(greatest(0, least(359, floor((89.75 - lat) / 0.5 + 0.5))) AS BIGINT) * 720 + CAST(greatest(0, least(719, floor((lon + 179.75) / 0.5 + 0.5))) AS BIGINT) AS cell_id,
             h, v, r, c, l_orderkey, l_linenumber, l_quantity FROM ll)
    SELECT year, cell_id, arg_max(l_quantity, (h, v, r, c, l_orderkey, l_linenumber, l_quantity)) AS v FROM cell GROUP BY ALL""",
)
def tile_mosaic(t):
    h, v = F.col("l_suppkey") % 3, F.col("l_partkey") % 4 + 6
    r, c = F.col("l_partkey") % 240 * 10, F.col("l_suppkey") % 240 * 10
    pixels = t.lineitem.select(
        F.year("l_shipdate").alias("year"),
        F.struct(h, v, r, c, "l_orderkey", "l_linenumber", "l_quantity").alias("file"),
        h.alias("tile_h"),
        v.alias("tile_v"),
        r.alias("row"),
        c.alias("col"),
        F.col("l_quantity").alias("v"),
    )
    return grid.sinusoidal_mosaic(pixels, ["year"], "v", 7.0, 0.5)


BILINEAR_SQL = """, tgt AS (SELECT i AS ti, j AS tj, {pi} AS p, {pj} AS q FROM range(0, {nt}) AS a(i), range(0, {nt}) AS b(j)),
    inside AS (SELECT *, least(floor(p), 10) AS i0, least(floor(q), 10) AS j0 FROM tgt WHERE p >= 0 AND p <= 11 AND q >= 0 AND q <= 11),
    corner AS (SELECT ti, tj, i0 + di AS i, j0 + dj AS j,
        (CASE WHEN di = 0 THEN 1 - (p - i0) ELSE p - i0 END) * (CASE WHEN dj = 0 THEN 1 - (q - j0) ELSE q - j0 END) AS w
        FROM inside, range(0, 2) AS x(di), range(0, 2) AS y(dj))"""


@query(
    "bilinear_regrid",
    "year:i lat_idx:i lon_idx:i v:5",
    f"WITH {GRID}, chosen AS (SELECT * FROM grid WHERE (lat_idx * 5 + lon_idx * 3 + year) % 29 <> 0)"
    + BILINEAR_SQL.format(pi="(i * 0.4 - 0.2)", pj="(j * 0.4 - 0.2)", nt=30)
    + """ SELECT year, ti AS lat_idx, tj AS lon_idx, sum(v * w) AS v FROM chosen JOIN corner ON i = lat_idx AND j = lon_idx
    GROUP BY ALL HAVING count(*) = 4""",
)
def bilinear_regrid(t):
    some = t.grid.where((F.col("lat_idx") * 5 + F.col("lon_idx") * 3 + F.col("year")) % 29 != 0)
    source, target = regrid.Axis(0.5, 1.0, 12), regrid.Axis(0.3, 0.4, 30)
    axis = regrid.positions_between(source, target)
    return regrid.bilinear(some, ["year"], "v", (12, 12), (30, 30), axis, axis)


@query(
    "nearest_regrid",
    "year:i lat_idx:i lon_idx:i v:2",
    f"""WITH {GRID}, tgt AS (SELECT i AS ti, j AS tj, floor(round(i * 0.4 - 0.3 + 0.0, 9) + 0.5) AS p, floor(round(j * 0.4 - 0.3 + 0.0, 9) + 0.5) AS q
    FROM range(0, 30) AS a(i), range(0, 30) AS b(j))
    SELECT year, ti AS lat_idx, tj AS lon_idx, v FROM tgt JOIN grid ON p = lat_idx AND q = lon_idx""",
)
def nearest_regrid(t):
    axis = regrid.positions_between(regrid.Axis(0.5, 1.0, 12), regrid.Axis(0.2, 0.4, 30))
    return regrid.nearest(t.grid, ["year"], ["v"], (30, 30), axis, axis)


@query(
    "nearest_lookup",
    "c_custkey:i cell_id:i v:2",
    f"""WITH {GRID}, g AS (SELECT lat_idx, lon_idx, sum(v) AS v FROM grid GROUP BY ALL),
    p AS (SELECT c_custkey, greatest(0, least(11, floor((82.5 - (c_acctbal / 100)) / 15 + 0.5))) AS i,
                 greatest(0, least(11, floor(((c_custkey % 360) - 180 + 165) / 30 + 0.5))) AS j FROM customer)
    SELECT c_custkey, i * 12 + j AS cell_id, v FROM p JOIN g ON i = lat_idx AND j = lon_idx""",
)
def nearest_lookup(t):
    total = t.grid.groupBy("lat_idx", "lon_idx").agg(F.sum("v").alias("v"))
    i = geo.axis_index(F.col("c_acctbal") / 100, 82.5, -15.0, 12)
    j = geo.axis_index((F.col("c_custkey") % 360 - 180).cast("double"), -165.0, 30.0, 12)
    points = t.customer.select("c_custkey", i.alias("lat_idx"), j.alias("lon_idx"))
    return points.join(total, ["lat_idx", "lon_idx"]).withColumn("cell_id", geo.cell_id(F.col("lat_idx"), F.col("lon_idx"), 12))


@query(
    "upsample_children",
    "year:i lat_idx:i lon_idx:i v:2",
    f"""WITH {GRID} SELECT year, i AS lat_idx, j AS lon_idx, v FROM grid JOIN range(0, 60) AS a(i) ON 11 - i // 5 = lat_idx
    JOIN range(0, 60) AS b(j) ON j // 5 = lon_idx""",
)
def upsample_children(t):
    return regrid.upsample(t.grid, ["year"], ["v"], (12, 12), 5, flip_lat=True)


@query(
    "upsample_endpoint",
    "year:i lat_idx:i lon_idx:i v:2",
    f"""WITH {GRID}, ax AS (SELECT i, floor(round(i * (11.0 / 71.0), 9) + 0.5) AS p FROM range(0, 72) AS r(i))
    SELECT year, a.i AS lat_idx, b.i AS lon_idx, v FROM grid JOIN ax a ON a.p = lat_idx JOIN ax b ON b.p = lon_idx""",
)
def upsample_endpoint(t):
    return regrid.upsample(t.grid, ["year"], ["v"], (12, 12), 6, align="endpoint")


@query(
    "sum_bin_regrid",
    "year:i lat_idx:i lon_idx:i v:2",
    """WITH p AS (SELECT year(l_shipdate) AS year, -87 + l_partkey % 59 * 3 AS lat, -177 + l_suppkey % 117 * 3 AS lon, l_quantity FROM lineitem)
    SELECT year, greatest(0, least(35, floor((90.0 - lat) / 5.0))) AS lat_idx, greatest(0, least(71, floor((lon + 180.0) / 5.0))) AS lon_idx,
      sum(l_quantity) AS v FROM p GROUP BY ALL""",
)
def sum_bin_regrid(t):
    points = t.lineitem.select(
        F.year("l_shipdate").alias("year"),
        (F.col("l_partkey") % 59 * 3 - 87).cast("double").alias("lat"),
        (F.col("l_suppkey") % 117 * 3 - 177).cast("double").alias("lon"),
        F.col("l_quantity").alias("v"),
    )
    return regrid.sum_bins(points, ["year"], ["v"], 5.0, 36, 72)


@query(
    "mass_rescale_regrid",
    "year:i lat_idx:i lon_idx:i v:5",
    f"WITH {GRID}, chosen AS (SELECT * FROM grid)"
    + BILINEAR_SQL.format(pi="round(i * (11.0 / 19.0), 9)", pj="round(j * (11.0 / 19.0), 9)", nt=20)
    + """, moved AS (SELECT year, ti, tj, sum(v * w) AS v FROM chosen JOIN corner ON i = lat_idx AND j = lon_idx GROUP BY ALL),
    f AS (SELECT year, (SELECT sum(v) FROM grid g WHERE g.year = m.year) / sum(v) AS f FROM moved m GROUP BY year)
    SELECT year, ti AS lat_idx, tj AS lon_idx, v * f AS v FROM moved JOIN f USING (year)""",
)
def mass_rescale_regrid(t):
    return regrid.bilinear_keep_total(t.grid, ["year"], "v", (12, 12), (20, 20))


@query(
    "block_aggregate",
    "year:i lat:3 lon:3 v:2",
    f"""WITH {GRID} SELECT year, -1.0 + ((lat_idx // 5) * 5 + 2) * 0.5 AS lat, 2.0 + ((lon_idx // 5) * 5 + 2) * 0.5 AS lon, sum(v) AS v
    FROM grid WHERE lat_idx < 10 AND lon_idx < 10 GROUP BY ALL""",
)
def block_aggregate(t):
    return regrid.block_sums(t.grid, ["year"], "v", 5, 12, 12, regrid.Axis(-1.0, 0.5, 12), regrid.Axis(2.0, 0.5, 12))


@query(
    "nearest_station",
    "c_custkey:i s_suppkey:i distance:6",
    """WITH s AS (SELECT s_suppkey, s_acctbal / 50 AS x, (s_suppkey * 37) % 101 AS y FROM supplier),
    c AS (SELECT c_custkey, c_acctbal / 50 AS x, (c_custkey * 13) % 97 AS y FROM customer),
    d AS (SELECT c_custkey, s_suppkey, (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS d2 FROM c, s)
    SELECT c_custkey, arg_min(s_suppkey, (d2, s_suppkey)) AS s_suppkey, sqrt(min(d2)) AS distance FROM d GROUP BY c_custkey""",
)
def nearest_station(t):
    stations = t.supplier.select(
        "s_suppkey", (F.col("s_acctbal") / 50).alias("x"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("y")
    )
    points = t.customer.select(
        "c_custkey", (F.col("c_acctbal") / 50).alias("x"), (F.col("c_custkey") * 13 % 97).cast("double").alias("y")
    )
    return stress.nearest_station(points, stations, "c_custkey", "s_suppkey")


@query(
    "station_factors",
    "station_id:i month:i factor:6",
    """SELECT s_suppkey AS station_id, m AS month, CASE WHEN s_suppkey % 10 = m % 10 THEN 0 ELSE s_acctbal / m END AS factor
    FROM supplier, range(1, 13) AS r(m)""",
)
def station_factors(t):
    wide = t.supplier.select(
        F.col("s_suppkey").alias("station_id"),
        *[
            F.when(F.col("s_suppkey") % 10 == (m + 1) % 10, -99999.0).otherwise(F.col("s_acctbal") / (m + 1)).alias(name)
            for m, name in enumerate(stress.MONTH_NAMES)
        ],
    )
    return stress.station_factors(wide)


@query(
    "positional_concat",
    "s_suppkey:i s_name:s n:i",
    """SELECT s_suppkey, s_name, s_nationkey AS n FROM supplier""",
)
def positional_concat(t):
    left = t.supplier.select("s_suppkey", "s_name").orderBy("s_suppkey")
    right = t.supplier.orderBy("s_suppkey").select(F.col("s_nationkey").alias("n"))
    return stress.concat_columns(left, right)


# A square with a square hole, a triangle and a concave shape that overlaps the square.
RINGS = [
    (1, [(-100, -40), (20, -40), (20, 50), (-100, 50)]),
    (1, [(-60, -10), (-20, -10), (-20, 20), (-60, 20)]),
    (2, [(40, -60), (160, -60), (100, 70)]),
    (3, [(0, 0), (60, 0), (60, 60), (30, 20), (0, 60)]),
]
EDGE_ROWS = [
    (poly, float(x1), float(y1), float(x2), float(y2))
    for poly, ring in RINGS
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])
]
EDGE_VALUES = ", ".join(f"({p}, {a}, {b}, {c}, {d})" for p, a, b, c, d in EDGE_ROWS)


def nation_edges(t):
    """Polygon outlines, one shifted copy per region of the world."""
    names = ("poly", "x1", "y1", "x2", "y2")
    shapes = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in EDGE_ROWS])
    shift = F.col("r_regionkey") * 3
    return t.region.select("r_regionkey", F.inline(shapes)).select(
        (F.col("r_regionkey") * 10 + F.col("poly")).alias("poly_id"),
        *[(F.col(c) + shift).alias(c) for c in ("x1", "y1", "x2", "y2")],
    )


@query(
    "point_in_polygon",
    "c_custkey:i poly_id:i",
    f"""WITH e(poly, x1, y1, x2, y2) AS (VALUES {EDGE_VALUES}),
    edges AS (SELECT r_regionkey * 10 + poly AS poly_id, x1 + r_regionkey * 3 AS x1, y1 + r_regionkey * 3 AS y1,
                     x2 + r_regionkey * 3 AS x2, y2 + r_regionkey * 3 AS y2 FROM region, e),
    p AS (SELECT c_custkey, 90 - ((c_custkey * 7) % 90 + 0.5) * 2 AS lat, -180 + ((c_custkey * 11) % 180 + 0.5) * 2 AS lon FROM customer),
    h AS (SELECT c_custkey, poly_id, count(*) AS n FROM p, edges
          WHERE least(y1, y2) <= lat AND lat < greatest(y1, y2) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon GROUP BY ALL)
    SELECT c_custkey, min(poly_id) AS poly_id FROM h WHERE n % 2 = 1 GROUP BY c_custkey""",
)
def point_in_polygon(t):
    cells = polygons.cells_in_polygons(nation_edges(t), 2.0)
    points = t.customer.select(
        "c_custkey", (F.col("c_custkey") * 7 % 90).alias("cell_lat"), (F.col("c_custkey") * 11 % 180).alias("cell_lon")
    )
    return points.join(cells, ["cell_lat", "cell_lon"])
