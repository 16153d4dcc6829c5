"""Harvested area: shares, factors, allocation, seasons, roll-ups and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.base import LINES, query
from gridspark.functions import calendar, taxonomy
from gridspark.operators import area
from gridspark.operators.scale import literal_rows

# Part brands stand for crops: brand number to a crop name and through it to a functional type.
CROP_OF_BRAND = ["wheat", "maize", "rice", "soybean", "cocoa", "sorghum", "potato", "almond", "mango", "lentil", "oats"]
CROP_CASE = "CASE CAST(substr(p_brand, 7) AS INTEGER) % 11 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(CROP_OF_BRAND)
) + " END"
TYPE_VALUES = ", ".join(f"('{c}', '{k}')" for k, crops in taxonomy.FUNCTIONAL_TYPES.items() for c in crops)
MEMBER_VALUES = ", ".join(
    f"('{code}', '{c}')" for code, crops in {**taxonomy.CODE_CROPS, **taxonomy.GROUP_CROPS}.items() for c in crops
)
MONTH_VALUES = ", ".join(f"({i + 1}, {a}, {b})" for i, (a, b) in enumerate(calendar.SEASON_MONTHS))
CIVIL_VALUES = ", ".join(f"({i + 1}, {a}, {b})" for i, (a, b) in enumerate(calendar.CIVIL_MONTHS))


def crop_name(brand):
    number = F.substring(brand, 7, 4).cast("int") % 11
    return F.element_at(F.array(*[F.lit(c) for c in CROP_OF_BRAND]), number + 1)


def crop_area(t):
    """Quantity per crop and cell."""
    parts = t.part.select(F.col("p_partkey").alias("partkey"), crop_name(F.col("p_brand")).alias("crop"))
    per_part = t.lines.groupBy("partkey", "cell_id").agg(F.sum("qty").alias("harvarea"))
    return per_part.join(parts, "partkey").groupBy("crop", "cell_id").agg(F.sum("harvarea").alias("harvarea"))


AREA_SQL = f"""{LINES}, area AS (
      SELECT {CROP_CASE} AS crop, cell_id, sum(qty) AS ha FROM lines JOIN part ON partkey = p_partkey GROUP BY ALL),
    types(crop, cft) AS (VALUES {TYPE_VALUES}),
    shares AS (SELECT crop, cft, cell_id, ha / sum(ha) OVER (PARTITION BY cell_id, cft) AS share FROM area JOIN types USING (crop))"""


@query(
    "within_group_share",
    "crop:s cft:s cell_id:i share:8",
    f"""WITH {AREA_SQL} SELECT crop, cft, cell_id, share FROM shares""",
)
def within_group_share(t):
    return area.crop_shares(crop_area(t), area.functional_types(t.spark))


@query(
    "zero_share",
    "crop:s cft:s cell_id:i share:8",
    f"""WITH {LINES}, area AS (SELECT {CROP_CASE} AS crop, cell_id, sum(CASE WHEN cell_id % 5 = 0 THEN -qty ELSE qty END) AS ha
      FROM lines JOIN part ON partkey = p_partkey GROUP BY ALL),
    types(crop, cft) AS (VALUES {TYPE_VALUES}),
    clean AS (SELECT crop, cft, cell_id, CASE WHEN ha > 0 THEN ha ELSE 0 END AS ha FROM area JOIN types USING (crop))
    SELECT crop, cft, cell_id, coalesce(ha / nullif(sum(ha) OVER (PARTITION BY cell_id, cft), 0), 0) AS share FROM clean""",
)
def zero_share(t):
    signed = crop_area(t).withColumn(
        "harvarea", F.when(F.col("cell_id") % 5 == 0, -F.col("harvarea")).otherwise(F.col("harvarea"))
    )
    return area.crop_shares(signed, area.functional_types(t.spark))


@query(
    "decoded_years",
    "year:i n:i",
    """WITH r AS (SELECT CASE WHEN l_linestatus = 'O' THEN year(l_shipdate) - 0.3 ELSE CAST(l_suppkey % 99 AS DOUBLE) END AS raw FROM lineitem),
    y AS (SELECT CASE WHEN round_even(raw, 0) < 100 THEN round_even(raw, 0) + 850 ELSE round_even(raw, 0) END AS year FROM r)
    SELECT year, count(*) AS n FROM y WHERE year BETWEEN 900 AND 2000 GROUP BY year""",
)
def decoded_years(t):
    raw = F.when(F.col("l_linestatus") == "O", F.year("l_shipdate") - 0.3).otherwise((F.col("l_suppkey") % 99).cast("double"))
    decoded = area.decode_years(t.lineitem.select(raw.alias("raw")), "raw", 900, 2000)
    return decoded.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def factor_tables(t):
    """A base and an update table of factors from orders of known and unknown origin."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    names = F.array(*[F.lit(c) for c in (*CROP_OF_BRAND, "other", "yautia", "No ")])
    base = rows.select(
        F.element_at(names, (F.col("o_orderkey") % 14 + 1).cast("int")).alias("CROPGRIDS"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("c_nationkey")).alias("country_code"),
        F.year("o_orderdate").alias("year"),
        (F.col("o_totalprice") / 20000 - 1).alias("change_prop"),
        F.col("o_orderkey").alias("line"),
        F.lit(1.0).alias("base_area"),
    )
    late = base.where(F.col("year") >= 2000).withColumn("change_prop", F.col("change_prop") * 2)
    return base.where(F.col("year") < 2001), late.withColumnRenamed("base_area", "bbase_area")


FACTOR_SQL = f"""names AS (SELECT [{', '.join(f"'{c}'" for c in (*CROP_OF_BRAND, 'other', 'yautia', 'No '))}] AS n),
    raw AS (SELECT n[o_orderkey % 14 + 1] AS crop, CASE WHEN o_orderkey % 6 <> 0 THEN c_nationkey END AS country,
              year(o_orderdate) AS year, o_totalprice / 20000 - 1 AS f, o_orderkey AS line FROM orders LEFT JOIN customer ON o_custkey = c_custkey, names),
    u AS (SELECT *, 0 AS tab FROM raw WHERE year < 2001 UNION ALL SELECT crop, country, year, f * 2, line, 1 FROM raw WHERE year >= 2000),
    factors AS (SELECT crop, coalesce(country, -1) AS country_code, year, arg_max(greatest(0, least(10, f)), (tab, line)) AS factor
      FROM u WHERE crop NOT IN ('other', 'yautia', 'No', 'No ') GROUP BY ALL)"""


@query("scaling_factors", "crop:s country_code:i year:i factor:8", f"WITH {FACTOR_SQL} SELECT * FROM factors")
def scaling_factors(t):
    return area.scaling_factors(*factor_tables(t))


def fractions(t):
    """Type fractions and irrigation per cell and year; irrigation may leave [0, 1]."""
    types = F.element_at(F.array(*[F.lit(c) for c in ("c3ann", "c4ann", "c3per", "c3nfx")]), (F.col("suppkey") % 4 + 1).cast("int"))
    return t.lines.groupBy("year", "cell_id", types.alias("cft")).agg(
        (F.sum("discount") / 100).alias("frac"), (F.avg("tax") * 30 - 0.1).alias("irrig_frac")
    )


def cells(t):
    return t.lines.select("cell_id").distinct().select(
        "cell_id", (F.col("cell_id") % 25).cast("int").alias("country_code"), (F.lit(1000.0) + F.col("cell_id")).alias("area_ha")
    )


ALLOC_SQL = f"""{AREA_SQL}, {FACTOR_SQL},
    frac AS (SELECT year, cell_id, (['c3ann', 'c4ann', 'c3per', 'c3nfx'])[suppkey % 4 + 1] AS cft, sum(discount) / 100 AS frac,
               avg(tax) * 30 - 0.1 AS irr FROM lines GROUP BY ALL),
    cells AS (SELECT DISTINCT cell_id, cell_id % 25 AS country_code, 1000.0 + cell_id AS area_ha FROM lines),
    ha AS (SELECT s.crop, f.year, s.cell_id, frac * area_ha * share * coalesce(factor, 1) AS total, greatest(0, least(1, irr)) AS irr
      FROM shares s JOIN cells USING (cell_id) JOIN frac f ON f.cell_id = s.cell_id AND f.cft = s.cft
      LEFT JOIN factors x ON x.crop = s.crop AND x.country_code = cells.country_code AND x.year = f.year WHERE share > 0)"""


def allocated(t):
    shares = area.crop_shares(crop_area(t), area.functional_types(t.spark))
    return area.allocate_area(fractions(t), shares, cells(t), area.scaling_factors(*factor_tables(t)))


@query(
    "area_allocation",
    "crop:s year:i cell_id:i harvested_area:5 harvested_area_irrigated:5 harvested_area_rainfed:5",
    f"""WITH {ALLOC_SQL} SELECT crop, year, cell_id, total AS harvested_area, total * irr AS harvested_area_irrigated,
    total * (1 - irr) AS harvested_area_rainfed FROM ha""",
)
def area_allocation(t):
    return allocated(t)


@query(
    "area_run_summary",
    "crop:s mean_total_mha:9 mean_irrigated_pct:6",
    f"""WITH {ALLOC_SQL}, y AS (SELECT crop, year, sum(total) AS t, sum(total * irr) AS i FROM ha GROUP BY ALL)
    SELECT crop, avg(t) / 1e6 AS mean_total_mha, avg(CASE WHEN t > 0 THEN i / t * 100 ELSE 0 END) AS mean_irrigated_pct FROM y GROUP BY crop""",
)
def area_run_summary(t):
    return area.area_summary(allocated(t))


SEASON_SQL = """m(month, ms, me) AS (VALUES {values}),
    season AS (SELECT l_orderkey AS k, l_linenumber AS ln, plant AS p, mature AS q FROM
      (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE least(365, dayofyear(o_orderdate)) END AS plant,
              least(365, dayofyear(l_shipdate)) AS mature FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
    w AS (SELECT k, ln, month, p, q, CASE WHEN p > 0 AND q > 0 THEN
        least(me - ms + 1, CASE WHEN p <= q THEN greatest(0, least(me, q) - greatest(ms, p) + 1)
          ELSE greatest(0, least(me, 365) - greatest(ms, p) + 1) + greatest(0, least(me, q) - greatest(ms, 1) + 1) END)
        / greatest(1, CASE WHEN p <= q THEN q - p + 1 ELSE 365 - p + 1 + q END) ELSE 0.0 END AS weight FROM season, m)"""


def seasons(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    plant = F.when(F.col("l_orderkey") % 9 == 0, 0).otherwise(F.least(F.lit(365), F.dayofyear("o_orderdate")))
    return joined.select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("ln"),
        plant.alias("planting_day"),
        F.least(F.lit(365), F.dayofyear("l_shipdate")).alias("maturity_day"),
    )


@query(
    "season_month_weights",
    "planting_day:i maturity_day:i month:i n:i weight:8",
    f"""WITH {SEASON_SQL.format(values=MONTH_VALUES)} SELECT p AS planting_day, q AS maturity_day, month, count(*) AS n, max(weight) AS weight FROM w GROUP BY ALL""",
)
def season_month_weights(t):
    rows = seasons(t).groupBy("planting_day", "maturity_day").agg(F.count(F.lit(1)).alias("n"))
    return area.season_months(rows, ["planting_day", "maturity_day", "n"])


@query(
    "season_civil_months",
    "month:i total:5",
    f"""WITH {SEASON_SQL.format(values=CIVIL_VALUES)} SELECT month, sum(weight) AS total FROM w GROUP BY month""",
)
def season_civil_months(t):
    rows = seasons(t).groupBy("planting_day", "maturity_day").agg(F.count(F.lit(1)).alias("n"))
    months = area.season_months(rows, ["planting_day", "maturity_day", "n"], calendar.CIVIL_MONTHS)
    return months.groupBy("month").agg(F.sum(F.col("weight") * F.col("n")).alias("total"))


@query(
    "annual_to_month",
    "crop:s year:i month:i cell_id:i harvested_area_irrigated:9 harvested_area_rainfed:9 harvested_area_total:9",
    f"""WITH {LINES}, m(month, ms, me) AS (VALUES {MONTH_VALUES}),
    annual AS (SELECT crop, year, cell_id, sum(qty * discount) AS irr, sum(qty * tax) AS rain FROM lines GROUP BY ALL),
    cal AS (SELECT crop, status, cell_id, min(partkey % 366) AS p, max(suppkey * 5 % 366) AS q FROM lines
            WHERE crop <> 'N' AND (cell_id % 7 <> 0 OR status = 'O') GROUP BY ALL),
    w AS (SELECT crop, status, cell_id, month, CASE WHEN p > 0 AND q > 0 THEN
        least(me - ms + 1, CASE WHEN p <= q THEN greatest(0, least(me, q) - greatest(ms, p) + 1)
          ELSE greatest(0, least(me, 365) - greatest(ms, p) + 1) + greatest(0, least(me, q) - greatest(ms, 1) + 1) END)
        / greatest(1, CASE WHEN p <= q THEN q - p + 1 ELSE 365 - p + 1 + q END) ELSE 0.0 END AS weight FROM cal, m),
    j AS (SELECT a.crop, a.year, m.month, a.cell_id, irr * coalesce(wi.weight, 0) AS i, rain * coalesce(wr.weight, 0) AS r
      FROM annual a CROSS JOIN m LEFT JOIN w wi ON wi.crop = a.crop AND wi.cell_id = a.cell_id AND wi.month = m.month AND wi.status = 'O'
      LEFT JOIN w wr ON wr.crop = a.crop AND wr.cell_id = a.cell_id AND wr.month = m.month AND wr.status = 'F' WHERE a.crop <> 'N')
    SELECT crop, year, month, cell_id, i AS harvested_area_irrigated, r AS harvested_area_rainfed, i + r AS harvested_area_total FROM j""",
)
def annual_to_month(t):
    annual = t.lines.groupBy("crop", "year", "cell_id").agg(
        F.sum(F.col("qty") * F.col("discount")).alias("harvested_area_irrigated"),
        F.sum(F.col("qty") * F.col("tax")).alias("harvested_area_rainfed"),
    )
    known = t.lines.where((F.col("crop") != "N") & ((F.col("cell_id") % 7 != 0) | (F.col("status") == "O")))
    calendars = known.groupBy("crop", F.when(F.col("status") == "O", "ir").otherwise("rf").alias("system"), "cell_id").agg(
        F.min(F.col("partkey") % 366).alias("planting_day"), F.max(F.col("suppkey") * 5 % 366).alias("maturity_day")
    )
    return area.annual_to_months(annual, calendars)


@query(
    "group_rollup_bridge",
    "code:s year:i cell_id:i ha:2 irr:4",
    f"""WITH {LINES}, g(code, crop) AS (VALUES {MEMBER_VALUES}),
    a AS (SELECT {CROP_CASE} AS crop, year, cell_id, sum(CASE WHEN discount > 0.01 THEN qty ELSE 0 END) AS ha, sum(qty * tax) AS irr
          FROM lines JOIN part ON partkey = p_partkey GROUP BY ALL)
    SELECT code, year, cell_id, sum(ha) AS ha, sum(irr) AS irr FROM a JOIN g USING (crop) GROUP BY ALL""",
)
def group_rollup_bridge(t):
    parts = t.part.select(F.col("p_partkey").alias("partkey"), crop_name(F.col("p_brand")).alias("crop"))
    rows = t.lines.select(
        "partkey", "year", "cell_id", F.when(F.col("discount") > 0.01, F.col("qty")).alias("ha"), (F.col("qty") * F.col("tax")).alias("irr")
    )
    per_part = rows.groupBy("partkey", "year", "cell_id").agg(F.sum("ha").alias("ha"), F.sum("irr").alias("irr"))
    return area.roll_up(per_part.join(parts, "partkey"), area.group_members(t.spark), ["year", "cell_id"], ["ha", "irr"])


@query(
    "missing_members",
    "code:s crop:s",
    f"""WITH g(code, crop) AS (VALUES {MEMBER_VALUES}), seen AS (SELECT DISTINCT {CROP_CASE} AS crop FROM part)
    SELECT code, crop FROM g WHERE crop NOT IN (SELECT crop FROM seen)""",
)
def missing_members(t):
    return area.missing_members(t.part.select(crop_name(F.col("p_brand")).alias("crop")), area.group_members(t.spark))


VALID_SQL = f"""{LINES}, cells AS (
      SELECT crop, (partkey % 40) * 40 + suppkey % 40 AS cell, partkey % 40 // 4 * 10 + suppkey % 40 // 4 AS block,
        sum(CASE WHEN status = 'O' THEN qty END) AS a, sum(CASE WHEN status = 'F' THEN qty * 1.5 END) AS b FROM lines GROUP BY ALL),
    coarse AS (SELECT crop, block, sum(coalesce(a, 0)) AS a, sum(coalesce(b, 0)) AS b, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb
      FROM cells GROUP BY ALL),
    e AS (SELECT *, rank() OVER (PARTITION BY crop ORDER BY a) + (count(*) OVER (PARTITION BY crop, a) - 1) / 2 AS ra,
                 rank() OVER (PARTITION BY crop ORDER BY b) + (count(*) OVER (PARTITION BY crop, b) - 1) / 2 AS rb
      FROM coarse WHERE a > 0 OR b > 0),
    r AS (SELECT crop, corr(a, b) AS pearson_r, corr(ra, rb) AS spearman_r FROM e GROUP BY crop),
    validated AS (SELECT crop, sum(a) / 1e6 AS pipeline_total_mha, sum(na) AS pipeline_nonzero_cells, sum(b) / 1e6 AS reference_total_mha,
      sum(nb) AS reference_nonzero_cells, 'ok' AS status, sum(a) / sum(b) AS ratio, max(pearson_r) AS pearson_r, max(spearman_r) AS spearman_r
      FROM coarse JOIN r USING (crop) GROUP BY crop)"""


def validated(t):
    cell = ((F.col("partkey") % 40) * 40 + F.col("suppkey") % 40).alias("cell_id")
    ours = t.lines.where(F.col("status") == "O").groupBy("crop", cell).agg(F.sum("qty").alias("area"))
    theirs = t.lines.where(F.col("status") == "F").groupBy("crop", cell).agg(
        F.sum(F.col("qty") * 1.5).alias("area")
    )
    block = F.floor(F.floor(F.col("cell_id") / 40) / 4) * 10 + F.floor(F.col("cell_id") % 40 / 4)
    return area.validate_area(ours, theirs, block)


@query(
    "area_validation",
    "crop:s pipeline_total_mha:8 pipeline_nonzero_cells:i reference_total_mha:8 reference_nonzero_cells:i status:s ratio:6 "
    "pearson_r:8 spearman_r:8 flag:s",
    f"""WITH {VALID_SQL} SELECT *, CASE WHEN ratio > 0.3 AND ratio < 3 THEN 'ok' WHEN ratio > 0.1 AND ratio < 10 THEN 'warn' ELSE 'bad' END AS flag FROM validated""",
)
def area_validation(t):
    return area.flag_ratios(validated(t))


@query(
    "correlation_range",
    "mean_r:8 min_r:8 min_name:s max_r:8 max_name:s",
    f"""WITH {VALID_SQL} SELECT avg(pearson_r) AS mean_r, min(pearson_r) AS min_r, arg_min(crop, (pearson_r, crop)) AS min_name,
    max(pearson_r) AS max_r, arg_min(crop, (-pearson_r, crop)) AS max_name FROM validated""",
)
def correlation_range(t):
    return area.correlation_range(validated(t))
