"""Country and sector mapping and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.base import LINES, query
from gridspark.functions import taxonomy
from gridspark.operators import mapping
from gridspark.operators.scale import literal_rows
from gridspark.session import cut_lineage

# Regions of the driver's nations: every nation but the last three belongs to one.
SECTORS = ["s0", "s1", "s2", "s3", "s4"]


def country_values(t):
    """Value per year, country and crop code; crops are part brands folded onto the crop list."""
    crops = F.array(*[F.lit(c) for c in taxonomy.CROPS])
    parts = t.part.select(
        F.col("p_partkey").alias("partkey"), F.element_at(crops, F.substring("p_brand", 7, 4).cast("int") % 27 + 1).alias("crop")
    )
    names = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("suppkey"), F.col("n_name").alias("country")
    )
    sums = t.lines.groupBy("year", "partkey", "suppkey").agg(F.sum("price").alias("value"))
    values = sums.join(parts, "partkey").join(names, "suppkey").groupBy("year", "country", "crop").agg(F.sum("value").alias("value"))
    return cut_lineage(values)


CROP_LIST = "[" + ", ".join(f"'{c}'" for c in taxonomy.CROPS) + "]"
CODE = f"({CROP_LIST})[CAST(substr(p_brand, 7) AS INTEGER) % 27 + 1]"
VALUES = f"""{LINES}, cv AS (SELECT year, n_name AS country, {CODE} AS crop, sum(price) AS value
      FROM lines JOIN part ON partkey = p_partkey JOIN supplier ON suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
    regions AS (SELECT n_name AS country, 'R' || CAST(n_nationkey % 10 AS VARCHAR) AS region FROM nation WHERE n_nationkey < 22)"""


def regions(t):
    return t.nation.where(F.col("n_nationkey") < 22).select(
        F.col("n_name").alias("country"), F.concat(F.lit("R"), (F.col("n_nationkey") % 10).cast("string")).alias("region")
    )


@query(
    "hist_pred_merge",
    "year:i country:s crop:s value:2",
    f"""WITH {VALUES}, h AS (SELECT * FROM cv WHERE year <= 1998), p AS (SELECT year, country, crop, value * 2 AS value FROM cv WHERE year >= 1998)
    SELECT year, country, crop, value FROM h UNION ALL SELECT * FROM p WHERE year NOT IN (SELECT year FROM h)""",
)
def hist_pred_merge(t):
    v = country_values(t)
    return mapping.merge_history(v.where(F.col("year") <= 1998), v.where(F.col("year") >= 1998).withColumn("value", F.col("value") * 2))


@query(
    "hist_pred_prefer_prediction",
    "year:i n:i value:2 change_pct:6",
    f"""WITH {VALUES}, h AS (SELECT * FROM cv WHERE year <= 1998), p AS (SELECT year, country, crop, value * 2 AS value FROM cv WHERE year >= 1998),
    m AS (SELECT * FROM p UNION ALL SELECT year, country, crop, value FROM h WHERE year NOT IN (SELECT year FROM p))
    SELECT year, count(*) AS n, sum(value) AS value, (SELECT (sum(value) FILTER (year = 1999) - sum(value) FILTER (year = 1998)) / sum(value) FILTER (year = 1998) * 100 FROM m) AS change_pct
    FROM m GROUP BY year""",
)
def hist_pred_prefer_prediction(t):
    v = country_values(t)
    history = v.where(F.col("year") <= 1998)
    merged = mapping.merge_history(history, v.where(F.col("year") >= 1998).withColumn("value", F.col("value") * 2), "keep_prediction")
    jump = mapping.discontinuity(merged, history).select("change_pct").scalar()
    return merged.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).withColumn("change_pct", jump)


def detailed(t):
    """Detailed crops per country and year."""
    names = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("country")
    )
    joined = t.orders.join(names, "o_custkey")
    crop = F.concat(F.lit("d"), (F.col("o_orderkey") % 12).cast("string"))
    return joined.groupBy("country", crop.alias("crop"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("value"))


CROP_MAP = [(f"d{i}", taxonomy.SPLIT_CROPS[i % 3], SECTORS[i % 5]) for i in range(12)]
CROP_MAP_VALUES = ", ".join(str(r) for r in CROP_MAP)
DETAIL = f"""regions AS (SELECT n_name AS country, 'R' || CAST(n_nationkey % 10 AS VARCHAR) AS region FROM nation WHERE n_nationkey < 22),
    cm(crop, crop_group, sector) AS (VALUES {CROP_MAP_VALUES}),
    sv AS (SELECT region, crop_group, sector, year(o_orderdate) AS year, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN regions r ON r.country = n_name JOIN cm ON cm.crop = 'd' || CAST(o_orderkey % 12 AS VARCHAR) GROUP BY ALL),
    yrs AS (SELECT DISTINCT year FROM sv),
    rm AS (SELECT region, crop_group, sector, y.year, avg(value) AS m FROM yrs y JOIN sv ON sv.year BETWEEN y.year - 2 AND y.year + 2 GROUP BY ALL),
    rolling AS (SELECT region, crop_group, sector, year, m / sum(m) OVER (PARTITION BY region, crop_group, year) AS weight FROM rm),
    cmn AS (SELECT region, crop_group, sector, avg(value) AS m FROM sv WHERE year BETWEEN 1997 AND 1999 GROUP BY ALL),
    recent AS (SELECT region, crop_group, sector, m / sum(m) OVER (PARTITION BY region, crop_group) AS weight FROM cmn)"""


def sector_values(t):
    crop_map = literal_rows(t.spark, CROP_MAP, "crop string, crop_group string, sector string")
    return cut_lineage(mapping.sector_values(detailed(t), crop_map, regions(t)))


@query("split_weights_rolling", "region:s crop_group:s sector:s year:i weight:8", f"WITH {DETAIL} SELECT * FROM rolling")
def split_weights_rolling(t):
    return mapping.rolling_weights(sector_values(t))


@query("split_weights_recent", "region:s crop_group:s sector:s weight:8", f"WITH {DETAIL} SELECT * FROM recent")
def split_weights_recent(t):
    return mapping.recent_weights(sector_values(t), 1997, 1999)


@query(
    "weight_check",
    "n_groups:i n_bad:i",
    f"""WITH {DETAIL}, s AS (SELECT region, crop_group, year, sum(weight) AS w FROM rolling WHERE sector <> 's4' GROUP BY ALL)
    SELECT count(*) AS n_groups, count(*) FILTER (w < 0.999 OR w > 1.001) AS n_bad FROM s""",
)
def weight_check(t):
    weights = mapping.rolling_weights(sector_values(t)).where(F.col("sector") != "s4")
    return mapping.check_weights(weights, ["region", "crop_group", "year"])


ALLOCATION = f"""{VALUES}, {DETAIL.replace('regions AS (', 'regions2 AS (', 1).replace('JOIN regions r', 'JOIN regions2 r')},
    rv AS (SELECT cv.year, region, crop, sum(value) AS value FROM cv JOIN regions USING (country) GROUP BY ALL),
    ds(crop, sector) AS (VALUES {', '.join(f"('{c}', '{s}')" for c, s in taxonomy.CROP_SECTOR.items())}),
    wy AS (SELECT DISTINCT year FROM rolling WHERE year < 2000), rw AS (SELECT * FROM rolling WHERE year < 2000),
    al AS (SELECT year, region, sector, value AS v FROM rv JOIN ds USING (crop)
      UNION ALL SELECT rv.year, rv.region, w.sector, value * weight FROM rv JOIN rw w ON w.region = rv.region AND w.crop_group = rv.crop AND w.year = rv.year
      UNION ALL SELECT rv.year, rv.region, w.sector, value * weight FROM rv JOIN recent w ON w.region = rv.region AND w.crop_group = rv.crop WHERE rv.year NOT IN (SELECT year FROM wy)),
    alloc AS (SELECT year, region, sector, sum(v) AS allocated FROM al GROUP BY ALL)"""


def allocation(t):
    values = mapping.map_regions(country_values(t), regions(t))
    sv = sector_values(t)
    rolling = mapping.rolling_weights(sv).where(F.col("year") < 2000)
    split = values.where(F.col("crop").isin(*taxonomy.SPLIT_CROPS))
    direct = mapping.allocate_direct(values, mapping.sector_lookup(t.spark))
    both = direct.unionByName(mapping.allocate_split(split, rolling, mapping.recent_weights(sv, 1997, 1999)))
    return both.groupBy("year", "region", "sector").agg(F.sum("allocated").alias("allocated"))


@query("sector_allocation", "year:i region:s sector:s allocated:4", f"WITH {ALLOCATION} SELECT * FROM alloc")
def sector_allocation(t):
    return allocation(t)


@query(
    "split_lost_mass",
    "year:i region:s crop:s lost:2",
    f"""WITH {ALLOCATION}, few AS (SELECT * FROM rw WHERE region <> 'R3'), fr AS (SELECT * FROM recent WHERE region <> 'R4')
    SELECT year, region, crop, value AS lost FROM rv WHERE crop IN ('oac', 'pdc', 'pec') AND
      CASE WHEN year IN (SELECT year FROM few) THEN NOT EXISTS (SELECT 1 FROM few f WHERE f.region = rv.region AND f.crop_group = rv.crop AND f.year = rv.year)
      ELSE NOT EXISTS (SELECT 1 FROM fr f WHERE f.region = rv.region AND f.crop_group = rv.crop) END""",
)
def split_lost_mass(t):
    values = mapping.map_regions(country_values(t), regions(t)).where(F.col("crop").isin(*taxonomy.SPLIT_CROPS))
    sv = sector_values(t)
    rolling = mapping.rolling_weights(sv).where((F.col("year") < 2000) & (F.col("region") != "R3"))
    return mapping.lost_mass(values, rolling, mapping.recent_weights(sv, 1997, 1999).where(F.col("region") != "R4"))


@query(
    "unmapped_countries",
    "country:s n_rows:i value:2",
    f"WITH {VALUES} SELECT country, count(*) AS n_rows, sum(value) AS value FROM cv WHERE country NOT IN (SELECT country FROM regions) GROUP BY country",
)
def unmapped_countries(t):
    return mapping.unmapped(country_values(t), regions(t))


def complete(t):
    order = t.nation.where(F.col("n_nationkey") < 10).select(
        F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("region"), F.col("n_nationkey").alias("region_ord")
    )
    return mapping.complete_table(allocation(t), order, range(1994, 2003), [*taxonomy.SECTORS, *SECTORS])


COMPLETE = f"""{ALLOCATION}, secs AS (SELECT unnest([{', '.join(f"'{s}'" for s in [*taxonomy.SECTORS, *SECTORS])}]) AS sector, unnest(range(0, 19)) AS sector_ord),
    sk AS (SELECT 'R' || CAST(n_nationkey AS VARCHAR) AS region, n_nationkey AS region_ord, y.year, sector, sector_ord FROM nation, range(1994, 2003) AS y(year), secs WHERE n_nationkey < 10),
    comp AS (SELECT sk.*, coalesce(allocated, 0) AS waterstress FROM sk LEFT JOIN alloc USING (year, region, sector))"""


@query("complete_skeleton", "year:i region:s region_ord:i sector:s sector_ord:i waterstress:4", f"WITH {COMPLETE} SELECT * FROM comp")
def complete_skeleton(t):
    return complete(t)


@query(
    "mapping_conservation",
    "original_total:2 mapped_total:3 diff_pct:8 n_null:i",
    f"""WITH {COMPLETE} SELECT (SELECT sum(value) FROM rv) AS original_total, sum(waterstress) AS mapped_total, count(*) FILTER (waterstress IS NULL) AS n_null,
    abs(sum(waterstress) - (SELECT sum(value) FROM rv)) / (SELECT sum(value) FROM rv) * 100 AS diff_pct FROM comp""",
)
def mapping_conservation(t):
    return mapping.conservation(mapping.map_regions(country_values(t), regions(t)), complete(t))


@query(
    "vector_layout",
    "year:i idx:i value:4",
    f"WITH {COMPLETE} SELECT year, region_ord * 120 + sector_ord AS idx, waterstress AS value FROM comp WHERE waterstress <> 0",
)
def vector_layout(t):
    return mapping.flat_account(complete(t))


def sut_cells(t):
    """Supply-use cells in blocks of 12 with 6 industries: 25 suppliers times 25 parts wide."""
    row = (F.col("partkey") % 25) * 12 + F.col("orderkey") % 12
    col = (F.col("suppkey") % 25) * 12 + (F.col("partkey") + F.col("linenumber")) % 12
    return t.lines.groupBy(row.alias("row"), col.alias("col")).agg(F.sum("price").alias("value"))


SUT = f"""{LINES}, sut AS (SELECT (partkey % 25) * 12 + orderkey % 12 AS r, (suppkey % 25) * 12 + (partkey + linenumber) % 12 AS c, sum(price) AS value FROM lines GROUP BY ALL)"""


@query(
    "sut_to_mrio",
    "from_region:i from_sector:i to_region:i to_sector:i value:2",
    f"""WITH {SUT} SELECT r // 12 AS from_region, r % 12 - 6 AS from_sector, c // 12 AS to_region, c % 12 AS to_sector, value FROM sut WHERE r % 12 >= 6 AND c % 12 < 6""",
)
def sut_to_mrio(t):
    return mapping.supply_use_blocks(sut_cells(t), 12, 6)


@query(
    "fd_by_region",
    "from_region:i from_sector:i to_region:i value:2",
    f"WITH {SUT} SELECT r // 12 AS from_region, r % 12 - 6 AS from_sector, c // 6 AS to_region, sum(value) AS value FROM sut WHERE r % 12 >= 6 GROUP BY ALL",
)
def fd_by_region(t):
    return mapping.demand_by_region(mapping.demand_rows(sut_cells(t), 12, 6), 6)


@query(
    "supply_columns",
    "row:i region:i sector:i value:2",
    f"""WITH {SUT} SELECT r AS "row", c // 12 AS region, c % 12 AS sector, value FROM sut WHERE c % 12 < 6""".replace(' AS "row"', " AS row"),
)
def supply_columns(t):
    return mapping.supply_columns(sut_cells(t), 6)


def account_pair(t):
    """Own and reference accounts on 25 regions and 9 sectors."""
    region, sector = (F.col("suppkey") % 25).alias("region"), (F.col("partkey") % 9).alias("sector")
    ours = t.lines.where(F.col("status") == "O").groupBy("year", region, sector).agg(F.sum("price").alias("value"))
    theirs = t.lines.where(F.col("status") == "F").groupBy("year", (F.col("linenumber") % 3 + 390).alias("row"), region, sector).agg(
        F.sum(F.col("price") / 1e6).alias("value")
    )
    return ours, theirs


PAIR = f"""{LINES}, ours AS (SELECT year, suppkey % 25 AS region, partkey % 9 AS sector, sum(price) AS value FROM lines WHERE status = 'O' GROUP BY ALL),
    theirs AS (SELECT year, linenumber % 3 + 390 AS line, suppkey % 25 AS region, partkey % 9 AS sector, sum(price / 1e6) AS value FROM lines WHERE status = 'F' GROUP BY ALL),
    ref AS (SELECT year, region, sector, value FROM theirs WHERE line = 390), own AS (SELECT year, region, sector, value / 1e6 AS value FROM ours)"""


@query(
    "hybrid_account",
    "year:i region:i sector:i value:8",
    f"""WITH {PAIR}, u AS (SELECT year, region, sector, value / 1e6 AS value FROM ours WHERE sector < 4
      UNION ALL SELECT year, region, sector, value FROM theirs WHERE line IN (390, 391) AND sector >= 4)
    SELECT year, region, sector, sum(value) AS value FROM u GROUP BY ALL""",
)
def hybrid_account(t):
    ours, theirs = account_pair(t)
    return mapping.hybrid_account(ours, theirs, own_sectors=4, include_other=True)


def own_and_reference(t):
    ours, theirs = account_pair(t)
    return ours.withColumn("value", F.col("value") / 1e6), theirs.where(F.col("row") == 390).drop("row")


@query(
    "account_agreement",
    "year:i our_total:6 reference_total:6 ratio_total:6 pearson_cell:6 rmse_cell:8 mape_cell_pct:5 country_ratio_n_total:i country_ratio_n_within_2x:i "
    "pearson_country:6 pearson_country_log1p:6 country_ratio_p25:6 country_ratio_median:6 country_ratio_p75:6 spearman_cell:6 spearman_country:6",
    f"""WITH {PAIR}, c AS (SELECT year, region, sector, coalesce(o.value, 0) AS a, coalesce(r.value, 0) AS b FROM own o FULL JOIN ref r USING (year, region, sector)),
    k AS (SELECT year, region, sum(a) AS a, sum(b) AS b FROM c GROUP BY ALL),
    rc AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY a) + (count(*) OVER (PARTITION BY year, a) - 1) / 2 AS x, rank() OVER (PARTITION BY year ORDER BY b) + (count(*) OVER (PARTITION BY year, b) - 1) / 2 AS y FROM c WHERE a > 0 OR b > 0),
    rk AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY a) + (count(*) OVER (PARTITION BY year, a) - 1) / 2 AS x, rank() OVER (PARTITION BY year ORDER BY b) + (count(*) OVER (PARTITION BY year, b) - 1) / 2 AS y FROM k WHERE a > 0 OR b > 0),
    sc AS (SELECT year, corr(x, y) AS s FROM rc GROUP BY year), sk AS (SELECT year, corr(x, y) AS s FROM rk GROUP BY year),
    ac AS (SELECT year, sum(a) AS our_total, sum(b) AS reference_total, sum(a) / sum(b) AS ratio_total, corr(a, b) FILTER (a > 0 OR b > 0) AS pearson_cell,
      sqrt(avg((a - b) ** 2)) AS rmse_cell, avg(abs((a - b) / b)) FILTER (b > 0) * 100 AS mape_cell_pct FROM c GROUP BY year),
    ak AS (SELECT year, count(*) FILTER (a > 0 AND b > 0) AS country_ratio_n_total, count(*) FILTER (a > 0 AND b > 0 AND a / b > 0.5 AND a / b < 2) AS country_ratio_n_within_2x,
      corr(a, b) FILTER (a > 0 OR b > 0) AS pearson_country, corr(ln(1 + a), ln(1 + b)) FILTER (a > 0 OR b > 0) AS pearson_country_log1p,
      quantile_cont(a / b, 0.25) FILTER (a > 0 AND b > 0) AS country_ratio_p25, quantile_cont(a / b, 0.5) FILTER (a > 0 AND b > 0) AS country_ratio_median,
      quantile_cont(a / b, 0.75) FILTER (a > 0 AND b > 0) AS country_ratio_p75 FROM k GROUP BY year)
    SELECT ac.*, ak.* EXCLUDE (year), sc.s AS spearman_cell, sk.s AS spearman_country FROM ac JOIN ak USING (year) JOIN sc USING (year) JOIN sk USING (year)""",
)
def account_agreement(t):
    return mapping.account_agreement(*own_and_reference(t))


@query(
    "account_composition",
    "year:i our_own:6 reference_rest:6 hybrid_total:6 pct_own_in_hybrid:6 reference_own:6 reference_wide:6 pct_own_in_reference:6",
    f"""WITH {PAIR}, a AS (SELECT year, sum(value) FILTER (sector < 4) AS our_own FROM own GROUP BY year),
    b AS (SELECT year, sum(value) FILTER (sector BETWEEN 4 AND 6) AS reference_rest, sum(value) FILTER (sector < 4) AS reference_own, sum(value) FILTER (sector < 7) AS reference_wide FROM ref GROUP BY year)
    SELECT year, our_own, reference_rest, our_own + reference_rest AS hybrid_total, our_own / (our_own + reference_rest) * 100 AS pct_own_in_hybrid, reference_own, reference_wide,
      reference_own / reference_wide * 100 AS pct_own_in_reference FROM a JOIN b USING (year)""",
)
def account_composition(t):
    return mapping.composition(*own_and_reference(t), own=4, wide=7)


@query(
    "region_groups",
    "region_group:s n_countries:i value:2",
    f"""WITH {VALUES} SELECT r_name AS region_group, count(DISTINCT country) AS n_countries, sum(value) AS value FROM cv JOIN nation ON n_name = country
    JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""",
)
def region_groups(t):
    # One map of group to members, as a settings file would give it.
    members = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list("n_name").alias("m"))
    one = members.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "m"))).alias("members"))
    bridge = mapping.region_groups(one)
    return country_values(t).join(bridge, "country").groupBy("region_group").agg(
        F.count_distinct("country").alias("n_countries"), F.sum("value").alias("value")
    )


@query(
    "item_crop_match",
    "item:s crop:s n:i",
    """WITH i AS (SELECT p_type AS item, p_brand || '; ' || p_name || ', dry' AS names FROM part),
    x AS (SELECT item, unnest(string_split(names, '; ')) AS crop FROM i) SELECT item, crop, count(*) AS n FROM x GROUP BY ALL""",
)
def item_crop_match(t):
    items = t.part.select("p_type", F.concat("p_brand", F.lit("; "), "p_name", F.lit(", dry")).alias("names"))
    return mapping.match_items(items, "p_type", "names").groupBy("item", "crop").agg(F.count(F.lit(1)).alias("n"))


_ROWS = [(crop.replace("'", "''"), group, sector.replace("'", "''")) for crop, group, sector in mapping.concordance_rows()]
_NUMBERED = ", ".join(f"({i}, '{crop}', '{group}', '{sector}')" for i, (crop, group, sector) in enumerate(_ROWS))


@query(
    "crop_concordance",
    "region:s crop_group:s sector:s year:i value:2",
    f"""WITH cc(n, crop, crop_group, sector) AS (VALUES {_NUMBERED})
    SELECT 'R' || CAST(n_nationkey % 10 AS VARCHAR) AS region, crop_group, sector, year(o_orderdate) AS year, sum(o_totalprice) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN cc ON cc.n = o_orderkey % {len(_ROWS)} WHERE n_nationkey < 22 GROUP BY ALL""",
)
def crop_concordance(t):
    """Orders dealt over all crops of the concordance, summed per sector."""
    names = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("country")
    )
    crop = F.element_at(F.array(*[F.lit(r[0]) for r in mapping.concordance_rows()]), (F.col("o_orderkey") % len(_ROWS) + 1).cast("int"))
    crops = t.orders.join(names, "o_custkey").select("country", crop.alias("crop"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"))
    return mapping.sector_values(crops, mapping.crop_concordance(t.spark), regions(t))
