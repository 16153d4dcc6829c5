"""Readers and writers on the given files, and on partitioned tables written from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridspark.catalog.base import query
from gridspark.operators.scale import number_rows
from gridspark.session import cut_lineage, ensure_checkpoint_dir
from gridspark.sources import readers, writers


def written_orders(t) -> str:
    """Order totals per status, year and customer as a partitioned table in the shared folder."""
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/orders-{uuid.uuid4().hex}"
    sums = t.orders.groupBy(F.col("o_orderstatus").alias("crop"), F.year("o_orderdate").alias("year"), "o_custkey")
    writers.write_partitions(sums.agg(F.sum("o_totalprice").alias("value")), path)
    return path


@query(
    "yearly_scan",
    "year:i n:i value:2",
    """WITH s AS (SELECT o_orderstatus AS crop, year(o_orderdate) AS year, o_custkey, sum(o_totalprice) AS value FROM orders GROUP BY ALL)
    SELECT year, count(*) AS n, sum(value) AS value FROM s WHERE year BETWEEN 1996 AND 1999 GROUP BY year""",
)
def yearly_scan(t):
    assert readers.read_years(t.spark, f"{t.sf_dir}/no_such_table", 1996, 1999) is None
    return readers.read_years(t.spark, written_orders(t), 1996, 1999).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query(
    "crop_year_scan",
    "crop:s year:i n:i value:2",
    """WITH s AS (SELECT o_orderstatus AS crop, year(o_orderdate) AS year, o_custkey, sum(o_totalprice) AS value FROM orders GROUP BY ALL)
    SELECT crop, year, count(*) AS n, sum(value) AS value FROM s WHERE year BETWEEN 1997 AND 2000 AND crop IN ('F', 'P') GROUP BY ALL""",
)
def crop_year_scan(t):
    rows = readers.read_crops(t.spark, written_orders(t), ["F", "P"], 1997, 2000)
    return rows.groupBy("crop", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query(
    "written_keys",
    "crop:s year:i",
    """WITH y AS (SELECT DISTINCT year(o_orderdate) + 1 AS year FROM orders), s AS (SELECT DISTINCT o_orderstatus AS crop FROM orders)
    SELECT crop, year FROM s, y WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = crop AND year(o_orderdate) = y.year)""",
)
def written_keys(t):
    """Keys one year on that are not written yet."""
    path = written_orders(t)
    years = F.array_sort(F.collect_set(F.col("year") + 1)).alias("years")
    keys = t.spark.read.parquet(path).select("crop", "year").distinct()
    wanted = keys.agg(years, F.collect_set("crop").alias("crops")).select(F.explode("crops").alias("crop"), "years")
    return writers.missing_keys(wanted.select("crop", F.explode("years").alias("year")), path)


@query("keyed_files", "name:s n:i", "SELECT 'nation' AS name, count(*) AS n FROM nation")
def keyed_files(t):
    """The key comes from the name of the file that each row was read from."""
    rows = readers.read_keyed(t.spark, f"{t.sf_dir}/nation.parquet", r"^([a-z]+)\.parquet$", "name")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prediction_export",
    "time:s lat:i lon:i year:i y_pred:2",
    """SELECT CAST(l_shipdate AS DATE) AS time, l_partkey % 180 - 90 AS lat, l_suppkey % 360 - 180 AS lon, year(l_shipdate) AS year, l_extendedprice AS y_pred FROM lineitem""",
)
def prediction_export(t):
    rows = t.lineitem.select(
        F.col("l_shipdate").cast("date").alias("time"),
        (F.col("l_partkey") % 180 - 90).alias("lat"),
        (F.col("l_suppkey") % 360 - 180).alias("lon"),
        F.col("l_extendedprice").alias("gre"),
    )
    return writers.prediction_rows(rows, "gre")


@query(
    "country_history",
    "crop:s year:i value:2",
    """SELECT replace(n_name, ' ', '-') AS crop, year(o_orderdate) AS year, round(sum(CAST(o_totalprice AS BIGINT)), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def country_history(t):
    """Country files named by crop and year, in one folder a year, read by the reader of such files."""
    folder = shared_folder(t, "history")
    named = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    year = F.year("o_orderdate")
    file = F.concat(F.translate("n_name", " ", "-"), F.lit("_country_"), year.cast("string"), F.lit(".csv"))
    # Rounded half to even, as the casts of the SQL side do.
    rows = named.select(year.alias("y"), file.alias("file"), F.bround("o_totalprice", 0).cast("bigint").alias("waterstress"))
    rows.repartition("y", "file").write.partitionBy("y", "file").option("header", True).csv(folder)
    return readers.sum_country_history(readers.read_country_history(t.spark, name_files(t.spark, folder, "y", "file")))


def shared_folder(t, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def name_files(spark, folder: str, outer: str, inner: str) -> str:
    """Give the one file of every partition the place ``outer value/inner value`` beside the folder; returns the pattern of all of them."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = files.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in fs.globStatus(files.Path(f"{folder}/{outer}=*/{inner}=*/part-*")):
        path = part.getPath()
        a, b = (p.getName().partition("=")[2] for p in (path.getParent().getParent(), path.getParent()))
        target = files.Path(f"{folder}-named/{a}/{b}")
        fs.mkdirs(target.getParent())
        fs.rename(path, target)
    return f"{folder}-named/*/*_country_*.csv"


MONTHS = range(1, 13)


@query(
    "matrix_source",
    "row:i col:i value:2",
    """WITH m AS (SELECT s_nationkey AS row, month(l_shipdate) - 1 AS col, sum(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT row, col, value FROM m WHERE value <> 0""",
)
def matrix_source(t):
    """Nations by months as a matrix without header or index, read back as cells that are not 0."""
    lines = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    sums = lines.groupBy("s_nationkey").agg(*[F.sum(F.when(F.month("l_shipdate") == m, F.col("l_quantity")).otherwise(0.0)).alias(f"m{m}") for m in MONTHS])
    cells = [F.coalesce(F.col(f"m{m}").cast("double"), F.lit(0.0)).cast("string") for m in MONTHS]
    full = t.nation.join(sums, F.col("n_nationkey") == F.col("s_nationkey"), "left").orderBy("n_nationkey")
    path = shared_folder(t, "matrix")
    full.select(F.concat_ws(",", *cells).alias("value")).write.text(path)
    return readers.read_matrix(t.spark, path)


@query(
    "account_source",
    "year:i region:i sector:i value:2",
    """WITH q AS (SELECT year(l_shipdate) AS year, s_nationkey AS region, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS sector, l_quantity AS v
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT year, region, sector, sum(v) AS value FROM q WHERE year BETWEEN 1995 AND 1997 GROUP BY ALL
    UNION ALL SELECT 1996, c_nationkey, -1, sum(c_acctbal) FROM customer GROUP BY ALL""",
)
def account_source(t):
    """Accounts of three years under the three names they may have, one of them with a household account (sector -1)."""
    folder = shared_folder(t, "account")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.groupBy(F.year("l_shipdate").alias("y"), (F.col("s_nationkey") * 3 + flag).alias("idx")).agg(F.sum("l_quantity").alias("value"))
    rows = cut_lineage(rows)
    rows.where("y = 1995").drop("y").write.option("header", True).csv(f"{folder}/satellite_1995.csv")
    rows.where("y = 1996").drop("y").write.parquet(f"{folder}/Q_1996.parquet")
    rows.where("y = 1997").drop("y").write.option("header", True).csv(f"{folder}/1997.csv")
    t.customer.groupBy(F.col("c_nationkey").alias("region")).agg(F.sum("c_acctbal").alias("value")).write.parquet(f"{folder}/Q_Y_1996.parquet")
    out = None
    for year in (1995, 1996, 1997):
        account, home = readers.read_account(t.spark, folder, year, 25, 3)
        out = account if out is None else out.unionByName(account)
        if home is not None:
            out = out.unionByName(home.select(F.lit(year).alias("year"), "region", F.lit(-1).alias("sector"), "value"))
    return out


@query(
    "csv_export",
    "position:i year:i o_custkey:i value:2",
    """WITH s AS (SELECT year(o_orderdate) AS year, o_custkey, sum(o_totalprice) AS value FROM orders GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY year, o_custkey) - 1 AS position, year, o_custkey, value FROM s""",
)
def csv_export(t):
    """A sorted export with a header; the rows of its files, one after the other, are in order."""
    path = shared_folder(t, "export")
    sums = t.orders.groupBy(F.year("o_orderdate").alias("year"), "o_custkey").agg(F.sum("o_totalprice").alias("value"))
    writers.write_csv(sums, path, ["year", "o_custkey"])
    read = t.spark.read.option("header", True).schema("year int, o_custkey long, value double").csv(path)
    placed = read.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    return number_rows(cut_lineage(placed), ["_path", "_start"], "_id", "position")
