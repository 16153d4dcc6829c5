"""Supply-chain attribution on a network of 25 nations and three sectors."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from gridspark.catalog.base import query
from gridspark.operators import attribution
from gridspark.operators.scale import literal_rows
from gridspark.plans.attribution_years import attribute_years
from gridspark.session import cut_lineage

# Rounds after which the SQL side has converged: increments shrink by a factor of about 7 a round.
SQL_ROUNDS = 20


class Network:
    """Flows between (supplier nation, return flag) and (customer nation, part class)."""

    def __init__(self, t):
        self.t = t

    @cached_property
    def flows(self):
        t = self.t
        flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        # Summed per order and supplier before the lookups.
        sums = t.lineitem.groupBy(
            "l_orderkey", "l_suppkey", flag.alias("s"), (F.col("l_partkey") % 3).alias("u"), (F.col("l_linenumber") == 1).alias("inner")
        ).agg(F.sum("l_quantity").alias("value"), F.sum(F.col("l_quantity") * F.col("l_tax")).alias("load"))
        buyers = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("c")
        )
        makers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("m"))
        placed = sums.join(buyers, "l_orderkey").join(makers, "l_suppkey")
        totals = placed.groupBy(
            (F.col("m") * 3 + F.col("s")).cast("bigint").alias("i"),
            (F.col("c") * 3 + F.col("u")).cast("bigint").alias("j"),
            F.col("c").cast("bigint").alias("k"),
            "inner",
        ).agg(F.sum("value").alias("value"), F.sum("load").alias("load"))
        # Every table below is read several times by the series.
        return cut_lineage(totals)

    @cached_property
    def edges(self):
        return self.flows.where("inner").groupBy("i", "j").agg(F.sum("value").alias("value"))

    @cached_property
    def demand(self):
        return self.flows.where("not inner").groupBy("i", "k").agg(F.sum("value").alias("value"))

    @cached_property
    def account(self):
        return self.flows.groupBy("i").agg(F.sum("load").alias("value"))

    @cached_property
    def output(self):
        return attribution.gross_output(self.edges, self.demand)

    @cached_property
    def prepared(self):
        return attribution.prepare(self.edges, self.demand, self.account)

    @property
    def a(self):
        return self.prepared[0]

    @property
    def d(self):
        return self.prepared[2]

    @cached_property
    def nodes(self):
        """Sector 1 is the target."""
        sectors = F.explode(F.array(*[F.lit(s) for s in range(3)])).alias("sector")
        named = self.t.nation.select(F.col("n_nationkey").cast("bigint").alias("region"), sectors)
        return cut_lineage(
            named.select((F.col("region") * 3 + F.col("sector")).alias("i"), "region", "sector", (F.col("sector") == 1).alias("is_target"))
        )


NET = """f AS (SELECT s_nationkey * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS i, c_nationkey * 3 + l_partkey % 3 AS j, c_nationkey AS k,
      l_linenumber = 1 AS inn, l_quantity AS v, l_quantity * l_tax AS load FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN supplier ON l_suppkey = s_suppkey),
    z AS (SELECT i, j, sum(v) AS v FROM f WHERE inn GROUP BY ALL), y AS (SELECT i, k, sum(v) AS v FROM f WHERE NOT inn GROUP BY ALL),
    x AS (SELECT i, sum(v) AS x FROM (SELECT i, v FROM z UNION ALL SELECT i, v FROM y) GROUP BY i),
    a AS (SELECT z.i, z.j, z.v / CASE WHEN x > 0 THEN x ELSE 1 END AS a FROM z LEFT JOIN x ON x.i = z.j),
    d AS (SELECT g.i, load / x AS d FROM (SELECT i, sum(load) AS load FROM f GROUP BY i) g JOIN x USING (i)),
    ao AS (SELECT * FROM a WHERE i % 3 <> 1 AND j % 3 <> 1)"""


def unrolled(name: str, start: str, matrix: str, keys: str, rounds: int = SQL_ROUNDS) -> str:
    """CTEs of a power series, so many rounds that later ones are below the digits compared."""
    parts = [f"{name}0 AS MATERIALIZED ({start})"]
    renamed = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    for n in range(1, rounds + 1):
        parts.append(
            f"{name}{n} AS MATERIALIZED (SELECT m.i, {renamed}, sum(m.a * p.v) AS v FROM {name}{n - 1} p JOIN {matrix} m ON m.j = p.i GROUP BY ALL)"
        )
    union = " UNION ALL ".join(f"SELECT i, {keys}, v FROM {name}{n}" for n in range(rounds + 1))
    parts.append(f"{name} AS MATERIALIZED (SELECT i, {keys}, sum(v) AS v FROM ({union}) GROUP BY ALL)")
    return ", ".join(parts)


DIRECT = unrolled("dr", "SELECT i, i % 3 AS t, k, v FROM y WHERE i % 3 = 1", "a", "t, k")
OTHER = unrolled("ot", "SELECT i, i % 3 AS s, k, v FROM y WHERE i % 3 <> 1", "ao", "s, k")
HANDED = unrolled("hd", "SELECT a.i, a.i % 3 AS t, s, k, sum(a.a * ot.v) AS v FROM ot JOIN a ON a.j = ot.i WHERE a.i % 3 = 1 GROUP BY ALL", "a", "t, s, k")


@query("gross_output", "i:i x:2", f"WITH {NET} SELECT i, x FROM x")
def gross_output(t):
    return Network(t).output


@query("tech_coefficients", "i:i j:i a:9", f"WITH {NET} SELECT i, j, a FROM a")
def tech_coefficients(t):
    return Network(t).a


@query("intensity", "i:i d:9", f"WITH {NET} SELECT i, d FROM d")
def intensity(t):
    return Network(t).d


@query(
    "target_nodes",
    "is_target:s n:i x:2",
    f"WITH {NET} SELECT i % 3 = 1 AS is_target, count(*) AS n, sum(x) AS x FROM x GROUP BY ALL",
)
def target_nodes(t):
    net = Network(t)
    chosen = attribution.target_sectors({"one": [1], "again": [1]})
    nodes = net.output.withColumn("is_target", (F.col("i") % 3).isin(chosen))
    return nodes.groupBy("is_target").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))


@query(
    "demand_groups",
    "i:i k:s value:2",
    f"""WITH {NET}, g AS (SELECT i, 'low' AS k, v FROM y WHERE k < 10 UNION ALL SELECT i, 'even', v FROM y WHERE k % 2 = 0 UNION ALL SELECT i, 'world', v FROM y)
    SELECT i, k, sum(v) AS value FROM g GROUP BY ALL""",
)
def demand_groups(t):
    groups = {"low": list(range(10)), "even": list(range(0, 25, 2)), "world": "all"}
    return attribution.demand_groups(Network(t).demand, groups)


@query(
    "series_requirements",
    "i:i v:4",
    f"""WITH {NET}, {unrolled('sr', "SELECT i, 0 AS one, sum(v) AS v FROM y GROUP BY i", "a", "one")} SELECT i, v FROM sr""",
)
def series_requirements(t):
    net = Network(t)
    start = net.demand.groupBy("i").agg(F.sum("value").alias("v"))
    return attribution.series(net.a, start, [])


@query(
    "footprint_direct",
    "preg:i psec:i tsec:i fssec:i k:i value:6",
    f"""WITH {NET}, {DIRECT} SELECT dr.i // 3 AS preg, dr.i % 3 AS psec, t AS tsec, t AS fssec, k, d * v AS value FROM dr JOIN d USING (i) WHERE d * v > 0""",
)
def footprint_direct(t):
    net = Network(t)
    return attribution.direct_slot(net.a, net.demand, net.nodes, net.d)


@query(
    "footprint_indirect",
    "preg:i psec:i tsec:i fssec:i k:i value:6",
    f"""WITH {NET}, {OTHER}, {HANDED} SELECT hd.i // 3 AS preg, hd.i % 3 AS psec, t AS tsec, s AS fssec, k, d * v AS value FROM hd JOIN d USING (i) WHERE d * v > 0""",
)
def footprint_indirect(t):
    net = Network(t)
    return attribution.indirect_slot(net.a, net.demand, net.nodes, net.d)


@query(
    "footprint_remaining",
    "preg:i psec:i fssec:i k:i value:6",
    f"""WITH {NET}, {OTHER} SELECT ot.i // 3 AS preg, ot.i % 3 AS psec, s AS fssec, k, d * v AS value FROM ot JOIN d USING (i) WHERE d * v > 0""",
)
def footprint_remaining(t):
    net = Network(t)
    return attribution.remaining(net.a, net.demand, net.nodes, net.d)


@query(
    "footprint_by_producer",
    "pgroup:i tsec:i fssec:i k:i slot:i value:6",
    f"""WITH {NET}, {DIRECT}, {OTHER}, {HANDED},
    u AS (SELECT i, t AS tsec, t AS fssec, k, 0 AS slot, d * v AS value FROM dr JOIN d USING (i) UNION ALL SELECT i, t, s, k, 1, d * v FROM hd JOIN d USING (i)
      UNION ALL SELECT i, NULL, s, k, 2, d * v FROM ot JOIN d USING (i))
    SELECT i // 3 % 5 AS pgroup, tsec, fssec, k, slot, sum(value) AS value FROM u GROUP BY ALL HAVING sum(value) > 0""",
)
def footprint_by_producer(t):
    """Five groups of producers: ten right-hand sides in place of one for each consumer and supplying sector; slot 2 never passes a target."""
    net = Network(t)
    producers = net.d.select("i", (F.floor(F.col("i") / 3) % 5).alias("pgroup"), "d")
    target, rest = attribution.footprints_by_producer(net.a, net.demand, net.nodes, producers, ["pgroup"])
    return target.unionByName(rest.withColumn("slot", F.lit(2)), allowMissingColumns=True)


@query(
    "household_slot",
    "preg:i k:s value:4",
    """WITH h AS (SELECT c_nationkey AS r, sum(c_acctbal) AS v FROM customer GROUP BY ALL)
    SELECT r AS preg, 'low' AS k, v AS value FROM h WHERE r < 10 UNION ALL SELECT r, 'all', v FROM h""",
)
def household_slot(t):
    direct = t.customer.groupBy(F.col("c_nationkey").alias("region")).agg(F.sum("c_acctbal").alias("value"))
    return attribution.household(direct, {"low": list(range(10)), "all": "all"})


@query(
    "footprint_balance",
    "expected:4 household:2 target:6 remaining:6 total:4 rel_error:7 ok:s",
    f"""WITH {NET}, {DIRECT}, {OTHER}, {HANDED}, h AS (SELECT sum(c_acctbal) AS h FROM customer),
    p AS (SELECT (SELECT sum(d * x) FROM d JOIN x USING (i)) + h AS expected, h AS household,
       (SELECT sum(d * v) FROM dr JOIN d USING (i)) + (SELECT sum(d * v) FROM hd JOIN d USING (i)) AS target,
       (SELECT sum(d * v) FROM ot JOIN d USING (i)) AS remaining FROM h),
    q AS (SELECT *, target + remaining + household AS total FROM p)
    SELECT *, abs(total - expected) / expected AS rel_error, abs(total - expected) / expected < 0.01 AS ok FROM q""",
)
def footprint_balance(t):
    net = Network(t)
    home = attribution.household(t.customer.groupBy(F.col("c_nationkey").alias("region")).agg(F.sum("c_acctbal").alias("value")))
    supply = attribution.others_supply(net.a, net.demand, net.nodes)
    both = attribution.footprints(net.a, net.demand, net.nodes, net.d, supply)
    return attribution.balance(both, attribution.remaining(net.a, net.demand, net.nodes, net.d, supply), net.d, net.output, home)


YEARS = """f AS (SELECT year(o_orderdate) AS yr, s_nationkey * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END + year(o_orderdate) * 75 AS i,
      c_nationkey * 3 + l_partkey % 3 + year(o_orderdate) * 75 AS j, c_nationkey AS k, l_linenumber = 1 AS inn, l_quantity AS v, l_quantity * l_tax AS tax,
      l_quantity * l_discount AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
    z AS (SELECT i, j, sum(v) AS v FROM f WHERE inn GROUP BY ALL), y AS (SELECT i, k, sum(v) AS v FROM f WHERE NOT inn GROUP BY ALL),
    x AS (SELECT i, sum(v) AS x FROM (SELECT i, v FROM z UNION ALL SELECT i, v FROM y) GROUP BY i),
    a AS (SELECT z.i, z.j, z.v / CASE WHEN x > 0 THEN x ELSE 1 END AS a FROM z LEFT JOIN x ON x.i = z.j),
    d AS (SELECT g.i, indicator, load / x AS d FROM (SELECT i, 'tax' AS indicator, sum(tax) AS load FROM f GROUP BY i
          UNION ALL SELECT i, 'discount', sum(discount) FROM f GROUP BY i) g JOIN x USING (i)),
    ao AS (SELECT * FROM a WHERE i % 3 <> 1 AND j % 3 <> 1)"""


@query(
    "attribution_of_years",
    "year:i indicator:s target:5 remaining:5 expected:5 rel_error:7 ok:s",
    f"""WITH {YEARS}, {DIRECT}, {OTHER}, {HANDED},
    parts AS (SELECT i // 75 AS year, indicator, 'target' AS part, d * v AS v FROM dr JOIN d USING (i)
      UNION ALL SELECT i // 75, indicator, 'target', d * v FROM hd JOIN d USING (i)
      UNION ALL SELECT i // 75, indicator, 'remaining', d * v FROM ot JOIN d USING (i)
      UNION ALL SELECT i // 75, indicator, 'expected', d * x FROM d JOIN x USING (i)),
    w AS (SELECT year, indicator, coalesce(sum(v) FILTER (part = 'target'), 0) AS target, coalesce(sum(v) FILTER (part = 'remaining'), 0) AS remaining,
          coalesce(sum(v) FILTER (part = 'expected'), 0) AS expected FROM parts GROUP BY ALL)
    SELECT *, abs(target + remaining - expected) / greatest(expected, 1e-12) AS rel_error,
           abs(target + remaining - expected) / greatest(expected, 1e-12) < 0.01 AS ok FROM w""",
)
def attribution_of_years(t):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    buyers = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"), F.col("c_nationkey").alias("to_region")
    )
    makers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("from_region"))
    keys = ["year", "from_region", "from_sector", "to_region", "to_sector", "inner"]
    lines = t.lineitem.withColumns({"from_sector": flag, "to_sector": F.col("l_partkey") % 3, "inner": F.col("l_linenumber") == 1})
    quantity = F.col("l_quantity")
    totals = cut_lineage(
        lines.join(buyers, "l_orderkey")
        .join(makers, "l_suppkey")
        .groupBy(*keys)
        .agg(F.sum(quantity).alias("value"), F.sum(quantity * F.col("l_tax")).alias("tax"), F.sum(quantity * F.col("l_discount")).alias("discount"))
    )
    loads = totals.unpivot(["year", "from_region", "from_sector"], ["tax", "discount"], "indicator", "value")
    accounts = loads.withColumnsRenamed({"from_region": "region", "from_sector": "sector"})
    accounts = accounts.groupBy("year", "indicator", "region", "sector").agg(F.sum("value").alias("value"))
    flows, demand = totals.where("inner"), totals.where("not inner")
    return attribute_years(flows, demand, accounts, [1], 25, 3)["balance"]


@query(
    "dashboard_flows",
    "crop:s target_sector:s production_country:s consumption_country:s impact_type:s value:5",
    f"""WITH {NET}, {DIRECT}, {OTHER}, {HANDED},
    u AS (SELECT dr.i, k, d * v AS direct, 0.0 AS indirect FROM dr JOIN d USING (i) UNION ALL SELECT hd.i, k, 0.0, d * v FROM hd JOIN d USING (i)),
    s AS (SELECT i, k, sum(direct) AS direct, sum(indirect) AS indirect FROM u GROUP BY ALL HAVING abs(sum(direct)) >= 1e-10 OR abs(sum(indirect)) >= 1e-10),
    g AS (SELECT CASE i % 3 WHEN 0 THEN 'grain' ELSE 'fruit' END AS crop, 'target' AS target_sector, CASE WHEN i // 3 < 23 THEN 'W' || CAST(i // 3 % 5 AS VARCHAR) ELSE 'Unknown' END AS p,
       CASE WHEN k < 23 THEN 'W' || CAST(k % 5 AS VARCHAR) ELSE 'Unknown' END AS c, sum(direct) AS direct, sum(indirect) AS indirect FROM s WHERE i % 3 < 2 GROUP BY ALL)
    SELECT crop, target_sector, p AS production_country, c AS consumption_country, 'direct' AS impact_type, direct AS value FROM g
    UNION ALL SELECT crop, target_sector, p, c, 'indirect', indirect FROM g UNION ALL SELECT crop, target_sector, p, c, 'total', direct + indirect FROM g""",
)
def dashboard_flows(t):
    net = Network(t)
    both = attribution.footprints(net.a, net.demand, net.nodes, net.d)
    crops = literal_rows(t.spark, [(0, "grain"), (1, "fruit")], "sector int, crop string")
    targets = literal_rows(t.spark, [(1, "target")], "sector int, target_sector string")
    groups = t.nation.where(F.col("n_nationkey") < 23).select(
        F.col("n_nationkey").cast("bigint").alias("region"), F.concat(F.lit("W"), (F.col("n_nationkey") % 5).cast("string")).alias("region_group")
    )
    return attribution.dashboard(both, crops, targets, groups)
