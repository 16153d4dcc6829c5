"""Supply-chain attribution on an edge table.

A node is one number per (region, sector). Tables: ``edges(i, j, value)`` is what ``i`` delivers to
``j``; ``demand(i, k, value)`` what ``i`` delivers to final consumers ``k``. Total requirements are
power series: one join and one aggregation per round, for all right-hand sides at once.

The operators read coefficients, demand, nodes and intensities many times. Pass materialised tables
(``prepare`` or written Parquet), not the joins they come from.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.operators.scale import null_safe_join, one_row
from gridspark.session import cut_lineage


def gross_output(edges: DataFrame, demand: DataFrame) -> DataFrame:
    """``x_i``: deliveries to industries plus final demand."""
    both = edges.select("i", "value").unionByName(demand.select("i", "value"))
    return both.groupBy("i").agg(F.sum("value").alias("x"))


def technical_coefficients(edges: DataFrame, output: DataFrame) -> DataFrame:
    """``a_ij``: input per unit of output of ``j``; an output of 0 or less counts as 1, negatives are cut."""
    x = output.select(F.col("i").alias("j"), "x")
    ratio = F.col("value") / F.when(F.col("x") > 0, F.col("x")).otherwise(1.0)
    joined = edges.join(x, "j", "left")
    return joined.select("i", "j", F.greatest(ratio, F.lit(0.0)).alias("a")).where(F.col("a") > 0)


def intensities(account: DataFrame, output: DataFrame) -> DataFrame:
    """``d_i``: account value per unit of output, cut at 0."""
    ratio = F.col("value") / F.when(F.col("x") > 0, F.col("x")).otherwise(1.0)
    return account.join(output, "i", "left").select("i", F.greatest(ratio, F.lit(0.0)).alias("d"))


def target_sectors(groups: dict[str, Sequence[int]], names: Sequence[str] | None = None) -> list[int]:
    """Sorted union of the named sector groups."""
    names = list(groups) if names is None else names
    unknown = [n for n in names if n not in groups]
    if unknown:
        raise KeyError(f"unknown target sector group: {unknown}")
    return sorted({s for n in names for s in groups[n]})


def demand_groups(demand: DataFrame, regions: dict[str, Sequence[int] | str] | str = "individual") -> DataFrame:
    """Sum final demand of consuming regions into groups: ``individual``, ``all`` or name to members.

    A region may be in several custom groups.
    """
    if regions == "individual":
        return demand
    if regions == "all":
        return demand.groupBy("i").agg(F.sum("value").alias("value")).withColumn("k", F.lit("all"))
    hits = [
        F.lit(name) if members == "all" else F.when(F.col("k").isin(*members), F.lit(name))
        for name, members in regions.items()
    ]
    grouped = demand.select("i", F.explode(F.array_compact(F.array(*hits))).alias("k"), "value")
    return grouped.groupBy("i", "k").agg(F.sum("value").alias("value"))


def prepare(edges: DataFrame, demand: DataFrame, account: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Materialised coefficients, demand, intensities and gross output of a network."""
    edges, demand = cut_lineage(edges), cut_lineage(demand)
    output = cut_lineage(gross_output(edges, demand))
    return cut_lineage(technical_coefficients(edges, output)), demand, cut_lineage(intensities(account, output)), output


class NotConverged(RuntimeError):
    """A series of which a block and right-hand side is not bracketed closely enough after the allowed rounds."""


# So many right-hand sides share a row of a series.
LANES = 8
# Growth below this share of a value is rounding; its ratio says nothing.
ROUNDING = 1e-14
# Rounds after which a series without named blocks looks for the blocks of its network.
BLOCKS_AFTER = 24


def series(
    coefficients: DataFrame,
    start: DataFrame,
    rhs: Sequence[str],
    tolerance: float = 1e-12,
    max_rounds: int = 400,
    checkpoint_every: int = 4,
    block: Column | None = None,
    lanes: int = LANES,
) -> DataFrame:
    """``(I + A + A^2 + ...) b`` for every right-hand side: ``i, *rhs, v``, where v is not 0.

    ``start`` has ``i, *rhs, v``. Right-hand sides are numbered, and ``lanes`` of them are the columns of one row, so a round is one join of
    the coefficients (laid out by their column once) with the rows of their node, one row per coefficient and ``lanes`` right-hand
    sides, and one aggregation, ``s = b + A s``. Negative starts run in lanes of their own and are subtracted at the end.

    Every ``checkpoint_every`` rounds the rows are materialised, and each block of the network and right-hand side is judged on its own. Growth over
    as many rounds follows ``g' = A^m g``. With lo and hi the smallest and the largest ratio ``g' / g`` of its nodes, what is still to come lies, at
    every node, between ``g' lo / (1 - lo)`` and ``g' hi / (1 - hi)``. The middle is added once half of that span is below ``tolerance`` of the
    value at every node; slow series close this bracket long before they have come near their sum. Finished blocks and lanes leave the
    rounds. ``block`` is an expression of ``i`` for networks of several parts that do not touch (years); without one the parts are looked up where the
    series is slow. What has not come so far after ``max_rounds`` is an error that names it, never a shortened result.
    """
    rhs = list(rhs)
    b = start.withColumn("_minus", F.col("v") < 0).groupBy("i", *rhs, "_minus").agg(F.sum(F.abs("v")).alias("v")).where("v > 0")
    b = cut_lineage(b)
    keys = [*rhs, "_minus"]
    numbers, n, signed = _numbered(b, keys)
    width = max(1, min(lanes, n))
    numbers = numbers.select(*keys, (F.col("_n") % width).alias("_lane"), F.floor(F.col("_n") / width).alias("_c"))
    named = null_safe_join(b, numbers, keys, "inner")
    picked = [F.expr(f"sum(CASE WHEN _lane = {k} THEN v ELSE 0D END) AS v{k}") for k in range(width)]
    lanes_of_b = cut_lineage(named.groupBy("i", "_c").agg(*picked))
    done = _rounds(coefficients, lanes_of_b, numbers, width, tolerance, max_rounds, checkpoint_every, block)
    long = done.select("i", "_c", F.posexplode(F.array(*[f"v{k}" for k in range(width)])).alias("_lane", "v")).where("v > 0")
    out = long.join(numbers, ["_c", "_lane"])
    if not signed:
        return out.select("i", *rhs, "v")
    return out.groupBy("i", *rhs).agg(F.sum(F.when(F.col("_minus"), -F.col("v")).otherwise(F.col("v"))).alias("v"))


def _numbered(b: DataFrame, keys: list[str]) -> tuple[DataFrame, int, bool]:
    """Right-hand sides with numbers from 0, how many there are, and whether one is negative."""
    distinct = b.select(*keys).distinct()
    numbers = cut_lineage(distinct.withColumn("_n", F.row_number().over(Window.orderBy(*keys)) - 1))
    n, signed = numbers.agg(F.count(F.lit(1)), F.max("_minus")).first()
    return numbers, n, bool(signed)


def _rounds(coefficients, b, numbers, width, tolerance, max_rounds, every, block) -> DataFrame:
    """All lanes of ``b``, summed up until their brackets are closed.

    Rows hold sums v, the growth g of the last rounds and the growth h of the rounds before. Growth is carried by itself, not as a difference.
    """
    def each(pattern: str) -> list[str]:
        return [pattern.format(k=k) for k in range(width)]

    parts = int(coefficients.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = coefficients.selectExpr("i AS _to", "j AS i", "a").repartition(parts, "i").persist(StorageLevel.MEMORY_AND_DISK)
    moved = ["_to AS i", "_c", *each("a * g{k} AS g{k}")]
    added = [F.expr(x) for x in each("sum(g{k}) AS g{k}")]
    kept = [F.expr(x) for x in each("coalesce(sum(g{k}), 0D) AS g{k}") + each("coalesce(sum(v{k}), 0D) + coalesce(sum(g{k}), 0D) AS v{k}") + each("coalesce(sum(h{k}), 0D) AS h{k}")]
    labels, finished = None, []
    rows = b.selectExpr("i", "_c", *each("v{k} AS g{k}"))
    memory = b.selectExpr("i", "_c", *each("v{k}"), *each("0D AS h{k}"))
    try:
        for first in range(0, max_rounds, every):
            began = rows
            for n in range(every):
                rows = rows.join(a, "i").selectExpr(*moved)
                if n < every - 1:
                    # The first growth is A b + ... + A^m b, each later one A^m times the one before.
                    rows = (rows if first else rows.unionByName(began)).groupBy("i", "_c").agg(*added)
            state = cut_lineage(rows.unionByName(memory, allowMissingColumns=True).groupBy("i", "_c").agg(*kept))
            if block is None and labels is None and first + every >= BLOCKS_AFTER:
                labels = network_blocks(coefficients)
            placed = _placed(state, block, labels)
            judged = cut_lineage(_judged(placed, width, tolerance))
            n_open, n_done = (x or 0 for x in judged.agg(F.sum((~F.col("_done")).cast("int")), F.sum(F.col("_done").cast("int"))).first())
            if n_done:
                ready = placed.join(judged.where("_done"), ["_block", "_c"])
                finished.append(ready.selectExpr("i", "_c", *each("v{k} + g{k} * m{k} AS v{k}")))
            if not n_open:
                return reduce(DataFrame.unionByName, finished) if finished else b
            if n_done:
                still = judged.where("not _done").select("_block", "_c")
                state = placed.join(still, ["_block", "_c"], "left_semi").drop("_block")
            rows = state.select("i", "_c", *each("g{k}"))
            memory = state.selectExpr("i", "_c", *each("v{k}"), *each("g{k} AS h{k}"))
    finally:
        a.unpersist()
    worst = judged.where("not _done").orderBy("_block", "_c").first()
    lane = next(k for k in range(width) if not worst[f"d{k}"])
    name = numbers.where((F.col("_c") == worst["_c"]) & (F.col("_lane") == lane)).drop("_c", "_lane", "_minus").first()
    raise NotConverged(
        f"after {max_rounds} rounds {n_open} blocks of right-hand sides are open, among them block {worst['_block']}, "
        f"right-hand side {name.asDict() if name else {}}: {worst[f't{lane}']:.3g} of a value added in the last {every} rounds"
    )


def _placed(rows: DataFrame, block: Column | None, labels: DataFrame | None) -> DataFrame:
    """Rows with the block of their node; nodes without coefficients are blocks of their own."""
    if block is not None:
        return rows.withColumn("_block", block.cast("long"))
    if labels is None:
        return rows.withColumn("_block", F.lit(0).cast("long"))
    return rows.join(labels, "i", "left").withColumn("_block", F.coalesce("_block", F.col("i").cast("long")))


def _judged(placed: DataFrame, width: int, tolerance: float) -> DataFrame:
    """Per block and row of lanes: whether all lanes are done (d: each lane), what to add per growth (m), the last growth (t).

    The last digits of a ratio near 1 are rounding, so no span is asked to be below ``ROUNDING / (1 - hi)``.
    """
    picks, marks = [], []
    for k in range(width):
        live, ratio = f"g{k} > {ROUNDING} * v{k}", f"CASE WHEN h{k} > 0 THEN g{k} / h{k} ELSE double('inf') END"
        picks += [f"max(CASE WHEN {live} THEN {ratio} END) AS hi{k}", f"min(CASE WHEN {live} THEN {ratio} END) AS lo{k}", f"max(CASE WHEN {live} THEN g{k} / v{k} END) AS t{k}"]
        upper, lower = f"hi{k} / (1 - hi{k})", f"lo{k} / (1 - lo{k})"
        closed = f"hi{k} < 1 AND t{k} * ({upper} - {lower}) / 2 <= greatest({tolerance!r}D, {ROUNDING} / (1 - hi{k}))"
        marks += [f"hi{k} IS NULL OR ({closed}) AS d{k}", f"CASE WHEN hi{k} < 1 THEN ({upper} + {lower}) / 2 ELSE 0D END AS m{k}", f"t{k}"]
    out = placed.groupBy("_block", "_c").agg(*map(F.expr, picks)).selectExpr("_block", "_c", *marks)
    return out.selectExpr("*", " AND ".join(f"d{k}" for k in range(width)) + " AS _done")


def network_blocks(coefficients: DataFrame) -> DataFrame:
    """``i, _block``: the smallest node of the part of the network that a node lies in.

    Nodes take the smallest label of their neighbours and then the label of their label, so the number of rounds grows with the logarithm of
    the longest way; the labels are materialised each round.
    """
    ways = coefficients.select("i", "j").union(coefficients.select("j", "i"))
    ways = cut_lineage(ways.where("i <> j").distinct())
    labels = cut_lineage(coefficients.select("i").union(coefficients.select("j")).distinct().withColumn("_block", F.col("i").cast("long")))
    while True:
        near = ways.join(labels.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.min("_block").alias("_near"))
        stepped = labels.join(near, "i", "left").select("i", "_block", F.least("_block", F.coalesce("_near", "_block")).alias("_new"))
        over = stepped.select(F.col("i").alias("_new"), F.col("_new").alias("_over"))
        moved = cut_lineage(stepped.join(over, "_new").select("i", F.col("_over").alias("_new"), (F.col("_over") < F.col("_block")).alias("_moved")))
        labels = moved.select("i", F.col("_new").alias("_block"))
        if not moved.where("_moved").limit(1).count():
            return labels


def outside(coefficients: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coefficients between nodes that are no targets. ``nodes``: i, region, sector, is_target."""
    others = nodes.where(~F.col("is_target")).select("i")
    return coefficients.join(others, "i", "left_semi").join(
        others.withColumnRenamed("i", "j"), "j", "left_semi"
    )


def direct_slot(coefficients, demand, nodes, intensity, **kw) -> DataFrame:
    """Footprint of final demand for target products: ``preg, psec, tsec, fssec, k, value``."""
    targets = nodes.where("is_target").select("i", F.col("sector").alias("tsec"))
    start = demand.join(targets, "i").select("i", "tsec", "k", F.col("value").alias("v"))
    applied = series(coefficients, start, ["tsec", "k"], **kw)
    return _footprint(applied, nodes, intensity, ["tsec", "k"]).withColumn("fssec", F.col("tsec"))


def others_supply(coefficients, demand, nodes, **kw) -> DataFrame:
    """What other nodes supply for their final demand without passing a target: ``i, fssec, k, v``."""
    others = nodes.where(~F.col("is_target")).select("i", F.col("sector").alias("fssec"))
    start = demand.join(others, "i").select("i", "fssec", "k", F.col("value").alias("v"))
    return series(cut_lineage(outside(coefficients, nodes)), start, ["fssec", "k"], **kw)


def handed_demand(coefficients, demand, nodes, supply: DataFrame | None = None, **kw) -> DataFrame:
    """Input that target nodes hand to what other nodes supply (``others_supply``): ``i, tsec, fssec, k, v``."""
    supply = others_supply(coefficients, demand, nodes, **kw) if supply is None else supply
    targets = nodes.where("is_target").select(F.col("i").alias("t"), F.col("sector").alias("tsec"))
    into = coefficients.select(F.col("i").alias("t"), F.col("j").alias("i"), "a").join(targets, "t")
    return (
        supply.join(into, "i")
        .groupBy(F.col("t").alias("i"), "tsec", "fssec", "k")
        .agg(F.sum(F.col("a") * F.col("v")).alias("v"))
    )


def indirect_slot(coefficients, demand, nodes, intensity, supply: DataFrame | None = None, **kw) -> DataFrame:
    """Footprint of target products that reach final demand inside other products.

    Demand for other products runs through the network of other nodes, is handed to target nodes as input, and from
    there through the whole network. The supplying sector stays in the key.
    """
    handed = handed_demand(coefficients, demand, nodes, supply, **kw)
    applied = series(coefficients, handed, ["tsec", "fssec", "k"], **kw)
    return _footprint(applied, nodes, intensity, ["tsec", "fssec", "k"])


def remaining(coefficients, demand, nodes, intensity, supply: DataFrame | None = None, **kw) -> DataFrame:
    """Footprint of other producers that never passes a target: ``preg, psec, fssec, k, value``."""
    supply = others_supply(coefficients, demand, nodes, **kw) if supply is None else supply
    return _footprint(supply, nodes, intensity, ["fssec", "k"])


def _extras(nodes, intensity):
    """Columns such as year or indicator that nodes and intensities carry along."""
    known = {"i", "region", "sector", "is_target", "d"}
    return [c for df in (nodes, intensity) for c in df.columns if c not in known]


def _footprint(applied, nodes, intensity, keys):
    extras = _extras(nodes, intensity)
    place = nodes.withColumnsRenamed({"region": "preg", "sector": "psec"}).drop("is_target")
    joined = applied.join(intensity, "i").join(place, "i")
    value = F.greatest(F.col("d") * F.col("v"), F.lit(0.0))
    return joined.select(*extras, "preg", "psec", *keys, value.alias("value")).where(F.col("value") > 0)


def household(direct: DataFrame, groups: dict[str, Sequence[int] | str] | str = "individual") -> DataFrame:
    """Household account of each region placed in its demand groups. ``direct``: region, value."""
    placed = demand_groups(direct.select(F.col("region").alias("i"), F.col("region").alias("k"), "value"), groups)
    return placed.select(F.col("i").alias("preg"), "k", "value")


def footprints(coefficients, demand, nodes, intensity, supply: DataFrame | None = None, **kw) -> DataFrame:
    """Direct (slot 0) and indirect (slot 1) footprints in one table, from one series.

    The slots are told apart by their supplying sector, which is the target itself or none. ``supply`` saves a series that
    ``remaining`` needs as well.
    """
    targets = nodes.where("is_target").select("i", F.col("sector").alias("tsec"))
    own = demand.join(targets, "i").select("i", "tsec", F.col("tsec").alias("fssec"), "k", F.col("value").alias("v"))
    start = own.unionByName(handed_demand(coefficients, demand, nodes, supply, **kw))
    applied = series(coefficients, start, ["tsec", "fssec", "k"], **kw)
    both = _footprint(applied, nodes, intensity, ["tsec", "fssec", "k"])
    columns = [*_extras(nodes, intensity), "preg", "psec", "tsec", "fssec", "k", "slot", "value"]
    return both.withColumn("slot", F.when(F.col("tsec") == F.col("fssec"), 0).otherwise(1)).select(columns)


def footprints_by_producer(coefficients, demand, nodes, producers, by: Sequence[str], **kw) -> tuple[DataFrame, DataFrame]:
    """Target footprints ``*by, tsec, fssec, k, slot, value`` and remaining ones ``*by, fssec, k, value`` of groups of producers.

    ``producers``: i, *by, d. The series run from the producers' side, on the transposed network: what a unit delivered by a node carries of each
    group. Demand is met in the last aggregation only, so the right-hand sides are the groups (times the target sectors for the
    indirect slot), however many consumers and supplying sectors there are. Demand is not negative.
    """
    by = list(by)
    place = nodes.select("i", "sector", "is_target")
    turned = coefficients.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")
    carried = cut_lineage(series(turned, producers.select("i", *by, F.col("d").alias("v")), by, **kw))
    at_targets = carried.join(place.where("is_target"), "i").select("i", *by, F.col("sector").alias("tsec"), "v")
    worth = F.sum(F.col("v") * F.col("value")).alias("value")
    direct = at_targets.join(demand, "i").groupBy(*by, "tsec", F.col("tsec").alias("fssec"), "k").agg(worth).withColumn("slot", F.lit(0))
    others = place.where(~F.col("is_target"))
    into = coefficients.join(others.select(F.col("i").alias("j")), "j", "left_semi")
    handed = at_targets.join(into, "i").groupBy(F.col("j").alias("i"), *by, "tsec").agg(F.sum(F.col("v") * F.col("a")).alias("v"))
    # Producers that are no targets, for the part that never passes a target, run in the same rounds.
    own = producers.join(others.select("i"), "i", "left_semi").select("i", *by, F.lit(None).cast(nodes.schema["sector"].dataType).alias("tsec"), F.col("d").alias("v"))
    inner = cut_lineage(outside(coefficients, nodes)).select(F.col("j").alias("i"), F.col("i").alias("j"), "a")
    through = cut_lineage(series(inner, handed.unionByName(own), [*by, "tsec"], **kw))
    met = through.join(others, "i").join(demand, "i").groupBy(*by, "tsec", F.col("sector").alias("fssec"), "k").agg(worth)
    target = direct.unionByName(met.where("tsec is not null").withColumn("slot", F.lit(1)))
    return target.where("value > 0"), met.where("tsec is null and value > 0").drop("tsec")


def balance(
    target: DataFrame, rest: DataFrame, intensity: DataFrame, output: DataFrame, home: DataFrame | None = None
) -> DataFrame:
    """Attributed total against the account total, with the relative error; below 1 % is ok."""
    t = one_row(target, F.coalesce(F.sum("value"), F.lit(0.0)).alias("v"))["v"]
    r = one_row(rest, F.coalesce(F.sum("value"), F.lit(0.0)).alias("v"))["v"]
    h = F.lit(0.0) if home is None else one_row(home, F.coalesce(F.sum("value"), F.lit(0.0)).alias("v"))["v"]
    expected = intensity.join(output, "i").agg(F.coalesce(F.sum(F.col("d") * F.col("x")), F.lit(0.0)).alias("expected"))
    out = expected.withColumns({"target": t, "remaining": r, "household": h})
    out = out.withColumn("expected", F.col("expected") + F.col("household"))
    total = F.col("target") + F.col("remaining") + F.col("household")
    error = F.abs(total - F.col("expected")) / F.greatest(F.col("expected"), F.lit(1e-12))
    return out.withColumns({"total": total, "rel_error": error, "ok": error < 0.01})


def balance_by(
    keys: Sequence[str], target: DataFrame, rest: DataFrame, expected: DataFrame, home: DataFrame | None = None
) -> DataFrame:
    """The balance per year or indicator. ``expected`` has ``keys, value``: the account total per key."""
    keys = list(keys)
    parts = {"target": target, "remaining": rest, "household": home, "expected": expected}
    stacked = None
    for name, df in parts.items():
        if df is not None:
            sums = df.groupBy(*keys).agg(F.sum("value").alias("value")).withColumn("part", F.lit(name))
            stacked = sums if stacked is None else stacked.unionByName(sums)
    picks = [F.coalesce(F.sum(F.when(F.col("part") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in parts]
    wide = stacked.groupBy(*keys).agg(*picks)
    wide = wide.withColumn("expected", F.col("expected") + F.col("household"))
    total = F.col("target") + F.col("remaining") + F.col("household")
    error = F.abs(total - F.col("expected")) / F.greatest(F.col("expected"), F.lit(1e-12))
    return wide.withColumns({"total": total, "rel_error": error, "ok": error < 0.01})


def dashboard(
    footprint: DataFrame, crops: DataFrame, targets: DataFrame, regions: DataFrame, years: Sequence[str] = ("year",)
) -> DataFrame:
    """Flows between crop, target and region groups as direct, indirect and total.

    ``crops``: sector, crop. ``targets``: sector, target_sector. ``regions``: region, region_group.
    A region without group is ``Unknown``. Cells whose two slots are both below 1e-10 are skipped.
    """
    years = [y for y in years if y in footprint.columns]
    slots = footprint.groupBy(*years, "preg", "psec", "tsec", "k").agg(
        F.sum(F.when(F.col("slot") == 0, F.col("value")).otherwise(0.0)).alias("direct"),
        F.sum(F.when(F.col("slot") == 1, F.col("value")).otherwise(0.0)).alias("indirect"),
    )
    kept = slots.where((F.abs("direct") >= 1e-10) | (F.abs("indirect") >= 1e-10))
    makers = regions.select(F.col("region").alias("preg"), F.col("region_group").alias("_p"))
    users = regions.select(F.col("region").alias("k"), F.col("region_group").alias("_c"))
    named = (
        kept.join(crops.withColumnRenamed("sector", "psec"), "psec")
        .join(targets.withColumnRenamed("sector", "tsec"), "tsec")
        .join(makers, "preg", "left")
        .join(users, "k", "left")
    )
    grouped = named.groupBy(
        *years,
        "crop",
        "target_sector",
        F.coalesce("_p", F.lit("Unknown")).alias("production_country"),
        F.coalesce("_c", F.lit("Unknown")).alias("consumption_country"),
    ).agg(F.sum("direct").alias("direct"), F.sum("indirect").alias("indirect"))
    wide = grouped.withColumn("total", F.col("direct") + F.col("indirect"))
    ids = [*years, "crop", "target_sector", "production_country", "consumption_country"]
    return wide.unpivot(ids, ["direct", "indirect", "total"], "impact_type", "value")
