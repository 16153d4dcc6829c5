"""Scarcity factors from stations and scarcity-weighted stress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.operators.scale import number_rows
from gridspark.session import cut_lineage

MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def with_row_number(df: DataFrame, out: str = "row_number") -> DataFrame:
    """Number rows in their stored order (0-based). Positions are counted per partition, not collected."""
    marked = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))
    return number_rows(marked.withColumn("_part", F.shiftright("_id", 33)), ["_part"], "_id", out)


def concat_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two tables of equal length side by side by stored row order."""
    return (
        with_row_number(left, "_row").join(with_row_number(right, "_row"), "_row").drop("_row")
    )


def station_factors(stations: DataFrame, id_col: str = "station_id", months: Sequence[str] = MONTH_NAMES) -> DataFrame:
    """Wide station table to ``(station_id, month, factor)``; the missing marker counts as 0."""
    long = stations.unpivot([id_col], list(months), "_m", "factor")
    number = F.element_at(F.create_map(*[x for i, m in enumerate(months) for x in (F.lit(m), F.lit(i + 1))]), F.col("_m"))
    clean = F.when(F.col("factor") <= -99999, 0.0).otherwise(F.col("factor"))
    return long.select(id_col, number.alias("month"), clean.alias("factor"))


def nearest_station(
    points: DataFrame,
    stations: DataFrame,
    point_id: str,
    station_id: str,
    x: str = "x",
    y: str = "y",
    leaf: int = 4,
    max_depth: int = 20,
) -> DataFrame:
    """Euclidean-nearest station per point; equal distances go to the smallest station id.

    Points and stations meet through a pyramid of boxes. Points are read twice: for their distinct positions, and for the answer. Boxes
    are aggregated once, at the deepest level; those above are rolled up from them. Level by level a box of points keeps the station
    boxes that may still hold its nearest station: those whose smallest possible distance does not
    exceed the best guaranteed distance. Only boxes are joined on the way down; points join stations
    once, at the level where no station box holds more than ``leaf`` distinct positions (or at
    ``max_depth``), so neither a crowded box of points nor one of stations is paired off as a whole.
    """
    where = stations.groupBy(F.col(x).alias("sx"), F.col(y).alias("sy")).agg(F.min(station_id).alias(station_id))
    spots = cut_lineage(points.select(F.col(x).alias("px"), F.col(y).alias("py")).distinct())
    bounds = where.select("sx", "sy").unionByName(spots.select(F.col("px").alias("sx"), F.col("py").alias("sy")))
    x0, x1, y0, y1 = bounds.agg(F.min("sx"), F.max("sx"), F.min("sy"), F.max("sy")).first()
    if x0 is None:
        empty = [F.lit(None).cast("bigint").alias(station_id), F.lit(None).cast("double").alias("distance")]
        return points.select(point_id).limit(0).select(point_id, *empty)
    size = max(x1 - x0, y1 - y0, 1e-9) * (1 + 1e-9)

    def box(coord: Column, origin: float, level: int) -> Column:
        return F.floor((coord - origin) / (size / 2**level)).cast("int")

    def up(coord: Column, levels: Column) -> Column:
        return F.floor(coord / F.pow(F.lit(2.0), levels)).cast("int")

    deep = where.groupBy(box(F.col("sx"), x0, max_depth).alias("i"), box(F.col("sy"), y0, max_depth).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    levels = deep.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("level"))
    above = F.lit(max_depth) - F.col("level")
    crowds = levels.groupBy("level", up(F.col("i"), above), up(F.col("j"), above)).agg(F.sum("n").alias("n"))
    fine = crowds.groupBy("level").agg(F.max("n").alias("n")).where(F.col("n") <= leaf)
    depth = fine.agg(F.min("level")).first()[0]
    depth = max_depth if depth is None else depth

    # Box tables carry the true extent of their content, which prunes better than the box itself.
    p_deep = cut_lineage(
        spots.groupBy(box(F.col("px"), x0, depth).alias("pi"), box(F.col("py"), y0, depth).alias("pj")).agg(
            F.min("px").alias("pa"), F.max("px").alias("pb"), F.min("py").alias("pc"), F.max("py").alias("pd")
        )
    )
    s_deep = cut_lineage(
        where.groupBy(box(F.col("sx"), x0, depth).alias("si"), box(F.col("sy"), y0, depth).alias("sj")).agg(
            F.min("sx").alias("sa"), F.max("sx").alias("sb"), F.min("sy").alias("sc"), F.max("sy").alias("sd")
        )
    )

    def rolled(deepest: DataFrame, level: int) -> DataFrame:
        """The boxes of a level, from those of the deepest one."""
        if level == depth:
            return deepest
        i, j, a, b, c, d = deepest.columns
        return deepest.groupBy(F.shiftright(i, depth - level).alias(i), F.shiftright(j, depth - level).alias(j)).agg(
            F.min(a).alias(a), F.max(b).alias(b), F.min(c).alias(c), F.max(d).alias(d)
        )

    # Down to this level a box of points looks at all station boxes, a fixed number.
    start = min(depth, 3)
    pairs = None
    for level in range(start, depth + 1):
        p_box, s_box = rolled(p_deep, level), rolled(s_deep, level)
        if pairs is None:
            numbers = F.sequence(F.lit(0), F.lit(2**level - 1))
            met = p_box.select("*", F.explode(numbers).alias("si")).select("*", F.explode(numbers).alias("sj"))
        else:
            halves = F.array(F.lit(0), F.lit(1))
            met = pairs
            for c in ("pi", "pj", "si", "sj"):
                met = met.withColumn("_h", F.explode(halves)).withColumn(c, F.col(c) * 2 + F.col("_h")).drop("_h")
            met = met.join(p_box, ["pi", "pj"])
        met = met.join(s_box, ["si", "sj"])
        gap_x = F.greatest(F.lit(0.0), F.col("sa") - F.col("pb"), F.col("pa") - F.col("sb"))
        gap_y = F.greatest(F.lit(0.0), F.col("sc") - F.col("pd"), F.col("pc") - F.col("sd"))
        far_x = F.greatest(F.abs(F.col("sb") - F.col("pa")), F.abs(F.col("pb") - F.col("sa")))
        far_y = F.greatest(F.abs(F.col("sd") - F.col("pc")), F.abs(F.col("pd") - F.col("sc")))
        scored = met.withColumns({"near": gap_x * gap_x + gap_y * gap_y, "far": far_x * far_x + far_y * far_y})
        # The candidate boxes of one box of points.
        best = F.min("far").over(Window.partitionBy("pi", "pj"))
        pairs = scored.withColumn("best", best).where(F.col("near") <= F.col("best") * (1 + 1e-12)).select("pi", "pj", "si", "sj")
        if level > start and (level - start) % 4 == 0:
            pairs = cut_lineage(pairs)

    at = {"p": (box(F.col("px"), x0, depth), box(F.col("py"), y0, depth)), "s": (box(F.col("sx"), x0, depth), box(F.col("sy"), y0, depth))}
    located = spots.withColumns({"pi": at["p"][0], "pj": at["p"][1]})
    anchored = where.withColumns({"si": at["s"][0], "sj": at["s"][1]})
    met = located.join(pairs, ["pi", "pj"]).join(anchored, ["si", "sj"])
    d2 = (F.col("px") - F.col("sx")) * (F.col("px") - F.col("sx")) + (F.col("py") - F.col("sy")) * (F.col("py") - F.col("sy"))
    best = met.groupBy("px", "py").agg(F.min(F.struct(d2.alias("d2"), F.col(station_id).alias("s"))).alias("b"))
    answer = best.select("px", "py", F.col("b.s").alias(station_id), F.sqrt("b.d2").alias("distance"))
    located_points = points.select(point_id, F.col(x).alias("px"), F.col(y).alias("py"))
    return located_points.join(answer, ["px", "py"]).select(point_id, station_id, "distance")


def station_grid(cells: DataFrame, stations: DataFrame, factors: DataFrame) -> DataFrame:
    """Monthly factor of the nearest station for each grid cell: ``(month, cell_id, monthly_weight)``."""
    placed = nearest_station(
        cells.select("cell_id", F.col("lon").alias("x"), F.col("lat").alias("y")),
        stations.select("station_id", F.col("lon").alias("x"), F.col("lat").alias("y")),
        "cell_id",
        "station_id",
    )
    return placed.join(factors, "station_id").select("month", "cell_id", F.col("factor").alias("monthly_weight"))


def water_stress(
    footprint: DataFrame,
    weights: DataFrame,
    crops: Sequence[str] | None = None,
    years: tuple[int, int] | None = None,
    value: str = "wfp_blue_ir",
    weight: str = "monthly_weight",
) -> DataFrame:
    """Blue-water footprint times the scarcity weight of its month and cell.

    Crop and year limits are plain filters on the partition columns, so they prune files. There are as many weights as cells and
    months, whatever Catalyst takes their size for (rows made by ``explode`` count as one), so the join shuffles both sides.
    """
    kept = footprint
    if crops is not None:
        kept = kept.where(F.col("crop").isin(*crops))
    if years is not None:
        kept = kept.where(F.col("year").between(*years))
    joined = kept.join(weights.select("month", "cell_id", weight).hint("merge"), ["month", "cell_id"])
    return joined.select("crop", "year", "month", "cell_id", (F.col(value) * F.col(weight)).alias("waterstress"))
