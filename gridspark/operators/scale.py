"""Skew-safe building blocks shared by the operator families.

Any key may hold a large part of all rows, so nothing here gathers a whole group in one task:

* ranks and quantiles are computed on *distinct values with counts*, cut into value ranges whose
  boundaries come from an approximate quantile sketch; each range is ordered on its own and an
  offset per range turns the local positions into exact ones,
* keep-one-row choices are ``min_by``/``max_by`` aggregates (map-side combine), not windows,
* one-row totals enter a plan as scalar subqueries.

Joins carry no broadcast hint: Catalyst broadcasts a side only below
``spark.sql.autoBroadcastJoinThreshold`` and the adaptive planner splits skewed partitions otherwise. Tables that grow with the data but
that Catalyst takes for small (exploded rows, well packed files) carry a merge hint.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.session import cut_lineage

# About so many rows of one value range are ordered by a single task.
RANGE_ROWS = 2_000_000


def one_row(df: DataFrame, *aggs: Column) -> Column:
    """Aggregate ``df`` to one row and use it as a struct-valued scalar subquery."""
    return df.agg(*aggs).select(F.struct("*").alias("t")).scalar()


def literal_rows(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed lookup table as an inline table, so Catalyst knows its size."""

    def text(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(v)

    fields = [part.split() for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    typed = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({names})")


def number_rows(df: DataFrame, runs: Sequence[str], position: str, out: str) -> DataFrame:
    """0-based numbers of rows that lie in contiguous runs; runs follow each other in the order of their keys.

    ``position`` counts up by one inside a run; it and the keys are dropped. Only one row per run is put in order.
    """
    lengths = df.groupBy(*runs).agg(F.min(position).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = (F.sum("_n").over(Window.orderBy(*runs)) - F.col("_n") - F.col("_first")).alias("_shift")
    shifts = lengths.select(*runs, before)
    return df.join(shifts, list(runs)).withColumn(out, F.col("_shift") + F.col(position)).drop(*runs, position, "_shift")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``; ties need a unique column in ``order``."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the last in ``order``."""
    return _keep(df, keys, order, F.max_by)


def _keep(df, keys, order, pick):
    others = [c for c in df.columns if c not in keys]
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    named = [c.alias(f"o{i}") for i, c in enumerate(cols)]
    chosen = pick(F.struct(*others), F.struct(*named)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*").select(*df.columns)


def share_of(df: DataFrame, keys: Sequence[str], value: str, out: str, empty: float | None = 0.0) -> DataFrame:
    """``value`` over its total per key; a zero total gives ``empty``.

    The total is a partial aggregate joined back, so a hot key is never gathered in one task.
    """
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    ratio = F.when(F.col("_total") != 0, F.coalesce(F.col(value), F.lit(0.0)) / F.col("_total"))
    if empty is not None:
        ratio = F.coalesce(ratio, F.lit(empty))
    return null_safe_join(df, totals, keys, "inner").withColumn(out, ratio).drop("_total")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join that matches NULL keys, keeping the left key columns.

    Without keys the right side is a one-row aggregate and enters as a scalar subquery.
    """
    if not keys:
        row = right.select(F.struct("*").alias("t")).scalar()
        return left.withColumn("_row", row).select(*left.columns, *[F.col("_row")[c].alias(c) for c in right.columns])
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


# A per-key table of up to so many rows is sent to every task.
LOOKUP_ROWS = 10_000


def small_side(stored: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is counted to have at most ``LOOKUP_ROWS`` rows."""
    return F.broadcast(stored) if stored.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else stored


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, stored: bool = False) -> DataFrame:
    """``null_safe_join`` with one row per key on the right.

    The right side is materialised (unless it is ``stored`` already) and counted: up to ``LOOKUP_ROWS`` rows it is broadcast, so that
    facts are not shuffled on a few keys; beyond, both sides are shuffled. The result is the same.
    """
    if keys:
        right = small_side(right if stored else cut_lineage(right))
    return null_safe_join(left, right, keys, how)


# A pass over a stored table has a task for so many rows, or one for each core.
TASK_ROWS = 100_000


def few_tasks(stored: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored table read in as many tasks as its rows need, however many partitions the step before it left.

    For tables that are passed over many times: every task of every pass reports to the driver. ``rows`` is the row count, if it is
    known. Partitions are put together, never split.
    """
    if rows is None:
        rows = stored.count()
    return stored.coalesce(max(stored.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def plain(value: Column) -> Column:
    """A double with one zero: -0.0 and 0.0 compare equal but may fail to meet as join keys."""
    value = value.cast("double")
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def range_cuts(df: DataFrame, value: str, range_rows: int = RANGE_ROWS, rows: int | None = None) -> list[float]:
    """Boundaries that cut the values into ranges of about ``range_rows`` rows; none if one range is enough.

    One double per range reaches the driver. ``rows`` is an upper bound of the row count and only saves
    counting; otherwise rows are counted.
    """
    if rows is None or rows > range_rows:
        rows = df.count()
    n = -(-rows // range_rows)
    if n <= 1:
        return []
    return sorted(set(df.approxQuantile(value, [i / n for i in range(1, n)], 1.0 / (4 * n))))


def value_ranges(df: DataFrame, value: str, out: str, cuts: Sequence[float]) -> DataFrame:
    """Number the range each value lies in. The cuts are literals, so every branch of a plan agrees."""
    # NaN and NULL never reach here: callers drop them.
    splits = [float("-inf"), *cuts, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=value, outputCol=out).transform(df)
    return ranged.withColumn(out, F.col(out).cast("int"))


def cumulative_mass(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    mass: Column | None = None,
    descending: bool = False,
    range_rows: int = RANGE_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Distinct values per key with their mass and the mass strictly before them.

    Returns ``keys, value, mass, before, total``. ``mass`` defaults to the row count; ``rows`` is a
    known upper bound of the row count.
    """
    values = value_masses(df, keys, value, mass)
    if rows is None:
        values = cut_lineage(values)
    return order_masses(values, keys, value, descending, range_rows, rows)


def value_masses(df: DataFrame, keys: Sequence[str], value: str, mass: Column | None = None) -> DataFrame:
    """Distinct values per key with their row count or summed mass; ties shrink before any shuffle."""
    mass = F.count(F.lit(1)) if mass is None else F.sum(mass)
    valid = df.where(F.col(value).isNotNull())
    return valid.groupBy(*keys, plain(F.col(value)).alias(value)).agg(mass.alias("mass"))


def order_masses(
    values: DataFrame,
    keys: Sequence[str],
    value: str,
    descending: bool = False,
    range_rows: int = RANGE_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Mass before each distinct value and total per key, range by range."""
    cuts = range_cuts(values, value, range_rows, rows)
    if not cuts:
        # All values together are one range.
        whole = Window.partitionBy(*keys)
        order = whole.orderBy(F.col(value).desc() if descending else F.col(value).asc())
        run = F.sum("mass").over(order.rowsBetween(Window.unboundedPreceding, 0))
        return values.select(*keys, value, "mass", (run - F.col("mass")).alias("before"), F.sum("mass").over(whole).alias("total"))
    ranged = value_ranges(values, value, "_range", cuts)
    joined = null_safe_join(ranged, _range_offsets(ranged, keys, descending), [*keys, "_range"], "inner")
    return joined.select(*keys, value, "mass", _mass_before(keys, value, descending).alias("before"), "total")


def _range_offsets(ranged: DataFrame, keys: Sequence[str], descending: bool) -> DataFrame:
    """Mass before each range, in it, and of all ranges, per key. One row per range and key is put in order."""
    per_range = ranged.groupBy(*keys, "_range").agg(F.sum("mass").alias("_in_range"))
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(F.col("_range").desc() if descending else F.col("_range").asc())
    run = F.sum("_in_range").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return per_range.select(
        *keys, "_range", "_in_range", (run - F.col("_in_range")).alias("_offset"), F.sum("_in_range").over(whole).alias("total")
    )


def _mass_before(keys: Sequence[str], value: str, descending: bool = False) -> Column:
    """Mass before a value: that before its range, and that before it inside of the range."""
    inside = Window.partitionBy(*keys, "_range").orderBy(F.col(value).desc() if descending else F.col(value).asc())
    return F.col("_offset") + F.sum("mass").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("mass")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    range_rows: int = RANGE_ROWS,
    rows: int | None = None,
    count: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per key, exact at any group size.

    The input is read once, as distinct values with counts (``count`` names a column of them, if the rows are counted already). A sketch cuts the values into ranges (one, if they are few), masses per
    range tell which ranges hold the positions asked for, and only those are put in order. ``rows`` is a known upper bound of the
    row count and saves counting.
    """
    counted = [] if count is None else [F.col(count)]
    clean = df.select(*keys, plain(F.col(value)).alias(value), *counted).where(F.col(value).isNotNull())
    values = value_masses(clean, keys, value, *counted)
    if rows is None or rows > range_rows:
        values = cut_lineage(values)
    cuts = range_cuts(values, value, range_rows, rows)
    positions = [index for p in quantiles.values() for index in _positions(F.col("total"), p)]
    if cuts:
        ranged = value_ranges(values, value, "_range", cuts)
        holds = [(F.col("_offset") <= i) & (i < F.col("_offset") + F.col("_in_range")) for i in positions]
        needed = _range_offsets(ranged, keys, False).where(reduce(lambda a, b: a | b, holds))
        ranked = null_safe_join(ranged, needed, [*keys, "_range"], "inner")
        ranked = ranked.select(*keys, value, "mass", _mass_before(keys, value).alias("before"), "total")
    else:
        ranked = order_masses(values, keys, value, rows=0)
    aggs, out = [], []
    for name, p in quantiles.items():
        for tag, index in zip(("lo", "hi"), _positions(F.col("total"), p), strict=True):
            holds = (F.col("before") <= index) & (index < F.col("before") + F.col("mass"))
            aggs.append(F.max(F.when(holds, F.col(value))).alias(f"_{tag}_{name}"))
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return ranked.groupBy(*keys).agg(F.max("total").alias("_total"), *aggs).select(*keys, *out)


def _positions(total: Column, p: float) -> tuple[Column, Column]:
    """The two 0-based positions between which a quantile lies."""
    position = (total - 1) * F.lit(float(p))
    return F.floor(position), F.ceil(position)


def weighted_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    q: float,
    out: str,
    range_rows: int = RANGE_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Smallest value whose cumulative weight reaches ``q`` of the total, per key."""
    ranked = cumulative_mass(df, keys, value, F.col(weight), range_rows=range_rows, rows=rows)
    reached = F.col("before") + F.col("mass") >= F.lit(q) * F.col("total") * F.lit(1 - 1e-12)
    return ranked.groupBy(*keys).agg(F.min(F.when(reached, F.col(value))).alias(out))


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Lookup ``keys, value -> out`` with the mean rank of tied values (1-based)."""
    ranked = cumulative_mass(df, keys, value, range_rows=range_rows)
    return ranked.select(*keys, value, (F.col("before") + (F.col("mass") + 1) / 2.0).alias(out))


def spearman(
    df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "spearman_r", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Rank correlation with average ranks, from distinct (x, y) pairs and their counts."""
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, plain(F.col(x)).alias(x), plain(F.col(y)).alias(y))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # Read five times below.
    pairs = cut_lineage(pairs)
    size = pairs.count()
    ranks = []
    for col, name in ((x, "_rx"), (y, "_ry")):
        ranked = cumulative_mass(pairs, keys, col, F.col("_n"), range_rows=range_rows, rows=size)
        ranks.append(ranked.select(*keys, col, (F.col("before") + (F.col("mass") + 1) / 2.0).alias(name)))
    joined = null_safe_join(null_safe_join(pairs, ranks[0], [*keys, x], "inner"), ranks[1], [*keys, y], "inner")
    # Ranks are centred on (n + 1) / 2, which every key knows from its total.
    total = pairs.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    centred = null_safe_join(joined, total, keys, "inner").select(
        *keys,
        "_n",
        (F.col("_rx") - (F.col("_total") + 1) / 2.0).alias("_dx"),
        (F.col("_ry") - (F.col("_total") + 1) / 2.0).alias("_dy"),
    )
    sums = centred.groupBy(*keys).agg(
        F.sum(F.col("_n") * F.col("_dx") * F.col("_dy")).alias("_sxy"),
        F.sum(F.col("_n") * F.col("_dx") * F.col("_dx")).alias("_sxx"),
        F.sum(F.col("_n") * F.col("_dy") * F.col("_dy")).alias("_syy"),
    )
    spread = F.sqrt(F.col("_sxx") * F.col("_syy"))
    return sums.select(*keys, F.when(spread > 0, F.col("_sxy") / spread).alias(out))


# Slices of a bracket that are counted at a time.
SLICES = 1024


def lexicographic_cuts(
    df: DataFrame, keys: Sequence[str], value: str, tiebreak: str, limits: DataFrame, range_rows: int = RANGE_ROWS, rows: int | None = None
) -> DataFrame:
    """The last of the ``_limit`` rows per key with the largest ``value``, ties by the smallest ``tiebreak``: ``keys, _cut, _cut_id``.

    ``limits`` is a stored table with one row per key: ``keys, _limit, _lo, _hi``, where ``_limit`` is at least 1 and at most the number of
    rows of the key, and all values lie within ``_lo`` and ``_hi``; other keys of ``df`` are left out. ``value`` is a finite number,
    ``tiebreak`` a whole number, unique within the key. ``rows`` is a known upper bound of the rows of these keys.

    The cut is found by brackets. While the rows in all brackets are more than one task should order, each bracket is cut into slices
    that are only counted (one row per key and slice is exchanged), and the slice that holds the cut is the next bracket; a bracket of
    one value goes on with the tiebreak. Only the rows of the last brackets are put in order.
    """
    values = df.select(*keys, plain(F.col(value)).alias("_v"), F.col(tiebreak).cast("bigint").alias("_t"))
    lo, hi, tlo, thi = (F.col(c) for c in ("_lo", "_hi", "_tlo", "_thi"))
    unset = F.lit(None).cast("bigint")
    brackets = limits.select(
        *keys, F.col("_limit").cast("bigint").alias("_need"), plain(lo).alias("_lo"), plain(hi).alias("_hi"), unset.alias("_tlo"), unset.alias("_thi")
    )

    def bracketed() -> DataFrame:
        met = lookup_join(values, brackets, keys, "inner", stored=True)
        return met.where(F.col("_v").between(lo, hi) & (tlo.isNull() | F.col("_t").between(tlo, thi)))

    left = rows
    while left is None or left > range_rows:
        # First come large values and, within one value, small tiebreaks: both get the high slices.
        width, id_width = hi - lo, thi.cast("double") - tlo.cast("double")
        place = F.when(width > 0, (F.col("_v") - lo) / width).when(id_width > 0, (thi.cast("double") - F.col("_t").cast("double")) / id_width)
        slice_no = F.least(F.floor(F.coalesce(place, F.lit(0.0)) * SLICES), F.lit(SLICES - 1))
        slices = bracketed().groupBy(*keys, slice_no.alias("_slice")).agg(
            F.count(F.lit(1)).alias("_n"), F.first("_need").alias("_need"),
            F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min("_t").alias("_tlo"), F.max("_t").alias("_thi"),
        )
        # At most SLICES rows per key.
        order = Window.partitionBy(*keys).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, 0)
        run = slices.withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
        held = run.where((F.col("_before") < F.col("_need")) & (F.col("_need") <= F.col("_before") + F.col("_n")))
        need, one = F.col("_need") - F.col("_before"), lo == hi
        brackets = cut_lineage(
            held.select(*keys, need.alias("_need"), "_lo", "_hi", F.when(one, tlo).alias("_tlo"), F.when(one, thi).alias("_thi"), "_n")
        )
        before, left = left, brackets.agg(F.sum("_n")).first()[0] or 0
        brackets = brackets.drop("_n")
        if left == before:
            # The first round knows no tiebreaks yet, so a bracket of one value may stay as it is once.
            if not brackets.where((lo < hi) | (id_width > 0)).limit(1).count():
                break
    order = Window.partitionBy(*keys).orderBy(F.col("_v").desc(), F.col("_t").asc())
    numbered = bracketed().withColumn("_number", F.row_number().over(order))
    return numbered.where(F.col("_number") == F.col("_need")).select(*keys, F.col("_v").alias("_cut"), F.col("_t").alias("_cut_id"))
