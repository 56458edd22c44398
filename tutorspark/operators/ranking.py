"""Order statistics without a global sort in one task.

Exact percentiles, the Gini coefficient, samples of any size and rolling sums over a sorted list all
need the position of a row in a sorted group.  A plain ``Window.partitionBy(group).orderBy(value)``
puts a whole group into one task, and ``percentile`` holds every distinct value of a group in one
buffer.

A percentile needs one rank: a mergeable summary brackets it, and only the values in the bracket are ranked.
Where every rank counts, a value's place follows from the value alone: its sign, binary exponent and
leading mantissa bits make a coarse cell, the next bits a fine cell.  Totals are summed by cell, running
sums over coarse cells, then over the fine cells of each, then over the values of each fine cell give
the running sum before every value.  A group has at most some hundred coarse cells per power of two, a
coarse cell at most 2^16 fine ones, and a fine cell holds what differs in the last bits only, so no
window sees more than that, whatever the distribution.

Plans are the same for any size; they start no job and draw no sample.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorspark.functions.text import quoted

_COARSE, _FINE = "_coarse", "_fine"
_CELLS = (_COARSE, _FINE)
COARSE_STEPS = 256
FINE_STEPS = 1 << 16
#: Cells that a coarse one is cut into where one level has to do.
CELL_STEPS = 1 << 8
#: The summary of a quantile is off by one in so many rows at most.
SUMMARY_STEPS = 10_000
# Above any shift that brings the exponents of doubles, -1074 to 1023, into the positive.
EXPONENT_SHIFT = 2048
ROWS_PER_BLOCK = 100_000


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), **extra: Column) -> DataFrame:
    """One row per (group, distinct non-null value) with its number of rows ``n``.

    ``extra`` adds further aggregates.  Map-side partial aggregation collapses hot values before
    the shuffle.
    """
    aggregates = [F.count(F.lit(1)).alias("n"), *(c.alias(name) for name, c in extra.items())]
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggregates)


def cells_sql(value: str) -> dict[str, str]:
    """Coarse and fine cell of a number as SQL: neither falls as the value grows.

    A wrong rounding of the logarithm right below a power of two would only move those values to
    the first cell of that power, still in order.
    """
    size = f"abs(double({value}))"
    finite = f"least({size}, 1.7976931348623157E308D)"
    exponent = f"floor(log2({finite}))"
    steps = f"({finite} / pow(2.0D, {exponent}) * {COARSE_STEPS})"
    coarse = f"({exponent} + {EXPONENT_SHIFT}) * {2 * COARSE_STEPS} + floor({steps})"
    fine = f"floor(({steps} - floor({steps})) * {FINE_STEPS})"
    return {
        name: f"CASE WHEN {size} > 0 THEN bigint(signum(double({value})) * ({cell})) ELSE 0L END"
        for name, cell in ((_COARSE, coarse), (_FINE, fine))
    }


def cells(value: str) -> dict[str, Column]:
    return {name: F.expr(cell) for name, cell in cells_sql(value).items()}


def _grouped(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The frame with ``_group``, its group columns in one: never NULL, and equal where both sides are NULL."""
    return df.withColumn("_group", F.struct(*by) if by else F.lit(0))


def _earlier(partition: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _before(column: Column, window: Window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def prefix_sums(
    df: DataFrame, value: str, sums: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``before_<name>`` (sum over the group's rows with a smaller value) and ``total_<name>``.

    Values are numbers, not NULL, and distinct within a group; NULL group columns are a group.  Windows and
    joins of a level have the same keys, so only the offsets of the level above move to meet it.
    """
    celled = _grouped(df, by).withColumns(cells(value))
    per_fine = celled.groupBy("_group", *_CELLS).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    in_coarse = _earlier(["_group", _COARSE], _FINE)
    fine = per_fine.select(
        "_group", *_CELLS, *sums, *(_before(F.col(name), in_coarse).alias(f"_within_{name}") for name in sums)
    )
    per_coarse = fine.groupBy("_group", _COARSE).agg(*(F.sum(name).alias(name) for name in sums))
    in_group, group = _earlier(["_group"], _COARSE), Window.partitionBy("_group")
    coarse = per_coarse.select(
        "_group",
        _COARSE,
        *(_before(F.col(name), in_group).alias(f"_below_{name}") for name in sums),
        *(F.sum(name).over(group).alias(f"total_{name}") for name in sums),
    )
    offsets = fine.join(coarse, ["_group", _COARSE]).select(
        "_group",
        *_CELLS,
        *((F.col(f"_below_{name}") + F.col(f"_within_{name}")).alias(f"_offset_{name}") for name in sums),
        *(f"total_{name}" for name in sums),
    )
    inside = _earlier(["_group", *_CELLS], value)
    placed = celled.withColumns({f"_inside_{name}": _before(c, inside) for name, c in sums.items()})
    return placed.join(offsets, ["_group", *_CELLS]).select(
        *df.columns,
        *((F.col(f"_offset_{name}") + F.col(f"_inside_{name}")).alias(f"before_{name}") for name in sums),
        *(f"total_{name}" for name in sums),
    )


def ranked_values(
    df: DataFrame, value: str, by: Sequence[str] = (), **extra: Column
) -> DataFrame:
    """Distinct values with ``n``, ``before_n`` (rows below) and group totals of n and value*n."""
    return prefix_sums(
        value_counts(df, value, by, **extra),
        value,
        {"n": F.col("n"), "sum": F.col(value) * F.col("n")},
        by,
    )


def _cell_sql(value: str) -> str:
    """One cell for coarse and the leading bits of fine, as SQL."""
    coarse, fine = cells_sql(value).values()
    return f"(({coarse}) * {CELL_STEPS}L + ({fine}) DIV {max(FINE_STEPS // CELL_STEPS, 1)})"


_EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def aggregate_with_quantiles(
    df: DataFrame, value: str, by: Sequence[str], aggregates: Mapping[str, Column], quantiles: Mapping[str, float]
) -> DataFrame:
    """``aggregates`` of every group and exact quantiles of its values, which are not NULL.

    Quantiles are interpolated linearly between neighbouring ranks; without group columns there is always one row.
    One aggregation takes the aggregates and, from a mergeable summary, two values on either side of each
    quantile whose ranks are off by a bounded share of the rows.  A second one counts the rows below the lower value
    and the rows of each value in between, which are a few in SUMMARY_STEPS; these are ranked and the
    exact values found.  Should a summary ever miss, the query fails and does not guess.

    The first aggregation comes back as one entry per group, so groups are meant to be categories.
    """
    number, keys = f"double({quoted(value)})", [quoted(c) for c in by]
    near = 4.0 / SUMMARY_STEPS
    sides = [side for p in quantiles.values() for side in (max(p - near, 0.0), min(p + near, 1.0))]
    summary = f"percentile_approx({number}, array({', '.join(f'{s!r}D' for s in sides)}), {SUMMARY_STEPS})"
    first = (df.groupBy(*by) if by else df).agg(
        F.expr(f"count({number})").alias("_rows"),
        F.expr(summary).alias("_sides"),
        F.expr(f"min({number})").alias("_low"),
        F.expr(f"max({number})").alias("_high"),
        *(c.alias(name) for name, c in aggregates.items()),
    )
    facts = f"struct({', '.join(map(quoted, ['_rows', '_sides', '_low', '_high', *aggregates]))})"
    group = f"struct({', '.join(keys)})"
    if by:
        known = first.selectExpr(f"map_from_entries(collect_list(struct({group} AS g, {facts} AS f))) AS m").scalar()
        known = F.try_element_at(known, F.expr(group))
    else:
        known = first.selectExpr(f"{facts} AS f").scalar()
    # A margin of less than a few rows is none: then, and at the ends, all values are ranked.
    few = f"_f._rows * {near!r}D < 8"
    brackets = ", ".join(
        f"struct({i} AS _p, CASE WHEN {few} OR {p <= near} THEN _f._low ELSE _f._sides[{2 * i}] END AS low, "
        f"CASE WHEN {few} OR {p >= 1 - near} THEN _f._high ELSE _f._sides[{2 * i + 1}] END AS high)"
        for i, p in enumerate(quantiles.values())
    )
    of_group = "".join(f"{k}, " for k in keys)
    rows = df.selectExpr(*keys, f"{number} AS _v").withColumn("_f", known).selectExpr(*keys, "_v", f"inline(array({brackets}))")
    counts = rows.filter("_v <= high").groupBy(*by, "_p", F.expr("CASE WHEN _v >= low THEN _v END").alias("_v")).agg(F.expr("count(*)").alias("n"))
    before = f"coalesce(sum(n) OVER (PARTITION BY {of_group}_p ORDER BY _v NULLS FIRST {_EARLIER}), 0L) AS before"
    ranked = counts.selectExpr("*", before).withColumn("_f", known)

    def at(i: int, p: float, end: str) -> Column:
        rank = f"{end}({p!r}D * (_f._rows - 1))"
        return F.expr(f"max(CASE WHEN _p = {i} AND before <= {rank} AND {rank} < before + n THEN _v END)").alias(f"_{end}{i}")

    ends = [at(i, float(p), end) for i, p in enumerate(quantiles.values()) for end in ("floor", "ceil")]
    found = (ranked.groupBy(*by) if by else ranked).agg(*ends).withColumn("_f", known)

    def interpolated(i: int, p: float) -> str:
        place = f"({p!r}D * (_f._rows - 1))"
        missed = f"_f._rows > 0 AND (_floor{i} IS NULL OR _ceil{i} IS NULL)"
        return f"CASE WHEN {missed} THEN double(raise_error('a quantile lies outside of its summary')) ELSE _floor{i} + (_ceil{i} - _floor{i}) * ({place} - floor{place}) END"

    return found.selectExpr(
        *keys,
        *(f"_f.{quoted(name)} AS {quoted(name)}" for name in aggregates),
        *(f"{interpolated(i, float(p))} AS {quoted(name)}" for i, (name, p) in enumerate(quantiles.items())),
    )


def gini(df: DataFrame, value: str) -> Column:
    """A6 as a scalar: NULL without values, 0 unless their sum is positive.

    A value occupying ranks b+1..b+n contributes value * (n*b + n(n+1)/2).  Values are ranked inside cells of the same
    leading bits; a cell's contribution is what it has inside, and its sum times the rows of smaller cells.
    """
    query = f"""WITH counted AS (
      SELECT {quoted(value)} AS v, count(*) AS n FROM {{src}} WHERE {quoted(value)} IS NOT NULL GROUP BY {quoted(value)}
    ), split AS (SELECT double(v) AS v, n, {_cell_sql("v")} AS cell FROM counted), ranked AS (
      SELECT cell, v * n AS s, n, v * (double(n) * coalesce(sum(n) OVER (PARTITION BY cell ORDER BY v {_EARLIER}), 0) + double(n) * (n + 1) / 2) AS part
      FROM split
    ), summed AS (SELECT cell, sum(n) AS n, sum(s) AS s, sum(part) AS part FROM ranked GROUP BY cell), whole AS (
      SELECT n, s, part + s * coalesce(sum(n) OVER (ORDER BY cell {_EARLIER}), 0) AS part FROM summed
    )
    SELECT CASE WHEN sum(s) > 0 THEN 2 * sum(part) / (double(sum(n)) * sum(s)) - (double(sum(n)) + 1) / sum(n)
                WHEN sum(n) > 0 THEN 0.0D END AS gini FROM whole"""
    return df.sparkSession.sql(query, src=df).scalar()


def smallest_rows(df: DataFrame, value: str, ties: Sequence[str], k: int) -> DataFrame:
    """Exactly the k first rows by ``value``, then by ``ties``, which must tell all rows apart.

    One histogram by cell shows in which cell the k-th row lies.  Rows of the cells up to it are ranked in their cell,
    which decides for the last one only.  A cell holds the rows that agree in sign, exponent and the leading
    16 bits, so the value should not have many near equals.
    """
    celled = df.withColumn("_cell", F.expr(_cell_sql(quoted(value))))
    counts = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.orderBy("_cell"))
    counts = counts.select("_cell", upto.alias("_upto"), (upto - F.col("_rows")).alias("before"))
    holds = (F.col("before") < F.lit(k)) & (F.lit(k) <= F.col("_upto"))
    found = counts.agg(F.max(F.when(holds, F.struct("_cell", "before")))).scalar()
    # Without a k-th row there are fewer than k, and all of them are meant.
    rows = celled.withColumn("_at", found).filter("_at IS NULL OR _cell <= _at._cell")
    rows = rows.withColumn("_order", F.row_number().over(Window.partitionBy("_cell").orderBy(value, *ties)))
    return rows.filter(f"_at IS NULL OR _cell < _at._cell OR _order <= {int(k)} - _at.before").select(*(quoted(c) for c in df.columns))


def centred_rolling_sums(
    df: DataFrame, order: str, columns: Sequence[str], window: int, by: Sequence[str]
) -> DataFrame:
    """Sums over a centred window of ``min(window, rows of the group)`` rows.

    Adds ``rolling_<column>`` and ``window_rows``.  ``order`` is a number, distinct within a group.  Each
    group is cut into blocks of consecutive rows that are windowed separately; the few rows next to a cut are
    copied into the neighbouring block, so the result does not depend on where the cuts fall.  A group
    with fewer rows than the window has its places stretched, so that one range frame fits all groups.
    """
    by = list(by)
    numbered = prefix_sums(df, order, {"row": F.lit(1)}, by)
    row, block_size = F.col("before_row"), F.lit(ROWS_PER_BLOCK)
    down, up = window // 2, (window - 1) // 2
    first_block = F.floor(F.greatest(row - up, F.lit(0)) / block_size)
    blocked = numbered.withColumn("_block", F.explode(F.sequence(first_block, F.floor((row + down) / block_size))))
    rows = F.least(F.lit(window), F.col("total_row"))
    place = row - F.col("_block") * block_size

    def side(name: str, reach: int, group_reach: Column, start: int, end: int) -> Column:
        # Half a step more than the group's reach: the last row within is in, the next one is out.
        scale = F.lit(float(reach)) / (group_reach + F.lit(0.5)) if reach else F.lit(1.0)
        frame = Window.partitionBy(*by, "_block").orderBy(place * scale).rangeBetween(start, end)
        return F.sum(name).over(frame)

    def rolling(name: str) -> Column:
        earlier = side(name, down, F.floor(rows / 2), -down, 0)
        return earlier + side(name, up, F.floor((rows - 1) / 2), 0, up) - F.col(name)

    return (
        blocked.withColumns({f"rolling_{name}": rolling(name) for name in columns})
        .withColumn("window_rows", rows.cast("int"))
        .filter(F.col("_block") == F.floor(row / block_size))
        .select(*df.columns, *(f"rolling_{name}" for name in columns), "window_rows")
    )
