"""Mix sources to target weights by nested hash thresholds, without a sort.

Every row draws a hash of 36 bits from its id and text.  Words are summed by source and by the upper 12 bits;
running sums over these at most 4096 cells show in which cell the source's budget ends.  Only that
cell is summed again by the next 12 bits, and the cell found there by the last 12.  A row is taken
when its hash lies at or below its source's threshold.  A smaller budget gives a smaller threshold,
so its rows are among those of the larger one.  A budget beyond the source repeats whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorspark.llm.storage import keep, neutral

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
CELL_BITS = 12
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, text: Column) -> Column:
    """36 bits of the MD5 of key and text, so that only rows that are equal in both share a draw.

    NULLs draw as empty ones.
    """
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (key, text)]
    digits = F.substring(F.md5(F.concat(parts[0], F.lit("\n"), parts[1]).cast("binary")), 1, 9)
    return F.conv(digits, 16, 10).cast("long")


def cycling_weights(source: Column, cycle: int = 3) -> Column:
    """1, 2, 3, 1, ... over the sources in code-point order, NULL last."""
    order = Window.orderBy(source.asc_nulls_last())  # one row per source
    return ((F.row_number().over(order) - 1) % cycle + 1).cast("double")


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    Targets are least(max_repeats * size, level * weight) for the level at which they add up to all
    sizes: what resharing the excess over the caps by weight ends in.  With the sources in order of
    their cap per unit of weight, the level is the largest of what is left after capping the first 0,
    1, 2, ... of them, per unit of the weight that is left.
    """
    cap = F.col("source_size") * max_repeats
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = sources.withColumn("_level", left.cast("double") / weight_left)
    level = F.max("_level").over(whole)
    return levels.withColumn("target", F.least(cap.cast("double"), level * F.col("weight"))).drop("_level")


def _boundary(cells: DataFrame) -> DataFrame:
    """Of (source, budget, before, cell, words): the cell in which each source's budget ends."""
    order = Window.partitionBy("source").orderBy("cell")
    after = F.col("before") + F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = cells.withColumn("_after", after).withColumn("_before", F.col("_after") - F.col("words"))
    inside = (F.col("_before") <= F.col("budget")) & (F.col("budget") < F.col("_after"))
    return found.filter(inside).select("source", "budget", "cell", "words", F.col("_before").alias("before"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): hashes up to the threshold sum to the budget, as near as whole rows allow.

    rows: (source, h, size).  budgets: (source, budget), budget below the source's size.  A source
    whose budget ends nowhere (it is empty) has no row.
    """
    top = F.shiftright("h", 2 * CELL_BITS)
    cells = rows.groupBy("source", top.alias("cell")).agg(F.sum("size").alias("words"))
    budgets = budgets.select(F.col("source").alias("_source"), "budget")
    cells = cells.join(budgets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    found = _boundary(cells.withColumn("before", F.lit(0).cast("long")))
    for level in (1, 0):
        # The prefix is part of the key, so a source of any size is spread over the cells.
        prefix = F.shiftright("h", CELL_BITS * (level + 1))
        part = found.select(F.col("source").alias("_source"), F.col("cell").alias("_cell"), "budget", "before")
        inside = rows.withColumn("_prefix", prefix).join(
            part, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_prefix") == F.col("_cell"))
        )
        cell = F.shiftright("h", CELL_BITS * level)
        cells = inside.groupBy("source", "budget", "before", cell.alias("cell")).agg(F.sum("size").alias("words"))
        found = _boundary(cells)
    over = F.col("before") + F.col("words") - F.col("budget")
    nearer = over < F.col("budget") - F.col("before")
    return found.select("source", F.when(nearer, F.col("cell")).otherwise(F.col("cell") - 1).alias("threshold"))


def source_plan(rows: DataFrame) -> DataFrame:
    """Of rows (source, h, size): source, source_size, target, whole, threshold, kept as a table.

    A row is taken ``whole`` times, and once more if its hash is at or below the threshold.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sources.withColumn("weight", cycling_weights(F.col("source"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = keep(sources.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    found = thresholds(rows, sources.select("source", "budget")).withColumnRenamed("source", "_source")
    return keep(sources.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"))


def _drawn(docs: DataFrame, id_col: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """The rows' ids, sources, sizes and hashes as a kept table, and the plan of their sources."""
    columns = {"doc_id": F.col(id_col), "source": F.col(source), "size": word_count(F.col(text)), "h": draw(F.col(id_col), F.col(text))}
    rows = keep(docs.select(*[c.alias(name) for name, c in columns.items()]))
    return rows, source_plan(rows)


def _copies(rows: DataFrame, plan: DataFrame, source: str, h: str) -> DataFrame:
    """Add the plan's columns and ``_copies``; the plan is one row per source, so Spark sends it
    around when it is small, and otherwise a source's rows go to SALTS tasks."""
    salted = plan.select(
        F.col("source").alias("_source"),
        F.col("source_size").alias("_size"),
        F.col("target").alias("_target"),
        F.col("whole").alias("_whole"),
        F.col("threshold").alias("_threshold"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    same = F.col(source).eqNullSafe(F.col("_source")) & (F.pmod(F.col(h), F.lit(SALTS)) == F.col("_salt"))
    more = F.when(F.col(h) <= F.col("_threshold"), 1).otherwise(0)
    return rows.join(salted, same).withColumn("_copies", F.col("_whole") + more)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, taken.

    One row per input row; other columns are not carried.  Sources share 100 % of all words by the
    weights 1, 2, 3, ... ; see ``targets``.  A NULL text has no words; a source without words has
    target 0.  A NULL source is a source of its own.  Rows with equal id and text draw one hash and so are
    taken or left together; rows that share the id alone, or have none, draw one by one.  Texts of any length are
    hashed whole.  An empty table gives an empty one.
    """
    docs, (id_col, text, source) = neutral(docs, id_col, text, source)
    rows, plan = _drawn(docs, id_col, text, source)
    return _copies(rows, plan, "source", "h").select(
        "doc_id",
        "source",
        "size",
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the plan takes it, with all its columns, whatever their names.

    A source without words has no budget to end anywhere: its rows are left as they are, once each.
    """
    plain, (id_col, text, source) = neutral(docs, id_col, text, source)
    _, plan = _drawn(plain, id_col, text, source)
    counted = _copies(plain.withColumn("_h", draw(F.col(id_col), F.col(text))), plan, source, "_h")
    times = F.when(F.col("_size") == 0, 1).otherwise(F.col("_copies")).cast("int")
    repeated = counted.withColumn("_times", times).filter("_times > 0")
    mixed = repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return mixed.select(*plain.columns).toDF(*docs.columns)
