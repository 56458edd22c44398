"""Records that go on over lines or nest, out of Spark's own text splits.

A file is read in pieces, cut at line ends or closing braces, wherever Spark splits it.  Whether a piece begins a
record depends on everything before it, but only through a sum: of quote characters in a CSV file, of
braces outside of strings in JSON.  Sums within a split and one number per split give that sum before every
piece, so a file of any size is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tutorspark.sources.positions import POSITION

_PIECE = ("_file", "_split", "_id")
TEXT, FIRST = "_text", "_first"


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, offset of the split, running id, text) of the pieces between separators."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias(TEXT),
    )


def _in_split(*order: str) -> Window:
    return Window.partitionBy("_file", "_split").orderBy(*order)


def with_sum_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all pieces of the file before each one."""
    rows = rows.withColumn("_value", value)
    splits = rows.groupBy("_file", "_split").agg(F.sum("_value").alias("_whole"))
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_split", F.coalesce(F.sum("_whole").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum("_value").over(_in_split("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = rows.withColumn("_inside", inside).join(starts, ["_file", "_split"])
    return summed.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_value", "_offset", "_inside")


def joined_records(rows: DataFrame, begins: Column, separator: str) -> DataFrame:
    """One row for every record: POSITION, its text, and whether it is the first of its file.

    ``begins`` says which pieces begin a record; the pieces up to the next one belong to it, also those of later splits.
    The id of the position counts the records of a split.
    """
    rows = rows.withColumn("_begins", begins)
    upto = _in_split("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_number", F.sum(F.col("_begins").cast("long")).over(upto))
    last = rows.groupBy("_file", "_split").agg(F.max("_number").alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    # The record that is open where a split begins: the last of the nearest split before it that has one.
    start = F.when(F.col("_n") > 0, F.struct(F.col("_split").alias("s"), F.col("_n").alias("n")))
    still_open = last.select("_file", "_split", F.last(start, ignorenulls=True).over(earlier).alias("_open"))
    own = F.when(F.col("_number") > 0, F.struct(F.col("_split").alias("s"), F.col("_number").alias("n")))
    owned = rows.join(still_open, ["_file", "_split"]).withColumn("_record", F.coalesce(own, F.col("_open")))
    parts = F.sort_array(F.collect_list(F.struct(F.col("_split"), F.col("_id"), F.col(TEXT))))
    whole = owned.groupBy("_file", "_record").agg(parts.alias("_parts"))
    return whole.select(
        F.struct(F.col("_file").alias("file"), F.col("_record.s").alias("split"), F.col("_record.n").alias("id")).alias(POSITION),
        F.array_join(F.transform("_parts", lambda p: p[TEXT]), separator).alias(TEXT),
        ((F.col("_record.s") == 0) & (F.col("_record.n") == 1)).alias(FIRST),
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files in which quoted cells may hold line breaks.

    A line goes on with the record before it if the number of quotes before it is odd; a doubled quote in a cell
    changes nothing.
    """
    lines = with_sum_before(pieces(spark, path, "\n"), F.length(TEXT) - F.length(F.replace(TEXT, F.lit('"'), F.lit(""))), "_quotes")
    return joined_records(lines, F.col("_quotes") % 2 == 0, "\n")


def _outside(text: Column, opened: Column) -> Column:
    """The text without its strings; ``opened`` says whether it begins inside of one."""
    plain = F.regexp_replace(text, r'(?s)"[^"]*(?:"|\z)', "")
    rest = F.regexp_replace(text, r'(?s)\A[^"]*(?:"|\z)', "")
    return F.when(opened, F.regexp_replace(rest, r'(?s)"[^"]*(?:"|\z)', "")).otherwise(plain)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of the outermost array of JSON files, or of files of one or more objects.

    Files are cut at closing braces.  Of a piece, the braces outside of strings count, and the one that it was cut at
    unless that is inside of a string; an object begins where all braces before are closed.
    """
    unescaped = F.regexp_replace(TEXT, r"(?s)\\.", "")
    cut = pieces(spark, path, "}").withColumn("_plain", unescaped)
    quotes = F.length("_plain") - F.length(F.replace("_plain", F.lit('"'), F.lit("")))
    known = with_sum_before(cut.withColumn("_n", quotes), F.col("_n"), "_quotes")
    opens = F.length(F.regexp_replace(_outside(F.col("_plain"), F.col("_quotes") % 2 == 1), r"[^{]", ""))
    closes = ((F.col("_quotes") + F.col("_n")) % 2 == 0).cast("long")
    deep = with_sum_before(known, opens - closes, "_depth")
    objects = joined_records(deep, F.col("_depth") == 0, "}")
    # What is left of the brackets and commas between objects goes.
    text = F.concat(F.regexp_extract(TEXT, r"(?s)\A[^{]*(\{.*)\z", 1), F.lit("}"))
    return objects.filter(F.col(TEXT).contains("{")).withColumn(TEXT, text)
