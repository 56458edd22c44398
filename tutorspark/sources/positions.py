"""The line a record came from, for messages about single rows.

A record carries (file, byte offset of its input split, running id).  That is free to attach and
orders the records of a file.  Dense line numbers need the number of records in earlier splits,
which is one count per split.  Findings are gathered by the same aggregation as these counts, so one
scan gives both.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION = "_position"
HEADER_LINES = 2


def with_position(df: DataFrame) -> DataFrame:
    """Attach the position, unless the reader has done so; call it directly on a scan."""
    if POSITION in df.columns:
        return df
    running = F.monotonically_increasing_id()
    try:
        return df.select(
            "*",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("split"),
                running.alias("id"),
            ).alias(POSITION),
        )
    except AnalysisException:
        # Not a file scan: the upper bits of the running id are the partition.
        return df.select(
            "*",
            F.struct(
                F.lit("").alias("file"), F.shiftright(running, 33).alias("split"), running.alias("id")
            ).alias(POSITION),
        )


def number_rows(rows: DataFrame, positioned: DataFrame) -> DataFrame:
    """Replace the position of ``rows`` by ``file`` and ``row_num``, the place in it plus 2 for the header.

    ``positioned`` is the whole table the rows were taken from.
    """
    file, split, running = (F.col(f"{POSITION}.{part}") for part in ("file", "split", "id"))
    splits = (
        positioned.select(file.alias("_file"), split.alias("_split"), running.alias("_id"))
        .groupBy("_file", "_split")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    )
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "_file", "_split", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        rows.withColumns({"_file": file, "_split": split, "_id": running})
        .join(starts, ["_file", "_split"])
        .withColumn("row_num", F.lit(HEADER_LINES) + F.col("_before") + F.col("_id") - F.col("_first"))
        .withColumn("file", F.col("_file"))
        .drop("_file", "_split", "_id", "_first", "_before", POSITION)
    )


def numbered_findings(positioned: DataFrame, findings: Column) -> DataFrame:
    """``file``, ``row_num`` and the fields of every finding, out of one scan.

    ``findings`` is an array of structs, empty for most records.  A split's findings are one row while its records are
    counted, which its task has read anyway; nothing of the other records leaves the task.
    """
    file, split, running = (F.col(f"{POSITION}.{part}") for part in ("file", "split", "id"))
    records = positioned.select(file.alias("file"), split.alias("_split"), running.alias("_id"), findings.alias("_found"))
    splits = records.groupBy("file", "_split").agg(
        F.min("_id").alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        F.collect_list(F.when(F.size("_found") > 0, F.struct("_id", "_found"))).alias("_hits"),
    )
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    hits = placed.select("file", "_first", "_before", F.explode("_hits").alias("_hit"))
    row = F.lit(HEADER_LINES) + F.col("_before") + F.col("_hit._id") - F.col("_first")
    return hits.select("file", row.alias("row_num"), F.explode("_hit._found").alias("_one")).select("file", "row_num", "_one.*")
