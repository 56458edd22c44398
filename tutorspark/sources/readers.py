"""Scans.  Everything textual is read as text; typing happens in ``normalize``."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutorspark.functions.text import quoted
from tutorspark.sources.positions import POSITION
from tutorspark.sources.records import FIRST, TEXT, csv_records, json_objects

#: Text of a record that does not fit: a line with too many or too few cells, or broken JSON.
MALFORMED = "_malformed"
SUPPORTED = (".csv", ".json", ".jsonl", ".ndjson", ".parquet")


def _distinct_names(header: list[str]) -> list[str]:
    """Repeated headers get .1, .2, ... so that every column can be addressed."""
    seen: dict[str, int] = {}
    names = []
    for name in header:
        count = seen.get(name, 0)
        names.append(f"{name}.{count}" if count else name)
        seen[name] = count + 1
    return names


def csv_header(spark: SparkSession, path: str, multi_line: bool = False) -> list[str]:
    """The header as written.  Spark's own header handling would rename names differing in case.

    With ``multi_line`` lines are taken until the quotes among them are even.
    """
    lines, wanted = spark.read.option("lineSep", "\n").text(path), 1
    while True:
        found = [row[0] for row in lines.take(wanted)]
        text = "\n".join(found)
        if not multi_line or text.count('"') % 2 == 0 or len(found) < wanted:
            break
        wanted *= 2
    if not found:
        return []
    return next(csv.reader(io.StringIO(text.removeprefix("﻿").replace("\r\n", "\n"), newline="\n")))


def read_csv(spark: SparkSession, path: str, multi_line: bool = False, mark: bool = False) -> DataFrame:
    """Every column text, blanks and words such as NA kept as they are.

    A line with more or fewer cells than the header is kept, as far as it goes; with ``mark`` its text
    is in the column MALFORMED.  Files of one folder must agree on their header.  ``multi_line`` is needed only
    for quoted line breaks; a file is split then, too, at the price of shuffling its lines, and a quote character
    must be part of quoting.
    """
    if multi_line:
        return _read_records(spark, path, mark)
    header = csv_header(spark, path)
    if not header:
        return spark.createDataFrame([], T.StructType([]))
    names = _distinct_names(header)
    # Spark refuses a schema whose names differ in case only; such files are read by position.
    by_position = len({name.lower() for name in names}) < len(names)
    fields = [f"_c{i}" for i in range(len(names))] if by_position else names
    df = (
        spark.read.schema(T.StructType([T.StructField(name, T.StringType()) for name in (*fields, MALFORMED)]))
        .option("header", True)
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("enforceSchema", fields != header)
        .csv(path)
    )
    if fields != header:
        # Spark does not compare these headers itself: one look at the first line of each file.
        for file in df.inputFiles():
            if csv_header(spark, file) != header:
                raise ValueError(f"{file} has another header than the other files of {path!r}")
    df = df.toDF(*names, MALFORMED)
    return df if mark else df.drop(MALFORMED)


def _read_records(spark: SparkSession, path: str, mark: bool) -> DataFrame:
    """``read_csv`` for quoted line breaks: records first, cells then; with ``mark`` POSITION is there already."""
    header = csv_header(spark, path, multi_line=True)
    if not header:
        return spark.createDataFrame([], T.StructType([]))
    cells = [f"_c{i}" for i in range(len(header))]
    records = csv_records(spark, path)
    schema = ", ".join(f"{c} STRING" for c in (*cells, MALFORMED))
    options = {"escape": '"', "columnNameOfCorruptRecord": MALFORMED, "multiLine": "true"}
    text = F.regexp_replace(F.regexp_replace(TEXT, "\r\n", "\n"), "\r\\z", "")
    parsed = records.filter(~F.col(FIRST)).withColumn(TEXT, text).filter(F.col(TEXT) != "")
    parsed = parsed.select(F.from_csv(TEXT, schema, options).alias("r"), POSITION).select("r.*", POSITION)
    named = parsed.toDF(*_distinct_names(header), MALFORMED, POSITION)
    return named if mark else named.drop(MALFORMED, POSITION)


def _first_object(spark: SparkSession, path: str) -> list[str]:
    """Keys of the first record of a JSON array, from the text up to the brace that completes it."""
    pieces, wanted = spark.read.option("lineSep", "}").text(path), 64
    while True:
        text, found = "", pieces.take(wanted)
        for piece in found:
            text += piece[0] + "}"
            try:
                return list(json.JSONDecoder().raw_decode(text[text.index("{") :])[0])
            except ValueError:
                continue
        if len(found) < wanted:
            return []
        wanted *= 4


def _json_key_order(spark: SparkSession, path: str, lines: bool) -> list[str]:
    if not lines:
        return _first_object(spark, path)
    keys = spark.read.text(path).select(F.json_object_keys("value").alias("keys"))
    first = keys.filter("keys is not null").first()
    return list(first["keys"]) if first else []


def _read_objects(spark: SparkSession, path: str, named: list[str], mark: bool) -> DataFrame:
    """``read_json`` for an array with known columns; with ``mark`` POSITION is there already."""
    schema = ", ".join(f"{quoted(c)} STRING" for c in named)
    objects = json_objects(spark, path)
    parsed = objects.select(F.from_json(TEXT, schema, {"columnNameOfCorruptRecord": MALFORMED}).alias("r"), POSITION)
    parsed = parsed.select(*(F.col("r")[c].alias(c) for c in named), POSITION)
    return parsed if mark else parsed.drop(MALFORMED, POSITION)


def read_json(
    spark: SparkSession, path: str, lines: bool = False, columns: Sequence[str] | None = None, mark: bool = False
) -> DataFrame:
    """Records with every scalar as text, so that ids keep their leading zeros.

    JSON Lines (``lines=True``) is the better form for large input.  Name the ``columns`` to save Spark a pass over the
    data that looks for them; an array of records is then read by as many tasks as its text has splits, at
    the price of shuffling it (a nested value is then text without white space), while without names one task reads a
    file.  Otherwise columns follow the
    first record, which decides who wins when aliases are merged.  With ``mark`` the text of a
    broken record is in the column MALFORMED; the column is left out if Spark, looking for columns, saw none.
    """
    reader = spark.read.option("multiLine", not lines).option("columnNameOfCorruptRecord", MALFORMED)
    if columns is not None:
        named = (*columns, MALFORMED)
        if not lines:
            return _read_objects(spark, path, list(named), mark)
        df = reader.schema(T.StructType([T.StructField(name, T.StringType()) for name in named])).json(path)
        return df if mark else df.drop(MALFORMED)
    df = reader.option("primitivesAsString", True).json(path)
    order = [name for name in _json_key_order(spark, path, lines) if name in df.columns]
    rest = [name for name in df.columns if name not in order and (mark or name != MALFORMED)]
    return df.select(*(f"`{name}`" for name in order + rest))


def read_table(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """S3: choose the reader by file suffix; Parquet has no malformed records to mark."""
    suffix = PurePosixPath(str(path).rstrip("/")).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, str(path), **options)
    if suffix == ".json":
        return read_json(spark, str(path), **options)
    if suffix in (".jsonl", ".ndjson"):
        return read_json(spark, str(path), lines=True, **options)
    if suffix == ".parquet":
        return spark.read.parquet(str(path))
    raise ValueError(f"unsupported file type {suffix!r} of {path!r}; use one of {', '.join(SUPPORTED)}")
