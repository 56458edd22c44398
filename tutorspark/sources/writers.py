"""Sinks in canonical column order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tutorspark.functions.text import col
from tutorspark.schema import standard


def in_canonical_order(df: DataFrame, dataset: str) -> DataFrame:
    """Known columns first, in schema order, then the rest as they come; ids as text."""
    known = [name for name in standard(dataset).names() if name in df.columns]
    rest = [name for name in df.columns if name not in known]
    ids = set(standard(dataset).names(kind="identifier"))
    return df.select(
        *(col(n).cast("string").alias(n) if n in ids else col(n) for n in known + rest)
    )


def write_table(df: DataFrame, dataset: str, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """One folder of part files, each with a header when it is CSV."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported sink format {fmt!r}")
    writer = in_canonical_order(df, dataset).write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = (
            writer.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    writer.save(path)
