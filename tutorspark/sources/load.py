"""Scan, rename, normalise, validate, type.  Issues are reported, they never stop a load."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tutorspark.operators.validate import Validation, validate
from tutorspark.schema import standard
from tutorspark.session import materialize
from tutorspark.sources.normalize import ColumnReport, apply_column_map, coerce_types, normalize_columns
from tutorspark.sources.positions import POSITION, with_position
from tutorspark.sources.readers import MALFORMED, read_table


@dataclass
class Loaded:
    """Lazy results of a load: clean text, typed table, data-quality findings, header report."""

    raw: DataFrame
    typed: DataFrame
    validation: Validation
    report: ColumnReport


def load_frame(
    scanned: DataFrame,
    dataset: str,
    column_map: Mapping[str, str] | None = None,
    keep_text: bool = False,
) -> Loaded:
    """As ``load_dataset``, for a table that has been scanned already.

    Records that the reader could not make out are in the tables with what was read of them, and each
    is a finding.
    """
    standard(dataset)
    positioned = with_position(scanned)
    renamed, applied = apply_column_map(positioned, column_map)
    clean, report = normalize_columns(renamed, dataset, keep=(POSITION, MALFORMED))
    report.applied_column_map = applied
    if keep_text:
        clean = materialize(clean)
    raw = clean.drop(POSITION, MALFORMED)
    return Loaded(raw, coerce_types(raw, dataset, is_clean=True), validate(clean, dataset, report), report)


def load_dataset(
    spark: SparkSession,
    path: str,
    dataset: str,
    column_map: Mapping[str, str] | None = None,
    keep_text: bool = False,
    **read_options: object,
) -> Loaded:
    """Nothing but the header is read until a result is used.

    ``keep_text`` keeps the clean text in executor storage; worth it when the typed table and the
    findings are both wanted, which otherwise scan the file once each.
    """
    return load_frame(read_table(spark, path, mark=True, **read_options), dataset, column_map, keep_text)
