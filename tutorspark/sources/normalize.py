"""Headers to canonical names, cells to clean text, clean text to types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutorspark.functions import parsing
from tutorspark.functions.text import clean, col
from tutorspark.schema import Standard, standard


@dataclass
class ColumnReport:
    """What happened to the headers; built from names alone, no job."""

    alias_sources: dict[str, list[str]] = field(default_factory=dict)
    combined_columns: dict[str, list[str]] = field(default_factory=dict)
    unknown_columns: list[str] = field(default_factory=list)
    applied_column_map: dict[str, str] = field(default_factory=dict)

    def renamed(self) -> dict[str, list[str]]:
        """Canonical column -> its source headers that were not already canonical."""
        legacy = {
            name: [s for s in sources if Standard.heading(s) != name]
            for name, sources in self.alias_sources.items()
        }
        return {name: sources for name, sources in legacy.items() if sources}


def apply_column_map(
    df: DataFrame, mapping: Mapping[str, str] | None
) -> tuple[DataFrame, dict[str, str]]:
    """Rename by trimmed, lower-cased header; returns the renames that took place."""
    targets = {Standard.heading(source): target for source, target in (mapping or {}).items()}
    wanted = {name: targets.get(Standard.heading(name)) for name in df.columns}
    applied = {name: target for name, target in wanted.items() if target}
    if not applied:
        return df, {}
    return df.toDF(*(applied.get(name, name) for name in df.columns)), applied


def normalize_columns(
    df: DataFrame, dataset: str, keep: Sequence[str] = ()
) -> tuple[DataFrame, ColumnReport]:
    """Each canonical column is the first non-blank cell among its source columns.

    Unknown columns pass through as clean text under their trimmed name.  ``keep`` names helper
    columns that pass through untouched.
    """
    columns = standard(dataset)
    report = ColumnReport()
    by_position = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    sources: dict[str, list[tuple[str, Column]]] = {}
    kept: list[Column] = []
    for i, header in enumerate(df.columns):
        if header in keep:
            kept.append(F.col(f"_c{i}").alias(header))
            continue
        canonical = columns.canonical(header)
        if canonical is None:
            canonical = header.strip()
            report.unknown_columns.append(canonical)
        else:
            report.alias_sources.setdefault(canonical, []).append(header)
        sources.setdefault(canonical, []).append((header, clean(f"_c{i}")))
    report.combined_columns = {
        name: [header for header, _ in cells] for name, cells in sources.items() if len(cells) > 1
    }
    merged = [F.coalesce(*(cell for _, cell in cells)).alias(name) for name, cells in sources.items()]
    return by_position.select(*merged, *kept), report


def typed_column(name: str, kind: str, data_type: T.DataType) -> Column:
    """One clean field by its kind.  Bad input becomes NULL; columns typed already stay."""
    c = col(name)
    if kind == "flag":
        return c if isinstance(data_type, T.BooleanType) else parsing.flag(name)
    if kind in ("grade", "numeric", "numeric_outcome") and isinstance(data_type, T.NumericType):
        value = parsing.typed_number(name, data_type)
        return value.try_cast("int") if kind == "grade" else value
    if kind == "grade":
        return parsing.grade(name)
    if kind in ("numeric", "numeric_outcome"):
        return parsing.number(name)
    if kind == "topic":
        return parsing.topic(name)
    return c


def _is_typed(kind: str, data_type: T.DataType) -> bool:
    if kind == "flag":
        return isinstance(data_type, T.BooleanType)
    return kind in ("grade", "numeric", "numeric_outcome") and isinstance(data_type, T.NumericType)


def coerce_types(df: DataFrame, dataset: str, is_clean: bool = False) -> DataFrame:
    """Every known column by its field kind, other columns untouched.

    Cells are cleaned in a projection of their own, see ``parsing``; ``is_clean`` skips it for the
    output of ``normalize_columns``.
    """
    columns = standard(dataset)
    kinds = {name: columns.about(name, "kind") for name in columns.names()}
    if not is_clean:
        df = df.select(
            *(
                clean(f.name).alias(f.name)
                if f.name in kinds and not _is_typed(kinds[f.name], f.dataType)
                else col(f.name)
                for f in df.schema.fields
            )
        )
    return df.select(
        *(
            typed_column(f.name, kinds[f.name], f.dataType).alias(f.name)
            if f.name in kinds
            else col(f.name)
            for f in df.schema.fields
        )
    )
