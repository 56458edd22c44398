"""Which analyses the columns support, and how well they are filled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.functions.text import col
from tutorspark.schema import EQUITY_FLAGS, SUBJECTS

READY, PARTIAL, UNAVAILABLE = "Ready", "Partial", "Unavailable"

# Tab names of the report.
TABS = {
    "overview": "Program Overview",
    "dosage": "Dosage & Access",
    "equity": "Equity Analysis",
    "outcomes": "Outcomes",
    "cost": "Cost Analytics",
}


@dataclass(frozen=True)
class Section:
    """A part of a tab, the columns it needs, and whether all or any of the prepared ones do."""

    tab: str
    name: str
    prepared: tuple[str, ...] = ()
    sessions: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    partial_below: int = 0

    def judge(self, have: set[str], have_sessions: set[str]) -> tuple[str, str, list[str], list[str]]:
        """Status, detail, and the prepared and session columns in use."""
        missing = [c for c in self.prepared if c not in have]
        missing += [f"session {c}" for c in self.sessions if c not in have_sessions]
        found = [c for c in self.any_of if c in have]
        if missing:
            return UNAVAILABLE, f"Missing: {', '.join(missing)}", [], []
        if self.any_of and not found:
            return UNAVAILABLE, f"Needs at least one of {', '.join(self.any_of)}", [], []
        used = [*self.prepared, *found]
        detail = f"Uses: {', '.join([*used, *(f'session {c}' for c in self.sessions)])}"
        status = PARTIAL if len(found) < self.partial_below else READY
        return status, detail, used, list(self.sessions)


_GROWTH = tuple(f"{s}_{m}" for m in ("value_added", "raw_gain") for s in SUBJECTS)

# The eleven sections and what each needs.
SECTIONS = (
    Section("dosage", "Dosage summary and distribution", ("total_hours",)),
    Section(
        "dosage",
        "School and subject dosage tables",
        ("school_name", "total_hours"),
        ("student_id", "session_topic", "session_duration"),
    ),
    Section(
        "dosage",
        "Time-of-day and over-time implementation views",
        (),
        ("session_date", "session_duration"),
    ),
    Section("equity", "Subgroup dosage gaps", ("total_hours",), any_of=EQUITY_FLAGS, partial_below=3),
    Section("equity", "Ethnicity dosage comparison", ("ethnicity", "total_hours")),
    Section(
        "equity",
        "Tutoring by proficiency level",
        ("performance_level_most_recent", "student_id"),
        ("student_id",),
    ),
    Section(
        "equity",
        "Tutoring likelihood by latest outcome",
        (),
        ("student_id",),
        any_of=tuple(f"{s}_latest_outcome" for s in SUBJECTS),
        partial_below=2,
    ),
    *(
        Section("outcomes", f"{s.upper()} value-added and raw gain", (f"{s}_raw_gain", f"{s}_value_added"))
        for s in SUBJECTS
    ),
    Section("cost", "Basic cost metrics", ("total_hours",)),
    Section("cost", "Outcome-based cost metrics", any_of=_GROWTH),
)
TAB_SUMMARY = "Tab summary"


def _coverage(columns: list[str]) -> Column:
    """Share of non-null cells per column, as a struct."""
    if not columns:
        return F.max(F.struct(F.lit(1.0).alias("nothing")))
    n = F.count(F.lit(1))
    return F.struct(*(F.try_divide(F.count(col(c)), n).alias(c) for c in columns))


def readiness(prepared: DataFrame, sessions: DataFrame) -> DataFrame:
    """(ord, tab, section, status, detail, coverage): a summary row per tab, then eleven sections.

    Status follows from the columns present.  Outcome columns always exist once prepared, so a
    status of Ready may hide that they are empty; ``coverage``, the lowest non-null share among the
    columns used, shows it.  It is NULL for an unavailable section.
    """
    have, have_sessions = set(prepared.columns), set(sessions.columns)
    if "session_ts" in have_sessions:
        have_sessions.add("session_date")
    judged = [(s, *s.judge(have, have_sessions)) for s in SECTIONS]

    def session_column(name: str) -> str:
        return name if name in sessions.columns else "session_ts"

    used_prepared = sorted({c for _, _, _, used, _ in judged for c in used})
    used_sessions = sorted({session_column(c) for _, _, _, _, used in judged for c in used})

    def lowest(columns: list[str], session_columns: list[str]) -> str:
        cells = [f"p.`{c}`" for c in columns] + [f"s.`{session_column(c)}`" for c in session_columns]
        if not cells:
            return "double(NULL)"
        return f"least({', '.join(cells)})" if len(cells) > 1 else cells[0]

    rows, order = [], 0
    tabs = list(dict.fromkeys(s.tab for s in SECTIONS))
    for tab in tabs:
        of_tab = [j for j in judged if j[0].tab == tab]
        statuses = {status for _, status, _, _, _ in of_tab}
        if statuses == {READY}:
            status = READY
        else:
            status = PARTIAL if statuses & {READY, PARTIAL} else UNAVAILABLE
        notes = "; ".join(f"{s.name}: {d}" for s, st, d, _, _ in of_tab if st != READY)
        columns = [c for _, _, _, used, _ in of_tab for c in used]
        session_columns = [c for _, _, _, _, used in of_tab for c in used]
        detail = notes or "All tracked sections available."
        rows.append((order, TABS[tab], TAB_SUMMARY, status, detail, lowest(columns, session_columns)))
        order += 1
    for s, status, detail, columns, session_columns in judged:
        rows.append((order, TABS[s.tab], s.name, status, detail, lowest(columns, session_columns)))
        order += 1

    names = ("ord", "tab", "section", "status", "detail")
    entries = F.array(
        *(
            F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row)), F.expr(row[5]).alias("coverage"))
            for row in rows
        )
    )
    one_row = prepared.agg(_coverage(used_prepared).alias("p")).select(
        "p", sessions.agg(_coverage(used_sessions)).scalar().alias("s")
    )
    return one_row.select(F.explode(entries).alias("r")).select("r.*").orderBy("ord")


def tab_notes(table: DataFrame, tab: str) -> DataFrame:
    """Sections of a tab that are not Ready, as "section: detail" lines."""
    return (
        table.filter(
            (F.col("tab") == tab) & (F.col("section") != TAB_SUMMARY) & (F.col("status") != READY)
        )
        .select("tab", F.concat_ws(": ", "section", "detail").alias("note"), "ord")
        .orderBy("ord")
        .drop("ord")
    )
