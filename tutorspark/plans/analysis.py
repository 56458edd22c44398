"""The result families over one prepared table, filtered and built on demand."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from tutorspark.functions.bands import DEFAULT_TARGET_HOURS
from tutorspark.operators import cohort, cost, dosage, equity, outcomes, overview, readiness
from tutorspark.operators.filters import (
    apply_filter_values,
    population_summary,
    tutored_students,
    unknown_shares,
)
from tutorspark.operators.prepare import prepare
from tutorspark.session import materialize

FLAG_LABELS = {"ell": "ELL", "iep": "IEP", "economic_disadvantage": "Economic disadvantage"}


class Tables(Mapping[str, DataFrame]):
    """Named result tables, each built when it is first asked for.

    A table whose columns are not in the data is not listed; ``readiness`` says what is missing.
    """

    def __init__(self, have: set[str], have_sessions: set[str]) -> None:
        self._have, self._have_sessions = have, have_sessions
        self._builders: dict[str, Callable[[], DataFrame]] = {}
        self._built: dict[str, DataFrame] = {}

    def add(
        self, name: str, build: Callable[[], DataFrame], needs: tuple[str, ...] = (), of_sessions: tuple[str, ...] = ()
    ) -> None:
        if set(needs) <= self._have and set(of_sessions) <= self._have_sessions:
            self._builders[name] = build

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


@dataclass
class Analysis:
    """Result tables by tab.

    ``filters`` narrow the students of a tab.  The hourly and daily tables describe all sessions
    whatever the filters, and cost is shared out over the unfiltered table.
    """

    sessions: DataFrame
    prepared: DataFrame
    filters: Mapping[str, object] = field(default_factory=dict)
    target: float = DEFAULT_TARGET_HOURS
    total_cost: float = 0.0

    @classmethod
    def of(
        cls, sessions: DataFrame, roster: DataFrame, keep: bool = True, path: str | None = None, **settings
    ) -> "Analysis":
        """Prepare once for all tabs, in executor storage or in a Parquet folder (``path``)."""
        prepared = prepare(sessions, roster)
        return cls(sessions, materialize(prepared, path) if keep else prepared, **settings)

    @cached_property
    def view(self) -> DataFrame:
        return apply_filter_values(self.prepared, self.filters)

    def _tables(self) -> Tables:
        have_sessions = set(self.sessions.columns)
        if "session_ts" in have_sessions:
            have_sessions.add("session_date")
        return Tables(set(self.prepared.columns), have_sessions)

    def overview(self) -> Tables:
        t = self._tables()
        t.add("kpis", lambda: overview.overview_kpis(self.prepared))
        t.add("session_kpis", lambda: overview.session_kpis(self.sessions))
        t.add("roster_kpis", lambda: overview.roster_kpis(self.prepared))
        t.add("readiness", lambda: readiness.readiness(self.prepared, self.sessions))
        t.add("preview", lambda: overview.preview(self.prepared), ("student_id",))
        t.add("numeric_summary", lambda: overview.numeric_summary(self.prepared))
        return t

    def dosage(self) -> Tables:
        timed = ("session_date", "session_duration", "student_id")
        t = self._tables()
        t.add("population", lambda: population_summary(self.view))
        t.add("metrics", lambda: dosage.dosage_metrics(self.view, self.target))
        t.add("histogram", lambda: dosage.dosage_histogram(self.view, self.target))
        t.add("schools", lambda: dosage.school_dosage(self.view, self.target), ("school_name",))
        t.add(
            "subjects",
            lambda: dosage.subject_dosage(self.view, self.sessions, self.target),
            ("student_id",),
            ("student_id", "session_topic", "session_duration"),
        )
        t.add("hourly", lambda: dosage.hourly_sessions(self.sessions), of_sessions=timed)
        t.add("daily", lambda: dosage.daily_sessions(self.sessions), of_sessions=timed)
        return t

    def equity(self) -> Tables:
        t = self._tables()
        t.add("population", lambda: population_summary(self.view))
        t.add("unknown", lambda: unknown_shares(tutored_students(self.view), FLAG_LABELS))
        t.add("gaps", lambda: equity.subgroup_gaps(self.view))
        t.add("subgroups", lambda: equity.subgroup_means(self.view))
        t.add("attainment", lambda: equity.target_attainment(self.view, self.target))
        t.add("ethnicity", lambda: equity.ethnicity_dosage(self.view, self.target), ("ethnicity",))
        t.add("proficiency", lambda: equity.proficiency_participation(self.view))
        t.add("proficiency_summary", lambda: equity.proficiency_summary(self.view))
        t.add("scores", lambda: equity.score_participation(self.view))
        return t

    def outcomes(self) -> Tables:
        t = self._tables()
        t.add("population", lambda: population_summary(self.view))
        t.add("unknown", lambda: unknown_shares(tutored_students(self.view), FLAG_LABELS))
        t.add("metrics", lambda: outcomes.outcome_metrics(self.view))
        t.add("overall", lambda: outcomes.overall_outcomes(t["metrics"]))
        t.add("labels", lambda: outcomes.outcome_labels(t["metrics"]))
        t.add("histogram_ela", lambda: outcomes.outcome_histogram(self.view, "ela"))
        t.add("histogram_math", lambda: outcomes.outcome_histogram(self.view, "math"))
        return t

    def cost(self) -> Tables:
        t = self._tables()
        t.add("population", lambda: population_summary(self.view))
        t.add("metrics", lambda: cost.cost_metrics(self.view, self.total_cost, self.target, self.prepared))
        return t

    def cohort(self) -> Tables:
        middle = ("ela_outcome_measure_2", "math_outcome_measure_2")
        t = self._tables()
        t.add("flag_rates", lambda: cohort.flag_rates(self.prepared))
        t.add("flag_enrolment", lambda: cohort.flag_enrolment(self.prepared))
        t.add("prior_score", lambda: cohort.enrolment_by_prior_score(self.prepared), middle)
        t.add("grade_bands", lambda: cohort.grade_band_shares(self.prepared), ("current_grade_level",))
        t.add("dosage", lambda: cohort.dosage_moments(self.prepared))
        t.add("flag_dosage", lambda: cohort.flag_dosage(self.prepared))
        t.add(
            "effect",
            lambda: cohort.treatment_effect(self.prepared),
            ("ela_outcome_measure_2", "ela_outcome_measure_3"),
        )
        t.add("correlation", lambda: cohort.score_correlation(self.prepared), middle)
        t.add("sessions_per_student", lambda: cohort.sessions_per_treated(self.sessions, self.prepared))
        t.add("ratios", lambda: cohort.ratio_shares(self.sessions), of_sessions=("session_ratio",))
        t.add(
            "topics",
            lambda: cohort.topic_share_by_grade_band(self.sessions, self.prepared),
            ("student_id", "current_grade_level"),
            ("student_id", "session_topic"),
        )
        t.add("times", lambda: cohort.session_time_profile(self.sessions), of_sessions=("session_date",))
        t.add(
            "within_student",
            lambda: cohort.within_student_spread(self.sessions),
            of_sessions=("student_id", "session_duration"),
        )
        return t
