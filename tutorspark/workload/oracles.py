"""The same questions in ANSI SQL, for a second engine over the same Parquet tables."""

from __future__ import annotations

from tutorspark.workload import views

# Fixed values, written out here and not taken from the code that they check.
TARGET = 60.0
TOTAL_COST = 2_000_000.0
SAMPLE_K = 400
SUBGROUP_FACTORS = {"ell": 1.15, "iep": 1.2, "economic_disadvantage": 1.25}
DOSAGE_EDGES = (0.25, 0.5, 0.75, 1.0)
DOSAGE_LABELS = ("<25%", "25-50%", "50-75%", "75-99%", "100%+")
DOSAGE_SHARES = ("pct_below_25", "pct_25_50", "pct_50_75", "pct_75_99", "pct_full_dosage")
LEVEL_CUTS = (680, 710, 740, 770, 790)
LEVEL_LABELS = ("Below Basic", "Basic", "Proficient", "Advanced", "Distinguished", "Exceeds")
PROFICIENCY_PHRASES = (
    "far below basic", "below basic", "basic", "approaching", "proficient", "advanced", "exceeds", "level 1",
    "level 2", "level 3", "level 4", "level 5", "novice", "developing", "distinguished",
)
ROSTER_GRADE_BANDS = ((-1, 2, "Pre-K-2"), (3, 5, "Grades 3-5"), (6, 8, "Grades 6-8"), (9, 12, "Grades 9-12"))
TOPIC_GRADE_BANDS = ((-1, 3, "Pre-K-3"), (4, 5, "Grades 4-5"), (6, 8, "Grades 6-8"), (9, 12, "Grades 9-12"))
SUBGROUP_NAMES = {
    "ell": ("ELL", "ELL Students", "Non-ELL Students"),
    "iep": ("IEP", "IEP Students", "Non-IEP Students"),
    "economic_disadvantage": ("Economic Status", "Economically Disadvantaged", "Not Economically Disadvantaged"),
}
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")
UNKNOWN_WORDS = ("unknown", "declined", "declined to provide", "na", "n/a")
PRE_KINDERGARTEN_WORDS = ("pre-k", "prek", "prekindergarten", "pk")
KINDERGARTEN_WORDS = ("kindergarten", "kg", "k")
ELA_WORDS = ("ela", "english language arts", "english", "reading", "literacy")
MATH_WORDS = ("math", "mathematics", "mathematic", "maths")

SUBJECTS = ("ela", "math")
MEASURES = ("value_added", "raw_gain")
FLAGS = ("ell", "iep", "economic_disadvantage")


def r(expression: str) -> str:
    """Six places; adding zero turns a negative zero into a plain one."""
    return f"(round(CAST({expression} AS DOUBLE), 6) + 0.0)"


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def pct(part: str, whole: str) -> str:
    return f"(100.0::DOUBLE * ({part}) / nullif({whole}, 0))"


def clean(c: str) -> str:
    return f"nullif(trim(CAST({c} AS VARCHAR)), '')"


def _outcome_columns() -> str:
    parts = []
    for s in SUBJECTS:
        m1, m2, m3 = (f"{s}_outcome_measure_{i}" for i in (1, 2, 3))
        parts.append(f"coalesce({m3}, {m2}, {m1}) AS {s}_latest_outcome")
        parts.append(f"{m3} - {m1} AS {s}_raw_gain")
        parts.append(f"({m3} - {m2}) - ({m2} - {m1}) AS {s}_value_added")
    return ", ".join(parts)


_CTES = {
    **{name: views.sql(name) for name in ("sessions", "roster", "messy_sessions", "messy_roster")},
    "hours": """SELECT student_id, coalesce(sum(CAST(session_duration AS DECIMAL(28, 12)))::DOUBLE / 60, 0.0::DOUBLE) AS h
                FROM sessions WHERE student_id IS NOT NULL GROUP BY student_id""",
    "prepared": f"""SELECT *, total_hours > 0 AS received_tutoring, {_outcome_columns()}
                FROM (SELECT roster.*, coalesce(h, 0.0::DOUBLE) AS total_hours FROM roster LEFT JOIN hours USING (student_id))""",
    "tutored": "SELECT * FROM prepared WHERE total_hours > 0",
    "norm_sessions": f"""SELECT row_num, {clean('learner_id')} AS student_id, {clean('topic')} AS session_topic,
                coalesce({clean('session_date')}, {clean('session_datetime')}) AS session_date,
                {clean('minutes')} AS session_duration, {clean('tutor_id')} AS tutor_id, {clean('note')} AS note
                FROM messy_sessions""",
    "norm_roster": f"""SELECT row_num, {clean('student_number')} AS student_id, {clean('district_id')} AS district_id,
                {clean('district_name')} AS district_name, {clean('school_id')} AS school_id,
                {clean('school_name')} AS school_name, {clean('current_grade_level')} AS current_grade_level,
                coalesce({clean('gender')}, {clean('sex')}) AS gender, {clean('ethnicity')} AS ethnicity,
                {clean('english_learner')} AS ell, {clean('iep')} AS iep,
                {clean('free_reduced_lunch')} AS economic_disadvantage,
                {clean('ela_state_score_current_year')} AS ela_outcome_measure_3,
                {clean('math_outcome_score_current_year')} AS math_outcome_measure_3,
                {clean('performance_level_current_year')} AS performance_level_most_recent
                FROM messy_roster""",
    "typed_sessions": "",  # filled below
}

_DEPENDS = {
    "hours": ("sessions",),
    "prepared": ("roster", "hours"),
    "tutored": ("prepared",),
    "norm_sessions": ("messy_sessions",),
    "norm_roster": ("messy_roster",),
    "typed_sessions": ("norm_sessions",),
}


def flag_sql(c: str) -> str:
    w = f"lower({clean(c)})"
    return f"CASE WHEN {w} IN ({words(TRUE_WORDS)}) THEN true WHEN {w} IN ({words(FALSE_WORDS)}) THEN false END"


def flag_valid_sql(c: str) -> str:
    w = f"lower({clean(c)})"
    known = words((*TRUE_WORDS, *FALSE_WORDS, *UNKNOWN_WORDS))
    return f"({w} IS NULL OR {w} IN ({known}))"


def number_sql(c: str) -> str:
    w = clean(c)
    return (
        rf"CASE WHEN regexp_full_match({w}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"
        f" THEN TRY_CAST({w} AS DOUBLE) END"
    )


def number_valid_sql(c: str) -> str:
    return f"({clean(c)} IS NULL OR ({number_sql(c)}) IS NOT NULL)"


def grade_sql(c: str) -> str:
    w = f"lower({clean(c)})"
    return (
        f"CASE WHEN {w} IN ({words(PRE_KINDERGARTEN_WORDS)}) THEN -1 "
        f"WHEN {w} IN ({words(KINDERGARTEN_WORDS)}) THEN 0 "
        f"ELSE CAST(trunc({number_sql(c)}) AS INTEGER) END"
    )


def grade_valid_sql(c: str) -> str:
    w = f"lower({clean(c)})"
    known = words((*PRE_KINDERGARTEN_WORDS, *KINDERGARTEN_WORDS))
    n = f"({number_sql(c)})"
    return f"({w} IS NULL OR {w} IN ({known}) OR coalesce({n} = trunc({n}), false))"


def topic_sql(c: str) -> str:
    w = f"lower({clean(c)})"
    return f"CASE WHEN {w} IN ({words(ELA_WORDS)}) THEN 'ela' WHEN {w} IN ({words(MATH_WORDS)}) THEN 'math' ELSE {w} END"


def topic_valid_sql(c: str) -> str:
    w = f"lower({clean(c)})"
    return f"({w} IS NULL OR {w} IN ({words((*ELA_WORDS, *MATH_WORDS))}))"


def time_sql(c: str) -> str:
    """The shapes that occur: ISO with or without seconds, yyyy/mm/dd and mm/dd/yyyy."""
    w = clean(c)
    formats = words(
        ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y")
    )
    return f"try_strptime({w}, [{formats}])"


_CTES["typed_sessions"] = f"""SELECT row_num, student_id, {topic_sql('session_topic')} AS session_topic, session_date,
    {number_sql('session_duration')} AS session_duration, tutor_id, note FROM norm_sessions"""


def with_ctes(sql: str, *names: str) -> str:
    needed: list[str] = []

    def add(name: str) -> None:
        for dependency in _DEPENDS.get(name, ()):
            add(dependency)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n].strip()})" for n in needed) + "\n" + sql


def bands_left_closed(h: str, target: float) -> dict[str, str]:
    cuts = [repr(target * e) for e in DOSAGE_EDGES]
    conditions = [f"{h} < {cuts[0]}"]
    conditions += [f"{h} >= {a} AND {h} < {b}" for a, b in zip(cuts, cuts[1:])]
    conditions += [f"{h} >= {cuts[-1]}"]
    return dict(zip(DOSAGE_SHARES, conditions))


def count_if(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


def band_shares(h: str, among: str, target: float, empty: str | None = None) -> str:
    cells = []
    for name, condition in bands_left_closed(h, target).items():
        share = pct(count_if(f"{among} AND {condition}"), count_if(among))
        if empty:
            share = f"coalesce({share}, {empty})"
        cells.append(f"{r(share)} AS {name}")
    return ", ".join(cells)


def category_sql(h: str) -> str:
    arms = [f"WHEN {h} <= 0 THEN NULL"]
    arms += [f"WHEN {h} <= {TARGET * e!r} THEN '{label}'" for e, label in zip(DOSAGE_EDGES, DOSAGE_LABELS)]
    return f"CASE {' '.join(arms)} ELSE '{DOSAGE_LABELS[-1]}' END"


def level_sql(score: str) -> str:
    arms = " ".join(f"WHEN {score} < {c} THEN '{l}'" for c, l in zip(LEVEL_CUTS, LEVEL_LABELS))
    return f"CASE WHEN {score} IS NULL THEN NULL {arms} ELSE '{LEVEL_LABELS[-1]}' END"


def bin_sql(score: str) -> str:
    arms = " ".join(f"WHEN {score} <= {c} THEN '{l}'" for c, l in zip((*LEVEL_CUTS, 1000), LEVEL_LABELS))
    return f"CASE WHEN {score} <= 0 THEN NULL {arms} END"


def rank_sql(level: str) -> str:
    arms = " ".join(f"WHEN contains(lower({level}), '{p}') THEN {i}" for i, p in enumerate(PROFICIENCY_PHRASES))
    return f"CASE {arms} ELSE {len(PROFICIENCY_PHRASES)} END"


def grade_band_sql(grade: str, grade_bands) -> str:
    arms = " ".join(f"WHEN {grade} BETWEEN {a} AND {b} THEN '{label}'" for a, b, label in grade_bands)
    return f"CASE {arms} END"


def multiplier_sql(base: float) -> str:
    return " * ".join(
        [f"{base!r}::DOUBLE", *(f"(CASE WHEN {f} THEN {x!r}::DOUBLE ELSE 1.0::DOUBLE END)" for f, x in SUBGROUP_FACTORS.items())]
    )


def uniform_sql(*keys: str, copy: str = "0") -> str:
    """A number in (0, 1] from the key columns and the number of the row among its equals."""
    parts = ", ".join([*(f"coalesce(CAST({k} AS VARCHAR), '\\N')" for k in keys), f"CAST({copy} AS VARCHAR)"])
    digits = f"substr(md5('42:' || md5(concat_ws('|', {parts}))), 1, 13)"
    return f"(1.0::DOUBLE - CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE)"


def long_outcomes() -> str:
    return " UNION ALL ".join(
        f"SELECT '{s}' AS subject, '{m}' AS measure, {s}_{m} AS value FROM tutored WHERE {s}_{m} IS NOT NULL"
        for s in SUBJECTS
        for m in MEASURES
    )


def moments() -> str:
    return f"""SELECT subject, measure, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS sd,
        {pct(count_if('value > 0'), 'count(*)')} AS positive_pct, count(*) AS n,
        CASE WHEN stddev_samp(value) > 0 THEN avg(value) / stddev_samp(value) END AS effect
        FROM ({long_outcomes()}) GROUP BY subject, measure"""


def p_value(t: str, df: str) -> str:
    """Two-sided tail of Student's t as a ratio of two Simpson integrals of cos(x)^(df-1).

    The substitution t = sqrt(df) tan x makes both ranges finite.  Beyond 40 standard widths the
    integrand is below any double, so the upper end may stop there.
    """
    n = 20000

    def integral(low: str) -> str:
        width = f"(least(pi() / 2, {low} + 40 / sqrt({df})) - {low})"
        return f"""(SELECT sum((CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
            * pow(greatest(cos({low} + {width} * i / {n}), 0.0), {df} - 1)) * {width}
            FROM range({n + 1}) AS steps(i))"""

    return f"({integral(f'atan(abs({t}) / sqrt({df}))')} / {integral('0.0')})"


def flag_rows(body: str, flags=FLAGS) -> str:
    return " UNION ALL ".join("(" + body.replace("$f", f) + ")" for f in flags)


def score_curve(window: int) -> str:
    frames = " ".join(
        f"WHEN w = {k} THEN sum($x) OVER (PARTITION BY subject ORDER BY outcome ROWS BETWEEN {k // 2} PRECEDING AND {(k - 1) // 2} FOLLOWING)"
        for k in range(1, window + 1)
    )
    scores = " UNION ALL ".join(
        f"SELECT '{s.upper()}' AS subject, {s}_outcome_measure_3 AS outcome, received_tutoring AS got FROM prepared"
        for s in SUBJECTS
    )
    return f"""SELECT *, CAST(CASE {frames.replace('$x', 'n')} END AS BIGINT) AS sn,
        CAST(CASE {frames.replace('$x', 'tutored_n')} END AS BIGINT) AS st
        FROM (SELECT subject, outcome, count(*) AS n, {count_if('got')} AS tutored_n,
              least({window}, count(*) OVER (PARTITION BY subject)) AS w
              FROM ({scores}) WHERE outcome IS NOT NULL GROUP BY subject, outcome)"""


def histogram(source: str, value: str, bins: int, keys: str, extra: str = "") -> str:
    """Equal-width bins; keys must start with a comma or be empty."""
    bucket = f"CASE WHEN lo = hi THEN 1 ELSE least(CAST(floor(({value} - lo) / ((hi - lo) / {bins})) AS INTEGER) + 1, {bins}) END"
    return f"""SELECT {bucket} AS bin, lo, hi {keys}, count(*) AS students {extra}
        FROM {source}, (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}) GROUP BY ALL"""


def session_rules() -> list[tuple[str, str, str, str, str]]:
    """(rule, field, condition, value, what is expected), in reporting order."""
    topic, date, minutes = "session_topic", "session_date", "session_duration"
    return [
        ("missing", "student_id", "student_id IS NULL", "NULL", "a value"),
        ("unsupported_topic", topic, f"NOT {topic_valid_sql(topic)}", topic, "math, ela or an accepted name of either"),
        ("invalid_date", date, f"({date} IS NOT NULL AND {time_sql(date)} IS NULL)", date, "a date or datetime"),
        ("not_numeric", minutes, f"NOT {number_valid_sql(minutes)}", minutes, "a number of minutes"),
        ("negative", minutes, f"coalesce(({number_sql(minutes)}) < 0, false)", minutes, "0 or more"),
        ("missing", "tutor_id", "tutor_id IS NULL", "NULL", "a value"),
    ]


def student_rules() -> list[tuple[str, str, str, str, str]]:
    rules = [("missing", c, f"{c} IS NULL", "NULL", "a value") for c in ("student_id", "district_id", "school_id", "current_grade_level")]
    g = "current_grade_level"
    grade = f"CAST(({grade_sql(g)}) AS VARCHAR)"
    outside = f"({grade_valid_sql(g)} AND coalesce(NOT (({grade_sql(g)}) BETWEEN -1 AND 12), false))"
    rules += [
        ("not_a_grade", g, f"NOT {grade_valid_sql(g)}", g, "a whole number, K or Pre-K"),
        ("grade_out_of_range", g, outside, grade, "-1 to 12"),
    ]
    rules += [("not_a_flag", f, f"NOT {flag_valid_sql(f)}", f, "a yes or no, or blank") for f in FLAGS]
    scores = [f"{s}_outcome_measure_3" for s in SUBJECTS]
    return rules + [("not_numeric", c, f"NOT {number_valid_sql(c)}", c, "a number") for c in scores]


def issues(dataset: str) -> str:
    table, rules = ("norm_sessions", session_rules()) if dataset == "session" else ("norm_roster", student_rules())
    return " UNION ALL ".join(
        f"""SELECT '{dataset}' AS dataset, 'warning' AS severity, '{rule}' AS rule, '{field}' AS field, NULL::VARCHAR AS file, row_num,
        CAST({value} AS VARCHAR) AS value,
        'Row ' || row_num || ': `{field}` is ' || coalesce('''' || {value} || '''', 'nothing') || ', expected {expected}' AS message,
        {i} AS rule_ord FROM {table} WHERE {condition}"""
        for i, (rule, field, condition, value, expected) in enumerate(rules)
    )


def rule_counts(dataset: str) -> str:
    table, rules = ("norm_sessions", session_rules()) if dataset == "session" else ("norm_roster", student_rules())
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, '{rule}' AS rule, '{field}' AS field, {count_if(condition)} AS n FROM {table}"
        for rule, field, condition, _, _ in rules
    )


def missing(dataset: str, table: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, '{c}' AS field, {count_if(f'{c} IS NULL')} AS missing FROM {table}" for c in columns
    )


ISSUE_COLUMNS = "dataset, severity, rule, field, file, row_num, value, message"


def all_oracles() -> dict[str, str]:
    o: dict[str, str] = {}

    def add(name: str, sql: str, *ctes: str) -> None:
        o[name] = with_ctes(sql, *ctes)

    typed = f"SELECT student_id, session_topic, session_date, {r('session_duration')} AS session_duration, tutor_id, note"
    for name in ("S1_csv_scan", "S2_json_scan", "S3_parquet_scan"):
        add(name, f"{typed} FROM typed_sessions", "typed_sessions")
    add("S5_mapping_profile", "SELECT row_num, student_id, gender FROM norm_roster", "norm_roster")
    add("S6_canonical_order", "SELECT *, 0 AS id_place, 17 AS level_place FROM roster", "roster")
    add("S7_materialized_prepared", f"SELECT student_id, {r('total_hours')} AS total_hours, received_tutoring FROM prepared", "prepared")
    add("S8_preview", f"SELECT student_id, school_name, {r('total_hours')} AS total_hours FROM prepared ORDER BY student_id LIMIT 10", "prepared")

    add("P1_P2_normalized_sessions", "SELECT * FROM norm_sessions", "norm_sessions")
    add("P2_P3_normalized_roster", "SELECT * FROM norm_roster", "norm_roster")
    add("P4_typed_sessions", f"{typed}, row_num FROM typed_sessions", "typed_sessions")
    add(
        "P4_typed_roster",
        f"""SELECT row_num, student_id, district_id, district_name, school_id, school_name,
        {grade_sql('current_grade_level')} AS current_grade_level, gender, ethnicity,
        {', '.join(f'{flag_sql(f)} AS {f}' for f in FLAGS)},
        {', '.join(f"{r(number_sql(f'{s}_outcome_measure_3'))} AS {s}_outcome_measure_3" for s in SUBJECTS)},
        performance_level_most_recent FROM norm_roster""",
        "norm_roster",
    )
    add("P5_flags", f"SELECT row_num, {flag_sql('english_learner')} AS value, {flag_valid_sql('english_learner')} AS valid FROM messy_roster", "messy_roster")
    add("P6_grades", f"SELECT row_num, {grade_sql('current_grade_level')} AS value, {grade_valid_sql('current_grade_level')} AS valid FROM messy_roster", "messy_roster")
    scores = ("ela_state_score_current_year", "math_outcome_score_current_year")
    add(
        "P7_numbers",
        f"""SELECT row_num, {', '.join(f'{r(number_sql(c))} AS {c[:4]}_value, {number_valid_sql(c)} AS {c[:4]}_valid' for c in scores)}
        FROM messy_roster""",
        "messy_roster",
    )
    add(
        "P8_datetimes",
        f"""SELECT row_num, strftime({time_sql('session_date')}, '%Y-%m-%d %H:%M:%S') AS value,
        ({clean('session_date')} IS NULL OR {time_sql('session_date')} IS NOT NULL) AS valid FROM messy_sessions""",
        "messy_sessions",
    )
    add("P9_topics", f"SELECT row_num, {topic_sql('topic')} AS value, {topic_valid_sql('topic')} AS valid FROM messy_sessions", "messy_sessions")
    add("P10_lowered_names", f"SELECT lower({clean('school_name')}) AS school, count(*) AS n FROM messy_roster GROUP BY 1", "messy_roster")
    derived = ", ".join(f"{r(f'{s}_{m}')} AS {s}_{m}" for s in SUBJECTS for m in ("latest_outcome", "raw_gain", "value_added"))
    add("P11_outcome_columns", f"SELECT student_id, {derived} FROM prepared", "prepared")
    add("P12_latest_outcome", f"SELECT student_id, {r('ela_latest_outcome')} AS ela FROM prepared", "prepared")
    add(
        "P13_session_hours",
        f"""SELECT session_topic, {r('sum(CAST(session_duration AS DECIMAL(28, 12)))::DOUBLE / 60')} AS hours,
        {r('max(session_duration / 60.0::DOUBLE)')} AS longest FROM sessions GROUP BY session_topic""",
        "sessions",
    )
    add("P14_received_tutoring", "SELECT student_id, received_tutoring AS received FROM prepared", "prepared")
    add("P15_hours_column", f"SELECT student_id, {r('total_hours')} AS hours FROM prepared", "prepared")
    add(
        "P16_hour_and_day",
        """SELECT CAST(extract(hour FROM session_ts) AS INTEGER) AS hour_of_day, strftime(session_ts, '%Y-%m-%d') AS session_day,
        count(*) AS n FROM sessions GROUP BY 1, 2""",
        "sessions",
    )
    level = "performance_level_most_recent"
    add("P17_level_rank", f"SELECT student_id, CAST(CASE WHEN {level} IS NULL THEN {len(PROFICIENCY_PHRASES)} ELSE {rank_sql(level)} END AS INTEGER) AS level_rank FROM prepared", "prepared")
    add(
        "P18_resolved_columns",
        f"""SELECT student_id, {level} AS level, {r('ela_outcome_measure_3')} AS ela_score,
        {r('math_outcome_measure_3')} AS math_score FROM prepared""",
        "prepared",
    )
    add("P19_dosage_category", f"SELECT student_id, {category_sql('total_hours')} AS category FROM prepared", "prepared")
    add(
        "P20_score_level",
        f"""SELECT student_id, {level_sql('ela_latest_outcome')} AS ela_level, {level_sql('math_outcome_measure_2')} AS math_level
        FROM prepared""",
        "prepared",
    )
    prior = "((ela_outcome_measure_2 + math_outcome_measure_2) / 2.0::DOUBLE)"
    add("P21_score_bin", f"SELECT student_id, {bin_sql(prior)} AS score_bin FROM prepared", "prepared")
    add(
        "P22_dose_response",
        f"""SELECT student_id, {r('total_hours / 55.0::DOUBLE')} AS linear,
        {r('CASE WHEN total_hours <= 0 THEN 0 ELSE ln(1 + total_hours) / ln(56.0::DOUBLE) END')} AS logarithmic,
        {r('CASE WHEN total_hours < 30 THEN 0 ELSE (total_hours - 30) / 25.0::DOUBLE END')} AS threshold FROM prepared""",
        "prepared",
    )
    add(
        "P23_subgroup_multiplier",
        f"""SELECT student_id, {r(multiplier_sql(1.0))} AS multiplier,
        {r(f'least({multiplier_sql(0.6)}, 0.95)')} AS probability FROM prepared""",
        "prepared",
    )

    ids = f"SELECT student_id, {r('total_hours')} AS total_hours FROM prepared"
    ethnicities = "'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'"
    add("F1_tutored", f"{ids} WHERE total_hours > 0", "prepared")
    add("F2_school", f"{ids} WHERE school_name = 'NATION_3'", "prepared")
    add("F3_grades", f"{ids} WHERE current_grade_level BETWEEN -1 AND 12", "prepared")
    add("F4_unknown_flag", f"{ids} WHERE ell IS NULL", "prepared")
    add("F4_false_flag", f"{ids} WHERE NOT iep", "prepared")
    listed = f"(SELECT list(DISTINCT ethnicity ORDER BY ethnicity) FROM $from WHERE ethnicity IS NOT NULL) = [{ethnicities}]"
    add("F5_every_option", f"{ids} WHERE {listed.replace('$from', 'prepared')} OR ethnicity IN ({ethnicities})", "prepared")
    add("F5_some_options", f"{ids} WHERE ethnicity IN ('AUTOMOBILE', 'BUILDING')", "prepared")
    add(
        "F6_combined",
        f"""SELECT student_id, {r('total_hours')} AS total_hours
        FROM (SELECT * FROM prepared WHERE current_grade_level BETWEEN 3 AND 7 AND gender IN ('Female', 'Male')) f
        WHERE ({listed.replace('$from', "(SELECT * FROM prepared WHERE current_grade_level BETWEEN 3 AND 7 AND gender IN ('Female', 'Male'))")}
               OR ethnicity IN ({ethnicities})) AND economic_disadvantage""",
        "prepared",
    )
    add("F7_fixed_keys", f"{ids} WHERE current_grade_level IN (0, 1, 2, 8) AND ell = false AND gender IN ('Female', 'Nonbinary')", "prepared")
    option = "SELECT {i} AS field_ord, '{f}' AS field, '{label}' AS label, '{kind}' AS kind, {ord} AS option_ord, {value} AS option FROM {source}"
    parts = [
        option.format(i=0, f="school_name", label="School", kind="single", ord="0.0::DOUBLE", value="school_name", source="(SELECT DISTINCT school_name FROM prepared WHERE school_name IS NOT NULL)"),
        option.format(i=1, f="current_grade_level", label="Grade Levels", kind="multi", ord="CAST(current_grade_level AS DOUBLE)", value="CAST(current_grade_level AS VARCHAR)", source="(SELECT DISTINCT current_grade_level FROM prepared WHERE current_grade_level IS NOT NULL)"),
        option.format(i=2, f="gender", label="Gender", kind="multi", ord="0.0::DOUBLE", value="gender", source="(SELECT DISTINCT gender FROM prepared WHERE gender IS NOT NULL)"),
        option.format(i=3, f="ethnicity", label="Ethnicity", kind="multi", ord="0.0::DOUBLE", value="ethnicity", source="(SELECT DISTINCT ethnicity FROM prepared WHERE ethnicity IS NOT NULL)"),
    ]
    labels = ("English learner flag", "IEP flag", "Economic disadvantage flag")
    for i, (f, label) in enumerate(zip(FLAGS, labels), start=4):
        parts.append(option.format(i=i, f=f, label=label, kind="tri_state", ord="CAST(o AS DOUBLE)", value="v", source="(VALUES (0, 'All'), (1, 'Yes'), (2, 'No'), (3, 'Unknown')) AS t(o, v)"))
    add("F8_filter_options", " UNION ALL ".join(parts), "prepared")
    add("F9_nonblank_levels", f"{ids} WHERE trim({level}) <> ''", "prepared")
    add(
        "F10_dated_sessions",
        f"""SELECT strftime(t, '%Y-%m-%d') AS session_day, count(*) AS n, {r('sum(CAST(session_duration AS DECIMAL(28, 12)))::DOUBLE / 60')} AS hours
        FROM (SELECT *, {time_sql('session_date')} AS t FROM typed_sessions) WHERE t IS NOT NULL GROUP BY 1""",
        "typed_sessions",
    )
    topics = ", ".join(f"{count_if(f'session_topic = {t!r}')} AS {t}_sessions" for t in ("math", "ela"))
    add("F11_topic_counts", f"SELECT count(*) AS total_sessions, {topics} FROM sessions", "sessions")
    add("F12_high_need", f"{ids} WHERE coalesce(ell, false) OR coalesce(iep, false) OR coalesce(economic_disadvantage, false)", "prepared")

    add("J1_roster_hours", ids, "prepared")
    add(
        "F5_long_list",
        f"""SELECT gender, count(*) AS students, {count_if('student_id IS NULL')} AS without_id FROM norm_roster
        WHERE gender IN ('Female', 'Nonbinary') GROUP BY gender""",
        "norm_roster",
    )
    add(
        "J2_sessions_on_roster",
        """SELECT student_id, count(*) AS n, count(DISTINCT tutor_id) AS tutors FROM norm_sessions
        WHERE student_id IN (SELECT student_id FROM norm_roster WHERE student_id IS NOT NULL) GROUP BY student_id""",
        "norm_sessions", "norm_roster",
    )
    doubles = [f"{s}_outcome_measure_{i}" for s in SUBJECTS for i in (1, 2, 3)] + ["total_hours"]
    doubles += [f"{s}_{m}" for s in SUBJECTS for m in ("latest_outcome", "raw_gain", "value_added")]
    add(
        "J3_prepared",
        f"""SELECT student_id, school_name, current_grade_level, gender, ethnicity, ell, iep, economic_disadvantage, {level},
        received_tutoring, {', '.join(f'{r(c)} AS {c}' for c in doubles)} FROM prepared""",
        "prepared",
    )
    subject_hours = ", ".join(f"coalesce(sum(CASE WHEN session_topic = '{s}' THEN CAST(session_duration AS DECIMAL(28, 12)) END)::DOUBLE / 60, 0.0::DOUBLE) AS {s}" for s in SUBJECTS)
    pivot = f"(SELECT student_id, {subject_hours} FROM sessions GROUP BY student_id)"
    with_subjects = f"(SELECT p.*, coalesce(v.ela, 0.0) AS ela, coalesce(v.math, 0.0) AS math FROM prepared p LEFT JOIN {pivot} v USING (student_id))"
    add("J4_subject_hours", f"SELECT student_id, {r('total_hours')} AS total_hours, {r('ela')} AS ela, {r('math')} AS math FROM {with_subjects}", "prepared", "sessions")
    add("J5_treated_and_control", "SELECT student_id, CASE WHEN received_tutoring THEN 'treated' ELSE 'control' END AS side FROM prepared", "prepared")
    add(
        "J5_split_by_ids",
        """SELECT CASE WHEN student_id IN (SELECT student_id FROM sessions) THEN 'members' ELSE 'rest' END AS side, count(*) AS students
        FROM roster GROUP BY 1""",
        "roster", "sessions",
    )
    add(
        "J6_session_grades",
        f"""SELECT g AS current_grade_level, count(*) AS n, count(s.student_id) AS with_id
        FROM norm_sessions s LEFT JOIN (SELECT student_id, max({grade_sql('current_grade_level')}) AS g FROM norm_roster
             WHERE student_id IS NOT NULL GROUP BY 1) r ON s.student_id = r.student_id GROUP BY 1""",
        "norm_sessions", "norm_roster",
    )
    add("J7_grade_bands", f"SELECT student_id, {grade_band_sql('current_grade_level', ROSTER_GRADE_BANDS)} AS grade_band FROM prepared", "prepared")
    grid = f"""SELECT CAST({rank_sql('l')} AS INTEGER) AS level_rank, l AS proficiency_level, CAST(status_ord AS INTEGER) AS status_ord, tutoring_status,
        CASE status_ord WHEN 0 THEN t ELSE n - t END AS student_count, n AS category_total,
        {r(pct('CASE status_ord WHEN 0 THEN t ELSE n - t END', 'n'))} AS pct_of_category
        FROM (SELECT trim({level}) AS l, count(*) AS n, {count_if('received_tutoring')} AS t FROM prepared
              WHERE trim({level}) <> '' GROUP BY 1) CROSS JOIN (VALUES (0, 'Tutored'), (1, 'Untutored')) AS s(status_ord, tutoring_status)"""
    add("J8_level_status_grid", grid, "prepared")

    add("A1_hours_per_student", f"SELECT student_id, {r('h')} AS total_hours FROM hours", "hours")
    add(
        "A2_hours_per_topic",
        f"""SELECT student_id, session_topic, {r('sum(CAST(session_duration AS DECIMAL(28, 12)))::DOUBLE / 60')} AS subject_hours FROM sessions
        WHERE session_topic IS NOT NULL GROUP BY 1, 2""",
        "sessions",
    )
    add("A3_hours_by_subject", f"SELECT student_id, {r('ela')} AS ela, {r('math')} AS math FROM {pivot}", "sessions")
    gini = """(SELECT CASE WHEN sum(total_hours) > 0 THEN 2 * sum(i * total_hours) / (count(*) * sum(total_hours)) - (count(*) + 1.0::DOUBLE) / count(*) ELSE 0 END
        FROM (SELECT total_hours, row_number() OVER (ORDER BY total_hours) AS i FROM tutored))"""
    add(
        "A4_dosage_metrics",
        f"""SELECT {r('median(total_hours)')} AS median_hours, {r('avg(total_hours)')} AS mean_hours,
        {r('quantile_cont(total_hours, 0.25)')} AS q25, {r('quantile_cont(total_hours, 0.75)')} AS q75,
        {r('quantile_cont(total_hours, 0.75) - quantile_cont(total_hours, 0.25)')} AS iqr, count(*) AS tutored_students,
        {r(repr(TARGET))} AS target_dosage, {r('sum(total_hours)')} AS total_tutoring_hours,
        {band_shares('total_hours', 'true', TARGET)}, {r(gini)} AS gini FROM tutored""",
        "tutored",
    )
    add("A5_band_shares", f"SELECT {band_shares('total_hours', 'total_hours > 0', TARGET)} FROM prepared", "prepared")
    add("A6_gini", f"SELECT {r(gini)} AS gini, count(*) AS tutored_students FROM tutored", "tutored")
    school = f"""SELECT school_name, {band_shares('total_hours', 'total_hours > 0', TARGET, '0.0')}, count(*) AS total_students,
        {count_if('total_hours > 0')} AS students_tutored, {r(pct(count_if('total_hours > 0'), 'count(*)'))} AS pct_tutored
        FROM $from WHERE school_name IS NOT NULL GROUP BY school_name"""
    add("A7_school_dosage", school.replace("$from", "prepared"), "prepared")
    printed_shares = ", ".join(f"printf('%.1f%%', {n}) AS {n}" for n in DOSAGE_SHARES)
    add(
        "A7_school_dosage_printed",
        f"""SELECT school_name, {printed_shares}, total_students, printf('%d (%.1f%%)', students_tutored, pct_tutored) AS students_tutored
        FROM ({school.replace('$from', 'prepared')})""",
        "prepared",
    )
    add(
        "A8_subject_dosage",
        " UNION ALL ".join(
            f"""SELECT '{s.upper()}' AS subject, {band_shares(s, f'{s} > 0', 30.0, '0.0')}, count(*) AS total_students,
            {count_if(f'{s} > 0')} AS students_tutored, {r(pct(count_if(f'{s} > 0'), 'count(*)'))} AS pct_tutored FROM {with_subjects}"""
            for s in SUBJECTS
        ),
        "prepared", "sessions",
    )
    subjects = " UNION ALL ".join(
        f"SELECT '{s.upper()}' AS subject, coalesce({pct(count_if(f'{s} >= 30'), count_if(f'{s} > 0'))}, 0.0) AS full_pct FROM {with_subjects}" for s in SUBJECTS
    )
    add("O2_subject_order", f"SELECT subject, row_number() OVER (ORDER BY full_pct DESC, subject) - 1 AS place FROM ({subjects})", "prepared", "sessions")
    full = pct(count_if(f"total_hours >= {TARGET}"), count_if("total_hours > 0"))
    add(
        "O1_school_order",
        f"""SELECT school_name, row_number() OVER (ORDER BY coalesce({full}, 0.0) DESC, school_name) - 1 AS place
        FROM prepared WHERE school_name IS NOT NULL GROUP BY school_name""",
        "prepared",
    )
    add(
        "O3_level_order",
        f"""SELECT l AS proficiency_level, row_number() OVER (ORDER BY {rank_sql('l')}, lower(l)) - 1 AS place
        FROM (SELECT DISTINCT trim({level}) AS l FROM prepared WHERE trim({level}) <> '')""",
        "prepared",
    )
    sides = f"""SELECT '$f' AS flag, avg(CASE WHEN $f THEN total_hours END) AS mean_true, avg(CASE WHEN NOT $f THEN total_hours END) AS mean_false,
        {count_if('$f')} AS n_true, {count_if('NOT $f')} AS n_false FROM tutored"""
    add(
        "A9_subgroup_gaps",
        f"SELECT flag, {r('mean_true')} AS mean_true, {r('mean_false')} AS mean_false, {r('mean_true - mean_false')} AS gap, n_true, n_false FROM ({flag_rows(sides)})",
        "tutored",
    )
    need = "(coalesce(ell, false) OR coalesce(iep, false) OR coalesce(economic_disadvantage, false))"
    add(
        "A10_target_attainment",
        f"""SELECT {r(pct(count_if(f'{need} AND total_hours >= {TARGET}'), count_if(need)))} AS high_need_full_dosage_pct, {count_if(need)} AS high_need_n,
        {count_if(need)} < 30 AS high_need_small_sample,
        {r(pct(count_if(f'total_hours >= {TARGET}'), 'count(*)'))} AS total_full_dosage_pct, count(*) AS total_n FROM tutored""",
        "tutored",
    )
    add(
        "A11_ethnicity_dosage",
        f"""SELECT ethnicity, {r('avg(total_hours)')} AS avg_hours, {r('median(total_hours)')} AS median_hours,
        {r(pct(count_if(f'total_hours >= {TARGET}'), 'count(*)'))} AS pct_full_dosage, count(*) AS n
        FROM tutored WHERE ethnicity IS NOT NULL GROUP BY ethnicity""",
        "tutored",
    )
    add(
        "A12_subgroup_means",
        " UNION ALL ".join(
            f"""SELECT '{group}' AS group_name, '{label}' AS subgroup, {r('avg(total_hours)')} AS average_hours, count(*) AS n
            FROM tutored WHERE {condition} HAVING count(*) > 0"""
            for f, (group, yes, no) in SUBGROUP_NAMES.items()
            for label, condition in ((yes, f), (no, f"NOT {f}"))
        ),
        "tutored",
    )
    add("A13_small_samples", f"SELECT flag, n_true, n_false, (n_true < 30 OR n_false < 30) AS small_sample FROM ({flag_rows(sides)})", "tutored")
    add(
        "A14_outcome_metrics",
        f"""SELECT subject, measure, {r('mean')} AS mean, {r("CASE WHEN measure = 'value_added' THEN median END")} AS median,
        {r('sd')} AS sd, {r('positive_pct')} AS positive_pct, n, {r('effect')} AS effect_size, {r('effect * 43.0')} AS weeks_learning
        FROM ({moments()})""",
        "tutored",
    )

    va = f"(SELECT *, mean / (sd / sqrt(n)) AS t, n - 1.0::DOUBLE AS df FROM ({moments()}) WHERE measure = 'value_added')"
    with_p = f"(SELECT *, {p_value('t', 'df')} AS p FROM {va} va)"
    def cell(s: str, m: str, c: str, name: str) -> str:
        return f"max(CASE WHEN subject = '{s}' AND measure = '{m}' THEN {c} END) AS {name}"

    wide = []
    for s in SUBJECTS:
        for m, prefix, names in (
            ("value_added", "va", ("mean", "median", "std", "positive_pct", "n", "pvalue", "significant", "effect_size", "weeks_learning")),
            ("raw_gain", "raw", ("mean", "positive_pct", "n", "effect_size", "weeks_learning")),
        ):
            source = {"std": "sd", "pvalue": "p", "significant": "p < 0.05", "effect_size": "effect", "weeks_learning": "effect * 43.0"}
            for name in names:
                c = source.get(name, name)
                wide.append(cell(s, m, c if name in ("n", "significant") else r(c), f"{s}_{prefix}_{name}"))
    add(
        "A14_outcome_metrics_wide",
        f"SELECT {', '.join(wide)} FROM (SELECT m.*, p FROM ({moments()}) m LEFT JOIN {with_p} v USING (subject, measure))",
        "tutored",
    )
    add("A15_p_values", f"SELECT subject, {r('p')} AS p_value, p < 0.05 AS significant FROM {with_p}", "tutored")
    weighted = ", ".join(
        f"{r(f'sum({c} * n) / sum(CASE WHEN {c} IS NOT NULL THEN n END)')} AS {name}"
        for name, c in (("avg_value_added", "mean"), ("avg_effect_size", "effect"), ("avg_weeks", "(effect * 43.0)"))
    )
    add("A16_overall_outcomes", f"SELECT {weighted} FROM ({moments()}) WHERE measure = 'value_added'", "tutored")
    add(
        "A17_outcome_labels",
        f"""SELECT s.subject, CASE WHEN p < 0.05 THEN 'significant' WHEN p < 0.10 THEN 'marginal' END AS significance,
        CASE WHEN coalesce(mean, 0) < 1 THEN 'limited' ELSE 'directionally positive' END AS direction
        FROM (VALUES ('ela'), ('math')) AS s(subject) LEFT JOIN {with_p} p ON p.subject = s.subject""",
        "tutored",
    )
    points = {m: " + ".join(f"coalesce(sum({s}_{m}), 0)" for s in SUBJECTS) for m in MEASURES}
    add(
        "A18_cost_metrics",
        f"""SELECT {r('cost')} AS allocated_cost, n AS tutored_students, CASE WHEN n > 0 THEN at_target END AS students_at_target_dosage, {r('h')} AS total_tutoring_hours,
        {r('share')} AS cost_allocation_share, {r('cost / n')} AS cost_per_student, {r('cost / h')} AS cost_per_hour,
        {r('CASE WHEN va > 0 THEN cost / va END')} AS cost_per_va_point, {r('CASE WHEN raw > 0 THEN cost / raw END')} AS cost_per_raw_point
        FROM (SELECT *, h / ref AS share, {TOTAL_COST!r}::DOUBLE * (h / ref) AS cost FROM
              (SELECT nullif(count(*), 0) AS n, {count_if(f'total_hours >= {TARGET}')} AS at_target, sum(total_hours) AS h,
               {points['value_added']} AS va, {points['raw_gain']} AS raw, (SELECT sum(total_hours) FROM tutored) AS ref
               FROM tutored WHERE school_name = 'NATION_3'))""",
        "tutored",
    )
    add(
        "A19_proficiency_summary",
        f"""SELECT CAST({rank_sql('l')} AS INTEGER) AS level_rank, l AS proficiency_level, t AS tutored, n - t AS untutored, n AS total, {r(pct('t', 'n'))} AS pct_tutored
        FROM (SELECT trim({level}) AS l, count(*) AS n, {count_if('received_tutoring')} AS t FROM prepared WHERE trim({level}) <> '' GROUP BY 1)""",
        "prepared",
    )
    add(
        "A20_score_participation",
        f"""SELECT subject, {r('outcome')} AS outcome, {r(pct('st', 'sn'))} AS smoothed_pct_tutored, {r(pct('tutored_n', 'n'))} AS pct_tutored,
        n AS student_count, tutored_n AS tutored_count, n - tutored_n AS untutored_count, sn AS smoothing_students,
        CAST(w AS INTEGER) AS smoothing_window FROM ({score_curve(7)})""",
        "prepared",
    )
    add(
        "A21_population",
        f"""SELECT count(*) AS matched_students, {count_if('total_hours > 0')} AS tutored_students,
        {r(f"coalesce({pct(count_if('total_hours > 0'), 'count(*)')}, 0)")} AS pct_tutored FROM prepared""",
        "prepared",
    )
    add(
        "A22_overview_kpis",
        f"""SELECT count(*) AS tutored_students, {r('sum(total_hours)')} AS total_hours, {r('avg(total_hours)')} AS avg_hours,
        count(DISTINCT school_name) AS schools_served, (SELECT count(*) FROM prepared) AS roster_students FROM tutored""",
        "tutored",
    )
    add(
        "A23_session_kpis",
        f"""SELECT count(*) AS total_sessions, {topics}, count(DISTINCT tutor_id) AS unique_tutors,
        strftime(min(session_ts), '%Y-%m-%d') AS first_date, strftime(max(session_ts), '%Y-%m-%d') AS last_date,
        {r('avg(session_duration)')} AS avg_minutes FROM sessions""",
        "sessions",
    )
    add(
        "A24_roster_kpis",
        f"""SELECT count(*) AS total_students, {count_if('total_hours > 0')} AS tutored_students, count(DISTINCT school_name) AS schools,
        count(DISTINCT district_name) AS districts, count(DISTINCT current_grade_level) AS grade_levels FROM prepared""",
        "prepared",
    )
    add(
        "A25_hourly_sessions",
        f"""SELECT CAST(extract(hour FROM session_ts) AS INTEGER) AS hour_of_day, {r('sum(CAST(session_duration AS DECIMAL(28, 12)))::DOUBLE / 60')} AS total_hours,
        count(student_id) AS session_count FROM sessions WHERE session_ts IS NOT NULL GROUP BY 1""",
        "sessions",
    )
    daily = """(SELECT *, avg(a) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling FROM
        (SELECT CAST(session_ts AS DATE) AS d, avg(session_duration / 60.0::DOUBLE) AS a, sum(CAST(session_duration AS DECIMAL(28, 12)))::DOUBLE / 60 AS h,
         count(session_duration) AS n, count(DISTINCT student_id) AS u FROM sessions GROUP BY 1))"""
    add(
        "A26_daily_sessions",
        f"""SELECT strftime(d, '%Y-%m-%d') AS session_day, {r('a')} AS avg_duration, {r('h')} AS total_hours, n AS session_count,
        u AS unique_students, {r('rolling')} AS rolling_avg FROM {daily}""",
        "sessions",
    )
    labels27 = {"ell": "ELL", "iep": "IEP", "economic_disadvantage": "Economic disadvantage"}
    add(
        "A27_unknown_shares",
        " UNION ALL ".join(
            f"""SELECT '{f}' AS field, '{label}' AS label, {count_if(f'{f} IS NULL')} AS unknown, {r(pct(count_if(f'{f} IS NULL'), 'count(*)'))} AS pct_unknown,
            printf('{label}: %.1f%% unknown and left out of subgroup comparisons', {pct(count_if(f'{f} IS NULL'), 'count(*)')}) AS note
            FROM tutored HAVING {count_if(f'{f} IS NULL')} > 0"""
            for f, label in labels27.items()
        ),
        "tutored",
    )
    add(
        "A28_numeric_summary",
        f"""SELECT "column", count(*) AS n, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS sd, {r('min(v)')} AS min, {r('quantile_cont(v, 0.25)')} AS q25,
        {r('median(v)')} AS median, {r('quantile_cont(v, 0.75)')} AS q75, {r('max(v)')} AS max FROM ("""
        + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM tutored WHERE {c} IS NOT NULL" for c in ["current_grade_level", *doubles])
        + ') GROUP BY "column"',
        "tutored",
    )
    edges = lambda bins: f"{r(f'lo + (hi - lo) / {bins} * (bin - 1)')} AS bin_low, {r(f'lo + (hi - lo) / {bins} * bin')} AS bin_high"
    hist = histogram(f"(SELECT total_hours, {category_sql('total_hours')} AS category FROM tutored)", "total_hours", 30, ", category")
    add("A29_dosage_histogram", f"SELECT CAST(bin AS INTEGER) AS bin, {edges(30)}, category, students FROM ({hist})", "tutored")
    parts30 = []
    for m in MEASURES:
        source = f"(SELECT math_{m} AS v FROM tutored WHERE math_{m} IS NOT NULL)"
        parts30.append(
            f"""SELECT 'math' AS subject, '{m}' AS measure, CAST(bin AS INTEGER) AS bin, {edges(20)}, students,
            {r(f'(SELECT avg(v) FROM {source})')} AS mean FROM ({histogram(source, 'v', 20, '')})"""
        )
    add("A30_outcome_histogram", " UNION ALL ".join(parts30), "tutored")
    add("A31_flag_rates", flag_rows(f"SELECT '$f' AS flag, {r(pct(count_if('$f'), 'count(*)'))} AS pct_true FROM prepared"), "prepared")
    add(
        "A32_flag_enrolment",
        flag_rows(f"SELECT '$f' AS flag, count(*) AS n, {r(pct(count_if('received_tutoring'), 'count(*)'))} AS pct_treated FROM prepared WHERE $f HAVING count(*) > 0"),
        "prepared",
    )
    add(
        "A33_enrolment_by_score",
        f"""SELECT score_bin, {r(pct(count_if('received_tutoring'), 'count(*)'))} AS pct_treated, count(*) AS n
        FROM (SELECT *, {bin_sql(prior)} AS score_bin FROM prepared) WHERE score_bin IS NOT NULL GROUP BY score_bin""",
        "prepared",
    )
    add(
        "A34_grade_band_shares",
        " UNION ALL ".join(
            f"""SELECT '{label}' AS grade_band, {count_if(f'current_grade_level BETWEEN {a} AND {b}')} AS n,
            {r(pct(count_if(f'current_grade_level BETWEEN {a} AND {b}'), 'count(*)'))} AS pct FROM prepared"""
            for a, b, label in ROSTER_GRADE_BANDS
        ),
        "prepared",
    )
    add(
        "A35_dosage_moments",
        f"""SELECT {r('median(total_hours)')} AS median_hours, {r('avg(total_hours)')} AS mean_hours, {r('stddev_samp(total_hours)')} AS sd_hours,
        {r('min(total_hours)')} AS min_hours, {r('max(total_hours)')} AS max_hours FROM prepared WHERE received_tutoring""",
        "prepared",
    )
    add(
        "A36_flag_dosage",
        flag_rows(
            f"""SELECT '$f' AS flag, {r('avg(CASE WHEN $f THEN total_hours END)')} AS mean_flag,
            {r('avg(CASE WHEN NOT coalesce($f, false) THEN total_hours END)')} AS mean_rest FROM prepared WHERE received_tutoring"""
        ),
        "prepared",
    )
    growth = "ela_outcome_measure_3 - ela_outcome_measure_2"
    g = {side: f"CASE WHEN {c} THEN {growth} END" for side, c in (("treated", "received_tutoring"), ("control", "NOT received_tutoring"))}
    add(
        "A37_treatment_effect",
        "SELECT " + ", ".join(f"{r(f'avg({e})')} AS {side}_mean, {r(f'stddev_samp({e})')} AS {side}_sd" for side, e in g.items())
        + f""", {r(f"(avg({g['treated']}) - avg({g['control']})) / sqrt((var_samp({g['treated']}) + var_samp({g['control']})) / 2)")} AS effect_size FROM prepared""",
        "prepared",
    )
    add("A38_score_correlation", f"SELECT {r('corr(ela_outcome_measure_2, math_outcome_measure_2)')} AS correlation FROM prepared", "prepared")
    add(
        "A39_sessions_per_treated",
        f"""SELECT count(*) AS total_sessions, (SELECT count(*) FROM tutored) AS treated_students,
        {r('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM tutored)')} AS sessions_per_student FROM sessions""",
        "tutored", "sessions",
    )
    add(
        "A40_ratio_shares",
        f"""SELECT session_ratio, count(*) AS n, {r(pct('count(*)', '(SELECT count(*) FROM sessions WHERE session_ratio IS NOT NULL)'))} AS pct
        FROM sessions WHERE session_ratio IS NOT NULL GROUP BY 1""",
        "sessions",
    )
    math_share = pct(count_if("session_topic = 'math'"), "count(*)")
    add(
        "A41_topic_share_by_band",
        f"""SELECT grade_band, count(*) AS sessions, {r(math_share)} AS pct_math, {r(f'100 - {math_share}')} AS pct_other
        FROM (SELECT *, {grade_band_sql('current_grade_level', TOPIC_GRADE_BANDS)} AS grade_band FROM sessions JOIN roster USING (student_id))
        WHERE grade_band IS NOT NULL GROUP BY grade_band""",
        "sessions", "roster",
    )
    add(
        "A42_session_times",
        f"""SELECT CAST(min(hr) AS INTEGER) AS first_hour, CAST(max(hr) AS INTEGER) AS last_hour,
        CAST((SELECT hr FROM h GROUP BY hr ORDER BY count(*) DESC, hr LIMIT 1) AS INTEGER) AS most_common_hour,
        {count_if('isodow(session_ts) >= 6')} AS weekend_sessions FROM h""".replace(" FROM h", " FROM (SELECT *, extract(hour FROM session_ts) AS hr FROM sessions) h"),
        "sessions",
    )
    add(
        "A43_within_student_spread",
        f"""SELECT {r('avg(sd)')} AS mean_within_student_sd, count(sd) AS students
        FROM (SELECT stddev_samp(session_duration) AS sd FROM sessions GROUP BY student_id)""",
        "sessions",
    )
    weight = f"least({multiplier_sql(0.4)}, 0.95)"
    draw = uniform_sql("student_id")
    add("A44_weighted_sample", f"SELECT student_id FROM prepared ORDER BY -ln({draw}) / {weight}, student_id LIMIT {SAMPLE_K}", "prepared")
    add("A44_independent_sample", f"SELECT student_id FROM prepared WHERE 1.0::DOUBLE - {draw} < {weight}", "prepared")
    o["A44_missing_and_repeated_ids"] = f"""SELECT student_id, district, count(*) AS n FROM
        (SELECT *, -ln({uniform_sql('student_id', 'district', copy='c')}) / (1.0::DOUBLE + district % 2) AS wait FROM
         (SELECT *, row_number() OVER (PARTITION BY student_id, district) - 1 AS c FROM
          (SELECT CASE WHEN c_custkey % 10 > 2 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0')
                  WHEN c_custkey % 10 > 0 THEN lpad(CAST(c_custkey % 10 AS VARCHAR), 10, '0') END AS student_id,
                  c_nationkey % 5 AS district FROM customer)) ORDER BY wait LIMIT 100) GROUP BY ALL"""
    o["A1_band_edges"] = """SELECT CAST(m AS DOUBLE) AS session_minutes, count(*) AS students, count(*) AS at_target, 60.0::DOUBLE AS hours
        FROM (SELECT CASE c_custkey % 7 WHEN 0 THEN 20 WHEN 1 THEN 50 WHEN 2 THEN 25 WHEN 3 THEN 40 WHEN 4 THEN 10 WHEN 5 THEN 45 ELSE 5 END AS m
              FROM customer) GROUP BY m"""

    add("W1_rolling_week", f"SELECT strftime(d, '%Y-%m-%d') AS session_day, {r('rolling')} AS rolling_avg FROM {daily}", "sessions")
    add(
        "W2_even_window",
        f"""SELECT subject, {r('outcome')} AS outcome, {r(pct('st', 'sn'))} AS smoothed_pct_tutored, sn AS smoothing_students,
        CAST(w AS INTEGER) AS smoothing_window FROM ({score_curve(4)})""",
        "prepared",
    )
    add(
        "W3_ranked_hours",
        f"""SELECT {r('total_hours')} AS hours, n, CAST(sum(n) OVER (ORDER BY total_hours) - n AS BIGINT) AS before_n, CAST(sum(n) OVER () AS BIGINT) AS total_n
        FROM (SELECT total_hours, count(*) AS n FROM tutored GROUP BY 1)""",
        "tutored",
    )
    o["W4_row_numbers"] = "SELECT event_id, row_number() OVER (ORDER BY event_id) + 1 AS row_num FROM events"

    add(
        "V1_critical_issues",
        """SELECT DISTINCT 'session' AS dataset, 'all' AS rows, 0::BIGINT AS critical_issues FROM norm_sessions
        UNION ALL SELECT DISTINCT 'student', 'all', 0::BIGINT FROM norm_roster
        UNION ALL SELECT 'session', 'nobody', CASE WHEN count(*) = 0 THEN 1::BIGINT ELSE 0::BIGINT END FROM norm_sessions WHERE student_id = 'nobody'
        UNION ALL SELECT 'student', 'nobody', CASE WHEN count(*) = 0 THEN 1::BIGINT ELSE 0::BIGINT END FROM norm_roster WHERE student_id = 'nobody'""",
        "norm_sessions", "norm_roster",
    )
    def blank_line(i: int, c: str) -> str:
        n = f"(SELECT count(*) FROM norm_sessions WHERE {c} IS NULL)"
        return f"SELECT 'warning', 51, {i}, printf('  `{c}`: %s missing values', format('{{:,}}', {n})) WHERE {n} > 0"

    found = f"(SELECT count(*) FROM ({issues('session')}))"
    lines = [
        "SELECT 'warning' AS severity, 30 AS section, 0::BIGINT AS line, 'Unexpected columns (1):' AS message",
        "SELECT 'warning', 31, 1, '  `note` (accepted, not used)'",
        "SELECT 'info', 40, 2, 'Accepted alternative column names: `session_date` from `session_datetime`'",
        "SELECT 'info', 41, 3, 'Merged columns: `session_date` from `session_date`, `session_datetime`'",
        "SELECT 'warning', 50, 0, 'Missing values in important columns:'",
        *(blank_line(i, c) for i, c in enumerate(("student_id", "session_topic", "session_date", "session_duration", "tutor_id"))),
        f"SELECT 'warning', 70, 0, 'Data quality issues (first 20):' WHERE {found} > 0",
        f"SELECT 'warning', 72, 0, printf('  ... and %d more issues', {found} - 20) WHERE {found} > 20",
    ]
    add("V3_V5_name_messages", "SELECT 'session' AS dataset, * FROM (" + " UNION ALL ".join(lines) + ")", "norm_sessions")
    session_columns = ("student_id", "session_topic", "session_date", "session_duration", "tutor_id")
    student_columns = ("student_id", "district_id", "school_id")
    add("V6_missing_session_values", missing("session", "norm_sessions", session_columns), "norm_sessions")
    add("V6_missing_student_values", missing("student", "norm_roster", student_columns), "norm_roster")
    add("V7_session_issues", f"SELECT {ISSUE_COLUMNS} FROM ({issues('session')})", "norm_sessions")
    add("V7_session_rule_counts", rule_counts("session"), "norm_sessions")
    bad = "CASE WHEN event_id % 50 = 7 THEN 'long' WHEN event_id % 70 = 9 THEN 'short' ELSE 'good' END"
    o["V7_malformed_records"] = f"""SELECT 'malformed_record' AS rule, count(*) AS n, count(*) AS places, 1 AS several_files, count(*) AS named FROM events WHERE {bad} <> 'good'
        UNION ALL SELECT 'missing', count(*), count(*), 1, count(*) FROM events WHERE {bad} = 'short'"""
    add("V8_student_issues", f"SELECT {ISSUE_COLUMNS} FROM ({issues('student')})", "norm_roster")
    add("V8_student_rule_counts", rule_counts("student"), "norm_roster")
    limits = {"gender": 5, "ethnicity": 10, "performance_level_most_recent": 6}
    add(
        "V9_category_counts",
        " UNION ALL ".join(
            f"""SELECT 'student' AS dataset, '{c}' AS field, count(DISTINCT {c}) AS distinct_values, {m} AS max_unique,
            count(DISTINCT {c}) > {m} AS too_many FROM norm_roster"""
            for c, m in limits.items()
        ),
        "norm_roster",
    )
    add("V10_session_sample", f"SELECT {ISSUE_COLUMNS} FROM ({issues('session')}) ORDER BY rule_ord, row_num LIMIT 20", "norm_sessions")
    add("V10_student_sample", f"SELECT {ISSUE_COLUMNS} FROM ({issues('student')}) ORDER BY row_num, rule_ord LIMIT 20", "norm_roster")
    blanks = " + ".join(f"CASE WHEN {count_if(f'{c} IS NULL')} > 0 THEN 1 ELSE 0 END" for c in session_columns)
    total_issues = f"(SELECT sum(n) FROM ({rule_counts('session')}))"
    add(
        "V11_normalization_summary",
        f"""SELECT 'Session' AS dataset, count(*) AS uploaded_rows, 6 AS canonical_columns, 1 AS renamed_columns, 1 AS merged_columns,
        1 AS unknown_columns, 3 AS profile_mappings_applied, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS critical_issues,
        CAST(2 + CASE WHEN ({blanks}) > 0 THEN 1 + ({blanks}) ELSE 0 END
             + CASE WHEN {total_issues} > 0 THEN 1 ELSE 0 END + least(20, {total_issues})
             + CASE WHEN {total_issues} > 20 THEN 1 ELSE 0 END AS BIGINT) AS warnings,
        CAST(2 AS BIGINT) AS info_messages FROM norm_sessions""",
        "norm_sessions",
    )
    sources = {
        "session": {
            "student_id": ("student_id", 0), "session_topic": ("session_topic", 0), "session_date": ("session_date, session_datetime", 2),
            "session_duration": ("session_duration", 0), "tutor_id": ("tutor_id", 0),
        },
        "student": {
            "student_id": ("student_id", 0), "district_id": ("district_id", 0), "district_name": ("district_name", 0), "school_id": ("school_id", 0),
            "school_name": ("school_name", 0), "current_grade_level": ("current_grade_level", 0), "gender": ("gender, sex", 2),
            "ethnicity": ("ethnicity", 0), "ell": ("english_learner", 1), "iep": ("iep", 0), "economic_disadvantage": ("free_reduced_lunch", 1),
            "ela_outcome_measure_3": ("ela_state_score_current_year", 1), "math_outcome_measure_3": ("math_outcome_score_current_year", 1),
            "performance_level_most_recent": ("performance_level_current_year", 1),
        },
    }
    statuses = ("Accepted as canonical", "Mapped from alias", "Merged alias columns")
    details = [
        f"""SELECT '{d.title()}' AS dataset, '{c}' AS canonical_column, '{src}' AS source_columns, '{statuses[k]}' AS status,
        count({c}) AS filled FROM {'norm_sessions' if d == 'session' else 'norm_roster'}"""
        for d, columns in sources.items()
        for c, (src, k) in columns.items()
    ]
    details += [
        f"SELECT '{d}' AS dataset, '' AS canonical_column, '{c}' AS source_columns, 'Not used by current schema' AS status, NULL::BIGINT AS filled"
        for d, c in (("Session", "note"), ("Student", "homeroom"))
    ]
    add("V11_normalization_details", " UNION ALL ".join(details), "norm_sessions", "norm_roster")

    def cover(table: str, *columns: str) -> str:
        cells = [f"(SELECT count({c}) / CAST(count(*) AS DOUBLE) FROM {table})" for c in columns]
        return f"least({', '.join(cells)})" if len(cells) > 1 else cells[0]

    sess = lambda *c: cover("sessions", *c)
    prep = lambda *c: cover("prepared", *c)
    latest = prep("ela_latest_outcome", "math_latest_outcome")
    growth_cover = prep(*(f"{s}_{m}" for s in SUBJECTS for m in MEASURES))
    sections = [
        ("Dosage & Access", "Dosage summary and distribution", prep("total_hours")),
        ("Dosage & Access", "School and subject dosage tables", f"least({prep('school_name', 'total_hours')}, {sess('student_id', 'session_topic', 'session_duration')})"),
        ("Dosage & Access", "Time-of-day and over-time implementation views", sess("session_ts", "session_duration")),
        ("Equity Analysis", "Subgroup dosage gaps", prep("total_hours", *FLAGS)),
        ("Equity Analysis", "Ethnicity dosage comparison", prep("ethnicity", "total_hours")),
        ("Equity Analysis", "Tutoring by proficiency level", f"least({prep(level, 'student_id')}, {sess('student_id')})"),
        ("Equity Analysis", "Tutoring likelihood by latest outcome", f"least({latest}, {sess('student_id')})"),
        ("Outcomes", "ELA value-added and raw gain", prep("ela_raw_gain", "ela_value_added")),
        ("Outcomes", "MATH value-added and raw gain", prep("math_raw_gain", "math_value_added")),
        ("Cost Analytics", "Basic cost metrics", prep("total_hours")),
        ("Cost Analytics", "Outcome-based cost metrics", growth_cover),
    ]
    # The columns that each section names.
    details = {
        "Dosage summary and distribution": "Uses: total_hours",
        "School and subject dosage tables": "Uses: school_name, total_hours, session student_id, session session_topic, session session_duration",
        "Time-of-day and over-time implementation views": "Uses: session session_date, session session_duration",
        "Subgroup dosage gaps": "Uses: total_hours, ell, iep, economic_disadvantage",
        "Ethnicity dosage comparison": "Uses: ethnicity, total_hours",
        "Tutoring by proficiency level": "Uses: performance_level_most_recent, student_id, session student_id",
        "Tutoring likelihood by latest outcome": "Uses: ela_latest_outcome, math_latest_outcome, session student_id",
        "ELA value-added and raw gain": "Uses: ela_raw_gain, ela_value_added",
        "MATH value-added and raw gain": "Uses: math_raw_gain, math_value_added",
        "Basic cost metrics": "Uses: total_hours",
        "Outcome-based cost metrics": "Uses: ela_value_added, math_value_added, ela_raw_gain, math_raw_gain",
    }
    rows = []
    for tab in dict.fromkeys(t for t, _, _ in sections):
        rows.append((tab, "Tab summary", "least(" + ", ".join(c for t, _, c in sections if t == tab) + ", 1.0)"))
    rows += sections
    add(
        "V12_readiness",
        " UNION ALL ".join(
            f"SELECT {i} AS ord, '{tab}' AS tab, '{section}' AS section, 'Ready' AS status, '{'All tracked sections available.' if section == 'Tab summary' else details.get(section, '')}' AS detail, {r(c)} AS coverage" for i, (tab, section, c) in enumerate(rows)
        ),
        "prepared", "sessions",
    )
    gaps, ethnic = "Uses: total_hours, ell, iep", "Missing: ethnicity"
    partial = [
        (1, "Tab summary", "Partial", f"Subgroup dosage gaps: {gaps}; Ethnicity dosage comparison: {ethnic}",
         f"least({prep('total_hours', 'ell', 'iep')}, {prep(level, 'student_id')}, {latest}, {sess('student_id')})"),
        (7, "Subgroup dosage gaps", "Partial", gaps, prep("total_hours", "ell", "iep")),
        (8, "Ethnicity dosage comparison", "Unavailable", ethnic, "NULL"),
    ]
    add(
        "V12_partial_readiness",
        " UNION ALL ".join(
            f"SELECT {i} AS ord, 'Equity Analysis' AS tab, '{section}' AS section, '{status}' AS status, '{detail}' AS detail, {r(c)} AS coverage"
            for i, section, status, detail, c in partial
        ),
        "prepared", "sessions",
    )
    add(
        "filtered_dosage_tab",
        school.replace("$from", "(SELECT * FROM prepared WHERE current_grade_level BETWEEN 1 AND 6 AND gender = 'Female')"),
        "prepared",
    )
    return o
