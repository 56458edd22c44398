"""A session log and a roster derived from the events and customer tables.

The SELECTs below are read by Spark and by the comparison engine alike, so both start from the
same rows.  ``clean_*`` are typed; ``messy_*`` are text with blanks, other headers and bad values.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SESSIONS = """
SELECT lpad(cast(user_id AS string), 10, '0') AS student_id,
       CASE event_type WHEN 'view' THEN 'math' WHEN 'click' THEN 'math'
            WHEN 'signup' THEN 'ela' WHEN 'purchase' THEN 'ela' ELSE 'science' END AS session_topic,
       ts AS session_ts,
       value AS session_duration,
       concat('1:', cast(1 + event_id % 5 AS string)) AS session_ratio,
       concat('T', lpad(cast(event_id % 50 AS string), 5, '0')) AS tutor_id
FROM {events}
"""

ROSTER = """
SELECT lpad(cast(c_custkey AS string), 10, '0') AS student_id,
       lpad(cast(n_regionkey AS string), 7, '0') AS district_id, r_name AS district_name,
       lpad(cast(c_nationkey AS string), 6, '0') AS school_id, n_name AS school_name,
       CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE cast(c_custkey % 14 - 1 AS int) END AS current_grade_level,
       CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Nonbinary' END AS gender,
       CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_mktsegment END AS ethnicity,
       CASE WHEN c_custkey % 7 = 0 THEN true WHEN c_custkey % 11 = 0 THEN NULL ELSE false END AS ell,
       CASE WHEN c_custkey % 5 = 0 THEN true WHEN c_custkey % 13 = 0 THEN NULL ELSE false END AS iep,
       CASE WHEN c_custkey % 2 = 0 THEN true WHEN c_custkey % 17 = 0 THEN NULL ELSE false END
           AS economic_disadvantage,
       cast(e1 AS double) AS ela_outcome_measure_1,
       cast(e1 + (c_custkey * 13) % 21 - 5 AS double) AS ela_outcome_measure_2,
       CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE cast(e1 + (c_custkey * 7) % 31 AS double) END
           AS ela_outcome_measure_3,
       cast(m1 AS double) AS math_outcome_measure_1,
       CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE cast(m1 + (c_custkey * 11) % 23 - 4 AS double) END
           AS math_outcome_measure_2,
       cast(m1 + (c_custkey * 17) % 37 AS double) AS math_outcome_measure_3,
       CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN e1 < 680 THEN 'Below Basic' WHEN e1 < 710 THEN 'Basic'
            WHEN e1 < 740 THEN 'Proficient' ELSE 'Advanced' END AS performance_level_most_recent
FROM (SELECT c.*, n_name, n_regionkey, r_name,
             650 + (c_custkey * 37) % 120 AS e1, 650 + (c_custkey * 53) % 120 AS m1
      FROM {customer} c JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey) b
"""

MESSY_SESSIONS = """
SELECT event_id + 2 AS row_num,
       CASE WHEN event_id % 109 = 0 THEN '   '
            ELSE concat('  ', lpad(cast(user_id AS string), 10, '0'), ' ') END AS learner_id,
       CASE WHEN event_id % 97 = 0 THEN ''
            WHEN event_type = 'view' THEN ' Mathematics' WHEN event_type = 'click' THEN 'MATH '
            WHEN event_type = 'signup' THEN 'reading' WHEN event_type = 'purchase' THEN 'English Language Arts'
            ELSE 'Science ' END AS topic,
       CASE WHEN event_id % 4 = 0 THEN ' '
            WHEN event_id % 107 = 0 THEN 'not-a-date'
            WHEN event_id % 4 = 1 THEN concat(substr(cast(ts AS string), 6, 2), '/', substr(cast(ts AS string), 9, 2),
                                              '/', substr(cast(ts AS string), 1, 4), substr(cast(ts AS string), 11, 9))
            WHEN event_id % 4 = 2 THEN replace(substr(cast(ts AS string), 1, 10), '-', '/')
            ELSE substr(cast(ts AS string), 1, 16) END AS session_date,
       CASE WHEN event_id % 89 = 0 THEN '' ELSE substr(cast(ts AS string), 1, 19) END AS session_datetime,
       CASE WHEN event_id % 101 = 0 THEN 'bad' WHEN event_id % 103 = 0 THEN '-5' WHEN event_id % 83 = 0 THEN ''
            ELSE concat(cast(value AS string), ' ') END AS minutes,
       CASE WHEN event_id % 113 = 0 THEN '' ELSE concat('T', lpad(cast(event_id % 50 AS string), 5, '0')) END
           AS tutor_id,
       props AS note
FROM {events}
"""

MESSY_ROSTER = """
SELECT c_custkey + 2 AS row_num,
       CASE WHEN c_custkey % 113 = 0 THEN ' ' ELSE concat(lpad(cast(c_custkey AS string), 10, '0'), ' ') END
           AS student_number,
       CASE WHEN c_custkey % 127 = 0 THEN '' ELSE lpad(cast(c_nationkey % 5 AS string), 7, '0') END AS district_id,
       concat(' District ', cast(c_nationkey % 5 AS string)) AS district_name,
       lpad(cast(c_nationkey AS string), 6, '0') AS school_id,
       concat('School ', cast(c_nationkey AS string), ' ') AS school_name,
       CASE WHEN c_custkey % 41 = 0 THEN '3.5' WHEN c_custkey % 43 = 0 THEN '15' WHEN c_custkey % 47 = 0 THEN 'grade 4'
            WHEN c_custkey % 53 = 0 THEN '' WHEN c_custkey % 14 = 0 THEN 'Pre-K' WHEN c_custkey % 14 = 1 THEN ' k '
            WHEN c_custkey % 14 = 2 THEN '1.0' ELSE cast(c_custkey % 14 - 1 AS string) END AS current_grade_level,
       CASE WHEN c_custkey % 6 = 5 THEN 'Nonbinary' ELSE ' ' END AS gender,
       CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE '' END AS sex,
       concat(c_mktsegment, ' ', cast(c_nationkey % 3 AS string)) AS ethnicity,
       CASE c_custkey % 9 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' no' WHEN 2 THEN 'Y' WHEN 3 THEN 'maybe' WHEN 4 THEN 'Unknown'
            WHEN 5 THEN 'N/A' WHEN 6 THEN '' WHEN 7 THEN 'f' ELSE 'Declined to provide' END AS english_learner,
       CASE c_custkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '2' WHEN 3 THEN 'Yes' ELSE 'False' END AS iep,
       CASE c_custkey % 2 WHEN 0 THEN 'T' ELSE 'N' END AS free_reduced_lunch,
       CASE WHEN c_custkey % 61 = 0 THEN 'bad' WHEN c_custkey % 67 = 0 THEN '7e2' WHEN c_custkey % 71 = 0 THEN 'nan'
            WHEN c_custkey % 73 = 0 THEN '' ELSE concat(' ', cast(650 + (c_custkey * 37) % 120 AS string), '.5') END
           AS ela_state_score_current_year,
       CASE WHEN c_custkey % 79 = 0 THEN 'inf' WHEN c_custkey % 59 = 0 THEN '3d'
            ELSE cast(650 + (c_custkey * 53) % 120 AS string) END AS math_outcome_score_current_year,
       CASE WHEN c_custkey % 37 = 0 THEN '' ELSE concat('Level ', cast(c_custkey % 4 + 1 AS string)) END
           AS performance_level_current_year,
       c_name AS homeroom
FROM {customer}
"""

SESSION_COLUMN_MAP = {"Learner_ID": "student_id", "topic": "session_topic", "minutes": "session_duration"}
ROSTER_COLUMN_MAP = {" Student_Number ": "student_id"}

_TABLES = {
    "sessions": (SESSIONS, ("events",)),
    "roster": (ROSTER, ("customer", "nation", "region")),
    "messy_sessions": (MESSY_SESSIONS, ("events",)),
    "messy_roster": (MESSY_ROSTER, ("customer",)),
}


@lru_cache(maxsize=64)
def _schema(path: str) -> T.StructType:
    """Read from the file footers once per folder; the tables of a folder do not change shape."""
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the four tables over the Parquet files in a folder."""
    select, bases = _TABLES[name]
    return spark.sql(select, **{base: table(spark, sf_dir, base) for base in bases})


def sql(name: str) -> str:
    """The same SELECT over tables registered under their own names."""
    select, bases = _TABLES[name]
    return select.format(**{base: base for base in bases})


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sessions")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "roster")
