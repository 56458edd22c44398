"""Typed values from clean text.

Each parser takes the name of a text column that ``clean`` has been through and gives a value (bad
input is NULL, never an error); the matching ``*_is_valid`` counts NULL input as valid.  Parsers
name their input more than once, so clean it in a projection of its own: Catalyst keeps that
projection and the cleaning runs once per cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutorspark.functions.text import quoted

# Accepted spellings.
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")
UNKNOWN_WORDS = ("unknown", "declined", "declined to provide", "na", "n/a")
PRE_KINDERGARTEN_WORDS = ("pre-k", "prek", "prekindergarten", "pk")
KINDERGARTEN_WORDS = ("kindergarten", "kg", "k")
ELA_WORDS = ("ela", "english language arts", "english", "reading", "literacy")
MATH_WORDS = ("math", "mathematics", "mathematic", "maths")

MIN_GRADE, MAX_GRADE = -1, 12

# Spark's cast would also take "3d", "inf" and "nan".
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Accepted date shapes besides ISO and how each is rewritten to ISO; text of another shape passes.
_TO_ISO = (
    (r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})(?=\s|$)", "$1-$2-$3"),
    (r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})(?=\s|$)", "$3-$1-$2"),
    (r"^\s*(\d{4})(\d{2})(\d{2})\s*$", "$1-$2-$3"),
)


def _one_of(expression: str, *words: str) -> str:
    return f"{expression} IN ({', '.join(repr(w) for w in words)})"


def _number(c: str) -> str:
    value = f"try_cast(CASE WHEN {c} RLIKE r'{_NUMBER}' THEN {c} END AS double)"
    return f"nullif(nullif({value}, double('Infinity')), double('-Infinity'))"


def _timestamp(c: str) -> str:
    rewritten = c
    for shape, iso in _TO_ISO:
        rewritten = f"regexp_replace({rewritten}, r'{shape}', '{iso}')"
    twelve_hour = f"try_to_timestamp(upper({rewritten}), 'yyyy-M-d h:mm[:ss][ ]a')"
    return f"""coalesce(
        try_cast({c} AS timestamp_ntz),
        CAST(CASE WHEN lower(substring({c}, -1, 1)) = 'm' THEN {twelve_hour} END AS timestamp_ntz),
        try_cast({rewritten} AS timestamp_ntz))"""


def flag(name: str) -> Column:
    """P5: tri-state flag; NULL means unknown."""
    word = f"lower({quoted(name)})"
    return F.expr(
        f"CASE WHEN {_one_of(word, *TRUE_WORDS)} THEN true WHEN {_one_of(word, *FALSE_WORDS)} THEN false END"
    )


def flag_is_valid(name: str) -> Column:
    c = quoted(name)
    return F.expr(f"{c} IS NULL OR {_one_of(f'lower({c})', *TRUE_WORDS, *FALSE_WORDS, *UNKNOWN_WORDS)}")


def number(name: str) -> Column:
    """A finite double."""
    return F.expr(_number(quoted(name)))


def number_is_valid(name: str) -> Column:
    return F.expr(f"{quoted(name)} IS NULL OR {_number(quoted(name))} IS NOT NULL")


def typed_number(name: str, data_type: T.DataType) -> Column:
    """A column that should hold numbers as finite doubles, whatever its type."""
    cell = quoted(name)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.expr(f"CASE WHEN abs({cell}) < double('Infinity') THEN double({cell}) END")
    if isinstance(data_type, T.NumericType):
        return F.expr(f"double({cell})")
    return F.expr(_number(f"trim(string({cell}))"))


def grade(name: str) -> Column:
    """Grade as int, truncated toward zero when the text is not integral."""
    c = quoted(name)
    word = f"lower({c})"
    return F.expr(
        f"""CASE WHEN {_one_of(word, *PRE_KINDERGARTEN_WORDS)} THEN -1
                 WHEN {_one_of(word, *KINDERGARTEN_WORDS)} THEN 0
                 ELSE try_cast({_number(c)} AS int) END"""
    )


def grade_is_valid(name: str) -> Column:
    c = quoted(name)
    value = _number(c)
    words = _one_of(f"lower({c})", *PRE_KINDERGARTEN_WORDS, *KINDERGARTEN_WORDS)
    return F.expr(f"{c} IS NULL OR {words} OR coalesce({value} = try_cast({value} AS int), false)")


def topic(name: str) -> Column:
    """Subject aliases become ela/math, anything else is kept in lower case."""
    word = f"lower({quoted(name)})"
    return F.expr(
        f"""CASE WHEN {_one_of(word, *ELA_WORDS)} THEN 'ela'
                 WHEN {_one_of(word, *MATH_WORDS)} THEN 'math' ELSE {word} END"""
    )


def topic_is_valid(name: str) -> Column:
    c = quoted(name)
    return F.expr(f"{c} IS NULL OR {_one_of(f'lower({c})', *ELA_WORDS, *MATH_WORDS)}")


def timestamp(name: str) -> Column:
    """Date or datetime as wall-clock time, every row by its own format.

    ISO text is cast as it is.  Other shapes are rewritten to ISO, so that the same time-zone-free
    cast parses them; a twelve-hour clock is parsed by pattern.
    """
    return F.expr(_timestamp(quoted(name)))


def timestamp_is_valid(name: str) -> Column:
    return F.expr(f"{quoted(name)} IS NULL OR {_timestamp(quoted(name))} IS NOT NULL")
