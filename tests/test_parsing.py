"""P3, P5-P9 cell by cell."""

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tutorspark.functions import parsing
from tutorspark.functions.text import clean, to_tenths


def apply(table, values, *exprs):
    df = table([(i, v) for i, v in enumerate(values)], "i int, raw string")
    cleaned = df.select("i", clean("raw").alias("c"))
    return rows(cleaned.select("i", *(e("c") for e in exprs)).orderBy("i").drop("i"))


def test_clean_trims_every_kind_of_space_and_blanks_become_null(table):
    values = [" a b ", "\t x　\n", "", "   ", None, "0"]
    assert apply(table, values, F.col) == [("a b",), ("x",), (None,), (None,), (None,), ("0",)]


def test_flags(table):
    values = ["TRUE", " yes", "1", "false", "N", "declined to provide", "N/A", None, "maybe"]
    assert apply(table, values, parsing.flag, parsing.flag_is_valid) == [
        (True, True), (True, True), (True, True), (False, True), (False, True),
        (None, True), (None, True), (None, True), (None, False),
    ]


def test_grades(table):
    values = ["K", "Pre-K", "3.0", "3.5", "-1", "inf", "grade 4", None, "1e1", "99999999999"]
    assert apply(table, values, parsing.grade, parsing.grade_is_valid) == [
        (0, True), (-1, True), (3, True), (3, False), (-1, True),
        (None, False), (None, False), (None, True), (10, True), (None, False),
    ]


def test_numbers(table):
    values = ["7.5", " 3 ", ".5", "5.", "1e3", "-2", "bad", "3d", "nan", "inf", "1e999", None]
    assert apply(table, values, parsing.number, parsing.number_is_valid) == [
        (7.5, True), (3.0, True), (0.5, True), (5.0, True), (1000.0, True), (-2.0, True),
        (None, False), (None, False), (None, False), (None, False), (None, False), (None, True),
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-01-10 09:00:00", datetime(2026, 1, 10, 9)),
        ("2026-01-10", datetime(2026, 1, 10)),
        ("2026-1-5 9:30", datetime(2026, 1, 5, 9, 30)),
        ("2026/01/10 09:05:06", datetime(2026, 1, 10, 9, 5, 6)),
        ("1/5/2026", datetime(2026, 1, 5)),
        ("01/05/2026 23:59:59", datetime(2026, 1, 5, 23, 59, 59)),
        ("20260105", datetime(2026, 1, 5)),
        ("1/5/2026 9:00 PM", datetime(2026, 1, 5, 21)),
        ("2026-01-10T09:00:00", datetime(2026, 1, 10, 9)),
        ("not-a-date", None),
        ("13/13/2026", None),
        ("2026-02-30", None),
    ],
)
def test_datetimes(table, text, expected):
    assert apply(table, [text], parsing.timestamp, parsing.timestamp_is_valid) == [(expected, expected is not None)]


def test_topics(table):
    values = ["Mathematics", "reading", " MATH", "English Language Arts", "Science ", None]
    assert apply(table, values, parsing.topic, parsing.topic_is_valid) == [
        ("math", True), ("ela", True), ("math", True), ("ela", True), ("science", False), (None, True),
    ]


def test_printed_tenths_round_the_exact_number(table):
    values = [6.25, 18.75, 0.35, 0.25, 0.05, 0.15, 33.333, 100.0, 12.349999, 2.675, 62.5, 0.45, 1.05]
    df = table([(v,) for v in values], "v double")
    got = [r[0] for r in rows(df.select(F.format_string("%.1f", to_tenths(F.col("v")))))]
    assert got == [f"{v:.1f}" for v in values]
