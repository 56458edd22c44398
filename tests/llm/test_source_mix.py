"""Mixing on odd tables; the whole query is compared with SQL elsewhere."""

import pytest
from llm.test_bin_packing import words
from llm.test_pipeline import plain_copies

from tutorspark.llm import source_mix


def check(df, rows):
    """rows: (id, text, source)."""
    plan = source_mix.mix_plan(df).collect()
    copies = plain_copies(rows)
    got = sorted(((r.doc_id, r.source, r.size, r.copies) for r in plan if r.source_size > 0), key=str)
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + words(text)
    want = sorted(((d, s, words(t), copies[d, t, s]) for d, t, s in rows if size[s] > 0), key=str)
    assert got == want
    assert sum({r.source: r.target for r in plan}.values()) == pytest.approx(sum(size.values()))
    for r in plan:
        assert r.taken == r.copies * r.size <= 3 * r.size and r.source_size == size[r.source]
    mixed = source_mix.mix(df)
    assert mixed.columns == df.columns
    want = sorted(str((d, t, s)) for d, t, s in rows for _ in range(copies[d, t, s] if size[s] else 1))
    assert sorted(str((r.doc_id, r.text, r.source)) for r in mixed.collect()) == want
    return plan


def test_documents(spark, documents):
    df, rows = documents
    check(df, [(r[0], r[1], r[3]) for r in rows])


def test_a_hot_source_and_small_ones(spark):
    rows = [(n, "w " * (n % 7), "hot" if n % 3 else f"s{n % 11}") for n in range(900)]
    rows += [(5000 + n, "one two", f"tiny{n}") for n in range(4)] + [(6000, "", "empty"), (6001, None, "empty"), (6002, "x", None)]
    plan = check(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9), rows)
    longest = max(r.size for r in plan)
    taken = {}
    for r in plan:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[r.source] - r.target) <= longest for r in plan)


@pytest.mark.parametrize("hot", ["a third without id", "one id for all"])
def test_shared_ids_draw_one_by_one(spark, hot):
    """Sources come as near to their targets as with ids of their own."""
    rows = [(None if n % 3 == 0 else n, f"{n} " + "w " * (n % 40), f"s{n % 4}") for n in range(6000)]
    if hot == "one id for all":
        rows = [(7, text, source) for _, text, source in rows]
    plan = check(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7), rows)
    taken = {}
    for r in plan:
        taken[r.source, r.target] = taken.get((r.source, r.target), 0) + r.taken
    assert all(abs(words_ / target - 1) < 0.01 for (_, target), words_ in taken.items())


def test_own_columns_are_kept(spark):
    rows = [(n, "a b c", "s", n, n, n, "x", n) for n in range(50)] + [(60, "a " * 900, "t", 60, 60, 60, "x", 60)]
    names = "doc_id long, text string, source string, _h long, _target long, `a.b` long, Text string, _copies long"
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame(rows, names)
        mixed = source_mix.mix(df).collect()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert mixed and all(r["_h"] == r["_target"] == r["a.b"] == r["_copies"] == r["doc_id"] and r["Text"] == "x" for r in mixed)


def test_budgets_are_nested(spark):
    """What a smaller budget takes, a larger one takes, too."""
    rows = [(f"d{n}", "s", (n * 37) % 50 + 1, n * 2654435761 % (1 << 36)) for n in range(500)]
    df = spark.createDataFrame(rows, "doc_id string, source string, size long, h long")
    total, before = sum(r[2] for r in rows), -1
    for share in (0.0, 0.01, 0.3, 0.31, 0.99):
        budget = spark.createDataFrame([("s", total * share)], "source string, budget double")
        ((source, threshold),) = source_mix.thresholds(df, budget).collect()
        taken = sum(r[2] for r in rows if r[3] <= threshold)
        assert abs(taken - total * share) <= 25 and threshold >= before
        before = threshold


def test_only_spark_runs(spark, plan_of, documents):
    df, _ = documents
    plan = plan_of(source_mix.mix_plan(df)) + plan_of(source_mix.mix(df))
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_empty(no_documents):
    assert source_mix.mix_plan(no_documents).collect() == []
    assert source_mix.mix(no_documents).collect() == []


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target, r.source_size) for r in source_mix.mix_plan(df).collect()] == [(0, 0.0, 0)] * 2
    assert source_mix.mix(df).count() == 2
