"""Order statistics against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from tutorspark.operators import cohort, dosage, equity, ranking
from tutorspark.workload.queries import all_queries


@pytest.fixture(params=["full", "narrow"])
def path(request, monkeypatch):
    """Cells as they are, and so wide or narrow that every level has work to do."""
    if request.param == "narrow":
        monkeypatch.setattr(ranking, "COARSE_STEPS", 1)
        monkeypatch.setattr(ranking, "FINE_STEPS", 4)
        monkeypatch.setattr(ranking, "ROWS_PER_BLOCK", 5)
        monkeypatch.setattr(ranking, "CELL_STEPS", 2)
        monkeypatch.setattr(ranking, "SUMMARY_STEPS", 100)
    return request.param


def draw(n, seed):
    rng = random.Random(seed)
    # One value holds a third of the rows, one group more than half.
    return [("big" if rng.random() < 0.6 else rng.choice("abc"), 7.25 if rng.random() < 0.33 else round(rng.uniform(0, 90), 2)) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 997])
def test_quantiles_and_gini(table, path, n):
    data = [v for _, v in draw(n, n)]
    got = one(dosage.dosage_metrics(table([(v,) for v in data], "total_hours double"), 60.0))
    x = np.sort([v for v in data if v > 0])
    i = np.arange(1, len(x) + 1)
    assert [got["q25"], got["median_hours"], got["q75"]] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.75])))
    assert got["gini"] == pytest.approx(2 * (i * x).sum() / (len(x) * x.sum()) - (len(x) + 1) / len(x), abs=1e-12)


def test_group_quantiles(table, path):
    data = draw(1500, 3)
    got = {r.ethnicity: (r.avg_hours, r.median_hours, r.n) for r in equity.ethnicity_dosage(table(data, "ethnicity string, total_hours double")).collect()}
    frame = pd.DataFrame(data, columns=["g", "v"]).query("v > 0").groupby("g").v
    for g, (mean, median, n) in got.items():
        assert (mean, median, n) == pytest.approx((frame.mean()[g], frame.median()[g], frame.size()[g]))
    assert len(got) == 4


@pytest.mark.parametrize("window", [1, 2, 6, 7, 60])
def test_centred_rolling_sums(table, path, window):
    rng = random.Random(window)
    data = [(g, float(s), rng.randint(1, 9)) for g, k in (("ELA", 41), ("MATH", 4)) for s in rng.sample(range(500), k)]
    got = ranking.centred_rolling_sums(table(data, "g string, s double, n int"), "s", ["n"], window, ["g"])
    result = {(r.g, r.s): (r.rolling_n, r.window_rows) for r in got.collect()}
    assert len(result) == len(data)
    for g, part in pd.DataFrame(data, columns=["g", "s", "n"]).sort_values("s").groupby("g"):
        w = max(1, min(window, len(part)))
        expected = part.n.rolling(w, center=True, min_periods=1).sum()
        for s, value in zip(part.s, expected):
            assert result[(g, s)] == (value, w)


def test_ranked_values(table, path):
    data = [v for _, v in draw(400, 8)]
    got = sorted(rows(ranking.ranked_values(table([(v,) for v in data], "v double"), "v").select("v", "n", "before_n", "total_n")))
    counts = pd.Series(data).value_counts().sort_index()
    assert [r[0] for r in got] == list(counts.index)
    assert [r[1] for r in got] == list(counts)
    assert [r[2] for r in got] == list(counts.cumsum() - counts)
    assert {r[3] for r in got} == {400}


def test_cells_keep_the_order(table):
    rng = np.random.default_rng(3)
    values = np.unique(np.r_[rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 2.0 ** np.arange(-60, 60), np.nextafter(2.0 ** np.arange(-60, 60), 0)])
    df = table([(float(v),) for v in values], "v double").withColumns(ranking.cells("v"))
    got = [(r._coarse, r._fine) for r in df.orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) > 350


def test_a_group_without_a_name_is_a_group(table, path):
    data = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 2.0), (None, 1.0)]
    got = sorted(map(str, rows(ranking.ranked_values(table(data, "g string, v double"), "v", ["g"]).select("g", "v", "n", "before_n", "total_n"))))
    assert got == sorted(map(str, [(None, 1.0, 2, 0, 3), (None, 3.0, 1, 2, 3), ("a", 2.0, 2, 0, 2)]))


def test_building_a_frame_starts_no_job(spark, table):
    frame = table([(1.0, "x")], "total_hours double, ethnicity string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    dosage.dosage_metrics(frame)
    equity.ethnicity_dosage(frame)
    cohort.weighted_sample(frame, F.lit(1.0), 5)
    assert list(tracker.getJobIdsForGroup("build")) == []
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("k", [0, 1, 40, 120, 500])
def test_sample_has_the_exact_size(spark, path, k):
    df = spark.range(120).selectExpr("string(id) AS student_id", "0.1D + id % 4 AS w")
    sample = [r.student_id for r in cohort.weighted_sample(df, F.col("w"), k, seed=7).collect()]
    assert len(sample) == len(set(sample)) == min(k, 120)
    again = [r.student_id for r in cohort.weighted_sample(df.repartition(5), F.col("w"), k, seed=7).collect()]
    assert sorted(sample) == sorted(again)


@pytest.mark.parametrize("k", [1, 40, 89])
def test_sample_of_repeated_ids(spark, path, k):
    """Equal rows draw one by one, and partitioning does not show."""
    df = spark.range(90).selectExpr("CASE WHEN id % 3 > 0 THEN string(id % 3) END AS student_id", "id % 2 AS x")
    first, *others = (
        sorted(map(str, rows(cohort.weighted_sample(d, F.lit(1.0), k)))) for d in (df, df.repartition(7), df.repartition(2, "x"))
    )
    assert len(first) == k and all(first == other for other in others)


def test_missing_ids_have_their_share(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id % 10 > 0 THEN string(id) END AS student_id")
    fixed = [r.student_id for r in cohort.weighted_sample(df, F.lit(1.0), 300).collect()]
    assert len(fixed) == 300 and 15 <= fixed.count(None) <= 48
    free = [r.student_id for r in cohort.weighted_sample(df, F.lit(0.5), None).collect()]
    assert 430 <= len(free) <= 570 and 30 <= free.count(None) <= 70
    repeated = spark.range(1000).selectExpr("'same' AS student_id")
    assert 430 <= cohort.weighted_sample(repeated, F.lit(0.5), None).count() <= 570
    assert cohort.weighted_sample(repeated, F.lit(1.0), 123).count() == 123


def test_copies_are_written_in_runs(spark, monkeypatch):
    monkeypatch.setattr(cohort, "ROWS_PER_RUN", 7)
    df = spark.range(30).selectExpr("id % 2 AS x")
    got = sorted((r.x, r._copy) for r in cohort.numbered_copies(df, ["x"]).collect())
    assert got == [(x, n) for x in (0, 1) for n in range(15)]


def test_sample_weights_matter_and_degenerate_weights_do_not(spark):
    df = spark.range(4000).selectExpr("string(id) AS student_id", "CASE WHEN id < 2000 THEN 9.0D ELSE 1.0D END AS w")
    heavy = cohort.weighted_sample(df, F.col("w"), 400).filter("int(student_id) < 2000").count()
    assert 330 <= heavy <= 385
    for weight in (F.lit(0.0), F.lit(float("inf")), F.lit(-3.0)):
        even = cohort.weighted_sample(df, weight, 400).filter("int(student_id) < 2000").count()
        assert 160 <= even <= 240
    alone = cohort.weighted_sample(df, F.col("w") / 10, None)
    assert 1900 <= alone.count() <= 2100


@pytest.mark.parametrize("distinct", [3, 100_000])
def test_bracketed_quantiles(table, spark, distinct):
    """Groups of very different size and spread, one value in a third of the rows, every rank by numpy."""
    v = f"CASE WHEN id % 3 = 0 THEN -1.5D ELSE exp(((id * 7919) % {distinct}) / 9000.0D) - 20 END"
    df = spark.range(0, 300_000, 1, 7).selectExpr("CASE WHEN id < 50 THEN NULL WHEN id % 20 = 0 THEN 'small' ELSE 'big' END AS g", f"{v} AS v")
    wanted = {f"q{n}": p for n, p in enumerate((0.0, 1e-6, 0.01, 0.25, 0.5, 0.999, 1.0))}
    got = ranking.aggregate_with_quantiles(df, "v", ["g"], {"n": F.count("v"), "odd.name": F.max("v")}, wanted)
    assert got.columns == ["g", "n", "odd.name", *wanted]
    frame = df.toPandas()
    for row in got.collect():
        values = frame.v[frame.g.isna() if row.g is None else frame.g == row.g]
        assert row.n == len(values) and row["odd.name"] == values.max()
        assert [row[name] for name in wanted] == pytest.approx([np.quantile(values, p) for p in wanted.values()], rel=1e-12)
    (whole,) = ranking.aggregate_with_quantiles(df, "v", [], {}, wanted).collect()
    assert list(whole) == pytest.approx([np.quantile(frame.v, p) for p in wanted.values()], rel=1e-12)
    assert [r[0] for r in ranking.aggregate_with_quantiles(df.filter("v > 1e9"), "v", [], {}, {"a": 0.5}).collect()] == [None]


def stages_run(spark, query, sf_dir):
    spark.sparkContext.setJobGroup("stages", "stages")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("stages"))
    query(spark, sf_dir).collect()
    tracker = spark.sparkContext.statusTracker()
    jobs = set(tracker.getJobIdsForGroup("stages")) - before
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    return sum(1 for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks)


@pytest.mark.parametrize("name, most", [("A11_ethnicity_dosage", 12), ("A14_outcome_metrics", 12), ("A28_numeric_summary", 13), ("A35_dosage_moments", 12)])
def test_quantiles_take_few_stages(spark, name, most):
    """With the stages of the roll-up and the join below."""
    stages_run(spark, all_queries()[name], "/root/testdata/sf0.01")  # reads the footers, once a folder
    assert stages_run(spark, all_queries()[name], "/root/testdata/sf0.01") <= most
