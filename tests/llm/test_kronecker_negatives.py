"""Hard negatives against brute force in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tutorspark.llm import kronecker_negatives as kn
from tutorspark.llm import wide_scores

SCHEMA = "vec_id long, label int, embedding array<double>, number int, shard string"


def plain(rows, positives=5, negatives=3, low=50, high=95, every=50):
    fine = []
    for vec_id, label, vector, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        fine.append((vec_id, label, tuple(math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256 for x in vector)))
    found = []
    for anchor in sorted({r for r in fine if r[0] % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r[1]) for r in fine if r[0] != anchor[0] and len(r[2]) == len(anchor[2]))
        for score, positive, _ in [s for s in scored if s[2] == anchor[1]][:positives]:
            inside = [s for s in scored if s[2] != anchor[1] and -low * score <= -100 * s[0] <= -high * score][:negatives]
            found += [(anchor[0], positive, n, s[1], -score, -s[0]) for n, s in enumerate(inside, 1)]
    return sorted(found)


def mined(df, **more):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    result = kn.hard_negatives(df, **more)
    assert result.columns == columns
    return sorted(tuple(r) for r in result.collect())


def drawn(n, seed, width=6):
    rng = random.Random(seed)
    # A third of the rows has one label, and many scores are equal.
    return [(i, 0 if rng.random() < 0.33 else rng.randrange(1, 5), [rng.choice([-0.5, -0.1, 0.0, 0.25, 0.3, 0.6]) for _ in range(width)], 1, "x") for i in range(n)]


@pytest.mark.parametrize("values", [24, 1 << 17])
def test_against_all_pairs(spark, monkeypatch, values):
    """With shards of four rows, too, and with what a table may hold."""
    monkeypatch.setattr(kn, "SHARD_VALUES", values)
    data = drawn(160, 1)
    data += [
        (None, 1, [0.5] * 6, 1, "x"), (1000, None, [0.5] * 6, 1, "x"), (1050, 1, None, 1, "x"), (1100, 1, [0.5] * 5 + [None], 1, "x"),
        (1150, 1, [0.5] * 5 + [float("nan")], 1, "x"), (1200, 1, [float("-inf")] + [0.5] * 5, 1, "x"), (1250, 1, [], 1, "x"), (1251, 1, [], 1, "x"),
        (1252, 2, [], 1, "x"), (1300, 1, [0.5] * 5, 1, "x"), (1301, 1, [0.5] * 5, 1, "x"), (1302, 2, [0.4] * 5, 1, "x"), (-50, 2, [0.6] * 6, 1, "x"),
    ]
    data += [data[50], data[50], data[51], (50, 3, [0.6] * 6, 1, "x")]
    assert mined(spark.createDataFrame(data, SCHEMA)) == plain(data)


def test_components_of_any_size(spark):
    """Scores that need more than 64 bits are ordered as whole numbers; the columns show the end of a long."""
    rng = random.Random(5)
    data = [(i, i % 2, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(0, 60, 7) + rng.random() for _ in range(4)], 1, "x") for i in range(120)]
    data += [(200 + i, i % 2, [rng.uniform(-9e5, 9e5) for _ in range(4)], 1, "x") for i in range(120)]
    cut = [(*r[:4], *(min(max(s, -(2**63)), 2**63 - 1) for s in r[4:])) for r in plain(data)]
    assert len(cut) > 10 and mined(spark.createDataFrame(data, SCHEMA)) == sorted(cut)


def test_products(monkeypatch):
    rng = np.random.default_rng(0)
    for largest, width in ((3, 1), (300, 64), (2**20, 7), (2**31, 5)):
        values = rng.integers(-largest, largest + 1, (50, width))
        shard = kn.Shard(np.arange(50), np.zeros(50), values)
        for anchor in rng.integers(-largest, largest + 1, (5, width)).tolist():
            assert shard.scores(anchor).tolist() == [sum(a * b for a, b in zip(anchor, row)) for row in values.tolist()]


def test_digits_keep_the_order():
    numbers = sorted(s * 10**p + d for s in (-1, 1) for p in (0, 18, 19, 30, 90) for d in range(-3, 4))
    cut, text = wide_scores.columns(numbers)
    pairs = list(zip(cut.to_pylist(), text.to_pylist()))
    assert pairs == sorted(pairs) and [wide_scores.number(*p) for p in pairs] == numbers


def test_settings(spark):
    data = drawn(120, 9)
    df = spark.createDataFrame([(*r[:3], 1, "x") for r in data], SCHEMA)
    got = mined(df, positives=2, negatives=5, band=(10, 100), every=20, label=F.col("label") + 0)
    assert got == plain(data, 2, 5, 10, 100, 20)
    renamed = df.toDF("my.id", "label", "embedding", "number", "shard")
    assert mined(renamed, id_col="my.id", positives=2, negatives=5, band=(10, 100), every=20) == got


def test_empty(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame(drawn(3, 1)[1:], SCHEMA)) == []
