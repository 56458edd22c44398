"""The impact-ordered index against scores of all rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tutorspark.llm import impact_index
from tutorspark.llm.queries import llm_queries

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=10, every=100, kind=np.float32):
    fit = []
    for vec_id, vector in rows:
        if vec_id is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            q = [math.floor(Fraction(float(kind(x))) * 1024) for x in vector]
            fit.append((vec_id, q))
    result = []
    for query, q in {(i, tuple(v)) for i, v in fit if i % every == 0}:
        scored = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in fit if i != query and len(v) == len(q)]
        result += [(query, rank, i, -score) for rank, (score, i) in enumerate(sorted(scored)[:k], start=1)]
    return sorted(result)


def found(df, **more):
    return sorted(tuple(r) for r in impact_index.top_k(df, **more).collect())


def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, width)) * rng.choice([0.001, 0.1, 1.0], size=(n, 1))
    values[: n // 3] = values[rng.integers(n // 3, n, n // 3)]
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(values)]


ODD = [
    (5000, None),
    (5100, [1.0, None, 0.0, 0.0, 0.0]),
    (5200, [float("nan")] + [0.5] * 4),
    (5300, [float("-inf")] + [0.5] * 4),
    (5400, []),
    (5401, []),
    (5500, [0.0] * 5),
    (5600, [0.5, -0.25]),
    (5601, [0.25, 3.0]),
    (5700, [1e9, -1e9, 0.0, 0.0, 1.0]),
    (5701, [2e5, 3e5, -1e5, 7.5, 1.0]),
    (None, [0.5] * 5),
    (5800, [0.125] * 5),
    (5800, [0.125] * 5),
    (-100, [0.3] * 5),
    (7, [0.3] * 5),
]


@pytest.mark.parametrize("shard_rows", [4096, 50])
def test_vectors(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(impact_index, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(impact_index, "BLOCK_QUERIES", 3)
    rows = vectors(0, 700, 5) + ODD
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "'x' AS number").repartition(6)
    assert found(df) == plain(rows)
    assert found(df, k=3, every=50) == plain(rows, 3, 50)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in llm_queries()["op6_impact_index"](spark, sf_dir).collect()) == plain(rows)


@pytest.mark.parametrize("size", [2e5, 1e12, 1e30])
def test_large_components(spark, monkeypatch, size):
    """Far beyond what a cut would leave; from 10^12 on scores need more than 64 bits."""
    monkeypatch.setattr(impact_index, "SHARD_ROWS", 90)
    rng = np.random.default_rng(7)
    values = rng.normal(size=(300, 8)) * size
    values[::7] *= 1e-6
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(values)] + [(300, [0.5] * 8)]
    cut = sorted((q, r, i, min(max(s, -(2**63)), 2**63 - 1)) for q, r, i, s in plain(rows, every=10, kind=float))
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10) == cut


def test_few_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(100, [0.5])], SCHEMA)) == []
    assert found(spark.createDataFrame([(100, [0.5]), (3, [0.5])], SCHEMA)) == [(100, 1, 3, 512 * 512)]


@pytest.mark.parametrize("stop", [1, 1000])
def test_early_stops_are_proven(monkeypatch, stop):
    """However early the search stops, the members are the same."""
    rng = np.random.default_rng(4)
    values = rng.integers(-900, 900, size=(600, 16)).astype(np.int32)
    queries = rng.integers(-900, 900, size=(20, 16)).astype(np.int32)
    ids = np.sort(rng.choice(10_000, 600, replace=False))
    own = np.r_[ids[:10], np.full(10, -1)]
    monkeypatch.setattr(impact_index, "FEW", stop)
    index = impact_index.build_shard(values)
    for n, (rows, scores) in enumerate(impact_index.search_shard(ids, values, index, queries, own, 10)):
        every = values.astype(np.int64) @ queries[n].astype(np.int64)
        order = [i for i in np.lexsort((ids, -every)) if ids[i] != own[n]][:10]
        assert rows.tolist() == order and scores.tolist() == every[order].tolist()


def test_rests_fall():
    values = np.random.default_rng(1).integers(-50, 50, size=(40, 7))
    order, ends, rest = impact_index.build_shard(values)
    assert (np.diff(ends) >= 0).all() and ends[-1] == len(order) == (values != 0).sum()
    assert (rest[-1] <= np.sqrt(7) * 50 / 64).all()
    assert np.allclose(rest[0], np.linalg.norm(values, axis=1))
