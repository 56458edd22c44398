"""Cover trees against all pairs."""

import numpy as np
import pytest

from tutorspark.llm import cover_tree
from tutorspark.llm.queries import llm_queries


def plain(rows, cosine=0.93):
    """(id, links, component, kept) of rows (id, vector, label), from all pairs."""
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    fit = []
    for _, vector, label in rows:
        fine = label is not None and vector is not None and len(vector) > 0 and all(x is not None and np.isfinite(x) for x in vector)
        fit.append(np.array(vector, float) if fine and any(vector) else None)
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = fit[i], fit[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                group[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    result = []
    for i, row in enumerate(rows):
        component = least.get(find(i))
        result.append((row[0], links[i], component, row[0] is not None and row[0] == component))
    return sorted(result, key=str)


def found(df, **more):
    return sorted([tuple(r) for r in cover_tree.near_duplicates(df, **more).collect()], key=str)


def clouds(seed, n, width=6):
    """Points around a few directions, some equal, some multiples of one another."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    vectors = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, width)) * rng.choice([0.02, 0.2, 1.0], size=(n, 1))
    vectors[: n // 4] = vectors[rng.integers(n // 4, n, n // 4)]
    vectors[: n // 8] *= 3
    return [(int(k), [float(np.float32(x)) for x in v], int(rng.integers(0, 3))) for k, v in enumerate(vectors)]


ODD = [
    (900, None, 0),
    (901, [], 0),
    (902, [0.0] * 6, 0),
    (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0),
    (904, [float("nan")] + [1.0] * 5, 0),
    (905, [float("inf")] + [1.0] * 5, 0),
    (906, [1.0, 0.0], 0),
    (907, [2.0, 0.0], 0),
    (908, [1.0, 0.0], None),
    (909, [-0.0, 1.0], 1),
    (910, [0.0, 1.0], 1),
    (910, [0.0, 1.0], 1),
    (None, [0.0, 1.0], 1),
    (None, [0.5, -1.0], 2),
    (911, [1e30, 1e30], 2),
    (912, [1e-30, 1e-30], 2),
]
SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("cell_rows", [1024, 16])
def test_clouds(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(cover_tree, "CELL_ROWS", cell_rows)
    rows = clouds(1, 400) + ODD
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id AS node", "'x' AS root").repartition(5)
    assert found(df) == plain(rows)


@pytest.mark.parametrize("cosine", [0.0, 0.999, 1.0])
def test_other_thresholds(spark, cosine):
    rows = clouds(2, 150)
    rows = [r for r in rows if r[0] >= 150 // 8] if cosine == 1.0 else rows
    got = found(spark.createDataFrame(rows, SCHEMA), cosine=cosine)
    if cosine < 1:
        assert got == plain(rows, cosine)
    assert {r[0] for r in got} == {r[0] for r in rows}


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted([tuple(r) for r in llm_queries()["op7_cover_tree"](spark, sf_dir).collect()], key=str) == plain(rows)


def test_empty(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert found(spark.createDataFrame([(1, None, None)], SCHEMA)) == [(1, 0, 1, True)]


@pytest.mark.parametrize("width", [2, 16])
def test_tree(width):
    rng = np.random.default_rng(width)
    points = cover_tree._unit(np.r_[rng.normal(size=(120, width)), np.repeat(rng.normal(size=(3, width)), 10, axis=0)])
    tree = cover_tree.CoverTree(points)
    assert sorted(tree.levels[-1].centre.tolist()) == list(range(len(points)))
    for depth, (level, below) in enumerate(zip(tree.levels, tree.levels[1:])):
        radius = (2.0, *cover_tree.RADII)[depth]
        assert (level.radius <= radius + 1e-9).all()
        for node in range(len(level.centre)):
            kids = slice(level.child[node], level.child[node] + level.children[node])
            # Nested: the node's centre goes on; covering: no centre below is farther than the radius.
            assert level.centre[node] in below.centre[kids]
            apart = np.sqrt(np.maximum(0, 2 - 2 * points[below.centre[kids]] @ points[level.centre[node]]))
            assert (apart <= level.radius[node] + 1e-7).all()


@pytest.mark.parametrize("same", [True, False])
def test_traversal_loses_no_pair(same):
    rng = np.random.default_rng(7)
    a = cover_tree._unit(rng.normal(size=(150, 3)))
    b = a if same else cover_tree._unit(rng.normal(size=(130, 3)))
    one = cover_tree.CoverTree(a)
    two = one if same else cover_tree.CoverTree(b)
    i, j = cover_tree.near_points(one, two, 0.3, same)
    got = set(zip(i.tolist(), j.tolist()))
    apart = np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))
    want = {(x, y) for x in range(len(a)) for y in range(len(b)) if apart[x, y] <= 0.3 and (not same or x < y)}
    if same:
        got = {(min(p), max(p)) for p in got} | {(x, y) for y, x in got if x < y}
    assert want <= got and len(got) < 0.5 * len(a) * len(b)
