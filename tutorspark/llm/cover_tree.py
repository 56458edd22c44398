"""Embedding near-duplicates by dual traversal of cover trees.

Vectors of one label lie on the unit sphere, where cosine c is distance sqrt(2 - 2c).  The upper
level of a label's tree are cells: its vectors by the nearest of some pivots, in parts that one task can
hold.  Each part has a cover tree of nested levels: the radius of a level's nodes is half that of the
level above, a node's centre is also the centre of one of its children, and each node knows how far
its farthest member really is.  Two trees are walked together.  A pair of nodes is left when their
centres are farther apart than both covering radii and the threshold together, first for whole
cells, then level by level; the pairs of points that remain are compared exactly.  Equal vectors
are one point with a multiplicity, and a task reports counts and a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorspark.llm.arrow_text import spread
from tutorspark.llm.components import components, forest
from tutorspark.llm.storage import keep

CELL_ROWS = 1024
#: Pivots of a label, and labels that get any: together the bound of what is sent to all tasks.
#: A label without pivots is cut into parts by a hash, which prunes less and finds the same.
PIVOTS = 32
PIVOT_LABELS = 128
#: Radii of the levels below a root of radius 2; below the last, points.
RADII = (1.0, 0.5, 0.25, 0.125)
ROUNDING = 1e-7
#: Pairs cost so much more one by one than as part of a whole product.
DENSE = 8
PAIRS_AT_ONCE = 1 << 16


@dataclass
class Level:
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


class CoverTree:
    """Levels of nodes over unit vectors, each a centre point, a covering radius and its children."""

    def __init__(self, points: np.ndarray):
        self.points = points
        members = [np.arange(len(points))]
        centres = [0]
        self.levels: list[Level] = []
        for radius in (*RADII, 0.0):
            reach = [np.sqrt(max(0.0, 2 - 2 * (points[m] @ points[c]).min())) for c, m in zip(centres, members, strict=True)]
            split = [self._children(points, c, m, radius) for c, m in zip(centres, members, strict=True)]
            count = np.array([len(s) for s in split])
            self.levels.append(Level(np.array(centres), np.array(reach), np.cumsum(count) - count, count))
            centres = [c for s in split for c, _ in s]
            members = [m for s in split for _, m in s]
        self.levels.append(Level(np.array(centres), np.zeros(len(centres)), np.zeros(0, int), np.zeros(0, int)))

    @staticmethod
    def _children(points: np.ndarray, centre: int, members: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
        """Members dealt to centres more than the radius apart, the node's own centre first.

        A centre is compared with the members that no earlier one has taken, and with nothing else.
        """
        if len(members) == 1:
            return [(centre, members)]
        if radius == 0.0:
            return [(m, np.array([m])) for m in members.tolist()]
        least, left, found = 1 - radius * radius / 2, members, []
        while len(left):
            head = centre if not found else int(left[0])
            inside = points[left] @ points[head] >= least
            inside |= left == head
            found.append((head, left[inside]))
            left = left[~inside]
        return found


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the points i of one matrix and j of another: one by one where few of all pairs are wanted."""
    rows, x = np.unique(i, return_inverse=True)
    columns, y = np.unique(j, return_inverse=True)
    if len(i) * DENSE >= len(rows) * len(columns):
        return (a[rows] @ b[columns].T)[x, y]
    found = np.empty(len(i))
    for first in range(0, len(i), PAIRS_AT_ONCE):
        part = slice(first, first + PAIRS_AT_ONCE)
        found[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]])
    return found


def near_points(a: CoverTree, b: CoverTree, reach: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of two trees that the bounds cannot tell apart; of one tree (same), each pair once."""
    i = j = np.zeros(1, np.int64)
    for left, right in zip(a.levels, b.levels, strict=True):
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * _dots(a.points, left.centre[i], b.points, right.centre[j])))
        open_ = apart <= left.radius[i] + right.radius[j] + reach + ROUNDING
        i, j = i[open_], j[open_]
        if left is a.levels[-1]:
            if same:
                i, j = i[i != j], j[i != j]
            return left.centre[i], right.centre[j]
        pair, nth = spread(left.children[i] * right.children[j])
        width = right.children[j][pair]
        i, j = left.child[i][pair] + nth // width, right.child[j][pair] + nth % width
        if same:
            # Each pair is walked in one order only: that of the nodes in their level.
            upper = i <= j
            i, j = i[upper], j[upper]
    raise AssertionError("unreachable")


def _unit(raw: np.ndarray) -> np.ndarray:
    # The largest component first, so that the norm of a large vector does not overflow.
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _finite(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _pivots(points: DataFrame, groups: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Pivots of the largest labels that do not fit one cell, as many as it needs cells: at most
    PIVOT_LABELS * PIVOTS vectors."""
    large = groups.filter(F.col("rows") > CELL_ROWS).orderBy(F.desc("rows"), "label", "dim").limit(PIVOT_LABELS)
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    share = F.lit(4.0 * PIVOTS * (1 << 30)) / F.col("rows")
    drawn = points.join(large, ["label", "dim"]).withColumn("h", draw).filter(F.col("h") < share)
    place = F.row_number().over(Window.partitionBy("label", "dim").orderBy("h", "node"))
    wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("rows") / CELL_ROWS))
    chosen = drawn.withColumn("place", place).filter(F.col("place") <= PIVOTS).filter(F.col("place") <= wanted).select("label", "dim", "embedding")
    found: dict[tuple[int, int], list] = {}
    for row in chosen.collect():
        found.setdefault((row.label, row.dim), []).append(row.embedding)
    return {key: _unit(np.array(vectors, np.float64)) for key, vectors in sorted(found.items())}


def _nearest_pivot(points: DataFrame, pivots: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """Add ``pivot``, the number of the nearest one."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            nearest = np.zeros(batch.num_rows, np.int32)
            for (one, width), centres in pivots.items():
                rows = np.flatnonzero((label == one) & (dim == width))
                if len(rows):
                    vectors = _unit(_matrix(batch.column("embedding").take(pa.array(rows)), width))
                    nearest[rows] = (vectors @ centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], [*batch.schema.names, "pivot"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(kernel, f"{schema}, pivot int")


def _pack_cell(table: pa.Table) -> pa.Table:
    """One row for a cell: its centre and radius, and its vectors, node ids and multiplicities as bytes."""
    width = table.column("dim")[0].as_py()
    order = np.argsort(table.column("node").to_numpy())
    raw = _matrix(table.column("embedding").combine_chunks(), width)[order]
    unit = _unit(raw)
    mean = unit.mean(axis=0)
    centre = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 0 else unit[0]
    radius = float(np.sqrt(np.maximum(0.0, 2 - 2 * (unit @ centre).min())))
    return pa.table(
        {
            "label": table.column("label")[:1],
            "dim": table.column("dim")[:1],
            "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
            "radius": pa.array([radius]),
            "vectors": pa.array([raw.tobytes()], pa.binary()),
            "nodes": pa.array([table.column("node").to_numpy()[order].tobytes()], pa.binary()),
            "times": pa.array([table.column("times").to_numpy()[order].tobytes()], pa.binary()),
        }
    )


def _compare(batches: Iterable[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Links of two cells: of each linked node how many vectors it links to, and a smaller node of its
    component."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    trees: dict[int, tuple] = {}

    def tree(row: dict, side: str) -> tuple:
        cell = row[f"cell_{side}"]
        if cell not in trees:
            if len(trees) >= 8:
                trees.clear()
            raw = np.frombuffer(row[f"vectors_{side}"], np.float64).reshape(-1, row["dim"])
            nodes, times = (np.frombuffer(row[f"{name}_{side}"], np.int64) for name in ("nodes", "times"))
            trees[cell] = CoverTree(_unit(raw)), raw, nodes, times
        return trees[cell]

    for batch in batches:
        for n in range(batch.num_rows):
            (row,) = batch.slice(n, 1).to_pylist()
            same = row["cell_a"] == row["cell_b"]
            (left, x, nodes_a, times_a), (right, y, nodes_b, times_b) = tree(row, "a"), tree(row, "b")
            i, j = near_points(left, right, reach, same)
            linked = exact_cosine(x, y, i, j) >= cosine
            i, j = i[linked], j[linked]
            shift = 0 if same else len(nodes_a)
            nodes = nodes_a if same else np.r_[nodes_a, nodes_b]
            count = np.zeros(len(nodes), np.int64)
            np.add.at(count, i, times_b[j])
            np.add.at(count, j + shift, times_a[i])
            root = forest(len(nodes), i, j + shift)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(count[some]), pa.array(nodes[root[some]])], ["node", "links", "root"])


def exact_cosine(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, portion: int = 1 << 17) -> np.ndarray:
    """Cosine of rows x[i] and y[j] in double precision."""

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a = a / np.abs(a).max(axis=1, keepdims=True)
        b = b / np.abs(b).max(axis=1, keepdims=True)
        return np.einsum("nk,nk->n", a, b) / np.sqrt(np.einsum("nk,nk->n", a, a) * np.einsum("nk,nk->n", b, b))

    pieces = [part(x[i[n : n + portion]], y[j[n : n + portion]]) for n in range(0, len(i), portion)]
    return np.concatenate(pieces) if pieces else np.zeros(0)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two rows are linked when their labels are equal and not NULL, their vectors equally long, and
    their cosine is at least ``cosine``.  n_links counts the other rows linked directly,
    component_id is the smallest id reachable by links, and kept says whether that is the row's own.
    A vector that is NULL, empty, zero or holds NULL or non-finite components links with nothing;
    nor does a row without label.  Equal vectors are linked, so repeated rows are links of one
    another.  A NULL id is never the smallest; a row alone with one has component NULL and is not kept.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    fit = rows.filter(F.col("label").isNotNull() & _finite(F.col("embedding")))
    points = fit.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("times"))
    # Numbers are given before the table is written, and read from it ever after.
    points = keep(points.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()))
    groups = keep(points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows")))
    placed = keep(_nearest_pivot(points.drop("least_id"), _pivots(points, groups)))
    sizes = placed.groupBy("label", "dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    parted = placed.join(keep(sizes), ["label", "dim", "pivot"]).withColumn("part", part)
    kind = vectors.schema[label].dataType.simpleString()
    cells = parted.groupBy("label", "dim", "pivot", "part").applyInArrow(
        _pack_cell, f"label {kind}, dim int, centre array<double>, radius double, vectors binary, nodes binary, times binary"
    )
    cells = keep(cells.withColumn("cell", F.monotonically_increasing_id()))

    def side(name: str, *columns: str) -> DataFrame:
        return cells.select("label", "dim", *[F.col(c).alias(f"{c}_{name}") for c in columns])

    dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + ROUNDING
    pairs = side("a", "cell", "centre", "radius").join(side("b", "cell", "centre", "radius"), ["label", "dim"])
    pairs = pairs.filter((F.col("cell_a") <= F.col("cell_b")) & (apart <= F.col("radius_a") + F.col("radius_b") + reach))
    pairs = pairs.select("cell_a", "cell_b", "dim")
    for name in ("a", "b"):
        pairs = pairs.join(side(name, "cell", "vectors", "nodes", "times").drop("label", "dim"), f"cell_{name}")
    pairs = pairs.repartition("cell_a", "cell_b")
    found = keep(pairs.mapInArrow(lambda batches: _compare(batches, cosine), "node long, links long, root long"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = points.select("label", "embedding", "node", "least_id", "times").join(links, "node", "left").join(roots, "node", "left")
    named = keep(named.withColumn("root", F.coalesce("root", "node")))
    least = keep(named.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = keep(
        named.join(least, "root").select(
            "label", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")
        )
    )
    # A vector may have any number of copies: both sides are plain exchanges, which Spark can split.
    result = rows.join(named.withColumn("_found", F.lit(True)), ["label", "embedding"], "left")
    component = F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("vec_id"))
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
