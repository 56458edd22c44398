"""Exact top-k by inner product over an impact-ordered index, score at a time.

The index is cut into shards that one task can hold.  A shard's postings (a vector's value in one
dimension) are quantised and ordered by falling impact, so segments of one level and dimension lie
together.  A search adds up segments from the highest level down, for a block of queries at a time.
What it has not added to a vector yet, and what quantising took away, is a rest vector of known length, so
the true score lies within the query's length times the rest's length of the sum.  Vectors whose upper
bound reaches the k-th best lower bound are possible members.  The search stops early only when these
are few, and always scores every possible member exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorspark.llm import wide_scores
from tutorspark.llm.storage import keep

SHARD_ROWS = 4096
BLOCK_QUERIES = 256
LEVELS = 64
#: Bounds are looked at when a level of this list is done; the last is the end.
STOPS = (32, 16, 8, 4, 2, 1)
#: A block stops early once no query has more possible members than this many times k.
FEW = 4
SCALE = 1024
#: What rounding can add to or take from a sum, as a share of the product of the lengths.
ROUNDING = 1e-11
VECTORS, QUERIES = 0, 1


def usable(vector: str) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def as_floats(values: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles; if some are very large, all in units of a power of two, as bounds need no more."""
    if values.dtype != object:
        return values.astype(np.float64)
    bits = max((int(v).bit_length() for v in values.ravel()), default=0)
    unit = 1 << max(bits - 400, 0)
    return np.array([int(v) / unit for v in values.ravel()], dtype=np.float64).reshape(values.shape)


def build_shard(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a matrix of values: postings in falling order of their level, the end of each level's postings
    (from the highest level down), and the rest lengths of every vector after each level."""
    values = as_floats(values)
    size = np.abs(values)
    width = max(size.max(initial=0.0), 1.0) / LEVELS
    level = np.ceil(size / width).astype(np.int64)
    impact = np.sign(values) * (level - 0.5) * width
    # Within a level by dimension, so that a segment is one stretch.
    dimension = np.broadcast_to(np.arange(values.shape[1]), values.shape)
    order = np.lexsort((dimension.ravel(), -level.ravel()))
    order = order[level.ravel()[order] > 0].astype(np.int32)
    ends = np.searchsorted(-level.ravel()[order], -np.arange(LEVELS, 0, -1), side="right")
    rest = np.empty((LEVELS + 1, len(values)))
    rest[0] = np.sqrt((size * size).sum(axis=1))
    for n, one in enumerate(range(LEVELS, 0, -1), start=1):
        left = np.where(level >= one, values - impact, values)
        rest[n] = np.sqrt((left * left).sum(axis=1))
    return order, ends, rest


def search_shard(
    ids: np.ndarray, values: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, own: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and scores of the k best of each query, ties to the smaller id; ids must be sorted.

    Rows whose id is the query's own take no part.
    """
    order, ends, rest = index
    width = values.shape[1]
    signs = np.sign(as_floats(values))
    step = max(float(np.abs(as_floats(values)).max(initial=0.0)), 1.0) / LEVELS
    sums = np.zeros((len(values), len(queries)))
    rows, dimensions = np.divmod(order, max(width, 1))
    weights = as_floats(queries).T
    lengths = np.sqrt((weights * weights).sum(axis=0))
    reach = np.abs(as_floats(values)).max(initial=0.0) * np.abs(weights).max(initial=0.0) * width
    exact = np.int64 if values.dtype != object and queries.dtype != object and reach < wide_scores.FITS else object
    excluded = [slice(*np.searchsorted(ids, [one, one + 1])) for one in own.tolist()]
    begin = 0
    for level in range(LEVELS, 0, -1):
        end = int(ends[LEVELS - level])
        cuts = np.flatnonzero(np.diff(dimensions[begin:end])) + begin + 1
        impact = (level - 0.5) * step
        for a, b in zip(np.r_[begin, cuts].tolist(), np.r_[cuts, end].tolist(), strict=True):
            if a < b:
                segment, dimension = rows[a:b], int(dimensions[a])
                sums[segment] += signs[segment, dimension][:, None] * (impact * weights[dimension])
        begin = end
        if level in STOPS:
            # What is left out, and what rounding may have done.
            slack = (rest[LEVELS - level + 1] + ROUNDING * rest[0])[:, None] * lengths + 1.0
            low, high = sums - slack, sums + slack
            for n, rows_of in enumerate(excluded):
                low[rows_of, n] = high[rows_of, n] = -np.inf
            place = len(values) - k
            bar = np.partition(low, place, axis=0)[place] if place > 0 else np.full(len(queries), -np.inf)
            possible = (high >= bar) & (high > -np.inf)
            if level == STOPS[-1] or possible.sum(axis=0).max(initial=0) <= FEW * k:
                break
    for n in range(len(queries)):
        members = np.flatnonzero(possible[:, n])
        scores = values[members].astype(exact) @ queries[n].astype(exact)
        # Members are in the order of their ids, and a stable sort leaves equal scores so.
        best = np.argsort(-scores, kind="stable")[:k]
        yield members[best], scores[best]


def _floors(batch: pa.RecordBatch) -> np.ndarray:
    values = wide_scores.floors(batch.column("vector"), SCALE)
    return values.reshape(batch.num_rows, len(values) // batch.num_rows)


def _search(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best rows of each shard for the queries sent to it; a shard's vectors come first, and its index is built once."""
    key, parts, shard = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "kind")])
        cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            part, here = batch.slice(a, b - a), tuple(keys[:2, a].tolist())
            if here != key:
                key, parts, shard = here, [], None
            if keys[2, a] == VECTORS:
                parts.append((part.column("vec_id").to_numpy(), _floors(part)))
                continue
            if shard is None:
                if not parts:
                    continue
                ids, values = (np.concatenate(column) for column in zip(*parts, strict=True))
                ids, values = ids[by_id := np.argsort(ids, kind="stable")], values[by_id]
                parts, shard = [], (ids, values, build_shard(values))
            for first in range(0, part.num_rows, BLOCK_QUERIES):
                yield _answers(part.slice(first, BLOCK_QUERIES), *shard, k)


def _answers(block: pa.RecordBatch, ids: np.ndarray, values: np.ndarray, index: tuple, k: int) -> pa.RecordBatch:
    own, numbers = block.column("vec_id").to_numpy(), block.column("number").to_numpy()
    found = list(search_shard(ids, values, index, _floors(block), own, k))
    count = [len(rows) for rows, _ in found]
    score, digits = wide_scores.columns([s for _, scores in found for s in scores.tolist()])
    members = np.concatenate([ids[rows] for rows, _ in found])
    columns = [pa.array(np.repeat(numbers, count)), pa.array(np.repeat(own, count)), pa.array(members), score, digits]
    return pa.RecordBatch.from_arrays(columns, ["number", "query_id", "vec_id", "score", "digits"])


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every row whose id is divisible by ``every``.

    The score is the inner product of the vectors floor(1024 * x), ties go to the smaller id, and a row is
    no candidate for its own id; all candidates are returned if there are fewer than k.  Vectors that
    are NULL or hold NULL or non-finite components, and rows without id, take no part.  Vectors are
    compared with those of their own length only.  Components may be of any size: scores are whole numbers,
    ordered exactly, and shown as the end of the range where they are beyond a long.  Repeated rows are
    candidates each, and one query if their vectors are equal.  Other columns do not matter.

    A shard's vectors are shuffled once.  The stated queries are sent to every shard, row by row.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable("vector")).withColumn("dim", F.size("vector"))
    rows = keep(rows.withColumn("number", F.monotonically_increasing_id()))
    asked = keep(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "dim", "vector").agg(F.min("number").alias("number")))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"))
    sizes = keep(sizes.join(asked.select("dim").distinct(), "dim"))
    shard = F.pmod(F.xxhash64("number"), F.col("shards")).cast("int")
    columns = ["number", "vec_id", "vector"]
    placed = rows.join(sizes, "dim").select("dim", shard.alias("shard"), F.lit(VECTORS).alias("kind"), *columns)
    everywhere = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    sent = asked.join(sizes, "dim").select("dim", everywhere.alias("shard"), F.lit(QUERIES).alias("kind"), *columns)
    meeting = placed.union(sent).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = meeting.mapInArrow(lambda batches: _search(batches, k), "number long, query_id long, vec_id long, score long, digits string")
    best = Window.partitionBy("number").orderBy(*wide_scores.falling(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
