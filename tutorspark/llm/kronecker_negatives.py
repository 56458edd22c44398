"""Hard negatives by Kronecker-packed products.

Rows are cut into shards of one label, or of several rare ones.  Of a shard, each dimension becomes one wide
integer whose fields hold the rows' components, biased so that none is negative.  An anchor's
component times that integer is the component times every row at once; summed over the dimensions, each field
holds a row's inner product with the anchor, plus what the biases add, and fields are wide enough that none
runs over into the next.  So scores are exact whatever the size of the components.

Two passes are needed, as the bands of negatives follow from the positives.  The first sends an anchor to
the shards that hold its label only, the second to all others; together they multiply each anchor with each
row once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorspark.llm import wide_scores
from tutorspark.llm.storage import keep

#: Components that a shard holds, so rows of a shard times the length of their vectors.
SHARD_VALUES = 1 << 17
SCALE = 256
ROWS, ANCHORS = 0, 1


class Shard:
    """Rows ready for products: ids in rising order, their labels, and the wide integers."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.bias = -int(values.min(initial=0))
        self.fields = values[order] + self.bias
        self.largest = int(self.fields.max(initial=0))
        self.bytes = 0

    def _pack(self, size: int) -> None:
        """One wide integer a dimension, its fields of ``size`` bytes; a row's field is at the row's place."""
        self.bytes = size
        columns = self.fields.T
        if size <= 8:
            raw = np.ascontiguousarray(columns).astype("<u8").view(np.uint8).reshape(*columns.shape, 8)
            self.words = [int.from_bytes(c.tobytes(), "little") for c in raw[:, :, :size]]
        else:
            self.words = [int.from_bytes(b"".join(int(v).to_bytes(size, "little") for v in c), "little") for c in columns]
        self.ones = int.from_bytes((b"\1" + bytes(size - 1)) * len(self.ids), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner product of each row with the anchor."""
        # What a field can reach on either side of zero; added to every field, none stays below zero.
        reach = sum(map(abs, anchor)) * self.largest
        size = max((2 * reach).bit_length() + 7, 8) // 8
        if size > self.bytes:
            self._pack(size)
        total = sum(map(mul, anchor, self.words), reach * self.ones)
        raw, offset = total.to_bytes(len(self.ids) * self.bytes, "little"), reach + self.bias * sum(anchor)
        if self.bytes < 8 and abs(offset) < wide_scores.FITS:
            fields = np.zeros((len(self.ids), 8), np.uint8)
            fields[:, : self.bytes] = np.frombuffer(raw, np.uint8).reshape(-1, self.bytes)
            return fields.view("<u8").ravel().astype(np.int64) - offset
        found = [int.from_bytes(raw[n : n + self.bytes], "little") - offset for n in range(0, len(raw), self.bytes)]
        return np.array(found, dtype=object)


def best(shard: Shard, scores: np.ndarray, members: np.ndarray, k: int) -> np.ndarray:
    """The k of the members with the highest scores, ties to the smaller id."""
    if len(members) > 4 * k:
        # Only members that reach the k-th highest score need sorting.
        bar = np.partition(scores[members], len(members) - k)[len(members) - k]
        members = members[scores[members] >= bar]
    return members[np.argsort(-scores[members], kind="stable")][:k]


def _floats(batch: pa.RecordBatch) -> np.ndarray:
    values = wide_scores.floors(batch.column("vector"), SCALE)
    return values.reshape(batch.num_rows, len(values) // batch.num_rows)


def meet(batches: Iterable[pa.RecordBatch], work: Callable[[Shard, dict, list[int]], list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Apply ``work`` to every anchor and the shard it was sent to; a shard's rows come first, then its anchors."""
    key, rows, shard = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "kind")])
        cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows].tolist()
        found: list[dict] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            part, here = batch.slice(a, b - a), tuple(keys[:2, a].tolist())
            if here != key:
                key, rows, shard = here, [], None
            if keys[2, a] == ROWS:
                rows.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _floats(part)))
                continue
            if shard is None and rows:
                shard = Shard(*(np.concatenate(column) for column in zip(*rows, strict=True)))
            if shard is None:
                continue
            anchors = part.select(["number", "vec_id", "label", "positives"]).to_pylist()
            for anchor, vector in zip(anchors, _floats(part).tolist(), strict=True):
                found += work(shard, anchor, vector)
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)


def positives_in(shard: Shard, anchor: dict, vector: list[int], k: int) -> list[dict]:
    members = np.flatnonzero((shard.labels == anchor["label"]) & (shard.ids != anchor["vec_id"]))
    if not len(members):
        return []
    scores = shard.scores(vector)
    chosen = best(shard, scores, members, k)
    cut, text = wide_scores.columns(scores[chosen])
    return [
        {"number": anchor["number"], "vec_id": i, "score": s, "digits": d}
        for i, s, d in zip(shard.ids[chosen].tolist(), cut.to_pylist(), text.to_pylist(), strict=True)
    ]


def negatives_in(shard: Shard, anchor: dict, vector: list[int], k: int, low: int, high: int) -> list[dict]:
    members = np.flatnonzero((shard.labels != anchor["label"]) & (shard.ids != anchor["vec_id"]))
    if not len(members):
        return []
    scores = shard.scores(vector)
    found = []
    for positive in anchor["positives"]:
        score = wide_scores.number(positive["score"], positive["digits"])
        # low * positive <= 100 * negative <= high * positive, in whole numbers.
        least, most = -(-low * score // 100), high * score // 100
        inside = members[(scores[members] >= least) & (scores[members] <= most)]
        chosen = best(shard, scores, inside, k)
        cut, text = wide_scores.columns(scores[chosen])
        found += [
            {"number": anchor["number"], "place": positive["place"], "vec_id": i, "score": s, "digits": d}
            for i, s, d in zip(shard.ids[chosen].tolist(), cut.to_pylist(), text.to_pylist(), strict=True)
        ]
    return found


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def _layout(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each label's rows are: first shard and number of shards by (dim, label); and the shards by dim.

    A label with half a shard's rows or more has shards of its own, rarer ones share, so neither a crowded label
    nor very many labels make shards too large or too small.
    """
    counts = rows.groupBy("dim", "label").agg((F.count(F.lit(1)) * F.greatest("dim", F.lit(1)) / SHARD_VALUES).alias("need"))
    counts = keep(counts.withColumn("alone", F.col("need") >= 0.5).withColumn("own", F.ceil("need").cast("int")))
    own, shared = F.when(F.col("alone"), F.col("own")), F.when(~F.col("alone"), F.col("need"))
    totals = counts.groupBy("dim").agg(
        F.coalesce(F.sum(own), F.lit(0)).cast("int").alias("owned"), F.ceil(F.coalesce(F.sum(shared), F.lit(0.0))).cast("int").alias("pools")
    )
    earlier = Window.partitionBy("dim").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    alone = counts.filter("alone").select(
        "dim", "label", F.coalesce(F.sum("own").over(earlier), F.lit(0)).cast("int").alias("first"), F.col("own").alias("parts")
    )
    rare = counts.filter("not alone").join(totals, "dim")
    pool = F.pmod(F.xxhash64("label"), F.col("pools")).cast("int")
    rare = rare.select("dim", "label", (F.col("owned") + pool).alias("first"), F.lit(1).alias("parts"))
    return keep(alone.union(rare)), keep(totals.select("dim", (F.col("owned") + F.col("pools")).alias("shards")))


def _meeting(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows and the anchors sent to their shards, a shard's rows before its anchors."""
    columns = ["dim", "shard", "kind", "number", "vec_id", "label", "vector", "positives"]
    both = rows.select(*columns).union(anchors.select(*columns))
    return both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")


def hard_negatives(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    band: tuple[int, int] = (50, 95),
    every: int = 50,
    id_col: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
) -> DataFrame:
    """For every row whose id is divisible by ``every`` (the anchors) and each of its best ``positives`` rows of its
    label, the best ``negatives`` rows of other labels whose score is within ``band`` percent of the positive's.

    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score; a pair without
    negatives has no row.  The score is the inner product of the vectors floor(256 * x); higher ones come
    first, ties go to the smaller id.  Rows without id, label or vector, or with a NULL or non-finite
    component, take no part.  Vectors are compared with those of their own length only.  A row is neither positive
    nor negative for its own id.  Repeated rows count one by one, but an anchor that is repeated with equal label
    and vector is one anchor.  Scores beyond a long are ordered exactly and shown as the end of its range.  All
    anchors meet all rows, in shards; other columns do not matter, whatever they are called.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    rows = keep(rows.withColumn("dim", F.size("vector")))
    anchors = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "vector"])
    anchors = keep(anchors.withColumn("number", F.monotonically_increasing_id()))
    layout, shards = _layout(rows)

    kind = "array<struct<place:int,vec_id:long,score:long,digits:string>>"
    none = F.lit(None).cast(kind).alias("positives")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    placed = rows.join(layout, ["dim", "label"]).select(
        "dim", (F.col("first") + part).alias("shard"), F.lit(ROWS).alias("kind"), F.lit(-1).cast("long").alias("number"),
        "vec_id", "label", "vector", none,
    )
    home = F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("shard")
    sent = anchors.join(layout, ["dim", "label"]).select("dim", home, F.lit(ANCHORS).alias("kind"), "number", "vec_id", "label", "vector", none)
    found = _meeting(placed, sent).mapInArrow(
        lambda batches: meet(batches, lambda s, a, v: positives_in(s, a, v, positives), _FOUND), "number long, vec_id long, score long, digits string"
    )
    place = F.row_number().over(Window.partitionBy("number").orderBy(*wide_scores.falling(), "vec_id"))
    first = found.withColumn("place", place).filter(F.col("place") <= positives)
    first = keep(first.select("number", F.struct("place", "vec_id", "score", "digits").alias("positive")))
    lists = first.groupBy("number").agg(F.collect_list("positive").cast(kind).alias("positives"))

    everywhere = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    sent = anchors.join(lists, "number").join(shards, "dim")
    sent = sent.select("dim", everywhere, F.lit(ANCHORS).alias("kind"), "number", "vec_id", "label", "vector", "positives")
    found = _meeting(placed, sent).mapInArrow(
        lambda batches: meet(batches, lambda s, a, v: negatives_in(s, a, v, negatives, *band), _BANDED),
        "number long, place int, vec_id long, score long, digits string",
    )
    rank = F.row_number().over(Window.partitionBy("number", "place").orderBy(*wide_scores.falling(), "vec_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    known = first.select("number", "positive.place", F.col("positive.vec_id").alias("positive_id"), F.col("positive.score").alias("positive_score"))
    named = anchors.select("number", F.col("vec_id").alias("anchor_id"))
    return ranked.join(known, ["number", "place"]).join(named, "number").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


_FOUND = pa.schema([("number", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("digits", pa.string())])
_BANDED = pa.schema(
    [("number", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()), ("digits", pa.string())]
)
