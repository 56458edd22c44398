"""Pack documents into bins of fixed length by best fit under conflicts.

A bin has at most one piece of each source and of each cluster of duplicates.  Pieces are placed in
falling order of size.  Bins are kept in order of what is left in them, each with the bitmaps of its
sources and clusters; a search starts at the least room that is enough and goes on to the next larger
until a bin without a conflict is found, so the piece goes into the tightest compatible bin, and into a
new one if there is none.  Texts longer than a bin are cut into full pieces and a last one.

Pieces are dealt evenly to shards that one task packs; the number of shards grows with the pieces, so
neither a large source nor a large cluster makes a task larger.  Bins do not span shards: the price is
at most a few half-empty bins in each.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.llm.source_mix import word_count
from tutorspark.llm.storage import exactly, keep

CAPACITY = 2048
SHARD_PIECES = 4096
SPACES = r"[\x20\x09-\x0D]+"
BINS_A_SHARD = 32
COPIES_A_RUN = 10_000


class Bins:
    """Open bins by the room left in them; bitmaps say what each bin may not take again."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.held: list[int] = []
        self.rooms: list[int] = []
        self.at: dict[int, list[int]] = {}
        #: How many bins with some room hold each bit: where all do, none of them needs a look.
        self.holders: dict[int, Counter] = {}

    def tightest(self, size: int, bits: tuple[int, ...]) -> int | None:
        """The bin with the least sufficient room and none of the bits, the oldest of equals."""
        mask = sum(1 << b for b in bits)
        for place in range(bisect_left(self.rooms, size), len(self.rooms)):
            room = self.rooms[place]
            bins, holders = self.at[room], self.holders[room]
            if any(holders[b] == len(bins) for b in bits):
                continue
            for one in bins:
                if not self.held[one] & mask:
                    return one
        return None

    def place(self, size: int, bits: tuple[int, ...], room_of: list[int]) -> int:
        one = self.tightest(size, bits)
        if one is None:
            one = len(self.held)
            self.held.append(0)
            room_of.append(self.capacity)
        else:
            self._leave(one, room_of[one])
        for b in bits:
            self.held[one] |= 1 << b
        room_of[one] -= size
        self._enter(one, room_of[one])
        return one

    def _bits(self, one: int) -> list[int]:
        bits, found = self.held[one], []
        while bits:
            low = bits & -bits
            found.append(low.bit_length() - 1)
            bits ^= low
        return found

    def _leave(self, one: int, room: int) -> None:
        self.at[room].remove(one)
        self.holders[room].subtract(self._bits(one))
        if not self.at[room]:
            del self.at[room], self.holders[room]
            del self.rooms[bisect_left(self.rooms, room)]

    def _enter(self, one: int, room: int) -> None:
        if room == 0:
            return  # a full bin takes nothing more
        if room not in self.at:
            self.at[room], self.holders[room] = [], Counter()
            insort(self.rooms, room)
        insort(self.at[room], one)
        self.holders[room].update(self._bits(one))


def best_fit(sizes: list[int], labels: list[tuple], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each piece, in the given order, and the room left in each bin; a piece's labels are what
    it shares a bin with nobody else of, None being no label."""
    bins, rooms, numbers, placed = Bins(capacity), [], {}, []
    for size, own in zip(sizes, labels, strict=True):
        bits = tuple(numbers.setdefault((n, label), len(numbers)) for n, label in enumerate(own) if label is not None)
        placed.append(bins.place(size, bits, rooms))
    return placed, rooms


def duplicate_cluster(text: Column) -> Column:
    """Copies up to case and white space have one cluster; a text without words has none."""
    plain = F.trim(F.regexp_replace(F.lower(text), SPACES, " "))
    return F.when(plain != "", F.xxhash64(plain))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``copy``, their number among equal ones: these are counted and written out again in runs, which
    are dealt to all tasks."""
    counts = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    run = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES_A_RUN)))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = counts.withColumn("run", run).repartition(tasks, *rows.columns, "run")
    first = F.col("run") * COPIES_A_RUN
    copy = F.explode(F.sequence(first, F.least(first + COPIES_A_RUN, F.col("copies")) - 1))
    return runs.select(*rows.columns, copy.alias("copy"))


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: Column | None = None,
) -> DataFrame:
    """One row a piece: doc_id, piece, first_word, n_words, source, cluster, bin_id and bin_words.

    A document of more than ``capacity`` words is cut into pieces; a piece is words first_word up to
    first_word + n_words of its text.  ``cluster`` tells duplicates (by default copies of the text); a
    NULL source or cluster conflicts with nothing.  Pieces of one document and repeated rows are of
    one cluster and never share a bin.  A NULL text, or one without words, is one piece of no words and
    has no bin (bin_id and bin_words NULL).  Other columns are not carried.  Bins depend on the rows alone, not on
    their order or partitions.
    """
    number, words, origin = exactly([id_col, text, source])
    rows = docs.select(
        number.alias("doc_id"),
        word_count(words).alias("words"),
        origin.alias("source"),
        (duplicate_cluster(words) if cluster is None else cluster).alias("cluster"),
        F.xxhash64(words).alias("hash"),
    )
    rows = _numbered(rows)
    last = F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("piece").cast("long") * capacity
    size = F.least(F.col("words") - first, F.lit(capacity)).cast("long")
    # Equal rows differ in their copy's number, so each piece has a key of its own that says nothing of partitions.
    key = F.xxhash64("doc_id", "piece", "words", "source", "cluster", "hash", "copy")
    pieces = keep(pieces.withColumn("first_word", first).withColumn("n_words", size).withColumn("number", key).drop("words", "hash", "copy"))
    filled = pieces.filter("n_words > 0")
    shards = max(1, -(-filled.count() // SHARD_PIECES))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    columns = ["doc_id", "piece", "first_word", "n_words", "source", "cluster"]

    def kernel(table: pa.Table) -> pa.Table:
        sizes, number = table.column("n_words").to_numpy(), table.column("number").to_numpy()
        order = np.lexsort((number, -sizes))
        table = table.take(pa.array(order))
        labels = list(zip(table.column("source").to_pylist(), table.column("cluster").to_pylist(), strict=True))
        placed, rooms = best_fit(sizes[order].tolist(), labels, capacity)
        shard = table.column("shard")[0].as_py()
        bins = np.array(placed, np.int64)
        words = capacity - np.array(rooms, np.int64)[bins]
        return table.select(columns).append_column("bin_id", pa.array((shard << BINS_A_SHARD) + bins)).append_column("bin_words", pa.array(words))

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["bin_id long, bin_words long"])
    sharded = filled.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)))
    packed = sharded.groupBy("shard").applyInArrow(kernel, schema)
    without = pieces.filter("n_words = 0").select(*columns, F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_words"))
    return packed.unionByName(without)
