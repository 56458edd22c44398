"""The trie of conversation prefixes, as minimal-perfect-hash node tables.

A prefix is known by a 128-bit digest: the XOR of its turns' hashes, each salted with its depth, so that digests
come from running XORs and a parent's digest is a child's without the child's own turn.  Conversations
are dealt to shards.  A shard enumerates its distinct digests, a minimal perfect hash gives each a slot
(a lookup compares the whole digest), and counts are scattered into flat arrays by slot and added
up along an array of parent slots, deepest nodes first.  Tables of all shards are added up by digest.

This is done twice: for members, and, once members and children of each node are known, for what is
summed over subtrees.  For the second, a node's own figure is put in once, in the shard of its
smallest member, which has all the node's ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorspark.llm.arrow_text import mix64
from tutorspark.llm.storage import keep

#: Conversations with ids from a multiple of this up to the next share the first one's opening turns.
FAMILY = 20
#: Most opening turns that are shared, plus one.
SHARED = 4
#: Turns that a shard holds on average.
SHARD_TURNS = 1 << 12
#: A longer conversation is cut here, and its parts may go to different shards.
BLOCK_TURNS = 1 << 12

WORD = r"[^\x20\x09-\x0D]+"

_KEY = ("depth", "k1", "k2")


class Slots:
    """A minimal perfect hash of distinct 128-bit digests: each has one of the slots 0, 1, 2, ...

    Digests that meet no other at their place of a bit table have the place's rank as slot, all others go
    on to the next table.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray) -> None:
        self.k1, self.k2 = np.empty(len(k1), np.uint64), np.empty(len(k1), np.uint64)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        left, first = np.arange(len(k1)), 0
        while len(left):
            size = 2 * len(left)
            place = self._place(k1[left], k2[left], len(self.tables), size)
            single = np.bincount(place, minlength=size) == 1
            slots = first + np.cumsum(single) - 1
            placed = single[place]
            self.tables.append((single, slots))
            self.k1[slots[place[placed]]] = k1[left[placed]]
            self.k2[slots[place[placed]]] = k2[left[placed]]
            first += int(placed.sum())
            left = left[~placed]

    @staticmethod
    def _place(k1: np.ndarray, k2: np.ndarray, table: int, size: int) -> np.ndarray:
        salt = np.uint64((2 * table + 1) * 0x9E3779B97F4A7C15 % 2**64)
        return (mix64(mix64(k1 ^ salt) + k2) % np.uint64(size)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slots of digests, -1 for one that has none."""
        slots, left = np.full(len(k1), -1), np.arange(len(k1))
        for table, (single, rank) in enumerate(self.tables):
            place = self._place(k1[left], k2[left], table, len(single))
            here = single[place]
            found = rank[place[here]]
            same = (self.k1[found] == k1[left[here]]) & (self.k2[found] == k2[left[here]])
            slots[left[here][same]] = found[same]
            left = left[~here]
        return slots


class Nodes:
    """The nodes of a shard's paths, by slot."""

    def __init__(self, rows: dict[str, np.ndarray]) -> None:
        digests = np.stack([rows["k1"], rows["k2"]])
        parents = np.stack([rows["p1"], rows["p2"]])
        # The root has no turn and so no row of its own, but the parent of the first turns is the root.
        of_root = rows["depth"] == 1
        _, first = np.unique(np.c_[digests, parents[:, of_root]], axis=1, return_index=True)
        origin = np.r_[np.arange(digests.shape[1]), np.flatnonzero(of_root)][first]
        is_root = (first >= digests.shape[1]) | (rows["depth"][origin] == 0)
        self.slots = Slots(*np.c_[digests, parents[:, of_root]][:, first])
        size = len(first)
        place = self.slots.find(*np.c_[digests, parents[:, of_root]][:, first])
        self.depth, self.words, self.parent = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1)
        self.p1, self.p2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        own, source = place[~is_root], origin[~is_root]
        self.depth[own], self.words[own] = rows["depth"][source], rows["words"][source]
        self.p1[own], self.p2[own] = parents[:, source]
        self.parent[own] = self.slots.find(*parents[:, source])
        # A cut between two blocks is no edge: what is below it is brought in by the caller.
        self.parent[(self.depth > 1) & ((self.depth - 1) % BLOCK_TURNS == 0)] = -1
        self.row = self.slots.find(*digests)
        order = np.argsort(-self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        #: Slots with a parent, by falling depth.
        self.levels = [level[self.parent[level] >= 0] for level in np.split(order, cuts)]

    def lift(self, figures: np.ndarray, ufunc: np.ufunc = np.add) -> np.ndarray:
        """Every node's figures together with those of all nodes below it."""
        for level in self.levels:
            ufunc.at(figures, self.parent[level], figures[level])
        return figures

    def table(self, chosen: np.ndarray, **figures: np.ndarray) -> pa.Table:
        named = {"depth": self.depth.astype(np.int32), "k1": self.slots.k1.view(np.int64), "k2": self.slots.k2.view(np.int64)}
        return pa.table({name: pa.array(x[chosen]) for name, x in (named | figures).items()})


def _columns(table: pa.Table, names: Iterable[str]) -> dict[str, np.ndarray]:
    found = {n: table.column(n).to_numpy() for n in names}
    return {n: x.view(np.uint64) if n in ("k1", "k2", "p1", "p2") else x for n, x in found.items()}


def member_table(table: pa.Table) -> pa.Table:
    """A shard's nodes with the number of conversations that begin with each, and the smallest of them."""
    rows = _columns(table, ("conv_id", "depth", "k1", "k2", "p1", "p2", "words"))
    nodes = Nodes(rows)
    # A conversation counts at its last turn of each block.
    block = np.maximum(rows["depth"] - 1, 0) // BLOCK_TURNS
    order = np.lexsort((rows["depth"], block, rows["conv_id"]))
    conv, part = rows["conv_id"][order], block[order]
    last = np.r_[(conv[1:] != conv[:-1]) | (part[1:] != part[:-1]), True]
    ends = nodes.row[order[last]]
    count = np.zeros(len(nodes.depth), np.int64)
    np.add.at(count, ends, 1)
    least = np.full(len(nodes.depth), np.iinfo(np.int64).max)
    np.minimum.at(least, ends, conv[last])
    everything = np.ones(len(count), bool)
    return nodes.table(
        everything, p1=nodes.p1.view(np.int64), p2=nodes.p2.view(np.int64), words=nodes.words,
        n_convs=nodes.lift(count), conv_id=nodes.lift(least, np.minimum),
    )


def subtree_table(table: pa.Table) -> pa.Table:
    """A shard's nodes with what is put in at each and below, of the rows that have a figure."""
    is_path = np.asarray(table.column("own_saved").is_null())
    rows = _columns(table.filter(pa.array(is_path)), ("depth", "k1", "k2", "p1", "p2", "words"))
    facts = _columns(table.filter(pa.array(~is_path)), ("k1", "k2", "own_saved", "own_leaves"))
    nodes = Nodes(rows)
    at = nodes.slots.find(facts["k1"], facts["k2"])
    if (at < 0).any():
        raise ValueError("a node is not in the shard of its smallest member")
    saved, leaves = np.zeros(len(nodes.depth), np.int64), np.zeros(len(nodes.depth), np.int64)
    np.add.at(saved, at, facts["own_saved"])
    np.add.at(leaves, at, facts["own_leaves"])
    saved, leaves = nodes.lift(saved), nodes.lift(leaves)
    return nodes.table((saved != 0) | (leaves != 0), saved=saved, leaves=leaves)


def _join_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node that lie together in a batch, joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, conv = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
        starts = np.r_[0, np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1]
        ids, ends = conv.tolist(), [*starts[1:].tolist(), len(conv)]
        joined = [",".join(map(str, ids[a:b])) for a, b in zip(starts.tolist(), ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1[starts]), pa.array(k2[starts]), pa.array(conv[starts]), pa.array(joined)], ["k1", "k2", "conv_id", "ids"]
        )


def _hash_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's pieces in order, whatever their number: only the hash's state is held."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) == key:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                done.append((*key, digest.hexdigest()))
            key, digest = (k1, k2), hashlib.sha256(ids.encode())
        yield _hashes(done)
    if digest is not None:
        yield _hashes([(*key, digest.hexdigest())])


def _hashes(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _family(conv: str = "conv_id") -> Column:
    return F.col(conv) - F.col(conv) % FAMILY


def _places(turns: DataFrame) -> DataFrame:
    """The turns with their place in their conversation, from 0, and the part of the sorted turns that they lie in.

    Turns are sorted by range, which cuts a conversation of any length into parts that one task can hold; places
    within a part and the sizes of earlier parts give the place.
    """
    ranged = turns.withColumn("row", F.monotonically_increasing_id())
    ranged = keep(keep(ranged).repartitionByRange("conv_id", "turn", "hi", "lo", "row").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = keep(sizes.withColumn("before", F.sum("n").over(before)).filter("before > 0").drop("n"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "hi", "lo", "row"))
    placed = ranged.withColumn("inside", inside).join(later, ["conv_id", "part"], "left")
    place = (F.col("inside") - 1 + F.coalesce("before", F.lit(0))).alias("place")
    return keep(placed.select("conv_id", "part", place, "hi", "lo", "words"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of all rebuilt conversations as (conv_id, part, place, hi, lo, words), and the ids of those without turns."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.xxhash64(role, text).alias("hi"), F.xxhash64(F.lit(1), text, role).alias("lo"), word_count(text).alias("words"),
    )
    own = _places(turns)
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("long")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("part"))
    sizes = keep(sizes.withColumn("family", _family()).withColumn("shared", F.when(F.col("family") == F.col("conv_id"), 0).otherwise(shared)))
    heads = own.filter((F.col("place") < SHARED) & (F.col("conv_id") == _family()))
    heads = heads.select(F.col("conv_id").alias("family"), "place", "hi", "lo", "words")
    borrowed = sizes.join(heads, "family").filter("place < shared").select("conv_id", "part", "place", "hi", "lo", "words")
    of_family = sizes.filter("family = conv_id").select("family", F.col("n").alias("n_family"))
    lent = F.least("shared", F.coalesce("n_family", F.lit(0)))
    sizes = keep(sizes.join(of_family, "family", "left").select("conv_id", "n", "shared", lent.alias("lent")))
    # Most rows need no look at their conversation: where the family lends all, places stay.
    short = sizes.filter("lent < shared").select("conv_id", (F.col("lent") - F.col("shared")).alias("shift"))
    mine = own.filter((F.col("conv_id") == _family()) | (F.col("place") >= shared)).join(short, "conv_id", "left")
    mine = mine.select("conv_id", "part", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"), "hi", "lo", "words")
    turnless = sizes.filter("lent = 0 AND n <= shared").select("conv_id")
    return keep(mine.union(borrowed)), turnless


def prefix_paths(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """One row for every prefix of every conversation: its depth, digest, parent's digest and last turn's words.

    A conversation without turns has a row of depth 0.
    """
    salted = turns.select(
        "conv_id", "part", (F.col("place") + 1).cast("int").alias("depth"), "words",
        F.xxhash64("hi", "lo", "place").alias("h1"), F.xxhash64(F.lit(2), "lo", "hi", "place").alias("h2"),
    )
    salted = keep(salted)
    parts = salted.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("b1", F.bit_xor("x1").over(before)).withColumn("b2", F.bit_xor("x2").over(before))
    later = keep(parts.filter("b1 IS NOT NULL").select("conv_id", "part", "b1", "b2"))
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = salted.withColumn("r1", F.bit_xor("h1").over(upto)).withColumn("r2", F.bit_xor("h2").over(upto))
    running = running.join(later, ["conv_id", "part"], "left")
    k1, k2 = (F.col(r).bitwiseXOR(F.coalesce(b, F.lit(0))) for r, b in (("r1", "b1"), ("r2", "b2")))
    paths = running.select("conv_id", "depth", k1.alias("k1"), k2.alias("k2"), "words", "h1", "h2")
    paths = paths.select(
        "conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "words"
    )
    zero = F.lit(0).cast("long")
    empty = turnless.select("conv_id", F.lit(0).alias("depth"), *(zero.alias(c) for c in ("k1", "k2", "p1", "p2", "words")))
    return keep(paths.union(empty))


def _block() -> Column:
    return F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / BLOCK_TURNS)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for every distinct prefix of the rebuilt conversations, from the root of depth 0 on.

    A conversation's turns are ordered by turn, NULL first; turns with the same number by a hash of role and text.
    NULL roles and texts are empty ones.  Conversation c begins with the first h turns of conversation
    c - c % 20 (all if it has fewer, none if it does not exist), then has its own turns after its first h;
    h is the CRC-32 of c in decimal, modulo 4.

    Columns: conv_id, the smallest member, and parent_conv_id, the parent's; depth; n_convs, the members; n_children;
    n_leaves, childless nodes in the subtree with the node itself; saved_tokens, the sum over the subtree of
    (n_convs - 1) times the words of the last turn; ends_sha256, over the ids of members that end here.
    Rows without conv_id belong to no conversation; without any, there is no node at all.  Repeated rows are
    turns each.  Texts are hashed and counted where they are read, whatever their length.  Other columns
    do not matter.
    """
    turns, turnless = rebuilt(conversations)
    paths = prefix_paths(turns, turnless)
    shards = max(1, -(-paths.count() // SHARD_TURNS))
    shard = F.pmod(F.xxhash64(_family(), _block()), F.lit(shards)).cast("int").alias("shard")

    members = paths.select(shard, "*").groupBy("shard").applyInArrow(
        member_table, "depth int, k1 long, k2 long, p1 long, p2 long, words long, n_convs long, conv_id long"
    )
    nodes = members.groupBy(*_KEY).agg(
        *(F.min(c).alias(c) for c in ("p1", "p2", "words", "conv_id")), F.sum("n_convs").alias("n_convs")
    )
    nodes = keep(nodes)
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, list(_KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = keep(nodes)

    figures = nodes.select(
        "conv_id", *_KEY, ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"), (F.col("n_children") == 0).cast("long").alias("own_leaves")
    )
    figures = figures.filter("own_saved <> 0 OR own_leaves <> 0")
    none = F.lit(None).cast("long")
    structure = paths.select(shard, *_KEY, "p1", "p2", "words", none.alias("own_saved"), none.alias("own_leaves"))
    put_in = figures.union(_carried(paths, figures)).select(shard, *_KEY, none.alias("p1"), none.alias("p2"), none.alias("words"), "own_saved", "own_leaves")
    sums = structure.union(put_in).groupBy("shard").applyInArrow(
        subtree_table, "depth int, k1 long, k2 long, saved long, leaves long"
    )
    sums = sums.groupBy(*_KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    ends = paths.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "depth").alias("end")).select("conv_id", "end.k1", "end.k2")
    pieces = ends.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = pieces.mapInArrow(_join_ids, "k1 long, k2 long, conv_id long, ids string")
    hashes = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_hash_ids, "k1 long, k2 long, ends_sha256 string")

    # The root may have very many children; its smallest member is the smallest of all.
    root = nodes.filter("depth = 0").agg(F.max("conv_id")).scalar()
    parents = nodes.filter("depth > 0 AND n_children > 0")
    parents = parents.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.filter("depth > 1").join(parents, ["depth", "p1", "p2"]).select(*nodes.columns, "parent_conv_id")
    parent = F.when(F.col("depth") == 1, root).cast("long").alias("parent_conv_id")
    named = nodes.filter("depth <= 1").select("*", parent).union(below)
    full = named.join(sums, list(_KEY), "left").join(hashes, ["k1", "k2"], "left")
    return full.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _carried(paths: DataFrame, figures: DataFrame) -> DataFrame:
    """What a conversation puts in behind each cut between its blocks, to be put in at the last node before the cut."""
    cuts = paths.filter((F.col("depth") > 0) & (F.col("depth") % BLOCK_TURNS == 0))
    cuts = cuts.select("conv_id", _block().alias("block"), *_KEY, F.lit(0).cast("long").alias("own_saved"), F.lit(0).cast("long").alias("own_leaves"))
    deep = figures.withColumn("block", _block()).filter("block > 0").groupBy("conv_id", "block")
    deep = deep.agg(F.sum("own_saved").alias("own_saved"), F.sum("own_leaves").alias("own_leaves"))
    no = F.lit(None)
    deep = deep.select("conv_id", "block", no.cast("int").alias("depth"), no.cast("long").alias("k1"), no.cast("long").alias("k2"), "own_saved", "own_leaves")
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rangeBetween(Window.unboundedPreceding, -1)
    carried = cuts.union(deep).select(
        "conv_id", *_KEY, F.sum("own_saved").over(later).alias("own_saved"), F.sum("own_leaves").over(later).alias("own_leaves")
    )
    return carried.filter("depth IS NOT NULL AND (own_saved <> 0 OR own_leaves <> 0)")
