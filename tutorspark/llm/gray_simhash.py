"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints that differ in at most two of 64 bits agree in at least two of their four 16-bit blocks.
The six masks that keep two blocks are the upper nodes of the index: a shuffle brings the
fingerprints that share a masked pattern together.  Within a node they are sorted by their rank in the
Gray sequence, in which neighbours differ in few bits, and consecutive ones are grouped by eights,
level by level; a group keeps the bits that all its members share.  A search adds up differences on
the way down, each level counting only the bits that its parent did not fix, and leaves a whole
group once they exceed the bound.  A node too large for one task is divided the same way again, by
8-bit blocks of the bits that it has not fixed; below that a node has at most 2^16 members.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.llm.arrow_text import ASCII_LOWER, IS_SPACE, first_of, runs, slices, spread, utf8
from tutorspark.llm.components import components, forest
from tutorspark.llm.storage import keep, neutral

SEED = 42
#: Bytes of text whose shingles are hashed at once; their bits take sixteen times as much.
SLICE_BYTES = 1 << 19
FAN_OUT = 8
#: A node with more members is divided further.  It must not be under 2^16, the most a last node has.
NODE_ROWS = 1 << 17
#: Searches that go down the index together.
SEARCHES = 1 << 14

FULL = (1 << 64) - 1
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _fingerprints(batch: pa.RecordBatch, shingle: int) -> np.ndarray:
    data, offsets = utf8(batch.column("text"))
    starts, ends = runs(~IS_SPACE[data], offsets)
    # Words joined by one space, the texts one after another.
    length = ends - starts
    begin = np.cumsum(length + 1) - length - 1
    joined = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
    owner, at = spread(length)
    joined[begin[owner] + at] = ASCII_LOWER[data[starts[owner] + at]]
    end = begin + length
    first = first_of(starts, offsets)
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    doc, nth = spread(count)
    head = first[:-1][doc] + nth
    tail = np.minimum(head + shingle, first[1:][doc]) - 1
    buffer, digest = joined.tobytes(), xxhash.xxh64_intdigest
    pieces = zip(begin[head].tolist(), end[tail].tolist(), strict=True)
    hashes = np.fromiter((digest(buffer[a:b], SEED) for a, b in pieces), dtype="<u8", count=len(head))
    prints = np.zeros(len(words), np.uint64)
    filled = np.flatnonzero(count)
    if len(filled):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(count) - count)[filled], axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > count[filled][:, None], axis=1, bitorder="little")
        prints[filled] = packed.view("<u8").ravel()
    return prints.view(np.int64)


def _long_fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of one long text, whose shingles are hashed some at a time and their bits added up."""
    ones, count, at, tail = np.zeros(64, np.int64), 0, 0, b""
    while at < len(text):
        space = SPACE.search(text, at + SLICE_BYTES)
        end = space.start() if space else len(text)
        words = (tail + text[at:end]).lower().split()
        pieces = (b" ".join(words[n : n + shingle]) for n in range(len(words) - shingle + 1))
        hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in pieces), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones, count, at = ones + bits.sum(axis=0, dtype=np.int64), count + len(hashes), end
        tail = b" ".join(words[max(len(words) - shingle + 1, 0) :]) + b" "
    if not count:
        words = tail.split()
        return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)) if words else 0
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8").astype("<u8").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint) of every row; a NULL or empty text has fingerprint zero.

    Texts are read whole; of one that is very long, some shingles are held at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                if part.num_rows == 1 and len(utf8(part.column("text"))[0]) > 2 * SLICE_BYTES:
                    prints = np.array([_long_fingerprint(part.column("text")[0].as_buffer().to_pybytes(), shingle)])
                else:
                    prints = _fingerprints(part, shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints)], ["doc_id", "fingerprint"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(kernel, f"doc_id {kind}, fingerprint long")


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def near_pairs(prints: np.ndarray, node: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions i < j of one node within the distance, in portions.

    prints must be sorted by (node, Gray rank).
    """
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(node)])
    # Level by level: the bits that a group shares, their values, and where its children begin.
    levels = [(np.full(len(prints), FULL, np.uint64), prints, None, None)]
    counts, heads = sizes, starts
    while len(counts) and counts.max() > 1:
        fixed, value, _, _ = levels[-1]
        above = -(-counts // FAN_OUT)
        owner, nth = spread(above)
        first = heads[owner] + nth * FAN_OUT
        number = np.minimum(FAN_OUT, counts[owner] - nth * FAN_OUT)
        every, some = np.bitwise_and.reduceat(value, first), np.bitwise_or.reduceat(value, first)
        shared = np.bitwise_and.reduceat(fixed, first) & ~(every ^ some)
        levels.append((shared, every & shared, first, number))
        counts, heads = above, np.cumsum(above) - above
    root = np.repeat(np.arange(len(starts)), sizes)
    for begin in range(0, len(prints), SEARCHES):
        query = np.arange(begin, min(begin + SEARCHES, len(prints)))
        query = query[sizes[root[query]] > 1]
        group = heads[root[query]] if len(levels) > 1 else query[:0]
        query = query[: len(group)]
        so_far, known = np.zeros(len(query), np.int64), np.zeros(len(query), np.uint64)
        for depth in range(len(levels) - 1, -1, -1):
            fixed, value, first, number = levels[depth]
            so_far = so_far + np.bitwise_count((prints[query] ^ value[group]) & fixed[group] & ~known)
            near = so_far <= distance
            query, group, so_far = query[near], group[near], so_far[near]
            if depth:
                known = fixed[group]
                owner, nth = spread(number[group])
                query, so_far, known, group = query[owner], so_far[owner], known[owner], first[group][owner] + nth
                # A later member finds the earlier ones; the rest of the tree is their mirror.
        pair = group < query
        yield group[pair], query[pair]


def _link_nodes(batches: Iterable[pa.RecordBatch], distance: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Links of each node as stars, from rows sorted by node; rows of a node too large for this task
    come back as they are, with link NULL."""

    def found(prints: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(prints), node))
        prints, node = prints[order], node[order]
        root = np.arange(len(prints))
        for a, b in near_pairs(prints, node, distance):
            a, b = root[a], root[b]
            if len(a):
                root = forest(len(prints), a, b)[root]
        linked = np.flatnonzero(root != np.arange(len(prints)))
        a, b = prints[linked].view(np.int64), prints[root[linked]].view(np.int64)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], ["fingerprint", "link", "node"]
        )

    held_print, held_node, deeper = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    for batch in batches:
        prints = batch.column("fingerprint").to_numpy().view(np.uint64)
        node = batch.column("node").to_numpy()
        held_print, held_node = np.r_[held_print, prints], np.r_[held_node, node]
        while len(held_node):
            if deeper is not None:
                n = int(np.searchsorted(held_node != deeper, True))
                if n:
                    yield _deeper(held_print[:n], held_node[:n])
                    held_print, held_node = held_print[n:], held_node[n:]
                if not len(held_node):
                    break
                deeper = None
            if len(held_node) < NODE_ROWS:
                break
            cut = int(np.argmax(held_node == held_node[-1]))
            if cut:
                yield found(held_print[:cut], held_node[:cut])
                held_print, held_node = held_print[cut:], held_node[cut:]
            elif last:
                break
            else:
                deeper = held_node[0]
    if len(held_node):
        yield found(held_print, held_node)


def _deeper(prints: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(prints.view(np.int64)), pa.nulls(len(prints), pa.int64()), pa.array(node)], ["fingerprint", "link", "node"]
    )


def _masks(blocks: list[int], agreeing: int) -> list[int]:
    """Masks that keep some of the blocks."""
    masks = []
    for kept in combinations(blocks, agreeing):
        mask = 0
        for block in kept:
            mask |= block
        masks.append(mask)
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _blocks(width: int, within: int) -> list[int]:
    """Blocks of the given width, counted over the set bits of ``within`` from the lowest."""
    bits = [i for i in range(64) if within >> i & 1]
    return [sum(1 << i for i in bits[at : at + width]) for at in range(0, len(bits), width)]


def upper_masks(distance: int) -> list[int]:
    """All choices of two blocks out of distance + 2: any two fingerprints within the distance agree
    under one of these masks."""
    blocks = _blocks(-(-64 // (distance + 2)), FULL)
    return _masks(blocks, len(blocks) - distance)


def _nodes(masks: list[int], *above: str) -> Column:
    """The node of each mask: a hash of the masked pattern, with the mask's number in the lowest byte."""
    keys = []
    for n, mask in enumerate(masks):
        pattern = F.xxhash64(F.lit(n), *above, F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))))
        keys.append(pattern.bitwiseAND(F.lit(-256)).bitwiseOR(F.lit(n)))
    return F.array(*keys)


def fingerprint_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs within the
    distance: of each node a spanning forest, not every pair.

    Takes distinct fingerprints in the column ``fingerprint``.
    """

    def search(nodes: DataFrame, last: bool) -> DataFrame:
        ordered = nodes.select("fingerprint", "node").repartition("node").sortWithinPartitions("node")
        return ordered.mapInArrow(lambda batches: _link_nodes(batches, distance, last), "fingerprint long, link long, node long")

    masks = upper_masks(distance)
    first = keep(search(prints.withColumn("node", F.explode(_nodes(masks))), False))
    links = first.filter("link IS NOT NULL").select(F.col("fingerprint").alias("a"), F.col("link").alias("b"))
    large = first.filter("link IS NULL").select("fingerprint", F.col("node").alias("above"))
    if not large.isEmpty():
        below = F.lit(None).cast("array<bigint>")
        for n, mask in enumerate(masks):
            blocks = _blocks(8, FULL & ~mask)
            inner = _nodes(_masks(blocks, max(len(blocks) - distance, 0)), "above")
            below = F.when(F.col("above").bitwiseAND(F.lit(255)) == n, inner).otherwise(below)
        deeper = search(large.withColumn("node", F.explode(below)), True)
        links = links.union(deeper.select(F.col("fingerprint").alias("a"), F.col("link").alias("b")))
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2
) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row.

    Documents with at most ``distance`` differing bits are linked; component_id is the smallest id
    reachable by links.  NULL ids count as larger than any id (a group of nothing else has NULL).
    NULL, empty and wordless texts share fingerprint zero and are linked like any others.  Repeated
    rows are one node.  Other columns are not carried.
    """
    prints = keep(fingerprints(docs, id_col, text, shingle))
    return label_components(prints, distance)


def label_components(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Add component_id to (doc_id, fingerprint)."""
    nodes = keep(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    roots = components(fingerprint_links(nodes.select("fingerprint"), distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = keep(rooted.withColumn("root", F.coalesce("root", "fingerprint")))
    least = keep(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = keep(rooted.join(least, "root").select("fingerprint", "component_id"))
    # Copies share a fingerprint: both sides are plain exchanges, which Spark can split.
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


NO_ID = (1 << 63) - 1


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2
) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, one of each component.

    Among rows that share this id the one with the least hash of its text stays, and equal rows
    stay once.  Rows without id stay only where a component has no others.  Ids must be integers; other
    columns may have any name.
    """
    plain, (number, words) = neutral(docs, id_col, text)
    keys = {
        "_id": F.coalesce(F.col(number).cast("long"), F.lit(NO_ID)),
        "_hash": F.xxhash64(F.col(words), F.col(number).isNull()),
    }
    rows = plain.withColumns(keys)
    row = F.struct("_id", "_hash")
    prints = keep(fingerprints(rows.select(row.alias("doc_id"), words), "doc_id", words, shingle))
    least = label_components(prints, distance).select("component_id.*").distinct()
    # Both sides meet by the key that the repeated rows are told by, so the texts are shuffled once.
    kept = rows.join(least, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return kept.select(*plain.columns).toDF(*docs.columns)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
