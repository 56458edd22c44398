"""The Gray-order index against the plain definition."""

import random
import re

import numpy as np
import pytest
import xxhash

from tutorspark.llm import gray_simhash
from tutorspark.llm.components import components, forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, shingle=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def plain_roots(prints, distance):
    """Smallest id by chains of links, over (id, fingerprint); NULL is larger than any id."""
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        root = find(i)
        least[root] = min(least.get(root, np.inf), np.inf if doc is None else doc)
    return [None if least[find(i)] == np.inf else least[find(i)] for i in range(len(prints))]


def test_documents(documents):
    df, rows = documents
    got = gray_simhash.near_duplicates(df).withColumn("hex", gray_simhash.hex_digits(gray_simhash.F.col("fingerprint")))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.hex, r.component_id) for r in got.collect())
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    roots = plain_roots(prints, 2)
    want = sorted((d is None, d or 0, f"{p:016x}", root) for (d, p), root in zip(prints, roots))
    assert got == want


def test_empty(no_documents):
    assert gray_simhash.near_duplicates(no_documents).collect() == []


def crowd(seed, n):
    """Random fingerprints, and many within a few bits of one another."""
    rng = np.random.default_rng(seed)
    far = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    near = np.full(n, far[0])
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    return np.unique(np.r_[far, near, far[: n // 4] ^ np.uint64(3), np.uint64(0), np.uint64((1 << 64) - 1)])


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_join_exactly_what_is_near(spark, distance):
    prints = [int(x) for x in crowd(distance, 400)]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "doc_id long").selectExpr("doc_id", "doc_id AS fingerprint")
    got = {r.doc_id: r.component_id for r in gray_simhash.label_components(df, distance).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = plain_roots(list(zip(signed, prints)), distance)
    assert got == dict(zip(signed, roots))


def test_a_crowded_node_is_divided(spark, monkeypatch):
    prints = crowd(9, 600)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    whole = {(r.node, r.root) for r in components(gray_simhash.fingerprint_links(df)).collect()}
    monkeypatch.setattr(gray_simhash, "_link_nodes", small_nodes(gray_simhash._link_nodes))
    divided = {(r.node, r.root) for r in components(gray_simhash.fingerprint_links(df)).collect()}
    assert divided == whole


def small_nodes(link_nodes):
    def limited(batches, distance, last):
        gray_simhash.NODE_ROWS = 40 if not last else 1 << 17
        return link_nodes(batches, distance, last)

    return limited


def test_near_pairs_of_a_node():
    prints = crowd(3, 200)
    node = np.arange(len(prints)) % 3
    order = np.lexsort((gray_simhash.gray_rank(prints), node))
    prints, node = prints[order], node[order]
    got = {(int(i), int(j)) for a, b in gray_simhash.near_pairs(prints, node, 2) for i, j in zip(a, b)}
    want = {
        (i, j) for j in range(len(prints)) for i in range(j) if node[i] == node[j] and int(prints[i] ^ prints[j]).bit_count() <= 2
    }
    assert got == want


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    codes = codes ^ (codes >> np.uint64(1))
    assert (gray_simhash.gray_rank(codes) == np.arange(256)).all()


def test_forest():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    label = forest(300, a, b)
    assert (label[a] == label[b]).all()
    assert len(np.unique(label)) == 300 - len(set_forest(a, b))


def set_forest(a, b):
    parent = list(range(300))
    used = []

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(a, b):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            used.append((i, j))
    return used


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_own_columns_are_kept(spark):
    rows = [(1, "a b c d", 5, "x", 2), (2, "a b c d", 6, "y", 3), (None, "p q r s", 7, "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _hash string, `a.b` int")
    got = gray_simhash.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, (df.collect()[0], df.collect()[2])))


@pytest.mark.parametrize("shingle", [1, 3])
def test_a_long_text_in_pieces(spark, monkeypatch, shingle):
    """Texts far longer than what is hashed at once, with words as long, have the fingerprint of the whole."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["A", "bé", "c\td", "e" * 400]) for _ in range(3000)), "x" * 300_000, "a " + "y" * 100_000, " " * 50_000 + "Z z", " " * 50_000]
    monkeypatch.setattr(gray_simhash, "SLICE_BYTES", 1 << 11)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in gray_simhash.fingerprints(df, shingle=shingle).collect()}
    for n, text in enumerate(texts):
        assert got[n] % 2**64 == plain_fingerprint(text, shingle)
