"""Seed and extend against all windows of all documents."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tutorspark.llm import seed_extend
from tutorspark.llm.queries import llm_queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, threshold=20):
    """(id, kept text, words, removed) of rows (id, text), by looking up every window."""
    seen, result = set(), []
    ordered = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    by_row = {}
    for doc, text in ordered:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - threshold + 1):
            window = tuple(words[i : i + threshold])
            if window in seen:
                gone |= set(range(i, i + threshold))
            seen.add(window)
        by_row[doc, text] = (" ".join(w for i, w in enumerate(words) if i not in gone), len(words), len(gone))
    for row in rows:
        result.append((row[0], *by_row[row]))
    return sorted(result, key=str)


def found(df, threshold=20):
    got = seed_extend.remove_repeats(df, threshold=threshold).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.repeats) == r.n_removed
        assert all(s.end - s.start >= threshold for s in r.repeats)
        assert all(a.end < b.start for a, b in zip(r.repeats, r.repeats[1:]))
    return sorted([(r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in got], key=str)


def test_documents(documents):
    df, rows = documents
    assert found(df) == plain([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("seed", range(3))
def test_few_words(spark, seed):
    """Small vocabularies make anchors that repeat within and across documents in all contexts."""
    rng = random.Random(seed)
    common = [" ".join(rng.choice("abcd") for _ in range(rng.randint(3, 40))) for _ in range(6)]
    rows = []
    for n in range(120):
        parts = [rng.choice(common) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 8))]
        rows.append((n, rng.choice([" ", "\n", " \t "]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for threshold in (1, 5, 8, 20):
        assert found(df, threshold) == plain(rows, threshold)


def test_copies(spark):
    """Thousands of copies, with heads and tails of their own, dealt over many tasks."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(n, base if n % 3 else f"h{n} {base} t{n} " + " ".join(f"w{i}" for i in range(n % 50))) for n in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert found(df) == plain(rows)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_that_share_an_id(spark, doc_id):
    """Texts of one id whose hashes have 24 bits in common: only the one that holds the passage is cut."""
    passage = " ".join(f"p{i}" for i in range(30))
    own = []
    for n, m in [(1990, 14360), (2449, 8677), (2592, 979)]:
        cut, clean = f"{passage} a{n}", " ".join(f"c{m}x{i}" for i in range(40))
        low = [r[0] & 0xFFFFFF for r in spark.createDataFrame([(cut,), (clean,)], "t string").selectExpr("xxhash64(t)").collect()]
        assert low[0] == low[1]
        own += [(doc_id, cut), (doc_id, clean), (doc_id, clean)]
    rows = [(0, passage), *own]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == plain(rows)


def test_no_id_comes_after_the_largest(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [((1 << 63) - 1, f"{text} a")] + [(None, f"{text} b{n}") for n in range(8)]
    kept = {r.doc_id: r.n_removed for r in seed_extend.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {(1 << 63) - 1: 0, None: 30}


def test_query(spark):
    import hashlib

    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in llm_queries()["op8_seed_extend"](spark, sf_dir).collect()], key=str)
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, kept, n, gone in plain(rows)]
    assert got == sorted(want, key=str)


def test_texts_are_shuffled_once(spark, plan_of):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = seed_extend.remove_repeats(df)
        result.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = plan_of(result).split("== Initial Plan ==")[0]
    # One scan looks for anchors, the other feeds the exchange that all three joins read.
    assert plan.count("FileScan") == 2 and plan.count("SortMergeJoin") == 3


def test_empty(no_documents):
    assert seed_extend.remove_repeats(no_documents).collect() == []


def test_merged():
    owner, s, e = (np.array(x) for x in ([1, 0, 1, 0, 1], [5, 0, 0, 30, 9], [9, 20, 3, 40, 12]))
    assert [x.tolist() for x in seed_extend.merged(owner, s, e)] == [[0, 0, 1, 1], [0, 30, 0, 5], [20, 40, 3, 12]]


def test_every_window_has_its_anchor():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(30)]
    words = seed_extend.Words(pa.array(texts))
    text, place, _, head, tail = words.anchors(20)
    windows = [i for t in range(30) for i in range(words.first[t], words.first[t + 1] - 19)]
    assert sorted(i for a, b in zip(head, tail) for i in range(a, b + 1)) == windows
    assert ((tail <= place) & (place + seed_extend.ANCHOR_WORDS <= head + 20)).all()
    assert (np.searchsorted(words.first, place, "right") - 1 == text).all()


@pytest.mark.parametrize("hot", [7, None])
def test_many_equal_rows(spark, hot):
    """Equal rows are one document: work grows with their number, and each gets the same result."""
    text = " ".join(f"w{n}" for n in range(400))
    rows = [(hot, text)] * 20_000 + [(3, " ".join(f"w{n}" for n in range(50, 100)) + " end"), (9, "x " + text), (9, "x " + text)]
    start = time.perf_counter()
    got = seed_extend.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert time.perf_counter() - start < 120
    found = Counter((r.doc_id, r.n_words, r.n_removed) for r in got)
    # 3 comes first; 7 has the rest; without an id the row comes last and 9 keeps what 7 would.
    want = {(7, 400, 50): 20_000, (3, 51, 0): 1, (9, 401, 400): 2} if hot else {(None, 400, 400): 20_000, (3, 51, 0): 1, (9, 401, 50): 2}
    assert found == want
