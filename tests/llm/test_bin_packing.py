"""Best fit against a search of all bins."""

import random

import pytest

from tutorspark.llm import bin_packing
from tutorspark.llm.queries import llm_queries


def plain(sizes, labels, capacity):
    """Bin of each piece: the tightest without a common label, the oldest of equals, or a new one."""
    bins, placed = [], []
    for size, own in zip(sizes, labels):
        own = {(n, x) for n, x in enumerate(own) if x is not None}
        fits = [(room, n) for n, (room, held) in enumerate(bins) if room >= size and not held & own]
        if fits:
            _, n = min(fits)
        else:
            n = len(bins)
            bins.append((capacity, set()))
        room, held = bins[n]
        bins[n] = (room - size, held | own)
        placed.append(n)
    return placed, [room for room, _ in bins]


@pytest.mark.parametrize("seed", range(20))
def test_best_fit(seed):
    rng = random.Random(seed)
    capacity, n = rng.choice([5, 40, 300]), rng.randint(1, 400)
    sizes = [rng.randint(1, capacity) for _ in range(n)]
    if seed % 2:
        sizes.sort(reverse=True)
    labels = [(rng.choice(["hot", "hot", "a", "b", "c", None]), rng.choice([None, 1, *range(2, n + 2)])) for _ in range(n)]
    assert bin_packing.best_fit(sizes, labels, capacity) == plain(sizes, labels, capacity)


def check_packing(rows, docs, capacity):
    """Every word of every document once, no bin too full, no conflict within a bin."""
    want = {}
    for doc, words in docs:
        want.setdefault(doc, []).append(words)
    got = {}
    bins = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.first_word, r.n_words))
        assert (r.bin_id is None) == (r.n_words == 0)
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for doc, lengths in want.items():
        pieces = []
        for words in lengths:
            count = max(-(-words // capacity), 1)
            pieces += [(p, p * capacity, min(capacity, words - p * capacity)) for p in range(count)]
        assert sorted(got[doc]) == sorted(pieces)
    assert got.keys() == want.keys()
    for held in bins.values():
        total = sum(r.n_words for r in held)
        assert total <= capacity and {r.bin_words for r in held} == {total}
        for column in ("source", "cluster"):
            own = [r[column] for r in held if r[column] is not None]
            assert len(own) == len(set(own))


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("shard", [4096, 60])
def test_documents(spark, documents, monkeypatch, shard):
    monkeypatch.setattr(bin_packing, "SHARD_PIECES", shard)
    df, rows = documents
    got = bin_packing.pack(df, capacity=500).collect()
    check_packing(got, [(r[0], words(r[1])) for r in rows], 500)


def test_shards_are_packed_by_best_fit(spark, documents):
    """All bins of a shard, against the plain search over its pieces in the order they were placed."""
    df, _ = documents
    rows = bin_packing.pack(df, capacity=700).filter("n_words > 0").collect()
    assert len({r.bin_id >> bin_packing.BINS_A_SHARD for r in rows}) == 1
    placed, rooms = plain([r.n_words for r in rows], [(r.source, r.cluster) for r in rows], 700)
    assert [r.bin_id for r in rows] == placed and [r.bin_words for r in rows] == [700 - rooms[b] for b in placed]


def test_copies(spark):
    """A cluster with a third of all rows, and a source with another."""
    rows = [(n, "same text here" if n % 3 == 0 else f"text {n}", "hot" if n % 3 == 1 else f"s{n}") for n in range(900)]
    got = bin_packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=10).collect()
    check_packing(got, [(r[0], words(r[1])) for r in rows], 10)
    assert len({r.bin_id for r in got}) < 500


def test_given_clusters_and_clashing_columns(spark):
    rows = [(1, "a b", "x", 5, "p"), (2, "c d", "y", 5, "q"), (3, "e f", "z", None, "r")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, cluster int, number string")
    got = {r.doc_id: r for r in bin_packing.pack(df, capacity=6, cluster=df["cluster"]).collect()}
    assert got[1].bin_id != got[2].bin_id and got[3].bin_id in (got[1].bin_id, got[2].bin_id)


def test_bins_do_not_depend_on_partitions(spark, documents, monkeypatch):
    monkeypatch.setattr(bin_packing, "SHARD_PIECES", 60)
    monkeypatch.setattr(bin_packing, "COPIES_A_RUN", 7)
    df, rows = documents
    repeated = df.union(spark.createDataFrame([rows[3]] * 100, df.schema))

    def bins(parts):
        packed = bin_packing.pack(repeated.repartition(parts), capacity=500).collect()
        return sorted(((r.bin_id, str(r.doc_id), r.piece, r.n_words, str(r.source)) for r in packed), key=str)

    first = bins(1)
    assert first == bins(6) == bins(13) and len(first) > len(rows) + 100 - 1


def test_empty(no_documents):
    assert bin_packing.pack(no_documents).collect() == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(llm_queries()["op4_bin_packing"](spark, sf_dir).collect(), docs, bin_packing.CAPACITY)
