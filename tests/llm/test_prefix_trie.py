"""The prefix trie against lists of whole prefixes in Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tutorspark.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn int, role string, text string, depth int, k1 string"


def plain(rows):
    """Turns with equal numbers must be equal here: their order is the operator's own."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        base, h = c - int(np.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4
        whole[c] = turns if base == c else own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for prefix in nodes:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    found, below = [], {}
    for prefix in sorted(nodes, key=len, reverse=True):
        members, own_children = sorted(nodes[prefix]), children.get(prefix, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0
        saved = (len(members) - 1) * words + sum(below[c][0] for c in own_children)
        leaves = sum(below[c][1] for c in own_children) or 1
        below[prefix] = saved, leaves
        ends = ",".join(str(c) for c in members if whole[c] == list(prefix))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        found.append((members[0], len(prefix), parent, len(members), len(own_children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def trie(df):
    result = pt.prefix_trie(df)
    assert result.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {f.dataType.simpleString() for f in result.schema.fields[:-1]} == {"bigint"}
    return sorted((tuple(r) for r in result.collect()), key=str)


def drawn(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(-7, 70), *(rng.randrange(10**12) for _ in range(20))]:
        turns = 0 if conv == 20 else rng.randrange(1, 7)
        for turn in range(turns):
            said = "hello there" if turn == 0 and rng.random() < 0.5 else rng.choice(["a  b", "c", "", None, "d e f\tg"])
            rows.append((conv, turn if turn else None, rng.choice(["user", "user", None]), said, 1, "x"))
    # A third of all conversations is one, and one is repeated row by row.
    rows += [(100 + c, t, "user", f"copied {t}", 1, "x") for c in range(0, 2000, 20) for t in range(3)]
    rows += [r for r in rows if r[0] == 5]
    rows += [(None, 0, "user", "no id", 1, "x"), (4000, 0, None, "x " * 200_000, 1, "x")]
    return rows


@pytest.mark.parametrize("turns", [3, 1 << 12])
def test_against_whole_prefixes(spark, monkeypatch, turns):
    """With blocks of three turns and shards of as many, too."""
    monkeypatch.setattr(pt, "SHARD_TURNS", turns)
    monkeypatch.setattr(pt, "BLOCK_TURNS", turns)
    rows = drawn(turns)
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_one_long_conversation(spark, monkeypatch):
    """A conversation of a third of all rows is cut into ranges and blocks."""
    monkeypatch.setattr(pt, "SHARD_TURNS", 50)
    monkeypatch.setattr(pt, "BLOCK_TURNS", 50)
    rows = [(3, t, "user", f"turn {t % 7}", 1, "x") for t in range(700)] + [(7, t, "user", f"turn {t % 7}", 1, "x") for t in range(300)]
    rows += [(40 + t, 0, "user", "w w", 1, "x") for t in range(900)] + [(20, 0, None, None, 1, "x")]
    random.Random(0).shuffle(rows)
    assert trie(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_and_turnless(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    # 3 begins with three turns of conversation 0, which does not exist, and has no fourth turn of its own.
    conv = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(conv, t, "user", "x", 1, "x") for t in range(3)]
    (root,) = trie(spark.createDataFrame(rows, SCHEMA))
    assert root[:7] == (conv, 0, None, 1, 0, 1, 0) and [root] == plain(rows)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(0, 2**63, (2, 5000), dtype=np.uint64)
    k1[:2500] = k1[0]
    slots = pt.Slots(k1, k2)
    assert sorted(slots.find(k1, k2).tolist()) == list(range(5000))
    assert (slots.find(k1, k2 + np.uint64(1)) == -1).all()
    assert len(pt.Slots(k1[:0], k2[:0]).find(k1[:3], k2[:3])) == 3
