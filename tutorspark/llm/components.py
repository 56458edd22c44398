"""Connected components of links, as Spark joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorspark.llm.storage import keep


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node that it reaches.

    Rounds of large and small stars: every node's larger neighbours, then its smaller ones, are linked
    to the smallest node known to it, until no link changes.  The number of rounds grows with the
    logarithm of a component's width, each round is written to the shared folder, and all that comes
    to the driver is one row of counts.  Links of a crowded node are joined between two plain
    exchanges, which Spark can split.  Self-links and NULL nodes are ignored.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links, before = keep(links.distinct()), None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = keep(large.filter("a <> b").distinct())
        lowest = keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lowest, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        links = keep(small.filter("a <> b").distinct())
        after = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches by the links a-b, for the links found in one task."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
