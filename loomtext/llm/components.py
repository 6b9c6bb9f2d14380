"""Connected components of a table of links, by union-find within partitions and stars across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import BROADCAST_IDS, mark, trimmed, written

#: Links that one union-find holds at once; beyond it, a partition is contracted in runs.
RUN = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of a partition's links becomes stars around the smallest member."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        found = [(x, r) for x in list(parent) if (r := find(x)) != x]
        parent.clear()
        return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["hi", "lo"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ru, rv = find(u), find(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
        if len(parent) > RUN:
            yield stars()
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links`` (two long columns): component is the smallest node reachable.

    Each partition's links are first contracted by union-find.  Large-star and small-star rounds
    then connect every node to the smallest of its neighbours until only stars are left; each takes
    minima with partial aggregation, and joins them by broadcast while a count bounds them, and else by a join that Spark
    splits where a hub is skewed.
    Null ends and loops are dropped; without links the result is empty.
    """
    since = mark(links.sparkSession)
    a, b = links.columns[:2]
    links = links.select(F.col(a).alias("hi"), F.col(b).alias("lo")).where("hi is not null and lo is not null and hi <> lo")
    stars = written(links.mapInArrow(_contract, "hi long, lo long"), "links")
    before, edges = None, stars.count()
    while True:
        # A node's minimum is a row; so many rows at most are sent to the links, whose hubs then need not meet in one task.
        hint = F.broadcast if 2 * edges <= BROADCAST_IDS else lambda df: df
        both = stars.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(stars.select("lo", "hi"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(hint(least), "x").where("y > x and y <> m").select(F.col("y").alias("hi"), F.col("m").alias("lo"))
        large = large.union(least.where("x <> m").select("x", "m"))
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(hint(low), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", "m"))
        stars = written(small.distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        trimmed(stars, since)
        if now == before:
            break
        before, edges = now, now[0]
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(stars.select("lo", "lo").distinct())
