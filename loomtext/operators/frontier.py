"""Breadth-first frontiers over a table of links, a join a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import host, is_blocked_url, same_site
from .lineage import settled


def crawl_frontier(seeds: DataFrame, links: DataFrame, depth: int = 2, max_urls: int | None = None, same_domain: bool = True, subdomains: bool = False, strip_fragment: bool = True, skip_blocked: bool = False) -> DataFrame:
    """``url, seed, depth`` of every URL within so many links of a seed, each at its least depth.

    ``seeds`` has ``url``, ``links`` has ``url, link``.  A URL that two seeds reach belongs to the one that comes
    first by depth, then by name.  ``max_urls`` keeps the first of each seed by depth, then by name.
    """
    depth = max(0, min(1000, depth))
    bare = lambda c: F.regexp_replace(c, "#.*$", "") if strip_fragment else F.col(c)
    edges = links.select(bare("url").alias("from"), bare("link").alias("to")).distinct()
    found = seeds.select(bare("url").alias("url")).distinct().select("url", F.col("url").alias("seed"), F.lit(0).alias("depth"))
    front = found = settled(found)
    for level in range(1, depth + 1):
        reached = front.join(edges, front["url"] == edges["from"]).select(F.col("to").alias("url"), "seed")
        if same_domain:
            reached = reached.where(same_site(host("url"), host("seed"), subdomains))
        if skip_blocked:
            reached = reached.where(~is_blocked_url("url"))
        fresh = reached.groupBy("url").agg(F.min("seed").alias("seed")).join(found.select("url"), "url", "left_anti")
        front = settled(fresh.withColumn("depth", F.lit(level)).select("url", "seed", "depth"))
        if front.isEmpty():
            break
        found = found.union(front)
    if max_urls is not None:
        place = Window.partitionBy("seed").orderBy("depth", "url")
        found = found.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= max_urls).drop("_rank")
    return found


def seed_limit(depth: int) -> int:
    """URLs that a seed of a list may give, by its depth."""
    return min(max(50, 50 * depth), 1000)


def crawl_depth_list(seeds: DataFrame, links: DataFrame, strip_fragment: bool = True) -> DataFrame:
    """``url, seed, depth`` for a list of seeds (``url, depth, ordinal``), each followed as deep as it asks.

    Every seed has a frontier of its own, on its own host, of at most ``max(50, 50 * depth)`` URLs and 1,000 by depth, then
    name, besides the seed itself.  A URL that several seeds reach stays with the first of them.
    """
    bare = lambda c: F.regexp_replace(c, "#.*$", "") if strip_fragment else F.col(c)
    edges = settled(links.select(bare("url").alias("from"), bare("link").alias("to")).distinct())
    wanted = F.least(F.greatest(F.coalesce("depth", F.lit(0)), F.lit(0)), F.lit(1000))
    start = seeds.groupBy(bare("url").alias("seed")).agg(F.min("ordinal").alias("ordinal"), F.max(wanted).alias("wanted"))
    front = found = settled(start.select("seed", "ordinal", "wanted", F.col("seed").alias("url"), F.lit(0).alias("depth")))
    while True:
        open_ends = front.where("depth < wanted")
        reached = open_ends.join(edges, open_ends["url"] == edges["from"]).where(host("to") == host("seed"))
        fresh = reached.select("seed", "ordinal", "wanted", F.col("to").alias("url"), (F.col("depth") + 1).alias("depth")).distinct()
        front = settled(fresh.join(found.select("seed", "url"), ["seed", "url"], "left_anti").select(*found.columns))
        if front.isEmpty():
            break
        found = found.union(front)
    place = Window.partitionBy("seed").orderBy("depth", "url")
    most = F.least(F.greatest(F.lit(50), F.col("wanted") * 50), F.lit(1000))
    kept = found.withColumn("_rank", F.row_number().over(place) - 1).where((F.col("depth") == 0) | (F.col("_rank") <= most))
    first = kept.groupBy("url").agg(F.min(F.struct("ordinal", "depth", "seed")).alias("f"))
    return first.select("url", "f.seed", "f.depth")
