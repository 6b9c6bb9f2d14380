"""Merging lists of sources: equal URLs, then equal canonical ones; the first stays and takes all categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.url import canonical_url
from .dedup import first_by


def canonical_key(url="url"):
    return F.lower(F.regexp_replace(canonical_url(url), "/+$", ""))


def merge_sources(sources: DataFrame) -> DataFrame:
    """``sources`` has ``url, categories, ordinal`` and more; categories are sorted, which the order of files doesn't change."""
    rows = sources.withColumn("_k", canonical_key())
    first = first_by(rows, F.col("_k")).drop("categories")
    every = rows.select("_k", F.explode("categories").alias("c")).groupBy("_k").agg(F.array_sort(F.collect_set("c")).alias("categories"))
    merged = first.join(every, "_k", "left").drop("_k")
    return merged.withColumn("categories", F.coalesce("categories", F.expr("cast(array() as array<string>)")))


def merge_stats(sources: DataFrame, file_col: str = "file") -> DataFrame:
    """Sources by file, and those that were first in the merge."""
    rows = sources.withColumn("_k", canonical_key())
    first = rows.groupBy("_k").agg(F.min("ordinal").alias("ordinal"))
    kept = rows.join(first.select("ordinal").withColumn("kept", F.lit(1)), "ordinal", "left")
    return kept.groupBy(file_col).agg(F.count("*").alias("total"), F.count("kept").alias("kept"))


def first_urls(sources: DataFrame) -> DataFrame:
    """The first source of each URL, compared as it is."""
    return first_by(sources, F.col("url"))
