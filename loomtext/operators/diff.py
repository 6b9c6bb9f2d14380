"""Differences of two corpora, by key; the last record of a key counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import first_by


@dataclass(frozen=True)
class CorpusDiff:
    added: DataFrame
    removed: DataFrame
    changed: DataFrame
    stats: DataFrame


def record_key() -> Column:
    """The content's hash, or the URL without one."""
    return F.coalesce(F.when(F.col("content_sha1") != "", F.col("content_sha1")), F.col("source_url"))


def diff_corpora(old: DataFrame, new: DataFrame) -> CorpusDiff:
    """Added and removed by anti join on the key, changed by equal URL and different hash.  Changed rows are
    also among the added and the removed ones."""
    has_key = record_key().isNotNull() & (record_key() != "")
    a = first_by(old.where(has_key), record_key(), last=True).withColumn("_k", record_key())
    b = first_by(new.where(has_key), record_key(), last=True).withColumn("_k", record_key())
    added, removed = b.join(a.select("_k"), "_k", "left_anti").drop("_k"), a.join(b.select("_k"), "_k", "left_anti").drop("_k")
    by_url = lambda df: first_by(df.drop("_k").where("source_url is not null and source_url <> ''"), F.col("source_url"), last=True).select("source_url", "content_sha1", "content")
    x, y = by_url(a), by_url(b)
    changed = x.alias("o").join(y.alias("n"), "source_url").where(~F.col("o.content_sha1").eqNullSafe(F.col("n.content_sha1")))
    changed = changed.select("source_url", F.col("o.content_sha1").alias("old_sha1"), F.col("n.content_sha1").alias("new_sha1"), F.length("o.content").alias("old_chars"), F.length("n.content").alias("new_chars"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    stats = count(a, "old_total").crossJoin(count(b, "new_total")).crossJoin(count(added, "added")).crossJoin(count(removed, "removed")).crossJoin(count(changed, "changed"))
    return CorpusDiff(added, removed, changed, stats)


def render_diff(stats: dict, changed: list[dict], limit: int = 100) -> str:
    """A small HTML page of the counts and the first changed records."""
    from html import escape

    head = "".join(f"<tr><th>{escape(str(k))}</th><td>{escape(str(v))}</td></tr>" for k, v in stats.items())
    short = lambda x: escape((x or "-")[:10])
    body = "".join(f"<tr><td>{escape(r['source_url'])}</td><td>{short(r['old_sha1'])}</td><td>{short(r['new_sha1'])}</td></tr>" for r in changed[:limit])
    return f"<!doctype html><meta charset=utf-8><title>Corpus diff</title><table>{head}</table><table>{body}</table>"
