"""Corpus and pair statistics: plain aggregations, each with a partial step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_language_simple
from ..functions.tokens import estimate_tokens
from ..functions.url import domain


def corpus_totals(records: DataFrame, content: str = "content") -> DataFrame:
    chars = F.coalesce(F.sum(F.length(content)), F.lit(0))
    return records.agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("is_duplicate", F.lit(False))).alias("duplicates"), chars.alias("total_chars"),
        F.when(F.count("*") > 0, F.floor(chars / F.count("*"))).otherwise(0).alias("avg_chars"),
    )


def corpus_breakdown(records: DataFrame) -> DataFrame:
    """``dimension, key, n`` for type, language, category, license and day, in one pass over exploded keys."""
    entry = lambda name, key: F.struct(F.lit(name).alias("dimension"), key.cast("string").alias("key"))
    keys = [entry("type", F.coalesce("source_type", F.lit("unknown"))), entry("language", F.coalesce("language", F.lit("unknown"))), entry("license", F.coalesce("license", F.lit("unknown"))), entry("date", F.substring("date_accessed", 1, 10))]
    categories = F.transform(F.coalesce("categories", F.expr("cast(array() as array<string>)")), lambda c: entry("category", c))
    exploded = records.select(F.explode(F.concat(F.array(*keys), categories)).alias("e")).select("e.*")
    return exploded.where("key is not null and key <> ''").groupBy("dimension", "key").agg(F.count("*").alias("n"))


def records_per_minute(rows: DataFrame, ts: Column) -> DataFrame:
    return rows.where(ts.isNotNull()).groupBy(F.date_trunc("minute", ts).alias("minute")).agg(F.count("*").alias("n"))


def top_domains(rows: DataFrame, url: str = "url", k: int = 10) -> DataFrame:
    """The k domains with the most rows, ties by name."""
    return rows.groupBy(domain(url).alias("domain")).agg(F.count("*").alias("n")).where("domain <> ''").orderBy(F.desc("n"), "domain").limit(k)


def ok_error_by(rows: DataFrame, key: Column, ok: Column, k: int = 15) -> DataFrame:
    """Good and bad rows of the k keys with the most rows."""
    good = F.count_if(F.coalesce(ok, F.lit(False)))
    counted = rows.groupBy(key.alias("key")).agg(good.alias("ok"), (F.count("*") - good).alias("error"))
    return counted.orderBy(F.desc(F.col("ok") + F.col("error")), "key").limit(k)


def histogram(rows: DataFrame, value: Column, bins: int = 10, low: float | None = None, high: float | None = None) -> DataFrame:
    """``bin, n``: equal widths from ``low`` to ``high``, or from the least to the largest value, which falls in the last bin."""
    v = rows.select(value.cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")) if low is None else v.sparkSession.range(1).select(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.when(width > 0, F.greatest(F.lit(0), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))).otherwise(0)
    return v.join(F.broadcast(ends)).groupBy(slot.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def pair_report(pairs: DataFrame) -> DataFrame:
    """Average characters and tokens by task type."""
    return pairs.groupBy(F.coalesce("task_type", F.lit("unknown")).alias("task_type")).agg(
        F.count("*").alias("n"), F.avg(F.length("prompt")).alias("prompt_chars"), F.avg(F.length("completion")).alias("completion_chars"),
        F.avg(estimate_tokens("prompt")).alias("prompt_tokens"), F.avg(estimate_tokens("completion")).alias("completion_tokens"),
    )


def report_sample(pairs: DataFrame, n: int = 500, seed: int = 42, key: str = "ordinal") -> DataFrame:
    """The rows a report looks at: the first ``n`` in the order of a hash, which partitioning doesn't change."""
    return pairs.orderBy(F.sha1(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def language_shares(pairs: DataFrame, column: str = "completion") -> DataFrame:
    counted = pairs.groupBy(detect_language_simple(column).alias("language")).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))


def stage_counts(stages: dict[str, DataFrame], type_col: str = "task_type") -> DataFrame:
    """Pairs of each type after each stage."""
    parts = [df.groupBy(F.coalesce(F.col(type_col), F.lit("unknown")).alias("task_type")).agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "task_type", "n") for i, (name, df) in enumerate(stages.items())]
    return reduce(DataFrame.unionByName, parts)


def collapse_warnings(counts: DataFrame, share: float = 0.1) -> DataFrame:
    """Types that a stage loses, or leaves less than a tenth of."""
    after = counts.select((F.col("step") - 1).alias("step"), "task_type", F.col("stage").alias("next_stage"), F.col("n").alias("left"))
    stages = counts.select((F.col("step") - 1).alias("step"), F.col("stage").alias("s")).distinct()
    joined = counts.join(F.broadcast(stages), "step").join(after.drop("next_stage"), ["step", "task_type"], "left")
    kind = F.when(F.col("left").isNull(), "vanished").when(F.col("left") < share * F.col("n"), "collapsed")
    return joined.select("task_type", F.col("s").alias("stage"), "n", F.coalesce("left", F.lit(0)).alias("left"), kind.alias("warning")).where("warning is not null")


def validate_corpus(records: DataFrame, supported: tuple[str, ...] = ("html", "pdf", "github_repo", "stackexchange", "forum")) -> DataFrame:
    """Warnings about a corpus, a row each."""
    n = records.agg(F.count("*").alias("n"), F.count_if(F.coalesce("content", F.lit("")) == "").alias("empty"), F.count_if(F.coalesce(F.col("source_type").isin(*supported), F.lit(False))).alias("known"))
    found = F.array_compact(F.array(
        F.when(F.col("n") == 0, "the corpus has no valid records"),
        F.when((F.col("n") > 0) & (F.col("known") == 0), "no record has a supported source_type"),
        F.when(F.col("empty") > 0.5 * F.col("n"), "more than half of the records have no content"),
    ))
    return n.select(F.explode(found).alias("warning"))


def html_report(totals: dict, by_type: list[tuple[str, int]], lengths: list[tuple[int, int]], title: str = "Dataset report") -> str:
    """A page of counts with bars; aggregates are computed before, nothing here grows with the data."""
    from html import escape

    top = max([n for _, n in by_type] or [1])
    bars = "".join(f'<g transform="translate(0,{22 * i})"><text y="14">{escape(str(k)[:12])}</text><rect x="110" width="{300 * n // top}" height="16"></rect><text x="{115 + 300 * n // top}" y="14">{n}</text></g>' for i, (k, n) in enumerate(by_type))
    tall = max([n for _, n in lengths] or [1])
    columns = "".join(f'<rect x="{30 * b}" y="{100 - 100 * n // tall}" width="26" height="{100 * n // tall}"><title>{n}</title></rect>' for b, n in lengths)
    rows = "".join(f"<tr><th>{escape(str(k))}</th><td>{escape(str(v))}</td></tr>" for k, v in totals.items())
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1><table>{rows}</table><svg width="520" height="{22 * len(by_type) + 10}">{bars}</svg><svg width="320" height="110">{columns}</svg>'
