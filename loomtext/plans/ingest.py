"""Ingestion of fetched pages: sources minus what is done, robots rules, records and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import host, path


def pending_sources(sources: DataFrame, state: DataFrame, kind: str | None = None, limit: int | None = None, retry_errors: bool = False) -> DataFrame:
    """Sources of a type, the first so many, that are neither done nor failed."""
    rows = sources if kind is None else sources.where(F.col("type") == kind)
    if limit is not None:
        rows = rows.orderBy("ordinal").limit(limit)
    seen = state.where("status = 'done'") if retry_errors else state
    return rows.join(seen.select("url").distinct(), "url", "left_anti")


def robots_allowed(rules: Column | str, url_path: Column) -> Column:
    """Whether the longest rule (``allow, prefix``) that a path starts with allows it; an allowing rule wins a tie."""
    hit = F.filter(rules, lambda r: (r["prefix"] != "") & url_path.startswith(r["prefix"]))
    best = F.try_element_at(F.array_sort(F.transform(hit, lambda r: F.struct((-F.length(r["prefix"])).alias("n"), (~r["allow"]).alias("deny")))), F.lit(1))
    return F.coalesce(~best["deny"], F.lit(True))


def robots_rules(files: DataFrame) -> DataFrame:
    """``host, rules`` out of fetched robots files (``host, status_code, body``): 200 is parsed, 401 and 403 deny all,
    any other answer allows all.  The group of all agents counts."""
    group = F.regexp_extract(F.col("body"), r"(?is)user-agent:\s*\*[^\n]*\n(.*?)(?=\n\s*user-agent:|\z)", 1)
    lines = F.regexp_extract_all(group, F.lit(r"(?im)^\s*((?:dis)?allow)\s*:\s*(\S*)"), F.lit(1))
    values = F.regexp_extract_all(group, F.lit(r"(?im)^\s*((?:dis)?allow)\s*:\s*(\S*)"), F.lit(2))
    parsed = F.zip_with(lines, values, lambda k, v: F.struct((F.lower(k) == "allow").alias("allow"), v.alias("prefix")))
    all_denied = F.array(F.struct(F.lit(False).alias("allow"), F.lit("/").alias("prefix")))
    none = F.expr("cast(array() as array<struct<allow:boolean,prefix:string>>)")
    return files.select("host", F.when(F.col("status_code") == 200, parsed).when(F.col("status_code").isin(401, 403), all_denied).otherwise(none).alias("rules"))


def allowed_sources(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """Sources that the rules of their own host allow; no rules allow all."""
    rows = sources.withColumn("host", host("url")).join(rules, "host", "left")
    return rows.where(robots_allowed("rules", F.when(path("url") == "", "/").otherwise(path("url")))).drop("host", "rules")


def allowed_by_first(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``allowed_sources``, but the decision for a host's first source holds for all of them."""
    rows = sources.withColumn("host", host("url"))
    first = rows.groupBy("host").agg(F.min_by("url", "ordinal").alias("first")).join(rules, "host", "left")
    ok = first.where(robots_allowed("rules", F.when(path("first") == "", "/").otherwise(path("first")))).select("host")
    return rows.join(ok, "host", "left_semi").drop("host")


def throttle_violations(requests: DataFrame, seconds: float, ts: str = "ts", url: str = "url") -> DataFrame:
    """Requests that came too soon after the one before to the same host."""
    before = F.lag(ts).over(Window.partitionBy(host(url)).orderBy(ts))
    return requests.withColumn("wait", F.col(ts).cast("double") - before.cast("double")).where(F.col("wait") < seconds)


def state_counts(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("errors"))
