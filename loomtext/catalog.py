"""The queries of the core operators and the SQL they are checked against.

Queries run over whole tables.  Where SQL can't express an operator there is no text for it, and tests hold it
against a plain implementation instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pii, quality, tokens
from .functions import text as T
from .functions import url as U
from .operators import dedup, diff, formats, frontier, generators, merge, pairs, stats
from .plans import ingest, postprocess
from .sources import html, readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.documents_as_records(_docs(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.conversations_to_pairs(_table(spark, sf_dir, "conversations"))


# SQL pieces.  RE2 has no Unicode classes for \w and \b, and no look-around.

METRICS = r"""
metrics AS (
  SELECT doc_id, lang, text, coalesce(length(text), 0) AS chars,
    CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text)::DOUBLE, 3) END AS alpha_ratio,
    list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: lower(trim(x, chr(32) || chr(9) || chr(13)))), lambda x: x <> '') AS lines,
    length(regexp_replace(substr(text, 1, 5000), '[^a-zA-Z]', '', 'g')) AS lat,
    length(regexp_replace(substr(text, 1, 5000), '[^\x{0400}-\x{04FF}]', '', 'g')) AS cyr,
    regexp_replace(list_extract(string_split(regexp_replace(text, '\n$', ''), chr(10)), -1), '(?i)^.*(^|[^\p{L}\p{N}_])(radio|electronics|circuit|schematic|datasheet)($|[^\p{L}\p{N}_])', '') AS tail
  FROM documents
), measured AS (
  SELECT doc_id, lang, text, chars, alpha_ratio,
    CASE WHEN len(lines) > 0 THEN round((len(lines) - len(list_distinct(lines))) / len(lines)::DOUBLE, 3) ELSE 0.0 END AS dup_line_ratio,
    CASE WHEN cyr > lat * 1.5 THEN 'ru' WHEN lat > cyr * 1.5 THEN 'en' WHEN cyr + lat = 0 THEN NULL WHEN cyr > 0 AND lat > 0 THEN 'mixed' WHEN cyr > lat THEN 'ru' ELSE 'en' END AS language,
    length(trim(text)) >= 30 AND NOT regexp_matches(lower(text), 'electronics|circuit|schematic|datasheet|microcontroller')
      AND length(regexp_replace(tail, '^[^\p{L}\p{N}_]+', '')) >= 200 AS spam
  FROM metrics
), judged AS (
  SELECT *, CASE WHEN chars < 200 THEN 'too_short' WHEN chars > 200000 THEN 'too_long' WHEN alpha_ratio < 0.7 THEN 'low_alpha'
    WHEN dup_line_ratio > 0.5 THEN 'too_many_dup_lines' WHEN spam THEN 'spam_or_low_quality'
    WHEN language NOT IN ('ru', 'en', 'mixed') THEN 'wrong_language:' || language END AS reason,
    round(0.4 * least(chars / 1000.0, 1.0) + 0.25 * alpha_ratio + 0.15 * (1 - dup_line_ratio) + 0.10 + 0.10 * CASE WHEN language IN ('ru', 'en', 'mixed') THEN 1 ELSE 0 END, 3) AS quality_score
  FROM measured
)
"""

CONV_PAIRS = """
turns AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'content': text} ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id
), pairs AS (
  SELECT conv_id AS ordinal, len(t) AS n,
    coalesce(array_to_string(list_transform(t[1:len(t) - 1], lambda x: CASE WHEN x.role = 'user' THEN 'User: ' WHEN x.role = 'system' THEN 'System: ' ELSE 'Assistant: ' END || x.content), chr(10) || chr(10)), '') AS prompt,
    t[len(t)].content AS completion, CASE WHEN len(t) > 2 THEN 'multi_turn_dialogue' ELSE 'single_turn' END AS task_type, 'conv://' || conv_id AS source, t
  FROM turns
)
"""


# Quality


@query(f"WITH {METRICS} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM judged GROUP BY 1")
def quality_reject_histogram(spark, sf_dir):
    judged = postprocess.with_quality(_docs(spark, sf_dir), content="text")
    return judged.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {METRICS} SELECT doc_id, chars, alpha_ratio, dup_line_ratio, language, spam, reason, quality_score FROM judged")
def quality_metrics(spark, sf_dir):
    judged = postprocess.with_quality(_docs(spark, sf_dir), content="text")
    return judged.select("doc_id", F.col("metrics.chars").cast("long").alias("chars"), "metrics.alpha_ratio", "metrics.dup_line_ratio", "metrics.language", "metrics.spam", "reason", "quality_score")


@query(f"WITH {METRICS} SELECT lang, coalesce(language, 'none') AS language, count(*) AS n FROM measured GROUP BY 1, 2")
def language_confusion(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang", F.coalesce(T.detect_language("text"), F.lit("none")).alias("language")).agg(F.count("*").alias("n"))


@query(f"WITH {METRICS} SELECT l.quality, (j.reason IS NULL) AS passed, count(*) AS n FROM judged j JOIN labels l USING (doc_id) GROUP BY 1, 2")
def quality_vs_labels(spark, sf_dir):
    judged = postprocess.with_quality(_docs(spark, sf_dir), content="text").join(_table(spark, sf_dir, "labels"), "doc_id")
    return judged.groupBy("quality", F.col("reason").isNull().alias("passed")).agg(F.count("*").alias("n"))


@query()
def code_share(spark, sf_dir):
    """Blocks of the documents as they are, which the given tables have none of: tested against plain Python, and with SQL as ``code_blocks_of_all_kinds``."""
    return _docs(spark, sf_dir).select("doc_id", F.size(quality.code_blocks("text")).alias("n_blocks"), quality.code_ratio("text").alias("code_ratio"))


# Text


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(9) || chr(10)) AS text FROM documents")
def normalize_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_whitespace("text").alias("text"))


@query("SELECT doc_id, sha1(replace(replace(text, 'ё', 'е'), 'Ё', 'Е')) AS sha1 FROM documents")
def yo_fingerprint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.text_sha1(T.normalize_yo("text")).alias("sha1"))


@query(r"SELECT doc_id, CASE WHEN n = 0 THEN 0 WHEN n < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, n - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS n_shingles FROM (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents))")
def shingle_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.shingle_hashes("text", 5)).cast("long").alias("n_shingles"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, CAST(floor(length(text) / 4.0) AS INTEGER)) END AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tokens.estimate_tokens("text").alias("n_tokens"))


@query()
def pii_redact(spark, sf_dir):
    """Word boundaries are Unicode's, which SQL's patterns don't have: Python's are the test."""
    clean = pii.remove_pii("text")
    return _docs(spark, sf_dir).select("doc_id", "text", clean.alias("clean")).select("doc_id", F.sha1("clean").alias("sha1"), (F.col("clean") != F.col("text")).alias("changed"))


@query()
def pii_kinds(spark, sf_dir):
    """Documents by kind of personal data."""
    return _docs(spark, sf_dir).select(F.explode(F.map_keys(pii.detect_pii("text"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# Duplicates

_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(9) || chr(10))"


@query(f"SELECT doc_id AS ordinal, 'doc://' || first AS first_url FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha1({_NORM})) AS first FROM documents WHERE text <> '') WHERE doc_id > first")
def exact_dedup_map(spark, sf_dir):
    return dedup.exact_duplicates(_records(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(DISTINCT sha1({_NORM})) AS kept, count(*) - count(DISTINCT sha1({_NORM})) AS removed FROM documents")
def exact_dedup_stats(spark, sf_dir):
    return dedup.dedup_stats(dedup.flag_duplicates(_records(spark, sf_dir), minhash=False, images=False))


@query()
def minhash_lsh_dups(spark, sf_dir):
    """Candidates by bands of an own hash: not for SQL; a sequential index is the test."""
    return dedup.minhash_duplicates(_records(spark, sf_dir))


@query()
def dedup_flags(spark, sf_dir):
    """Exact, MinHash and URL flags together."""
    return dedup.flag_duplicates(_records(spark, sf_dir), images=False).select("ordinal", "is_duplicate", "duplicate_of")


@query(r"""WITH base AS (SELECT conv_id, turn, string_split_regex(trim(lower(text)), '\s+') AS w, trim(lower(text)) AS t FROM conversations),
sh AS (SELECT conv_id, turn, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [t] END) AS s FROM base)
SELECT conv_id, turn, array_to_string(list_transform(range(0, 16), lambda i: list_min(list_transform(s, lambda x: sha1(i || ':' || x)))), ',') AS signature FROM sh""".replace("range(0, 16)", "range(0, 128)"))
def minhash_signature_sha1(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(dedup.sha1_signature("text"), ",").alias("signature"))


@query()
def semantic_dedup_prompts(spark, sf_dir):
    """First-wins over a similarity graph: not for SQL; a sequential scan is the test.  Every prompt stands again, with a word more."""
    rows = _pairs(spark, sf_dir).select("ordinal", "prompt")
    rows = rows.union(rows.select(F.col("ordinal") + 1_000_000, F.concat("prompt", F.lit(" indeed"))))
    return dedup.similar_to_earlier(rows, "prompt", 0.85, 128).select("ordinal", "keeper", F.round("similarity", 6).alias("similarity"))


# URLs and pages

_CANON = r"""regexp_replace(url, '#.*$', '')"""
_PARTS = r"""parts AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS base,
  list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND NOT regexp_matches(p, '(?i)^utm_'))) AS q FROM pages),
canon AS (SELECT page_id, url, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM parts)"""


@query(f"WITH {_PARTS} SELECT page_id, canonical_url FROM canon")
def canonical_urls(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", U.canonical_url("url").alias("canonical_url"))


_TWICE_PARTS = _PARTS.replace("FROM pages)", "FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=again#x' FROM pages))")


@query(f"WITH {_TWICE_PARTS} SELECT page_id, first_url FROM (SELECT page_id, first_value(url) OVER (PARTITION BY canonical_url ORDER BY page_id) AS first_url, min(page_id) OVER (PARTITION BY canonical_url) AS f FROM canon) WHERE page_id > f")
def url_dedup(spark, sf_dir):
    """Every page again, under a URL that is the same only in its canonical form."""
    rows = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), F.col("url").alias("source_url"))
    again = F.concat(F.regexp_replace("source_url", "#.*$", ""), F.when(F.col("source_url").contains("?"), "&").otherwise("?"), F.lit("utm_source=again#x"))
    return dedup.url_duplicates(rows.union(rows.select(F.col("ordinal") + 1_000_000, again))).withColumnRenamed("ordinal", "page_id")


@query(r"SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def domain_top10(spark, sf_dir):
    return stats.top_domains(_table(spark, sf_dir, "pages"))


@query(r"""SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS domain, substr(sha1(url), 1, 12) AS url_hash,
CASE WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\.pdf$') THEN 'pdf' ELSE 'html' END AS source_type, regexp_matches(url, 'youtube\.com|vimeo\.com|\.mp4') AS blocked FROM pages""")
def url_facts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", U.domain("url").alias("domain"), U.url_hash("url").alias("url_hash"), U.detect_source_type("url").alias("source_type"), U.is_blocked_url("url").alias("blocked"))


_LINKS = r"""links AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*') || h AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages) WHERE h LIKE '/%')"""


@query(f"WITH {_LINKS} SELECT url, link FROM links")
def page_links(spark, sf_dir):
    return html.page_links(_table(spark, sf_dir, "pages"))


@query(f"""WITH {_LINKS}, seeds AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages),
edges AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS f, regexp_replace(link, '#.*$', '') AS t FROM links),
l1 AS (SELECT e.t AS url, min(s.url) AS seed FROM seeds s JOIN edges e ON s.url = e.f WHERE e.t NOT IN (SELECT url FROM seeds) GROUP BY 1)
SELECT url, url AS seed, 0 AS depth FROM seeds UNION ALL SELECT url, seed, 1 AS depth FROM l1""")
def link_frontier(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return frontier.crawl_frontier(pages.select("url"), html.page_links(pages), depth=2)


@query()
def html_main_text(spark, sf_dir):
    """Text of pages by a chain of patterns; a DOM parser is the test."""
    return _table(spark, sf_dir, "pages").select("page_id", html.title("html").alias("title"), html.main_text("html").alias("text"))


@query("""WITH s AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS file, regexp_extract(url, '://[^/?#]*/([a-z]+)/', 1) AS c,
lower(regexp_replace(canonical_url, '/+$', '')) AS k FROM (""" + f"WITH {_PARTS} SELECT page_id, url, canonical_url FROM canon" + """))
SELECT first(url ORDER BY page_id) AS url, array_to_string(list_sort(list_distinct(list(c))), ',') AS categories, min(page_id) AS ordinal FROM s GROUP BY k""")
def merge_sources_categories(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), "url", F.array(F.regexp_extract("url", "://[^/?#]*/([a-z]+)/", 1)).alias("categories"))
    return merge.merge_sources(rows).select("url", F.array_join("categories", ",").alias("categories"), "ordinal")


@query()
def summary_pairs(spark, sf_dir):
    """Extracted from paragraphs of pages."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), F.col("url").alias("source_url"), html.paragraph_text("html").alias("content"))
    return generators.extract_summaries(pages).select("ordinal", "pos", "prompt", "completion", "task_type", "source")


@query()
def article_summary_pairs(spark, sf_dir):
    """Generated from chunks of pages."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), F.col("url").alias("source_url"), html.paragraph_text("html").alias("content"))
    return generators.article_summaries(generators.chunk_records(pages), generators.Prompts())


@query()
def chunk_documents(spark, sf_dir):
    """Chunks of documents with their numbers."""
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    return generators.chunk_records(rows).select("doc_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce("total_chunks", F.lit(1)).alias("total_chunks"), F.length("content").alias("chars"))


# Pairs


@query(f"WITH {CONV_PAIRS} SELECT ordinal, prompt, completion, task_type, source, n AS n_turns FROM pairs")
def conversation_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("ordinal", "prompt", "completion", "task_type", "source", F.size("conversation").cast("long").alias("n_turns"))


_REASON = r"""CASE WHEN length(prompt) < 20 THEN 'prompt_too_short' WHEN length(prompt) > 8000 THEN 'prompt_too_long' WHEN length(completion) < 20 THEN 'completion_too_short'
WHEN length(completion) > 16000 THEN 'completion_too_long' WHEN trim(prompt) = trim(completion) THEN 'prompt_equals_completion'
WHEN length(regexp_replace(prompt, '[^\p{L}]', '', 'g')) < length(prompt) * 0.3 THEN 'low_alpha_prompt' END"""


@query(f"WITH {CONV_PAIRS} SELECT ordinal, coalesce({_REASON}, 'ok') AS reason FROM pairs")
def pair_filter(spark, sf_dir):
    return _pairs(spark, sf_dir).select("ordinal", F.coalesce(pairs.pair_reason(), F.lit("ok")).alias("reason"))


@query(f"""WITH {CONV_PAIRS}, t AS (SELECT ordinal, CASE WHEN prompt = '' THEN 0 ELSE greatest(1, CAST(floor(length(prompt) / 4.0) AS INTEGER)) END AS p, CASE WHEN completion = '' THEN 0 ELSE greatest(1, CAST(floor(length(completion) / 4.0) AS INTEGER)) END AS c FROM pairs)
SELECT ordinal, CASE WHEN p < 5 THEN 'prompt_too_few_tokens' WHEN p > 2000 THEN 'prompt_too_many_tokens' WHEN c < 5 THEN 'completion_too_few_tokens' WHEN c > 4000 THEN 'completion_too_many_tokens' ELSE 'ok' END AS reason FROM t""")
def token_limit_filter(spark, sf_dir):
    return _pairs(spark, sf_dir).select("ordinal", F.coalesce(tokens.token_limit_reason(), F.lit("ok")).alias("reason"))


@query(f"WITH {CONV_PAIRS}, r AS (SELECT ordinal, task_type, row_number() OVER (PARTITION BY task_type ORDER BY sha1('42|' || ordinal)) AS k FROM pairs) SELECT ordinal, task_type FROM r WHERE k <= 30")
def balance_by_type(spark, sf_dir):
    return pairs.balance_by_type(_pairs(spark, sf_dir), 30).select("ordinal", "task_type")


@query("""WITH r AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY sha1('42|' || doc_id)) AS k FROM documents)
SELECT doc_id, lang, CASE WHEN k <= CASE WHEN n >= 2 AND greatest(1, floor(n * 0.1)) >= n THEN n - 1 ELSE greatest(1, floor(n * 0.1)) END THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf_dir):
    return pairs.split_dataset(_docs(spark, sf_dir), 0.1, 42, type_col="lang", key="doc_id").select("doc_id", "lang", "split")


def _format_query(fmt: str, sql: str) -> None:
    def run(spark, sf_dir):
        rows = _pairs(spark, sf_dir).where("prompt <> '' and completion <> ''")
        cols = formats.fields(rows, fmt)
        flat = [F.array_join(F.transform(c, lambda t: F.concat_ws("=", *[t[f] for f in (("from", "value") if fmt in ("sharegpt", "axolotl") else ("role", "content"))])), "|").alias("turns") if fmt in ("sharegpt", "axolotl", "llama_factory") and i == 0 else c for i, c in enumerate(cols)]
        return rows.select("ordinal", *flat)

    run.__name__ = f"fmt_{fmt}"
    query(f"WITH {CONV_PAIRS} SELECT ordinal, {sql} FROM pairs WHERE prompt <> '' AND completion <> ''")(run)


_FROM = "CASE WHEN x.role = 'assistant' THEN 'gpt' WHEN x.role = 'system' THEN 'system' ELSE 'human' END"
_said = lambda role: f"array_to_string(list_transform(list_filter(t, lambda x: x.content <> ''), lambda x: {role} || '=' || x.content), '|') AS turns, source, task_type"
_format_query("jsonl", "prompt, completion, task_type, source")
_format_query("alpaca", "trim(string_split(prompt, chr(10))[1]) AS instruction, CASE WHEN contains(prompt, chr(10)) THEN trim(substr(prompt, instr(prompt, chr(10)) + 1), chr(32) || chr(9) || chr(10)) ELSE '' END AS input, completion AS output")
_format_query("chatml", "array_to_string(list_transform(list_filter(t, lambda x: x.content <> ''), lambda x: '<|im_start|>' || x.role || chr(10) || x.content || '<|im_end|>'), chr(10)) AS text, task_type")
_format_query("sharegpt", _said(_FROM))
_format_query("axolotl", _said(_FROM))
_format_query("llama_factory", _said("x.role"))


# Differences


def _halves(spark, sf_dir):
    rows = _records(spark, sf_dir)
    url = F.concat(F.lit("doc://"), F.floor(F.col("ordinal") / 2).cast("string"))
    return [rows.where(F.col("ordinal") % 2 == i).withColumn("source_url", url) for i in (0, 1)]


_HALVES = """h AS (SELECT doc_id, doc_id % 2 AS half, 'doc://' || (doc_id // 2) AS source_url, sha1(text) AS content_sha1, length(text) AS chars FROM documents),
keyed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY half, content_sha1 ORDER BY doc_id DESC) AS k FROM h) WHERE k = 1),
byurl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY half, source_url ORDER BY doc_id DESC) AS u FROM keyed) WHERE u = 1)"""
_ADDED = "SELECT doc_id AS ordinal, content_sha1 FROM keyed WHERE half = 1 AND content_sha1 NOT IN (SELECT content_sha1 FROM keyed WHERE half = 0)"
_REMOVED = "SELECT doc_id AS ordinal, content_sha1 FROM keyed WHERE half = 0 AND content_sha1 NOT IN (SELECT content_sha1 FROM keyed WHERE half = 1)"
_CHANGED = "SELECT a.source_url, a.content_sha1 AS old_sha1, b.content_sha1 AS new_sha1, a.chars AS old_chars, b.chars AS new_chars FROM byurl a JOIN byurl b ON a.source_url = b.source_url AND a.half = 0 AND b.half = 1 WHERE a.content_sha1 <> b.content_sha1"


@query(f"WITH {_HALVES} {_ADDED}")
def corpus_diff_added(spark, sf_dir):
    return diff.diff_corpora(*_halves(spark, sf_dir)).added.select("ordinal", "content_sha1")


@query(f"WITH {_HALVES} {_REMOVED}")
def corpus_diff_removed(spark, sf_dir):
    return diff.diff_corpora(*_halves(spark, sf_dir)).removed.select("ordinal", "content_sha1")


@query(f"WITH {_HALVES} {_CHANGED}")
def corpus_diff_changed(spark, sf_dir):
    return diff.diff_corpora(*_halves(spark, sf_dir)).changed


@query(f"WITH {_HALVES} SELECT (SELECT count(*) FROM keyed WHERE half = 0) AS old_total, (SELECT count(*) FROM keyed WHERE half = 1) AS new_total, (SELECT count(*) FROM ({_ADDED})) AS added, (SELECT count(*) FROM ({_REMOVED})) AS removed, (SELECT count(*) FROM ({_CHANGED})) AS changed")
def corpus_diff_stats(spark, sf_dir):
    return diff.diff_corpora(*_halves(spark, sf_dir)).stats


# Statistics


@query("SELECT count(*) AS total, 0 AS duplicates, sum(length(text))::BIGINT AS total_chars, (sum(length(text)) // count(*))::BIGINT AS avg_chars FROM documents")
def corpus_statistics(spark, sf_dir):
    return stats.corpus_totals(_records(spark, sf_dir))


@query("""SELECT 'type' AS dimension, 'html' AS key, count(*) AS n FROM documents UNION ALL SELECT 'language', coalesce(lang, 'unknown'), count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'license', 'unknown', count(*) FROM documents UNION ALL SELECT 'category', source, count(*) FROM documents WHERE source <> '' GROUP BY 2""")
def corpus_breakdown(spark, sf_dir):
    return stats.corpus_breakdown(_records(spark, sf_dir))


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1")
def records_per_minute(spark, sf_dir):
    return stats.records_per_minute(_table(spark, sf_dir, "events"), F.col("ts"))


@query("SELECT user_id AS key, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15")
def ok_error_by_key(spark, sf_dir):
    return stats.ok_error_by(_table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_type") != "error")


@query("SELECT CAST(least(floor((length(text) - lo) / ((hi - lo) / 10.0)), 9) AS INTEGER) AS bin, count(*) AS n FROM documents, (SELECT min(length(text)) AS lo, max(length(text)) AS hi FROM documents) GROUP BY 1")
def length_histogram(spark, sf_dir):
    return stats.histogram(_docs(spark, sf_dir), F.length("text"), 10)


@query(f"WITH {METRICS} SELECT CAST(least(floor(quality_score / 0.05), 19) AS INTEGER) AS bin, count(*) AS n FROM judged GROUP BY 1")
def score_histogram(spark, sf_dir):
    return stats.histogram(postprocess.with_quality(_docs(spark, sf_dir), content="text"), F.col("quality_score"), 20, 0.0, 1.0)


@query(f"WITH {CONV_PAIRS} SELECT task_type, count(*) AS n, round(avg(length(prompt)), 6) AS prompt_chars, round(avg(length(completion)), 6) AS completion_chars, round(avg(CASE WHEN prompt = '' THEN 0 ELSE greatest(1, floor(length(prompt) / 4.0)) END), 6) AS prompt_tokens, round(avg(CASE WHEN completion = '' THEN 0 ELSE greatest(1, floor(length(completion) / 4.0)) END), 6) AS completion_tokens FROM pairs GROUP BY 1")
def pair_report(spark, sf_dir):
    return stats.pair_report(_pairs(spark, sf_dir)).select("task_type", "n", *[F.round(c, 6).alias(c) for c in ("prompt_chars", "completion_chars", "prompt_tokens", "completion_tokens")])


@query("SELECT 'doc://' || doc_id AS url, doc_id AS ordinal FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_antijoin(spark, sf_dir):
    url = F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url")
    state = _table(spark, sf_dir, "labels").where("quality = 1").select(url, F.lit("done").alias("status"))
    return ingest.pending_sources(_docs(spark, sf_dir).select(url, F.col("doc_id").alias("ordinal")), state)


@query("SELECT 'doc://' || doc_id AS source_url, 'html' AS source_type, sha1(text) AS content_sha1, lang AS language, '' AS license, 0.0::DOUBLE AS quality_score, false AS is_duplicate, source AS category FROM documents")
def parquet_export(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("quality_score", F.lit(None).cast("double"))
    return writers.export_columns(rows).select("source_url", "source_type", "content_sha1", "language", "license", "quality_score", "is_duplicate", F.col("categories")[0].alias("category"))
