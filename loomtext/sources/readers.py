"""Reading corpora and lists of sources."""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.url import detect_source_type
from ..operators.lineage import settled
from ..schema import RECORDS


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORDS, with_ordinal: bool = False) -> DataFrame:
    """Records of JSON lines, plain or gzip by extension; blank and broken lines are skipped.

    ``ordinal`` numbers the lines in file order: file by file, then by line.
    """
    full = T.StructType.fromDDL(schema).add("_bad", "string")
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ordinal")).where("trim(value) <> ''")
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("ordinal", parsed.alias("r")).where("r._bad is null").select("ordinal", *[f"r.{f.name}" for f in full if f.name != "_bad"])
    return rows if with_ordinal else rows.drop("ordinal")


def bad_lines(spark: SparkSession, path: str, schema: str = RECORDS) -> DataFrame:
    """The lines that aren't records; blank ones don't count."""
    full = T.StructType.fromDDL(schema).add("_bad", "string")
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).where("trim(value) <> ''").select("value", parsed["_bad"].alias("bad")).where("bad is not null").select(F.col("value").alias("line"))


def read_any_jsonl(spark: SparkSession, path: str, schema: str = RECORDS) -> DataFrame:
    """Records of files that may be gzip whatever their name: the first bytes tell."""
    import gzip

    def lines(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column("content").to_pylist():
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                yield pa.record_batch([pa.array(raw.decode("utf-8", "replace").splitlines(), pa.string())], names=["value"])

    files = spark.read.format("binaryFile").load(path).select("content")
    full = T.StructType.fromDDL(schema).add("_bad", "string")
    parsed = F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"})
    return files.mapInArrow(lines, "value string").where("trim(value) <> ''").select(parsed.alias("r")).where("r._bad is null").select(*[f"r.{f.name}" for f in full if f.name != "_bad"])


def gzip_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, is_gzip`` by the first two bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", (F.hex(F.substring("content", 1, 2)) == "1F8B").alias("is_gzip"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.sha1("content").alias("sha1"))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count("*").alias("lines"))


def documents_as_records(documents: DataFrame) -> DataFrame:
    """A documents table as records: ``ordinal`` is the id."""
    none = F.lit(None)
    return documents.select(
        F.col("doc_id").alias("ordinal"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_url"), F.lit("html").alias("source_type"), F.col("text").alias("content"),
        F.sha1("text").alias("content_sha1"), none.cast("string").alias("metadata"), F.array("source").alias("categories"), none.cast("string").alias("date_accessed"),
        F.col("lang").alias("language"), none.cast("string").alias("license"), F.lit(False).alias("is_duplicate"), none.cast("string").alias("duplicate_of"), F.lit("ok").alias("status"),
    )


# Source lists


def _http(url: Column) -> Column:
    return url.rlike("(?i)^https?://")


def _labels(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;|]"), lambda x: F.trim(x)), lambda x: x != "")


def sniff_delimiter(sample: str) -> str:
    """The delimiter of a header, of comma, tab, semicolon and bar."""
    try:
        return csv.Sniffer().sniff(sample[:2048], delimiters=",\t;|").delimiter
    except csv.Error:
        return "\t" if "\t" in sample else ","


def read_source_csv(spark: SparkSession, path: str, url_column: str = "url", type_column: str = "type", categories_column: str = "categories", delimiter: str = "auto") -> DataFrame:
    """``url, type, categories`` of a CSV or TSV; a missing URL column is an error, a missing type is told from the URL."""
    if delimiter == "auto":
        head = spark.read.text(path).limit(1).collect()
        delimiter = sniff_delimiter(head[0][0] if head else "")
    rows = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').csv(path)
    if url_column not in rows.columns:
        raise ValueError(f"no column {url_column!r} in {path}")
    url = F.trim(url_column)
    kind = F.coalesce(F.nullif(F.trim(type_column), F.lit("")), detect_source_type(url)) if type_column in rows.columns else detect_source_type(url)
    labels = _labels(F.col(categories_column)) if categories_column in rows.columns else F.expr("cast(array() as array<string>)")
    return rows.where(url != "").select(url.alias("url"), kind.alias("type"), labels.alias("categories"))


def read_depth_list(spark: SparkSession, path: str, url_column: str = "url", depth_column: str = "depth", categories_column: str = "categories") -> DataFrame:
    """``url, depth, categories`` of a list of seeds: URLs over HTTP only, depths from 0 to 1000, 0 if not a number.  Spreadsheets are read by pandas if it can."""
    if path.lower().endswith((".xlsx", ".xls")):
        import pandas as pd

        rows = spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda d: d.notna(), None))
    elif path.lower().endswith((".csv", ".tsv", ".txt")):
        rows = spark.read.option("header", True).option("sep", "\t" if path.lower().endswith(".tsv") else ",").csv(path)
    else:
        raise ValueError(f"neither a spreadsheet nor a CSV: {path}")
    return depth_list(rows, url_column, depth_column, categories_column)


def depth_list(rows: DataFrame, url_column: str = "url", depth_column: str = "depth", categories_column: str = "categories") -> DataFrame:
    depth = F.lit(0)
    if depth_column in rows.columns:
        depth = F.least(F.greatest(F.coalesce(F.col(depth_column).try_cast("double").cast("int"), F.lit(0)), F.lit(0)), F.lit(1000))
    labels = _labels(F.col(categories_column)) if categories_column in rows.columns else F.expr("cast(array() as array<string>)")
    return rows.where(_http(F.trim(url_column))).select(F.trim(url_column).alias("url"), depth.alias("depth"), labels.alias("categories"))


class _Bookmarks(HTMLParser):
    """Links of a Netscape bookmarks file with the folders they are in."""

    def __init__(self) -> None:
        super().__init__()
        self.folders: list[str] = []
        self.open: str | None = None
        self.text, self.href = "", None
        self.found: list[dict] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "h3":
            self.open, self.text = "h3", ""
        elif tag == "a":
            self.open, self.text, self.href = "a", "", dict(attrs).get("href")

    def handle_data(self, data) -> None:
        self.text += data

    def handle_endtag(self, tag) -> None:
        if tag == "h3":
            self.folders.append(self.text.strip())
        elif tag == "a" and (self.href or "").lower().startswith("http"):
            self.found.append({"url": self.href, "title": self.text.strip(), "categories": [f for f in self.folders if f]})
        elif tag == "dl" and self.folders:
            self.folders.pop()
        self.open = None


def parse_bookmarks(text: str) -> list[dict]:
    parser = _Bookmarks()
    parser.feed(text)
    return parser.found


def read_bookmarks(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """``url, type, categories`` of bookmark files, a row for each URL's first place by file and position; with ``every``, one for each bookmark."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(file, i, r) for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for i, r in enumerate(parse_bookmarks(content.decode("utf-8", "replace")))]
            yield pa.record_batch([pa.array([f for f, _, _ in rows], pa.string()), pa.array([i for _, i, _ in rows], pa.int64()), pa.array([r["url"] for *_, r in rows], pa.string()), pa.array([r["categories"] for *_, r in rows], pa.list_(pa.string()))], names=["file", "place", "url", "categories"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, place long, url string, categories array<string>")
    if not every:
        found = found.groupBy("url").agg(F.min_by("categories", F.struct("file", "place")).alias("categories"))
    return found.select("url", detect_source_type("url").alias("type"), "categories")


def read_sitemap(spark: SparkSession, path: str, pattern: str | None = None, max_urls: int | None = None) -> DataFrame:
    """``url`` of the entries of sitemap files that match a pattern."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path).select(F.trim("loc").alias("url")).where("url <> ''")
    if pattern:
        rows = rows.where(F.col("url").rlike(pattern))
    rows = rows.distinct()
    return rows.orderBy("url").limit(max_urls) if max_urls is not None else rows


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """The sitemaps that an index names."""
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).select(F.trim("loc").alias("url")).where("url <> ''").distinct()


def follow_sitemaps(index: DataFrame, bodies: DataFrame, pattern: str | None = None, max_urls: int | None = None, depth: int = 5) -> DataFrame:
    """``url, site`` of the pages that sitemaps name, with those of the sitemaps that indexes name, however nested up to ``depth``.

    ``index`` has the ``url`` of the sitemaps to begin with, which are the sites; ``bodies`` has ``url, body`` of those that were
    fetched.  A page belongs to the site that comes first by name; ``max_urls`` keeps the first of each site by name.
    """
    entry = lambda tag: F.regexp_extract_all("body", F.lit(rf"(?s)<{tag}>\s*<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    read = settled(bodies.select("url", entry("sitemap").alias("maps"), entry("url").alias("pages")))
    front = known = settled(index.select("url", F.col("url").alias("site")).distinct())
    for _ in range(depth):
        named = front.join(read, "url").select("site", F.explode("maps").alias("url")).select(plain(F.col("url")).alias("url"), "site").distinct()
        front = settled(named.join(known, ["url", "site"], "left_anti"))
        if front.isEmpty():
            break
        known = known.union(front)
    pages = known.join(read, "url").select("site", F.explode("pages").alias("page")).select(plain(F.col("page")).alias("url"), "site").where("url <> ''")
    if pattern:
        pages = pages.where(F.col("url").rlike(pattern))
    pages = pages.groupBy("url").agg(F.min("site").alias("site"))
    if max_urls is not None:
        pages = pages.withColumn("_rank", F.row_number().over(Window.partitionBy("site").orderBy("url"))).where(F.col("_rank") <= max_urls).drop("_rank")
    return pages


# Configuration


@dataclass(frozen=True)
class CorpusConfig:
    """Sources and knobs of a run, as a YAML or JSON file gives them."""

    sources: tuple[dict, ...] = ()
    quality: dict = field(default_factory=dict)
    dedup: dict = field(default_factory=dict)
    finetune: dict = field(default_factory=dict)


KINDS = ("html", "pdf", "github_repo", "stackexchange", "forum")


def load_config(path: str) -> CorpusConfig:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(io.StringIO(text))
    if not isinstance(raw, dict):
        raise ValueError("a configuration is a mapping")
    sources = tuple(raw.get("sources") or ())
    for s in sources:
        if not s.get("url"):
            raise ValueError(f"a source needs a url: {s}")
        if s.get("type") not in KINDS:
            raise ValueError(f"unknown source type {s.get('type')!r}")
    return CorpusConfig(sources, raw.get("quality") or {}, raw.get("dedup") or {}, raw.get("finetune") or {})


def save_config(sources: list[dict], path: str, template: dict | None = None) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({**(template or {}), "sources": sources}, f, allow_unicode=True, sort_keys=False)


def sources_frame(spark: SparkSession, config: CorpusConfig) -> DataFrame:
    rows = [(s["url"], s["type"], list(s.get("categories") or []), i) for i, s in enumerate(config.sources)]
    return spark.createDataFrame(rows, "url string, type string, categories array<string>, ordinal int")


def cached_pages(pages: DataFrame, now: Column, ttl_hours: int = 168) -> DataFrame:
    """Saved responses of status 200 that are fresh enough."""
    return pages.where((F.col("status_code") == 200) & (F.col("fetched_at") >= now - F.expr(f"interval {ttl_hours} hours")))
