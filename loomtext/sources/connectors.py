"""Parsers of fetched bodies: API answers, threads, repositories and pages become records.  Nothing here fetches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import col, strip
from .html import body_text, main_text, title

#: From 2020 on, contributions are under the later license (fixed values).
LICENSE_CHANGE = 1_577_836_800
SCHEMATIC_WORDS = ("schematic", "circuit", "resistor", "capacitor", "gnd", "vcc", "схема")


def as_record(url: Column, kind: str, content: Column, language: bool = True, status: Column | None = None, **more: Column) -> list[Column]:
    """The common end of every connector: normalised content, its hash and a language."""
    body = T.normalize_whitespace(content)
    extra = {"license": F.lit(None).cast("string"), "metadata": F.lit(None).cast("string")} | more
    return [
        url.alias("source_url"), F.lit(kind).alias("source_type"), body.alias("content"), F.sha1(body).alias("content_sha1"),
        (T.detect_language(body) if language else F.lit(None).cast("string")).alias("language"), (status if status is not None else F.when(body != "", "ok").otherwise("error")).alias("status"),
        *[v.alias(k) for k, v in extra.items()],
    ]


def html_records(pages: DataFrame) -> DataFrame:
    """``url, html`` as records; the title is in the metadata."""
    return pages.select(*as_record(F.col("url"), "html", main_text("html"), metadata=F.to_json(F.struct(title("html").alias("title")))))


def thread_records(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions (``question_id, url, title, body, tags, creation_date``) with their answers (``question_id, answer_id,
    body, score, is_accepted``), the accepted first, then by score."""
    order = F.struct((~F.coalesce("is_accepted", F.lit(False))).alias("other"), (-F.coalesce("score", F.lit(0))).alias("minus"), "answer_id", "body", "score", F.coalesce("is_accepted", F.lit(False)).alias("is_accepted"))
    grouped = answers.groupBy("question_id").agg(F.array_sort(F.collect_list(order)).alias("a"))
    rows = questions.join(grouped, "question_id", "left")
    said = F.transform("a", lambda a: F.concat(F.lit("## Ответ (score="), a["score"].cast("string"), F.lit(")"), F.when(a["is_accepted"], " [ПРИНЯТ]").otherwise(""), F.lit("\n\n"), body_text(a["body"])))
    content = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n## Вопрос\n\n"), body_text("body"), F.when(F.size("a") > 0, F.concat(F.lit("\n\n"), F.array_join(said, "\n\n"))).otherwise(""))
    brief = F.transform("a", lambda a: F.struct(a["answer_id"].alias("answer_id"), a["score"].alias("score"), a["is_accepted"].alias("is_accepted"), F.length(a["body"]).alias("body_chars")))
    meta = F.to_json(F.struct("title", "tags", brief.alias("answers")))
    return rows.select(*as_record(F.col("url"), "stackexchange", content, license=F.when(F.col("creation_date") >= LICENSE_CHANGE, "CC BY-SA 4.0").otherwise("CC BY-SA 3.0"), metadata=meta))


def issue_sections(issues: DataFrame, body: str = "json") -> DataFrame:
    """``number, section`` of issues and pull requests, told apart by a key."""
    j = F.from_json(body, "number long, title string, state string, body string, pull_request string, labels array<struct<name:string>>")
    rows = issues.select(j.alias("j"))
    labels = F.array_join(F.transform("j.labels", lambda x: x["name"]), ", ")
    head = F.concat(F.lit("## "), F.when(F.col("j.pull_request").isNull(), "Issue").otherwise("PR"), F.lit(" #"), F.col("j.number").cast("string"), F.lit(": "), F.coalesce("j.title", F.lit("")))
    return rows.select(F.col("j.number").alias("number"), F.concat_ws("\n", head, F.concat(F.lit("State: "), F.col("j.state")), F.when(labels != "", F.concat(F.lit("Labels: "), labels)), F.coalesce("j.body", F.lit(""))).alias("section"))


def repository_records(files: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """Text files of repositories (``url, path, text``) joined in order of their paths; globs keep some."""
    rows = files
    if include:
        import fnmatch

        rows = rows.where(F.lower("path").rlike("|".join(f"(?:{fnmatch.translate(g.lower())})" for g in include).replace(r"\z", r"$").replace(r"\Z", "$")))
    joined = rows.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("f"))
    return joined.select(*as_record(F.col("url"), "github_repo", F.array_join(F.transform("f", lambda x: F.concat(F.lit("=== "), x["path"], F.lit(" ===\n"), x["text"])), "\n\n")))


def is_docs_path(path: Column | str) -> Column:
    return col(path).rlike(r"^(?:docs|doc|documentation|Documentation|Docs)/")


def spdx_license(json: Column | str) -> Column:
    return F.nullif(F.get_json_object(col(json), "$.license.spdx_id"), F.lit("NOASSERTION"))


def unzip(archives: DataFrame, content: str = "content", key: str = "url") -> DataFrame:
    """``url, path, bytes`` of the files of ZIP archives; folders and names that leave the archive are left out."""
    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            for url, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for i in z.infolist():
                        if not i.is_dir() and ".." not in i.filename.split("/") and not i.filename.startswith("/"):
                            yield pa.record_batch([pa.array([url], pa.string()), pa.array([i.filename], pa.string()), pa.array([z.read(i)], pa.binary())], names=["url", "path", "bytes"])

    return archives.select(F.col(key).alias("url"), content).mapInArrow(run, "url string, path string, bytes binary")


def section(name: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"## {name}\n\n"), value))


def article_sections(answers: DataFrame, body: str = "json", api: str = "crossref") -> DataFrame:
    """Sections of at most 50 entries of a search API's JSON answer: title, year, authors, abstract."""
    if api == "crossref":
        j = F.from_json(body, "message struct<items:array<struct<title:array<string>,abstract:string,DOI:string,author:array<struct<given:string,family:string>>>>>")
        items = F.transform(F.slice(j["message"]["items"], 1, 50), lambda x: F.struct(x["title"][0].alias("title"), F.regexp_replace(x["abstract"], "<[^>]+>", "").alias("abstract"), F.array_join(F.transform(x["author"], lambda a: F.concat_ws(" ", a["given"], a["family"])), ", ").alias("authors")))
    elif api == "doaj":
        j = F.from_json(body, "results array<struct<bibjson:struct<title:string,abstract:string,author:array<struct<name:string>>>>>")
        items = F.transform(F.slice(j["results"], 1, 50), lambda x: F.struct(x["bibjson"]["title"].alias("title"), x["bibjson"]["abstract"].alias("abstract"), F.array_join(F.transform(x["bibjson"]["author"], lambda a: a["name"]), ", ").alias("authors")))
    else:
        raise ValueError(f"unknown API {api!r}")
    text = F.transform(items, lambda x: F.concat_ws("\n\n", F.concat(F.lit("## "), x["title"]), F.when(x["authors"] != "", F.concat(F.lit("Authors: "), x["authors"])), strip(x["abstract"])))
    return answers.withColumn("content", F.array_join(text, "\n\n"))


def atom_sections(feeds: DataFrame, body: str = "xml") -> DataFrame:
    """Sections of an Atom feed's entries."""
    entries = F.regexp_extract_all(F.col(body), F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))
    tag = lambda x, t: strip(F.regexp_replace(F.regexp_extract(x, rf"(?s)<{t}\b[^>]*>(.*?)</{t}>", 1), r"\s+", " "))
    text = F.transform(entries, lambda x: F.concat(F.lit("## "), tag(x, "title"), F.lit("\n\n"), tag(x, "summary")))
    return feeds.withColumn("content", F.array_join(text, "\n\n"))


def encyclopedia_text(c: Column | str) -> Column:
    """Text of an encyclopedia page without tables, figures and formulas."""
    t = col(c)
    for tag in ("table", "figure", "math"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return main_text(t)


# PDF pages, given as tables of blocks


def two_columns(blocks: DataFrame) -> DataFrame:
    """``doc, two_column``: more than three tenths of ten blocks or more start in the left third, over the first five pages with text."""
    pages = blocks.where("page < 10").groupBy("doc", "page").agg(F.count("*").alias("n"), F.count_if(F.col("x0") < 0.35 * F.col("width")).alias("left"))
    first = pages.groupBy("doc").agg(F.slice(F.array_sort(F.collect_list(F.struct("page", "n", "left"))), 1, 5).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x[f])
    return first.select("doc", ((total("n") >= 10) & (total("left") > 0.3 * total("n"))).alias("two_column"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """``doc, page, text``: the left column from the top, then the right one."""
    order = F.struct((F.col("x0") >= F.col("width") / 2).alias("right"), "y0", "x0", "text")
    return blocks.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda b: b["text"]), "\n").alias("text"))


def is_schematic(ocr: Column | str) -> Column:
    """Whether an image may be a schematic, by what was read in it: nothing, a word of the trade, or much."""
    t = strip(F.coalesce(col(ocr), F.lit("")))
    return (t == "") | F.lower(t).rlike("|".join(SCHEMATIC_WORDS)) | (F.length(t) >= 30)


def with_headings(content: Column | str, toc: Column | str) -> Column:
    """The text with a heading mark before the first place of each title of its contents."""
    def mark(text: Column, e: Column) -> Column:
        at = F.instr(text, e["title"])
        hashes = F.repeat(F.lit("#"), F.least(e["level"] + 1, F.lit(6)))
        return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), F.lit("\n"), hashes, F.lit(" "), text.substr(at, F.length(text)))).otherwise(text)

    return F.aggregate(col(toc), col(content), mark)


def table_block(tables: Column | str) -> Column:
    """Tables (``page, rows``) as Markdown under a common heading."""
    def one(t: Column) -> Column:
        line = F.transform(t["rows"], lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |")))
        return F.concat(F.lit("Page "), t["page"].cast("string"), F.lit(":\n"), F.array_join(line, "\n"))

    return F.concat(F.lit("=== EXTRACTED TABLES ===\n"), F.array_join(F.transform(col(tables), one), "\n\n"))


PARSERS: dict[str, Callable[..., DataFrame]] = {"html": html_records, "github_repo": repository_records, "stackexchange": thread_records, "crossref": lambda df: article_sections(df, api="crossref"), "doaj": lambda df: article_sections(df, api="doaj"), "arxiv": atom_sections}


def parser_for(kind: str) -> Callable[..., DataFrame]:
    if kind not in PARSERS:
        raise ValueError(f"unknown source type {kind!r}; known are {', '.join(sorted(PARSERS))}")
    return PARSERS[kind]
