"""Text, links and assets of fetched pages, by pattern."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, normalize_whitespace, strip
from ..functions.url import domain, extension, host, is_blocked_url, same_site, scheme

#: Blocks that hold no text of the page (fixed values).
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "form")
# Entities that texts of pages use.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&amp;": "&"}


def unescape(c: Column | str) -> Column:
    t = col(c)
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


def title(c: Column | str) -> Column:
    return strip(unescape(F.regexp_extract(col(c), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def main_text(c: Column | str) -> Column:
    """The text of <article>, else <main>, else <body>, else all, without what never is text; an element's text is a line."""
    t = F.regexp_replace(col(c), r"(?s)<!--.*?-->", "")
    for tag in DROPPED:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    inside = lambda tag: F.regexp_extract(t, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1)
    body = F.when(inside("article") != "", inside("article")).when(inside("main") != "", inside("main")).when(inside("body") != "", inside("body")).otherwise(t)
    lines = F.transform(F.split(unescape(F.regexp_replace(body, r"(?s)<[^>]+>", "\n")), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def paragraph_text(c: Column | str) -> Column:
    """The page's <p> elements with blank lines between them."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.array_join(F.filter(F.transform(found, lambda x: strip(unescape(F.regexp_replace(x, r"(?s)<[^>]+>", "")))), lambda x: x != ""), "\n\n")


def body_text(c: Column | str) -> Column:
    """A question's or answer's HTML as text, its code fenced."""
    fenced = F.regexp_replace(col(c), r"(?is)<code[^>]*>(.*?)</code>", "\n```\n$1\n```\n")
    return normalize_whitespace(unescape(F.regexp_replace(fenced, r"(?s)<[^>]+>", "\n")))


def hrefs(c: Column | str) -> Column:
    """Targets of anchors that can be followed, repeats and fragments kept."""
    found = F.regexp_extract_all(col(c), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: (x != "") & ~x.rlike(r"(?i)^(?:#|mailto:|javascript:|tel:|data:)"))


def _joined(bases: pd.Series, targets: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    def one(base: str | None, target: str | None) -> str | None:
        try:
            return urljoin(base or "", target or "")
        except ValueError:
            return None

    return pd.Series([one(b, t) for b, t in zip(bases, targets, strict=True)], dtype=object)


def resolve(base: Column | str, target: Column | str) -> Column:
    """A target as seen from a page.  Rooted and absolute ones are joined natively by ``rooted``; this takes all."""
    return F.pandas_udf(_joined, "string")(col(base), col(target))


def rooted(base: Column | str, target: Column | str) -> Column:
    """As ``resolve`` where the target is absolute or starts at the root; null elsewhere."""
    t = col(target)
    origin = F.concat(scheme(base), F.lit("://"), domain(base))
    return F.when(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), t).when(t.startswith("//"), F.concat(scheme(base), F.lit(":"), t)).when(t.startswith("/"), F.concat(origin, t))


def page_links(pages: DataFrame, url: str = "url", html: str = "html", seed: Column | None = None, same_domain: bool = False, subdomains: bool = False) -> DataFrame:
    """``url, link``: a row per link over HTTP, of the same site if asked."""
    rows = pages.select(F.col(url).alias("url"), F.explode(hrefs(html)).alias("t"))
    quick = rooted("url", "t")
    links = rows.withColumn("q", quick)
    # Only relative targets go to Python.
    slow = resolve("url", F.when(F.col("q").isNull(), F.col("t")))
    links = links.withColumn("link", F.coalesce("q", slow)).where(scheme("link").isin("http", "https"))
    if same_domain:
        links = links.where(same_site(host("link"), host(seed if seed is not None else "url"), subdomains))
    return links.select("url", "link")


def page_assets(pages: DataFrame, extensions: tuple[str, ...], url: str = "url", html: str = "html") -> DataFrame:
    """Images and linked files of the given extensions that aren't blocked."""
    images = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<img\b[^>]*?\b(?:data-)?src\s*=\s*["']([^"']+)["']"""), F.lit(1))
    rows = pages.select(F.col(url).alias("url"), F.explode(F.concat(F.transform(images, lambda x: F.struct(F.lit("image").alias("kind"), x.alias("t"))), F.transform(hrefs(html), lambda x: F.struct(F.lit("file").alias("kind"), x.alias("t"))))).alias("a"))
    found = rows.select("url", "a.kind", F.coalesce(rooted("url", "a.t"), resolve("url", "a.t")).alias("asset"))
    return found.where(extension("asset").isin(*extensions) & ~is_blocked_url("asset")).distinct()
