"""URL scalars, by pattern rather than by a parser that fails on bad URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# What is never fetched.
BLOCKED_EXTENSIONS = (
    ".mp4", ".webm", ".avi", ".mov", ".wmv", ".flv", ".mkv", ".m4v", ".mpg", ".mpeg", ".m2ts", ".ts", ".3gp", ".3g2",
    ".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma", ".m4a", ".opus",
    ".m3u8", ".m3u", ".pls", ".asx",
    ".torrent",
)
BLOCKED_DOMAINS = (
    "youtube.com", "www.youtube.com", "youtu.be", "vimeo.com", "player.vimeo.com", "rutube.ru", "dailymotion.com", "twitch.tv", "player.twitch.tv",
    "vk.com", "vk.ru", "tiktok.com", "www.tiktok.com", "facebook.com", "fb.watch", "instagram.com", "streamable.com", "wistia.com", "brightcove.com",
    "jwplatform.com", "cloudflare.com", "cloudflarestream.com", "cdn.jsdelivr.net",
)
QUESTION_HOSTS = ("stackoverflow.com", "serverfault.com", "superuser.com", "electronics.stackexchange.com", "mathoverflow.net")

_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?$"


def _part(url: Column | str, group: int) -> Column:
    return F.regexp_extract(col(url), _SPLIT, group)


def scheme(url: Column | str) -> Column:
    return F.lower(_part(url, 1))


def domain(url: Column | str) -> Column:
    """The network location, port included; empty without one."""
    return _part(url, 2)


def host(url: Column | str) -> Column:
    return F.lower(domain(url))


def path(url: Column | str) -> Column:
    return _part(url, 3)


def query(url: Column | str) -> Column:
    return _part(url, 4)


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encoded(c: Column) -> Column:
    """As forms encode it: a space is a plus sign, and ``_.-~`` stay."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column | str) -> Column:
    """Without fragment, ``utm_`` and blank parameters; the others sorted by name and value, decoded and encoded anew."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p.contains("=") & ~p.endswith("=") | (F.regexp_count(p, F.lit("=")) > 1))
    named = F.transform(pairs, lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    kept = F.array_sort(F.filter(named, lambda p: (p["v"] != "") & ~F.lower(p["k"]).startswith("utm_")))
    again = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    s, d, p = scheme(url), domain(url), path(url)
    return F.concat(
        F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""), F.when(d != "", F.concat(F.lit("//"), d)).otherwise(""),
        p, F.when(again != "", F.concat(F.lit("?"), again)).otherwise(""),
    )


def detect_source_type(url: Column | str) -> Column:
    """github_repo, stackexchange, pdf or html."""
    h, p = host(url), F.lower(path(url))
    return (
        F.when(h.endswith("github.com") & (F.regexp_count(p, F.lit("/")) >= 2), "github_repo")
        .when((h.endswith("stackexchange.com") | h.isin(*QUESTION_HOSTS)) & p.contains("/questions/"), "stackexchange")
        .when(p.endswith(".pdf"), "pdf")
        .otherwise("html")
    )


def make_source(url: Column | str, source_type: Column | None = None, categories: Column | None = None, include_files: Column | None = None) -> Column:
    """A row of the sources relation; globs of files only make sense for repositories."""
    kind = F.coalesce(source_type, detect_source_type(url)) if source_type is not None else detect_source_type(url)
    none = F.lit(None).cast("array<string>")
    files = F.when(kind == "github_repo", include_files) if include_files is not None else none
    return F.struct(col(url).alias("url"), kind.alias("type"), (categories if categories is not None else none).alias("categories"), files.alias("include_files"))


def is_blocked_url(url: Column | str) -> Column:
    """True for an empty URL, a blocked domain or one below it, a blocked extension of the path or anywhere in the query."""
    h, p, q = host(url), F.lower(path(url)), F.lower(query(url))
    alternatives = "|".join(d.replace(".", r"\.") for d in BLOCKED_DOMAINS)
    extensions = "|".join(e.replace(".", r"\.") for e in BLOCKED_EXTENSIONS)
    return F.coalesce((col(url) == "") | h.rlike(rf"^(?:.*\.)?(?:{alternatives})$") | p.rlike(rf"(?:{extensions})$") | q.rlike(extensions), F.lit(True))


def extension(url: Column | str) -> Column:
    """What follows the last dot, without a query, lower-cased."""
    return F.lower(F.regexp_extract(col(url), r"([^.?]*)(?:\?[^.]*)?$", 1))


def url_hash(url: Column | str) -> Column:
    return F.substring(F.sha1(col(url)), 1, 12)


def safe_filename(url: Column | str, max_len: int = 80) -> Column:
    """slug_hash.extension; letters outside ASCII are dropped, not transliterated."""
    name = F.regexp_extract(path(url), "([^/]+)/*$", 1)
    name = F.when(name == "", "index").otherwise(name)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = F.when(suffix == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, max_len - 16)
    return F.concat(F.when(slug == "", "file").otherwise(slug), F.lit("_"), url_hash(url), F.lower(F.when(suffix == "", ".bin").otherwise(suffix)))


def github_repo(url: Column | str) -> Column:
    """``owner/name`` of a repository URL; null without both."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.concat(parts[0], F.lit("/"), F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"\.git$", "")))


def question_of(url: Column | str) -> Column:
    """Site and number of a question's URL."""
    number = F.regexp_extract(path(url), r"/questions/(\d+)", 1)
    h = host(url)
    site = F.when(h.endswith(".stackexchange.com"), F.regexp_replace(h, r"\.stackexchange\.com$", "")).otherwise(F.substring_index(h, ".", 1))
    return F.when(number != "", F.struct(site.alias("site"), number.cast("long").alias("question_id")))


def same_site(h: Column, seed: Column, subdomains: bool = False) -> Column:
    """Whether a host is the seed's, or below it."""
    return (h == seed) | (h.endswith(F.concat(F.lit("."), seed)) if subdomains else F.lit(False))


def stored_name(p: Column | str) -> Column:
    """A name for a file of a repository that can't leave its folder: hash of the path, then the last part."""
    return F.concat(F.substring(F.sha1(col(p)), 1, 8), F.lit("_"), F.regexp_extract(col(p), "([^/]*)$", 1))
