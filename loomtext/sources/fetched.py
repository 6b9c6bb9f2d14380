"""Responses that were fetched: which downloads are taken, and the texts of pages by their charset."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..functions.url import is_blocked_url, safe_filename

#: Content types of streams, which aren't files to keep (fixed values).
STREAM_TYPES = ("video/", "audio/", "application/vnd.apple.mpegurl", "application/x-mpegurl")
#: Charsets that say nothing: servers send them for anything.
VAGUE_CHARSETS = ("", "iso-8859-1")


def refusal(max_mb: int = 50, max_seconds: float = 120) -> Column:
    """Why a response (``url, status_code, content_type, content_length, seconds, body``) isn't kept; null if it is.

    The first check that fails counts.  A null length is not declared, and a null time no timeout.
    """
    most = max_mb * 1024 * 1024
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    stream = F.lit(False)
    for t in STREAM_TYPES:
        stream = stream | kind.startswith(t)
    return (
        F.when(is_blocked_url("url"), "blocked url").when(~F.coalesce(F.col("status_code").between(200, 299), F.lit(False)), "status").when(stream, "stream")
        .when(F.col("content_length") > most, "declared too large").when(F.col("seconds") > max_seconds, "timeout").when(F.length("body") > most, "too large")
        .when(F.coalesce(F.length("body"), F.lit(0)) == 0, "empty")
    )


def downloads(responses: DataFrame, max_mb: int = 50, max_seconds: float = 120) -> DataFrame:
    """``url, local_path, sha1, size_bytes`` of the responses that are kept."""
    kept = responses.where(refusal(max_mb, max_seconds).isNull())
    return kept.select("url", safe_filename("url").alias("local_path"), F.sha1("body").alias("sha1"), F.length("body").cast("long").alias("size_bytes"))


def _decoded(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    def one(body: bytes | None, charset: str) -> str | None:
        if body is None:
            return None
        try:
            return bytes(body).decode(charset, "replace")
        except LookupError:
            return bytes(body).decode("utf-8", "replace")

    return pd.Series([one(b, c) for b, c in zip(bodies, charsets, strict=True)], dtype=object)


def decoded(body: Column | str, charset: Column | str) -> Column:
    """The text of a body; UTF-8 where the charset is missing, vague or unknown, and broken bytes are marked."""
    name = F.lower(F.trim(F.coalesce(col(charset), F.lit(""))))
    return F.pandas_udf(_decoded, "string")(col(body), F.when(name.isin(*VAGUE_CHARSETS), "utf-8").otherwise(name))
