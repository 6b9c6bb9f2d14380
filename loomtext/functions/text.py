"""Text scalars: normalisation, fingerprints, shingles, metrics, language."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() sees it, as a class of patterns with Unicode classes, and its characters one by one.
SPACE = r"[\s\x1c-\x1f]"
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Latin letters as patterns without regard to case find them, with the two that fold to them; Cyrillic ones by their block.
LATIN = "".join(map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B), 0x130, 0x212A)))
CYRILLIC = "".join(map(chr, range(0x400, 0x500)))
RUSSIAN = "".join(map(chr, (0x401, *range(0x410, 0x450), 0x451)))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: an expression of a lambda's outside would be computed at each element."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITE))


def count_of(c: Column, characters: str) -> Column:
    """How many of a text's characters are among the given ones."""
    return F.length(c) - F.length(F.translate(c, characters, ""))


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _fixed(texts: pd.Series) -> pd.Series:
    try:
        import ftfy
    except ImportError:  # an optional library: without it, encodings stay as they are
        return texts
    return texts.map(lambda t: None if t is None else ftfy.fix_text(t))


def nfkc(c: Column | str) -> Column:
    """Unicode NFKC, which Spark has no function for: one Arrow batch at a time."""
    return F.pandas_udf(_nfkc, "string")(col(c))


def fix_encoding(c: Column | str) -> Column:
    """Repairs broken encodings if the optional library is there."""
    return F.pandas_udf(_fixed, "string")(col(c))


def normalize_whitespace(c: Column | str) -> Column:
    """The part of ``normalize_text`` after Unicode: zero-width and no-break characters become spaces, line ends LF,
    runs of blanks one space, three LFs or more two, ends stripped.  Null reads as empty."""
    t = F.coalesce(col(c), F.lit(""))
    t = F.translate(t, "​‌‍﻿ ", "     ")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?m)[ \t]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def normalize_text(c: Column | str, repair: bool = False, normalize_chars: bool = True) -> Column:
    t = col(c)
    if repair:
        t = fix_encoding(t)
    if normalize_chars:
        t = nfkc(t)
    return normalize_whitespace(t)


def normalize_yo(c: Column | str, lang: Column | str | None = None) -> Column:
    """ё as е, where the language is Russian (always, without a language)."""
    folded = F.translate(col(c), "ёЁ", "еЕ")
    return folded if lang is None else F.when(col(lang) == "ru", folded).otherwise(col(c))


def text_sha1(c: Column | str) -> Column:
    return F.sha1(col(c))


def words(c: Column | str) -> Column:
    r"""``\w+`` of the lower-cased text, in Unicode."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)\w+"), F.lit(0))


def _grams(w: Column, k: int) -> Column:
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " ")))


def shingles(c: Column | str, k: int = 5) -> Column:
    """Distinct k-word shingles; fewer words are one shingle; none, an empty array."""
    def all_of(w: Column) -> Column:
        one = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.array_distinct(F.coalesce(_grams(w, k), one))

    return let(words(c), all_of)


def shingle_hashes(c: Column | str, k: int = 5) -> Column:
    """64-bit hashes of the distinct shingles: distinct numbers are found by hashing, distinct texts by comparing all."""
    def all_of(w: Column) -> Column:
        one = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.array_distinct(F.transform(F.coalesce(_grams(w, k), one), lambda s: F.xxhash64(s)))

    return let(words(c), all_of)


def blank_shingles(c: Column | str, k: int = 3) -> Column:
    """Distinct k-word shingles over words between white space; fewer words give the stripped lower-cased text."""
    t = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    return let(t, lambda x: F.array_distinct(F.coalesce(let(F.split(x, rf"(?U){SPACE}+"), lambda w: F.when(x != "", _grams(w, k))), F.array(x))))


def rounded(c: Column, digits: int = 3) -> Column:
    """Rounded as SQL does it, on the double times a power of ten.  Spark's own rounding goes by the shortest decimal of the double, so that
    a sum just under a half, such as 0.7494999999999999 for 0.7495, falls on the other side."""
    return F.round(c * 10.0**digits) / 10.0**digits


def alpha_ratio(c: Column | str) -> Column:
    """Letters by characters, rounded to 3 digits; 0 for an empty text."""
    t = F.coalesce(col(c), F.lit(""))
    return F.when(t == "", 0.0).otherwise(rounded(F.length(F.regexp_replace(t, r"\P{L}+", "")) / F.length(t)))


def dup_line_ratio(c: Column | str) -> Column:
    """Share of non-blank lines that stand before in the text, stripped and lower-cased; rounded to 3 digits."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "\n"), lambda x: F.lower(strip(x))), lambda x: x != "")
    hashed = F.transform(lines, lambda x: F.xxhash64(x))
    return let(hashed, lambda h: F.when(F.size(h) > 0, rounded((F.size(h) - F.size(F.array_distinct(h))) / F.size(h))).otherwise(0.0))


def char_count(c: Column | str) -> Column:
    return F.length(F.coalesce(col(c), F.lit("")))


def detect_language(c: Column | str) -> Column:
    """ru, en or mixed by the letters of the first 5000 characters; null without any."""
    sample = F.substring(F.coalesce(col(c), F.lit("")), 1, 5000)
    def named(n: Column) -> Column:
        cyr, lat = n["cyr"], n["lat"]
        return F.when(cyr > lat * 1.5, "ru").when(lat > cyr * 1.5, "en").when(cyr + lat == 0, F.lit(None).cast("string")).otherwise(F.when((cyr > 0) & (lat > 0), "mixed").when(cyr > lat, "ru").otherwise("en"))

    return let(F.struct(count_of(sample, CYRILLIC).alias("cyr"), count_of(sample, LATIN).alias("lat")), named)


def detect_language_simple(c: Column | str) -> Column:
    """zh, ru or en by counts in the first 2000 characters, as token estimates need it."""
    sample = F.substring(F.coalesce(col(c), F.lit("")), 1, 2000)
    return F.when(F.regexp_count(sample, F.lit("[一-鿿぀-ヿ가-힯]")) > 20, "zh").when(count_of(sample, RUSSIAN) > 20, "ru").otherwise("en")


def detect_language_model(c: Column | str, detector=None) -> Column:
    """A language by ``detector`` (text -> code) for texts of 20 characters or more; null without a detector."""
    if detector is None:
        return F.lit(None).cast("string")

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None or len(t.strip()) < 20 else detector(t.replace("\n", " ")))

    return F.pandas_udf(run, "string")(col(c))


def first_sentence(c: Column | str) -> Column:
    return strip(F.split(col(c), rf"(?U)(?<=[.!?]){SPACE}+", 2)[0])


def sentences(c: Column | str) -> Column:
    return F.split(col(c), rf"(?U)(?<=[.!?]){SPACE}+")


def paragraphs(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), "\n\n"), strip), lambda x: x != "")
