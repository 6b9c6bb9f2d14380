"""Quality metrics, the first reason to reject a text, and its score."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .text import col, strip

# Advertising in Russian, words of the trade, and a run of URLs.
SPAM_WORDS = (
    r"\b(купить|заказать|цена|скидк[аи]|акция|распродаж[аи]|доставка)\b",
    r"\b(купон|промокод|бесплатно|выиграй|розыгрыш)\b",
    r"\b(кредит|займ|микрозайм|взять\s+в\s+долг)\b",
    r"\b(казино|ставки?|беттинг|букмекер)\b",
)
TRADE_WORDS = ("radio", "electronics", "circuit", "schematic", "datasheet", "микросхем", "транзистор", r"печатн\w+(?= пл\b)", "схем[аы]", "электрон")
URL_RUN = r"(https?://\S+\s+){5,}"
LONG_LINE = 200
TECHNICAL_KEYWORDS = (
    "electronics", "circuit", "schematic", "datasheet", "microcontroller", "транзистор", "микросхема", "схема", "печатная плата", "питание",
    "компонент", "сопротивление", "ёмкость", "индуктивность",
)
MIN_CODE = 50


@dataclass(frozen=True)
class QualityConfig:
    min_chars: int = 200
    max_chars: int = 200_000
    max_non_alpha_ratio: float = 0.30
    max_dup_line_ratio: float = 0.50
    max_code_ratio: float = 0.50
    language: str = "bilingual"
    languages_allowed: tuple[str, ...] = ("ru", "en")
    spam_check: bool = True
    perplexity_check: bool = False
    max_perplexity: float = 1000.0


def long_plain_ending(c: Column | str) -> Column:
    """Whether, from some word boundary of the last line on, 200 characters or more follow without a word of the trade.

    That is so if what follows the last such word is long enough; without one, what follows the first
    character of a word.
    """
    last = F.substring_index(F.regexp_replace(col(c), r"\n\z", ""), "\n", -1)
    found = r"(?idU)^.*\b(?:" + "|".join(TRADE_WORDS) + r")\b"
    rest = F.when(last.rlike(found), F.regexp_replace(last, found, "")).otherwise(F.regexp_replace(last, r"(?U)^\W+", ""))
    return F.length(rest) >= LONG_LINE


def is_spam(c: Column | str, keywords: tuple[str, ...] = TECHNICAL_KEYWORDS) -> Column:
    """Advertising, a page of URLs, or a long plain ending; never below 30 characters or with a technical keyword."""
    t = F.coalesce(col(c), F.lit(""))
    spoken = "(?iU)" + "|".join(f"(?:{p})" for p in SPAM_WORDS)

    def judged(low: Column) -> Column:
        technical = F.lit(False)
        for k in keywords:
            technical = technical | low.contains(k.lower())
        return ~technical & (long_plain_ending(t) | (low.rlike("[а-я]") & t.rlike(spoken)) | (low.contains("http") & t.rlike("(?iU)" + URL_RUN)))

    # The lower-cased text is made once for all keywords.
    return (F.length(T.strip(t)) >= 30) & T.let(F.lower(t), judged)


_FENCED = r"(?s)```([a-zA-Z0-9]*)\n(.*?)```"
_PRE = r"(?is)<pre>(.*?)</pre>"
_BRACKET = r"(?is)\[code\](.*?)\[/code\]"


def prose(c: Column | str) -> Column:
    """The text without blocks of code."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), _FENCED, ""), _PRE, ""), _BRACKET, "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def code_blocks(c: Column | str) -> Column:
    """Language, code and length of the blocks of 50 characters or more: fenced, then <pre>, then [code]."""
    t = F.coalesce(col(c), F.lit(""))
    without = F.regexp_replace(t, _FENCED, "")
    rest = F.regexp_replace(without, _PRE, "")
    found = lambda x, p, g: F.regexp_extract_all(x, F.lit(p), F.lit(g))
    block = lambda lang, code: F.struct(lang.alias("language"), strip(code).alias("code"), F.length(strip(code)).alias("char_count"))
    fenced = F.zip_with(found(t, _FENCED, 1), found(t, _FENCED, 2), lambda a, b: block(F.when(a == "", "unknown").otherwise(F.lower(a)), b))
    plain = F.transform(F.concat(found(without, _PRE, 1), found(rest, _BRACKET, 1)), lambda x: block(F.lit("unknown"), x))
    marked = t.contains("```") | t.rlike(r"(?i)<pre>|\[code\]")
    return F.when(marked, F.filter(F.concat(fenced, plain), lambda b: b["char_count"] >= MIN_CODE)).otherwise(F.expr("cast(array() as array<struct<language:string,code:string,char_count:int>>)"))


def code_ratio(c: Column | str) -> Column:
    """Characters of code by all characters, not rounded."""
    t = F.coalesce(col(c), F.lit(""))
    return F.when(t == "", 0.0).otherwise(F.aggregate(code_blocks(t), F.lit(0), lambda n, b: n + b["char_count"]) / F.length(t))


def metrics(c: Column | str, cfg: QualityConfig | None = None, perplexity: Column | None = None) -> Column:
    """One struct, so that each metric is computed once and read by name."""
    cfg = cfg or QualityConfig()
    language = T.detect_language(c) if cfg.language != "multi" else F.lit(None).cast("string")
    return F.struct(
        T.char_count(c).alias("chars"), T.alpha_ratio(c).alias("alpha_ratio"), T.dup_line_ratio(c).alias("dup_line_ratio"), code_ratio(c).alias("code_ratio"),
        language.alias("language"), (perplexity if perplexity is not None else F.lit(None).cast("double")).alias("perplexity"),
        (is_spam(c) if cfg.spam_check else F.lit(False)).alias("spam"),
    )


def reject_reason(m: Column | str, cfg: QualityConfig | None = None) -> Column:
    """The first check that a struct of ``metrics`` fails; null if it passes."""
    cfg = cfg or QualityConfig()
    m = col(m)
    allowed = [*cfg.languages_allowed, *(["mixed"] if cfg.language == "bilingual" else [])]
    out = (
        F.when(m["chars"] < cfg.min_chars, "too_short").when(m["chars"] > cfg.max_chars, "too_long")
        .when(m["alpha_ratio"] < 1 - cfg.max_non_alpha_ratio, "low_alpha").when(m["dup_line_ratio"] > cfg.max_dup_line_ratio, "too_many_dup_lines")
        .when(m["code_ratio"] > cfg.max_code_ratio, "too_much_code")
    )
    if cfg.spam_check:
        out = out.when(m["spam"], "spam_or_low_quality")
    if cfg.language != "multi":
        out = out.when(~m["language"].isin(*allowed), F.concat(F.lit("wrong_language:"), m["language"]))
    if cfg.perplexity_check:
        out = out.when(m["perplexity"] > cfg.max_perplexity, "high_perplexity")
    return out


def quality_score(m: Column | str, cfg: QualityConfig | None = None) -> Column:
    cfg = cfg or QualityConfig()
    m = col(m)
    known = F.coalesce(m["language"].isin(*cfg.languages_allowed, "mixed"), F.lit(False)) if cfg.language != "multi" else F.lit(False)
    score = (
        0.4 * F.least(m["chars"] / 1000, F.lit(1.0)) + 0.25 * m["alpha_ratio"] + 0.15 * (1 - m["dup_line_ratio"]) + 0.10 * (1 - T.rounded(m["code_ratio"])) + 0.10 * F.when(known, 1.0).otherwise(0.0)
    )
    return T.rounded(score)


def perplexity_ok(perplexity: Column | str, limit: float = 1000.0) -> Column:
    """True without a perplexity."""
    return F.coalesce(col(perplexity) <= limit, F.lit(True))


def compute_perplexity(c: Column | str, score=None) -> Column:
    """10 ** (-log10 score / words) by a language model's ``score`` (text -> log10); null without a model, below
    50 characters or without words."""
    if score is None:
        return F.lit(None).cast("double")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> float | None:
            found = re.findall(r"\w+", (t or "").lower())
            if not t or len(t.strip()) < 50 or not found:
                return None
            return float(10 ** (-score(" ".join(found)) / len(found)))

        return texts.map(one)

    return F.pandas_udf(run, "double")(col(c))
