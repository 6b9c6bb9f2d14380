"""Token counts: an estimate by language, and exact counts by a public vocabulary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, detect_language_simple

# Characters a token, by language.
CHARS_PER_TOKEN = {"en": 4.0, "ru": 2.7, "zh": 1.5, "ja": 1.5, "ko": 1.5, "mixed": 3.5}
DEFAULT_CHARS_PER_TOKEN = 3.5


def estimate_tokens(c: Column | str, lang: Column | str | None = None) -> Column:
    """Length by the language's ratio, 1 at least; 0 for an empty text."""
    t = F.coalesce(col(c), F.lit(""))
    of = detect_language_simple(t) if lang is None else col(lang)
    ratio = F.lit(DEFAULT_CHARS_PER_TOKEN)
    for name, value in CHARS_PER_TOKEN.items():
        ratio = F.when(of == name, value).otherwise(ratio)
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), (F.length(t) / ratio).cast("int")))


def count_tokens(c: Column | str, tokenizer_path: str) -> Column:
    """Exact count by a tokenizers vocabulary file, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer_path)
        return pd.Series([len(e.ids) for e in encoder.encode_batch([t or "" for t in texts], add_special_tokens=False)], dtype="int64")

    return F.pandas_udf(run, "long")(col(c))


def pair_tokens(prompt: Column | str = "prompt", completion: Column | str = "completion") -> Column:
    p, c = estimate_tokens(prompt), estimate_tokens(completion)
    return F.struct(p.alias("prompt"), c.alias("completion"), (p + c).alias("total"))


def token_limit_reason(prompt: Column | str = "prompt", completion: Column | str = "completion", prompt_min: int = 5, prompt_max: int = 2000, completion_min: int = 5, completion_max: int = 4000) -> Column:
    """Why a pair is outside the token limits; null if it isn't."""
    p, c = estimate_tokens(prompt), estimate_tokens(completion)
    return (
        F.when(p < prompt_min, "prompt_too_few_tokens").when(p > prompt_max, "prompt_too_many_tokens").when(c < completion_min, "completion_too_few_tokens").when(c > completion_max, "completion_too_many_tokens")
    )
