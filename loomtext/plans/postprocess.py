"""Post-processing of a crawled corpus: one lazy plan of flags, filter, normalisation and pairs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as T
from ..functions.quality import QualityConfig
from ..operators import dedup, generators


@dataclass(frozen=True)
class PostprocessConfig:
    quality: QualityConfig = field(default_factory=QualityConfig)
    exact: bool = True
    minhash: bool = True
    images: bool = True
    normalize_chars: bool = True


def with_quality(records: DataFrame, cfg: QualityConfig | None = None, content: str = "content") -> DataFrame:
    """Adds ``metrics``, ``reason`` (null for a pass) and ``quality_score``, in place of columns of these names.

    A text is measured once, whatever is asked of the result: the columns come out of a generator, through which Catalyst
    neither copies an expression nor pushes a filter that holds it.
    """
    cfg = cfg or QualityConfig()
    rest = [c for c in records.columns if c not in ("metrics", "reason", "quality_score")]
    measured = records.select(*rest, F.inline(F.array(F.struct(Q.metrics(content, cfg).alias("metrics")))))
    return measured.withColumn("reason", Q.reject_reason("metrics", cfg)).withColumn("quality_score", Q.quality_score("metrics", cfg))


def quality_filter(records: DataFrame, cfg: QualityConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept records with score, language and metrics, and counts of the rejected by reason; duplicates are skipped."""
    once = F.explode(F.array(T.normalize_whitespace("content"))).alias("content")
    fresh = records.where("not coalesce(is_duplicate, false)")
    rows = with_quality(fresh.select(*[c for c in fresh.columns if c != "content"], once), cfg)
    kept = rows.where("reason is null").withColumn("language", F.coalesce("metrics.language", "language")).drop("reason")
    return kept, rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def normalize_records(records: DataFrame, yo: bool = True, normalize_chars: bool = True, refresh_sha1: bool = False) -> DataFrame:
    """Normalised contents; ё is folded where the language is Russian, mixed or unknown.  The hash stays unless asked."""
    body = T.normalize_text("content", normalize_chars=normalize_chars)
    out = records.withColumn("content", body)
    if yo:
        folds = F.coalesce(F.col("language").isin("ru", "mixed"), F.lit(True))
        out = out.withColumn("content", F.when(folds, T.normalize_yo("content")).otherwise(F.col("content")))
    return out.withColumn("content_sha1", F.sha1("content")) if refresh_sha1 else out


def postprocess(records: DataFrame, cfg: PostprocessConfig | None = None) -> dict[str, DataFrame]:
    """Frames ``flagged, filtered, corpus, pairs``; each is computed only if it is written."""
    cfg = cfg or PostprocessConfig()
    flagged = dedup.flag_duplicates(records, cfg.exact, cfg.minhash, cfg.images)
    filtered, rejected = quality_filter(flagged, cfg.quality)
    corpus = normalize_records(filtered, normalize_chars=cfg.normalize_chars)
    return {"flagged": flagged, "filtered": filtered, "rejected": rejected, "corpus": corpus, "pairs": generators.extract_pairs(corpus)}
