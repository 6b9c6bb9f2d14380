"""A fine-tuning dataset out of a corpus: generate, filter, dedup, redact, balance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions import pii
from ..functions.tokens import token_limit_reason
from ..operators import generators, pairs
from ..operators.stats import stage_counts


@dataclass(frozen=True)
class FinetuneConfig:
    max_per_type: int = 1000
    min_prompt: int = 20
    max_prompt: int = 8000
    min_completion: int = 20
    max_completion: int = 16000
    by_tokens: bool = False
    dedup_mode: str = "prompt+completion"
    redact: bool = True
    balance: bool = True
    seed: int = 42


def refine(made: DataFrame, cfg: FinetuneConfig | None = None) -> dict[str, DataFrame]:
    """The stages after generation, by name, in order."""
    cfg = cfg or FinetuneConfig()
    reason = token_limit_reason() if cfg.by_tokens else pairs.pair_reason(min_prompt=cfg.min_prompt, max_prompt=cfg.max_prompt, min_completion=cfg.min_completion, max_completion=cfg.max_completion)
    stages = {"generated": made}
    stages["filtered"] = pairs.filter_pairs(made, reason)
    stages["deduped"] = pairs.dedup_pairs(stages["filtered"], cfg.dedup_mode)
    if cfg.redact:
        stages["redacted"] = pii.clean_pairs(stages["deduped"])
    last = list(stages.values())[-1]
    if cfg.balance:
        stages["balanced"] = pairs.balance_by_type(last, cfg.max_per_type, seed=cfg.seed)
    return stages


def finetune(records: DataFrame, files: DataFrame | None = None, cfg: FinetuneConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """The final pairs, and the counts of every stage by type."""
    cfg = cfg or FinetuneConfig()
    stages = refine(generators.generate_pairs(records, files, max_per_type=cfg.max_per_type), cfg)
    return list(stages.values())[-1], stage_counts(stages)
