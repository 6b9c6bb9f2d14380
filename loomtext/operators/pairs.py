"""Instruction pairs: filters, duplicates, balance and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .dedup import first_by

DEDUP_MODES = ("prompt+completion", "prompt", "completion", "prompt_normalized")


def pair_reason(prompt: str = "prompt", completion: str = "completion", min_prompt: int = 20, max_prompt: int = 8000, min_completion: int = 20, max_completion: int = 16000) -> Column:
    """The first check a pair fails; null if it passes.  Lengths are in characters."""
    p, c = F.coalesce(F.col(prompt), F.lit("")), F.coalesce(F.col(completion), F.lit(""))
    return (
        F.when(F.length(p) < min_prompt, "prompt_too_short").when(F.length(p) > max_prompt, "prompt_too_long")
        .when(F.length(c) < min_completion, "completion_too_short").when(F.length(c) > max_completion, "completion_too_long")
        .when(strip(p) == strip(c), "prompt_equals_completion").when(F.regexp_count(p, F.lit(r"\p{L}")) < F.length(p) * 0.3, "low_alpha_prompt")
    )


def filter_pairs(pairs: DataFrame, reason: Column | None = None) -> DataFrame:
    return pairs.where((pair_reason() if reason is None else reason).isNull())


def rejected_counts(pairs: DataFrame, reason: Column | None = None) -> DataFrame:
    """Rejected pairs by reason."""
    return pairs.select((pair_reason() if reason is None else reason).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def pair_hash(mode: str = "prompt+completion", conversation: bool = False) -> Column:
    """SHA-1 of what a mode compares; a conversation of two turns or more always counts."""
    if mode not in DEDUP_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    p, c = F.coalesce(F.col("prompt"), F.lit("")), F.coalesce(F.col("completion"), F.lit(""))
    folded = F.lower(strip(F.regexp_replace(p, r"(?U)[\s\x1c-\x1f]+", " ")))
    body = {"prompt+completion": F.concat(p, F.lit("\n@@@\n"), c), "prompt": p, "completion": c, "prompt_normalized": folded}[mode]
    if conversation:
        turns = F.to_json(F.transform("conversation", lambda t: F.struct(t["content"].alias("content"), t["role"].alias("role"))), {"ignoreNullFields": "false"})
        body = F.when(F.size("conversation") >= 2, F.concat(body, F.lit("\n@@@\n"), turns)).otherwise(body)
    return F.sha1(body)


def dedup_pairs(pairs: DataFrame, mode: str = "prompt+completion", keep: str = "first") -> DataFrame:
    if keep not in ("first", "last"):
        raise ValueError(f"keep is 'first' or 'last', not {keep!r}")
    return first_by(pairs, pair_hash(mode, "conversation" in pairs.columns), last=keep == "last")


def dedup_stats(pairs: DataFrame, mode: str = "prompt+completion") -> DataFrame:
    """Input, kept and removed pairs, by one aggregation per hash and one over all."""
    groups = pairs.groupBy(pair_hash(mode, "conversation" in pairs.columns).alias("h")).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg(total.alias("input"), F.count("*").alias("kept"), (total - F.count("*")).alias("removed"))


def filter_and_dedup(pairs: DataFrame, mode: str = "prompt+completion") -> DataFrame:
    return dedup_pairs(filter_pairs(pairs), mode)


def hash_rank(df: DataFrame, group: list[str], key: Column, seed: int) -> DataFrame:
    """``_rank`` (from 1) of each row within its group, in the order of SHA-1 of seed and key; ``_count`` rows in the group.

    Rows are first counted by the hash's leading digits, so a hot group is ranked in many partitions at once.
    """
    h = F.sha1(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    rows = df.withColumn("_h", h).withColumn("_slot", F.substring("_h", 1, 3))
    counts = rows.groupBy(*group, "_slot").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*[F.col(g) for g in group])
    before = over.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slot").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(over).alias("_count"))
    match = F.col("_slot") == F.col("_s")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = rows.join(counts, match)
    place = Window.partitionBy(*[F.col(g) for g in group], "_slot").orderBy("_h", key)
    return joined.withColumn("_rank", F.row_number().over(place) + F.col("_before")).drop("_h", "_slot", "_s", "_before", *[f"_g{i}" for i in range(len(group))])


def balance_by_type(pairs: DataFrame, max_per_type: int = 1000, min_per_type: int = 0, seed: int = 42, type_col: str = "task_type", key: str = "ordinal") -> DataFrame:
    """At most so many pairs of a type, chosen by hash; types with fewer than the minimum after that are left out."""
    ranked = hash_rank(pairs, [type_col], F.col(key), seed)
    return ranked.where((F.col("_rank") <= max_per_type) & (F.least("_count", F.lit(max_per_type)) >= min_per_type)).drop("_rank", "_count")


def balance_stats(pairs: DataFrame, type_col: str = "task_type") -> DataFrame:
    return pairs.groupBy(F.coalesce(F.col(type_col), F.lit("unknown")).alias("task_type")).agg(F.count("*").alias("n"))


def split_dataset(pairs: DataFrame, val_ratio: float = 0.1, seed: int = 42, stratify: bool = True, type_col: str = "task_type", key: str = "ordinal") -> DataFrame:
    """Column ``split``, 'train' or 'val': of each type the floor of its share, but one at least, goes to 'val', and one of two at least stays."""
    if not 0.0 < val_ratio < 1.0:
        raise ValueError(f"val_ratio is between 0 and 1, not {val_ratio}")
    df = pairs.withColumn("_type", F.coalesce(F.col(type_col), F.lit("unknown")) if stratify else F.lit("all"))
    ranked = hash_rank(df, ["_type"], F.col(key), seed)
    wanted = F.greatest(F.lit(1), F.floor(F.col("_count") * val_ratio))
    if stratify:
        wanted = F.when((F.col("_count") >= 2) & (wanted >= F.col("_count")), F.col("_count") - 1).otherwise(wanted)
    return ranked.withColumn("split", F.when(F.col("_rank") <= wanted, "val").otherwise("train")).drop("_type", "_rank", "_count")


def cap_per_type(pairs: DataFrame, n: int, type_col: str = "task_type", order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """The first ``n`` pairs of each type in order of arrival; a limit on rank is applied before the shuffle too."""
    place = Window.partitionBy(type_col).orderBy(*order)
    return pairs.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= n).drop("_rank")


def conversations_to_pairs(turns: DataFrame) -> DataFrame:
    """A pair per conversation: the last turn is the completion, what comes before it the prompt."""
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    talk = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    before = F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0)))
    said = F.transform(before, lambda x: F.concat(F.when(x["role"] == "user", "User: ").when(x["role"] == "system", "System: ").otherwise("Assistant: "), x["content"]))
    return grouped.select(
        F.col("conv_id").alias("ordinal"), F.array_join(said, "\n\n").alias("prompt"), F.element_at("t", -1)["content"].alias("completion"),
        F.when(F.size("t") > 2, "multi_turn_dialogue").otherwise("single_turn").alias("task_type"), F.concat(F.lit("conv://"), F.col("conv_id")).alias("source"), talk.alias("conversation"),
    )


