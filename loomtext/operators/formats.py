"""Chat-training formats of instruction pairs, each a JSON text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

FORMATS = ("jsonl", "chatml", "alpaca", "sharegpt", "axolotl", "llama_factory")


def _turns(df: DataFrame, system: str) -> Column:
    """The turns to write: the conversation's non-empty ones if it has two turns, else prompt and completion; a system turn first."""
    turn = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    single = F.array(turn(F.lit("user"), F.coalesce("prompt", F.lit(""))), turn(F.lit("assistant"), F.coalesce("completion", F.lit(""))))
    turns = single
    if "conversation" in df.columns:
        talk = F.transform("conversation", lambda t: turn(F.coalesce(t["role"], F.lit("user")), F.coalesce(t["content"], F.lit(""))))
        turns = F.when(F.coalesce(F.size("conversation") >= 2, F.lit(False)), F.filter(talk, lambda t: t["content"] != "")).otherwise(single)
    return F.concat(F.array(turn(F.lit("system"), F.lit(system))), turns) if system else turns


def _optional(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def _named(role: Column) -> Column:
    return F.when(role == "assistant", "gpt").when(role == "system", "system").otherwise("human")


def chatml_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit("<|im_end|>"))), "\n")


def fields(pairs: DataFrame, fmt: str, system: str = "") -> list[Column]:
    """The columns of a format's record; a key whose column is missing or null isn't written."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known are {', '.join(FORMATS)}")
    prompt, completion = F.coalesce("prompt", F.lit("")), F.coalesce("completion", F.lit(""))
    if fmt == "jsonl":
        return [prompt.alias("prompt"), completion.alias("completion"), *_optional(pairs, "task_type", "source")]
    if fmt == "alpaca":
        at = F.instr(prompt, "\n")
        first = F.when(at > 0, F.substring_index(prompt, "\n", 1)).otherwise(prompt)
        rest = F.when(at > 0, prompt.substr(at + 1, F.length(prompt))).otherwise("")
        return [strip(first).alias("instruction"), strip(rest).alias("input"), completion.alias("output")]
    turns = _turns(pairs, system if fmt in ("chatml", "axolotl", "llama_factory") else "")
    if fmt == "chatml":
        task = F.coalesce("task_type", F.lit("")) if "task_type" in pairs.columns else F.lit("")
        return [chatml_text(turns).alias("text"), task.alias("task_type")]
    if fmt == "llama_factory":
        return [turns.alias("messages"), *_optional(pairs, "source", "task_type")]
    said = F.transform(turns, lambda t: F.struct(_named(t["role"]).alias("from"), t["content"].alias("value")))
    return [said.alias("conversations" if fmt == "sharegpt" else "conversation"), *_optional(pairs, "source", "task_type")]


def convert(pairs: DataFrame, fmt: str, system: str = "") -> DataFrame:
    """One column ``value`` of JSON texts; pairs with an empty prompt or completion are left out."""
    full = pairs.where("coalesce(prompt, '') <> '' and coalesce(completion, '') <> ''")
    return full.select(F.to_json(F.struct(*fields(pairs, fmt, system))).alias("value"))


def convert_all(pairs: DataFrame, formats: tuple[str, ...] = FORMATS, system: str = "") -> DataFrame:
    """``format, value`` of every format in one frame; write it partitioned by ``format``."""
    return reduce(DataFrame.unionByName, [convert(pairs, f, system).select(F.lit(f).alias("format"), "value") for f in formats])


def write_split(split: DataFrame, path: str, formats: tuple[str, ...] = FORMATS) -> None:
    """Texts of each format and side in folders ``format=.../split=...``."""
    for fmt in formats:
        for side in ("train", "val"):
            convert(split.where(F.col("split") == side), fmt).write.mode("overwrite").text(f"{path}/format={fmt}/split={side}")
