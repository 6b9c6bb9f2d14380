"""The queries opN_<name>: each applies its operator to a whole table and derives the columns of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import oracles
from .ann import nearest_neighbours
from .chat import ChatConfig, format_chats
from .embeddings import embedding_near_duplicates
from .licenses import scan_licenses
from .linededup import dedup_lines
from .minhash import MinHashConfig, near_duplicates
from .mixing import MixConfig, mix_sources, source_targets, word_count
from .packing import pack
from .secrets import BASE_KINDS, scan_versions, span_text
from .toxicity import crc_fold, fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, as this query's results are defined; the operator's own default is five."""
    return near_duplicates(_table(spark, sf_dir, "documents"), MinHashConfig(shingle_words=2))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan: the ledger is empty, so every blob is unseen."""
    found, _ = scan_versions(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[of(k) for k in BASE_KINDS], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("matches")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document after deletion of later repeated runs, with the deleted line numbers as first-last pairs."""
    done = dedup_lines(_table(spark, sf_dir, "documents"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("removed") / 2 - 1, F.lit(0)).cast("int")), lambda i: F.concat_ws("-", F.try_element_at("removed", 2 * i + 1).cast("string"), F.try_element_at("removed", 2 * i + 2).cast("string")))
    return done.select("doc_id", "text", "n_removed", F.when(F.size("removed") > 0, F.concat_ws(",", pairs)).otherwise("").alias("removed_lines"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(crc_fold(F.col("doc_id")) != 0))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 aims at: the size and the target of each source."""
    docs = _table(spark, sf_dir, "documents")
    targets = source_targets(docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), MixConfig())
    return targets.select("source", "source_size", F.round("target", 6).alias("target"))


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL can express: places of phrases."""
    return scan_licenses(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over conversations whose replies are calls, with results, references, schemas and results of no call."""
    turns = _table(spark, sf_dir, "conversations")
    first = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("first"))
    name = F.concat(F.lit("c"), F.col("turn").cast("string"))
    of = F.col("conv_id") % 3
    # References: none, to the reply before, or from the first reply to the one after it.
    to = F.when((of == 1) & (F.col("turn") > F.col("first")), F.col("turn") - 2).when((of == 2) & (F.col("turn") == F.col("first")), F.col("turn") + 2)
    reference = F.coalesce(F.concat(F.lit(', "on": {"$ref": "c'), to.cast("string"), F.lit('"}')), F.lit(""))
    arguments = F.concat(F.lit('{"z": "é", "n": '), F.length("text").cast("string"), reference, F.lit("}"))
    tool = F.when(F.col("conv_id") % 2 == 0, "say").otherwise("shout")
    replies = turns.where("role = 'assistant'").join(first, "conv_id")
    calls = replies.select("conv_id", "turn", "role", F.to_json(F.struct(F.lit("I see.").alias("content"), F.array(F.struct(name.alias("id"), tool.alias("name"), arguments.alias("arguments"))).alias("tool_calls"))).alias("text"))
    target = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("x"), F.col("turn").cast("string"))).otherwise(name)
    results = replies.select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(F.struct(F.concat(F.lit("r"), F.col("turn").cast("string")).alias("content"), target.alias("tool_call_id"))).alias("text"))
    rest = turns.where("role <> 'assistant'").select("conv_id", "turn", "role", "text")
    schemas = ChatConfig({"say": {"n": "number", "z": "string", "on": "object"}, "shout": {"n": "string", "z": "string", "on": "object"}}, {"say": ("n", "z"), "shout": ("n",)})
    return format_chats(rest.union(calls).union(results), schemas)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_embedding_near_dedup, op3_pack_sequences, op4_chat_format, op5_minhash_near_dedup,
        op6_secret_scan, op7_license_scan, op8_line_dedup, op9_nearest_neighbours, op10_toxicity,
        mix_targets, license_places, chat_tool_calls,
    )
}

ORACLE_SQL: dict[str, str] = oracles.SQL
