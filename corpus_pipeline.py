"""A training-data pipeline over the documents table.

Toxic documents go, later repeats of line runs are deleted, one document of each near-duplicate group
stays, sources are mixed to their target weights, and what is left is packed into sequences.
Each stage reads what its predecessor wrote and works on all of it.  It first removes the tables that earlier
stages' results were read from, as those results are written by then.

As a stage's result is written by who calls it, the pipeline bounds the Arrow batches of the session that it is given: it is
an application, and the operators themselves leave the session as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.cluster import BATCH_BYTES, BROADCAST_IDS, by_ids, free, trimmed, written
from loomtext.llm.linededup import dedup_lines
from loomtext.llm.minhash import near_duplicates
from loomtext.llm.mixing import take_copies
from loomtext.llm.packing import pack
from loomtext.llm.toxicity import crc_fold, fit_toxicity, score_toxicity
from loomtext.session import ship


def _begun(spark: SparkSession, docs: DataFrame) -> None:
    """What every stage begins with: earlier tables go, and batches are bounded."""
    trimmed(docs)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.  Only labels outside the held-out fold are learnt from."""
    _begun(spark, docs)
    (score,) = free(docs, "_score")
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(crc_fold(F.col("doc_id")) != 0))
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 50 words or more are cut out whole; a document of nothing else goes."""
    _begun(spark, docs)
    gone, ranges = free(docs, "_gone", "_ranges")
    done = dedup_lines(docs, added=(gone, ranges)).where((F.col(gone) == 0) | F.col("text").isNull() | (F.col("text") != ""))
    size = F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", size.cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (shingles of five words, similarity of 0.8 or more) the smallest id stays.

    Rows that repeat an id, or have none, are told apart by a 64-bit hash of id and text, so that unlike texts of one id
    are judged each on its own; of rows that repeat both, one stays.
    """
    _begun(spark, docs)
    key, same = free(docs, "_key", "_same")
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").select(F.col("doc_id").alias(same)), "repeated-ids")
    if repeated.isEmpty():
        keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    else:
        few = repeated.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        marked = (F.broadcast(repeated) if few else repeated).withColumn(key, F.lit(True))
        joined = docs.join(marked, F.col("doc_id").eqNullSafe(F.col(same)), "left")
        keyed = joined.withColumn(same, F.coalesce(key, F.lit(False))).withColumn(key, F.when(F.col(same), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")))
    groups = written(near_duplicates(keyed, id_col=key), "groups")
    kept = by_ids(keyed, groups.where("not kept"), key, "left_anti")
    if same in keyed.columns:
        kept = kept.where(~F.col(same)).unionByName(kept.where(same).dropDuplicates([key]))
    return kept.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, words counted."""
    _begun(spark, docs)
    return take_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens a sequence, with their ids."""
    _begun(spark, docs)
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix),
    ("packing", pack_sequences),
]

#: Trees, rounding draws and token ids are not SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
