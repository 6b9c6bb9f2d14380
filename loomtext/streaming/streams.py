"""Structured Streaming: counts by minute, exact and near duplicates as data comes, and crawl state."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text as T
from ..operators.dedup import band_entries, first_wins, is_content


def minute_counts(stream: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows by minute; a minute is final once the watermark has passed it."""
    windowed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("minute"), "n")


def exact_dedup_stream(stream: DataFrame, content: str = "content", ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first record of each normalised content; with a time column, repeats count within the watermark only and state is bounded."""
    hashed = stream.withColumn("_h", T.text_sha1(T.normalize_whitespace(content)))
    if ts is None:
        return hashed.dropDuplicates(["_h"]).drop("_h")
    return hashed.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


#: How Spark names files that aren't what they should be (fixed values); any other error isn't the index's.
BROKEN = ("FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file")


def _folder(spark, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def read_bands(spark, path: str) -> DataFrame | None:
    """Band buckets of the records kept so far; null before the first batch.  An index that can't be read counts as empty."""
    jvm_path, files = _folder(spark, path)
    if not files.exists(jvm_path):
        return None
    known = spark.read.schema("ordinal long, bucket long, batch long").parquet(path)
    try:
        known.count()  # reads the footers of all files, and no rows
    except (PySparkException, Py4JJavaError) as e:
        if not any(kind in str(e) for kind in BROKEN):
            raise
        warnings.warn(f"the index at {path} can't be read and counts as empty: {e}", stacklevel=2)
        return None
    return known


def clear_bands(spark, path: str) -> None:
    """Forget the records kept so far."""
    jvm_path, files = _folder(spark, path)
    files.delete(jvm_path, True)


def dedup_batch(records: DataFrame, batch_id: int, bands_path: str, out_path: str, num_perm: int = 128, bands: int = 8, rows: int = 16) -> None:
    """Near duplicates of a micro-batch against all kept before it: kept rows are appended, with their buckets.

    A batch that runs again replaces its own part of both tables.  ``ordinal`` grows from batch to batch.
    """
    spark = records.sparkSession
    fresh = records.where(is_content()).persist()
    try:
        entries = band_entries(fresh, num_perm, bands, rows)
        known = read_bands(spark, bands_path)
        seen = entries.limit(0).select("ordinal")
        if known is not None:
            seen = entries.join(known.where(F.col("batch") != batch_id).select("bucket").distinct(), "bucket", "left_semi").select("ordinal").distinct()
        rest = entries.join(seen, "ordinal", "left_anti")
        dropped = seen.union(first_wins(rest).select("ordinal"))
        kept = fresh.join(dropped, "ordinal", "left_anti")
        kept.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_path)
        rest.join(dropped, "ordinal", "left_anti").withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(bands_path)
    finally:
        fresh.unpersist()


def near_dedup_stream(stream: DataFrame, bands_path: str, out_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs ``dedup_batch`` over what is there now and ends."""
    writer = stream.writeStream.foreachBatch(lambda df, i: dedup_batch(df, i, bands_path, out_path, **options))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    done, errors = state.get if state.exists else (0, 0)
    for b in batches:
        done += int((b["status"] == "done").sum())
        errors += int((b["status"] == "error").sum())
    state.update((done, errors))
    yield pd.DataFrame({"url": [key[0]], "done": [done], "errors": [errors], "status": ["done" if done else "error"]})


def crawl_state(outcomes: DataFrame) -> DataFrame:
    """Running state of each URL out of a stream of outcomes (``url, status``): done once it was done."""
    return outcomes.groupBy("url").applyInPandasWithState(_latest, "url string, done long, errors long, status string", "done long, errors long", "update", "NoTimeout")
