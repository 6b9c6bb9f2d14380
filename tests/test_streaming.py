import pytest
from pyspark.sql import functions as F

from loomtext.operators import dedup
from loomtext.sources import readers
from loomtext.streaming import streams

DATA = "/root/testdata/sf0.001"


def test_minutes_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.minute_counts(stream).writeStream.format("memory").queryName("minutes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("minutes").collect()))
    want = sorted(map(tuple, events.groupBy(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute")).count().collect()))
    assert got == want


def test_near_dedup_stream_equals_batch(spark, tmp_path):
    rows = readers.documents_as_records(spark.read.parquet(f"{DATA}/documents.parquet")).select("ordinal", "source_url", "content", "status")
    for i in range(2):  # one file a batch, in order of ordinals
        rows.where((F.col("ordinal") >= 100 * i) & (F.col("ordinal") < 100 * (i + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.near_dedup_stream(stream, str(tmp_path / "bands"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    kept = {r.ordinal for r in spark.read.parquet(str(tmp_path / "out")).select("ordinal").collect()}
    batch = rows.where("ordinal < 200")
    dropped = {r.ordinal for r in dedup.minhash_duplicates(batch).collect()}
    assert kept == {r.ordinal for r in batch.select("ordinal").collect()} - dropped


def test_crawl_state(spark, tmp_path):
    spark.createDataFrame([("a", "error"), ("a", "done"), ("b", "error")], "url string, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, status string").parquet(str(tmp_path / "in"))
    q = streams.crawl_state(stream).writeStream.format("memory").queryName("state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.url: r.status for r in spark.table("state").collect()} == {"a": "done", "b": "error"}


def test_index_is_saved_cleared_and_survives_damage(spark, tmp_path):
    rows = readers.documents_as_records(spark.read.parquet(f"{DATA}/documents.parquet")).select("ordinal", "source_url", "content", "status")
    bands, out = str(tmp_path / "bands"), str(tmp_path / "out")
    assert streams.read_bands(spark, bands) is None
    streams.dedup_batch(rows, 0, bands, out)
    kept = {r.ordinal for r in spark.read.parquet(out).select("ordinal").collect()}
    assert {r.ordinal for r in streams.read_bands(spark, bands).select("ordinal").distinct().collect()} == kept
    streams.dedup_batch(rows.withColumn("ordinal", F.col("ordinal") + 10_000), 1, bands, out)
    assert spark.read.parquet(out).count() == len(kept)
    for part in (tmp_path / "bands").rglob("*.parquet"):
        part.write_bytes(b"damaged")
    for crc in (tmp_path / "bands").rglob(".*.crc"):
        crc.unlink()
    with pytest.warns(UserWarning, match="counts as empty"):
        assert streams.read_bands(spark, bands) is None
    streams.clear_bands(spark, bands)
    assert streams.read_bands(spark, bands) is None and not (tmp_path / "bands").exists()
