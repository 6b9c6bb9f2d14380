"""Writing corpora: JSON lines, Parquet, and a dataset folder with a card."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "append", gzip: bool = False) -> None:
    """JSON lines with nulls kept."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def export_columns(records: DataFrame) -> DataFrame:
    """The ten columns of the Parquet export, with defaults for nulls."""
    return records.select(
        "source_url", "source_type", "content", "content_sha1", F.coalesce("language", F.lit("")).alias("language"), F.coalesce("license", F.lit("")).alias("license"),
        F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"),
        F.coalesce("categories", F.expr("cast(array() as array<string>)")).alias("categories"), "date_accessed",
    )


def write_parquet(records: DataFrame, path: str) -> None:
    export_columns(records).write.mode("overwrite").option("compression", "zstd").parquet(path)


def split_outcomes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that came through with content, and errors for the rest."""
    good = F.coalesce((F.col("status") == "ok") & (F.col("content") != ""), F.lit(False))
    errors = records.where(~good).select("source_url", "source_type", F.coalesce("status", F.lit("no content")).alias("reason"))
    return records.where(good), errors


def write_dataset_folder(records: DataFrame, path: str, name: str = "corpus", license: str = "other") -> None:
    """Data files with ``dataset_infos.json`` and a card, for a local folder."""
    write_jsonl(records, os.path.join(path, "data"), mode="overwrite")
    infos = {name: {"features": {f.name: f.dataType.simpleString() for f in records.schema}, "splits": {"train": {"num_examples": records.count()}}, "license": license}}
    with open(os.path.join(path, "dataset_infos.json"), "w", encoding="utf-8") as f:
        json.dump(infos, f, ensure_ascii=False, indent=2)
    with open(os.path.join(path, "README.md"), "w", encoding="utf-8") as f:
        f.write(f"---\nlicense: {license}\n---\n# {name}\n\nJSON lines in `data/`.\n")
