"""Duplicates in record order: exact, by URL, by file, by MinHash bands; and first-wins or last-wins rows.

Records carry ``ordinal``, their place in the source; the first of equal ones stays.  First rows are
found by aggregation, whose partial step meets a hot key's rows before the shuffle, and joined back.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import col
from ..functions.url import canonical_url
from .lineage import settled


def first_by(df: DataFrame, key: Column, order: str = "ordinal", last: bool = False) -> DataFrame:
    """The first row of each key by ``order``, or the last."""
    pick = F.max_by if last else F.min_by
    rows = df.groupBy(key.alias("_key")).agg(pick(F.struct(*df.columns), F.col(order)).alias("_row"))
    return rows.select("_row.*")


def _duplicates(records: DataFrame, key: Column, eligible: Column) -> DataFrame:
    """``ordinal, first_url`` of the rows whose key stands in an earlier row."""
    keyed = records.where(eligible).select("ordinal", "source_url", key.alias("_key"))
    first = keyed.groupBy("_key").agg(F.min(F.struct("ordinal", "source_url")).alias("f"))
    return keyed.join(first, "_key").where(F.col("ordinal") > F.col("f.ordinal")).select("ordinal", F.col("f.source_url").alias("first_url"))


def is_content(status: str = "status", content: str = "content") -> Column:
    return F.coalesce((F.col(status) == "ok") & (F.col(content) != ""), F.lit(False))


def exact_duplicates(records: DataFrame, normalize: bool = True) -> DataFrame:
    """By SHA-1 of the content, white space normalised."""
    body = T.normalize_whitespace("content") if normalize else F.col("content")
    return _duplicates(records, T.text_sha1(body), is_content())


def url_duplicates(records: DataFrame) -> DataFrame:
    """By canonical URL, whatever the status."""
    return _duplicates(records, canonical_url("source_url"), F.col("source_url").isNotNull())


def mark_image_duplicates(records: DataFrame) -> DataFrame:
    """Files carry ``is_duplicate`` and ``duplicate_of`` (the path of the first file of their hash)."""
    files = records.select("ordinal", F.posexplode("downloaded_files").alias("place", "f"))
    hashed = files.where("f.type = 'image' and f.sha1 is not null and f.sha1 <> ''").select("ordinal", "place", "f.sha1", "f.local_path")
    first = hashed.groupBy("sha1").agg(F.min(F.struct("ordinal", "place", "local_path")).alias("o"))
    later = hashed.join(first, "sha1").where("struct(ordinal, place) <> struct(o.ordinal, o.place)")
    by_record = later.groupBy("ordinal").agg(F.map_from_entries(F.collect_list(F.struct("place", "o.local_path"))).alias("_dups"))
    old = lambda i: F.element_at(F.col("_dups"), i)
    marked = F.transform("downloaded_files", lambda f, i: f.withField("is_duplicate", F.coalesce(F.map_contains_key("_dups", i), F.lit(False))).withField("duplicate_of", old(i)))
    return records.join(by_record, "ordinal", "left").withColumn("downloaded_files", marked).drop("_dups")


def _bucketed(bands: int, rows: int, seed: int = 1):
    """Band buckets of arrays of shingle hashes: minima under random linear maps, a hash for each band's."""
    import numpy as np

    draw = np.random.default_rng(seed)
    factor = draw.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)
    weight = draw.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def one(shingles) -> list[int]:
        with np.errstate(over="ignore"):
            h = np.array(shingles, dtype=np.int64).view(np.uint64)
            least = np.full(bands * rows, np.uint64(2**64 - 1))
            for i in range(0, len(h), 4096):  # a long text's table stays small
                part = h[i : i + 4096, None] * factor + shift
                least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0))
            keys = (least.reshape(bands, rows) * weight).sum(axis=1, dtype=np.uint64)
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(bands, dtype=np.uint64)
        return keys.view(np.int64).tolist()

    def run(batches):
        for batch in batches:
            ordinals, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = [one(x or []) for x in hashes]
            yield pa.record_batch([pa.array([o for o in ordinals for _ in range(bands)], pa.int64()), pa.array([k for row in keys for k in row], pa.int64())], names=["ordinal", "bucket"])

    return run


def band_entries(records: DataFrame, num_perm: int = 128, bands: int = 8, rows: int = 16, k: int = 5, content: str = "content") -> DataFrame:
    """``ordinal, bucket``: a row for each band of each record's MinHash signature, of which ``bands * rows`` components are used.
    Texts without words all have the same buckets."""
    if bands * rows > num_perm:
        raise ValueError(f"{bands} bands of {rows} rows need more than {num_perm} components")
    return records.select(F.col("ordinal").cast("long").alias("ordinal"), T.shingle_hashes(content, k).alias("h")).mapInArrow(_bucketed(bands, rows), "ordinal long, bucket long")


def first_wins(entries: DataFrame) -> DataFrame:
    """``ordinal, keeper`` of the rows that share a bucket with an earlier row that stays.

    This is what a scan in order with an index of kept rows gives.  Each round keeps the rows that come first in
    all of their buckets and removes those that share one with them; a bucket's rows are never paired.
    """
    entries = settled(entries)
    # Buckets of one row decide nothing, and most are of one.
    shared = entries.groupBy("bucket").agg(F.min("ordinal").alias("low"), F.max("ordinal").alias("high")).where("low < high").select("bucket")
    removed, left = None, settled(entries.join(shared, "bucket", "left_semi").select("ordinal", "bucket"))
    while not left.isEmpty():
        at = left.join(left.groupBy("bucket").agg(F.min("ordinal").alias("low")), "bucket")
        first = at.groupBy(F.col("ordinal").alias("low")).agg(F.every(F.col("ordinal") == F.col("low")).alias("first")).where("first")
        # A row's keeper is itself, an earlier row that stays, or not known yet; its buckets are as many as there are bands.
        judged = at.join(first, "low", "left").groupBy("ordinal").agg(F.min(F.when(F.col("first"), F.col("low"))).alias("keeper"), F.collect_set("bucket").alias("buckets"))
        judged = settled(judged)
        out = judged.where("keeper <> ordinal").select("ordinal", "keeper")
        removed = out if removed is None else removed.union(out)
        left = judged.where("keeper is null").select("ordinal", F.explode("buckets").alias("bucket"))
    return left.select("ordinal", F.col("ordinal").alias("keeper")) if removed is None else removed


def minhash_duplicates(records: DataFrame, num_perm: int = 128, bands: int = 8, rows: int = 16, known: DataFrame | None = None) -> DataFrame:
    """``ordinal, keeper``: a candidate of an earlier kept record is its duplicate, without verification.

    ``known`` has the buckets of records kept before (ordinals below all of these).
    """
    entries = band_entries(records.where(is_content()), num_perm, bands, rows)
    if known is None:
        return first_wins(entries)
    entries = settled(entries)
    hit = entries.join(known.select("bucket", F.col("ordinal").alias("keeper")), "bucket").groupBy("ordinal").agg(F.min("keeper").alias("keeper"))
    hit = settled(hit)
    return hit.union(first_wins(entries.join(hit, "ordinal", "left_anti")))


def flag_duplicates(records: DataFrame, exact: bool = True, minhash: bool = True, images: bool = True, num_perm: int = 128, bands: int = 8, rows: int = 16) -> DataFrame:
    """``is_duplicate`` and ``duplicate_of``: exact duplicates, MinHash candidates among the rest, and URL duplicates,
    which override; rows are marked, not dropped."""
    none = records.select("ordinal", F.lit(None).cast("string").alias("first_url")).limit(0)
    by_content = exact_duplicates(records) if exact else none
    near = none
    if minhash:
        rest = records.join(by_content.select("ordinal"), "ordinal", "left_anti")
        found = minhash_duplicates(rest, num_perm, bands, rows)
        near = found.join(records.select(F.col("ordinal").alias("keeper"), F.col("source_url").alias("first_url")), "keeper").select("ordinal", "first_url")
    sides = ((url_duplicates(records), "_u"), (by_content, "_e"), (near, "_m"))
    out = reduce(lambda df, s: df.join(s[0].withColumnRenamed("first_url", s[1]), "ordinal", "left"), sides, records.drop("is_duplicate", "duplicate_of"))
    origin = F.coalesce("_u", "_e", "_m")
    out = out.withColumn("is_duplicate", origin.isNotNull()).withColumn("duplicate_of", origin).drop("_u", "_e", "_m")
    return mark_image_duplicates(out) if images and "downloaded_files" in records.columns else out


def dedup_stats(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count("*").alias("total"), F.count_if(~F.col("is_duplicate")).alias("kept"), F.count_if("is_duplicate").alias("removed"))


def sha1_signature(c: Column | str, num_perm: int = 128, k: int = 3) -> Column:
    """Signature whose component i is the least SHA-1 of ``i:shingle``, as fixed-width text, which orders as numbers do."""
    least = lambda sh: F.transform(F.sequence(F.lit(0), F.lit(num_perm - 1)), lambda i: F.array_min(F.transform(sh, lambda s: F.sha1(F.concat(i.cast("string"), F.lit(":"), s)))))
    return T.let(T.blank_shingles(col(c), k), least)


def signature_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def similar_to_earlier(df: DataFrame, column: str, threshold: float = 0.7, num_perm: int = 128) -> DataFrame:
    """``ordinal, keeper, similarity`` of the rows whose signature is like that of an earlier row that stays.

    At least ``threshold`` of the components agree only if one of floor(n (1 - t)) + 1 bands agrees whole, so
    the bands lose no pair.  Equal signatures always go with their first row and aren't paired.
    """
    n_bands = int(num_perm * (1 - threshold) + 1e-9) + 1
    cut = [round(i * num_perm / n_bands) for i in range(n_bands + 1)]
    signed = settled(df.select("ordinal", sha1_signature(column, num_perm).alias("sig")))
    first = settled(signed.groupBy("sig").agg(F.min("ordinal").alias("ordinal")))
    same = signed.join(first.withColumnRenamed("ordinal", "head"), "sig").where("ordinal <> head").select("ordinal", "head")
    bands = F.array(*[F.xxhash64(F.lit(i), F.array_join(F.slice("sig", a + 1, b - a), ",")) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))])
    entries = first.select("ordinal", "sig", F.explode(bands).alias("bucket"))
    pairs = entries.select("bucket", F.col("ordinal").alias("lo"), F.col("sig").alias("s1")).join(entries.select("bucket", F.col("ordinal").alias("hi"), F.col("sig").alias("s2")), "bucket").where("lo < hi")
    edges = pairs.dropDuplicates(["lo", "hi"]).withColumn("similarity", signature_similarity("s1", "s2")).where(F.col("similarity") >= threshold).select("lo", "hi", "similarity")
    edges = settled(edges)
    removed = None
    while True:
        roots = edges.select("lo").distinct().join(edges.select(F.col("hi").alias("lo")), "lo", "left_anti")
        out = settled(edges.join(roots, "lo").groupBy("hi").agg(F.min(F.struct("lo", "similarity")).alias("f")).select(F.col("hi").alias("ordinal"), F.col("f.lo").alias("keeper"), "f.similarity"))
        removed = out if removed is None else removed.union(out)
        gone = out.select("ordinal")
        edges = settled(edges.join(gone, edges["hi"] == gone["ordinal"], "left_anti").join(gone, edges["lo"] == gone["ordinal"], "left_anti"))
        if edges.isEmpty():
            break
    keeper = F.coalesce(F.col("r.keeper"), F.col("s.head"))
    copies = same.alias("s").join(removed.alias("r"), F.col("s.head") == F.col("r.ordinal"), "left").select("s.ordinal", keeper.alias("keeper"), F.coalesce("r.similarity", F.lit(1.0)).alias("similarity"))
    return removed.union(copies)
