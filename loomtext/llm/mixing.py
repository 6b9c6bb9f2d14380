"""Mixing sources to target weights by pivotal dependent rounding along a distributed reduction tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .cluster import free, mark, trimmed, written

#: Sources whose targets are broadcast at most, after they have been counted.
BROADCAST_SOURCES = 50_000
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    """``weights`` repeat over the sources by code point, null last; all sources together are to give
    ``total`` times all sizes, each at most ``most`` times its own."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    total: float = 1.5
    most: float = 2.0
    leaf_rows: int = 4096
    fan_in: int = 64
    seed: int = 5


def word_count(text: Column) -> Column:
    """Words of non-white-space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """``source, rank, source_size, target``: shares by weight, with the excess of full sources reshared until none is above its limit.

    Ranks come from a range partitioning and its partitions' counts; the resharing keeps only sums on
    the driver, one aggregation a round.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parted = per.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    parted = written(parted, "sources")
    before, at = [], 0
    for part, n in sorted((r[0], r[1]) for r in parted.groupBy("part").count().collect()):
        before.append((part, at))
        at += n
    place = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    offset = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in before for x in p]), F.col("part")), F.lit(0)) if before else F.lit(0)
    ranked = parted.withColumn("rank", (F.row_number().over(place) - 1 + offset).cast("long"))
    turns = F.array(*[F.lit(float(w)) for w in cfg.weights])
    ranked = ranked.withColumn("weight", F.element_at(turns, (F.col("rank") % len(cfg.weights) + 1).cast("int")))
    ranked = written(ranked.select("source", "rank", "source_size", "weight"), "ranked")
    limit, level = F.col("source_size") * F.lit(float(cfg.most)), None
    everything = ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:
        # Sources whose share at the present level is above their limit stay at the limit from now on.
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= limit
        open_weight, given = ranked.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, limit))).first()
        if not open_weight:
            break
        now = (cfg.total * everything - (given or 0.0)) / open_weight
        if level is not None and now <= level:
            break
        level = now
    share = limit if level is None else F.least(limit, F.col("weight") * F.lit(float(level)))
    return ranked.select("source", "rank", F.col("source_size").cast("long").alias("source_size"), share.cast("double").alias("target"))


def _round_group(seed: int, last: bool):
    """Sequential pivotal rounding of one group: at most one item stays fractional, unless ``last`` settles it too.

    Items stay in Arrow, where a long column with nulls keeps all its digits.
    """

    def run(items: pa.Table) -> pa.Table:
        items = items.combine_chunks()
        of = lambda name: items.column(name).to_numpy()
        named = pc.is_valid(items.column("id")).to_numpy()
        ids = pc.fill_null(items.column("id"), 0).to_numpy()
        order = np.lexsort((ids, named, of("key"), -of("size")))
        size, part = of("size").astype(float)[order], of("part").astype(float)[order]
        draw = (K.mix(of("key").astype(np.int64)[order].view(np.uint64) ^ K.U64(seed * 977 + 13)) >> K.U64(11)).astype(float) * 2.0**-53
        held = -1
        for i in range(len(part)):
            if not 0.0 < part[i] < 1.0:
                continue
            if held < 0:
                held = i
                continue
            # Moving size * part between the two keeps the words that both are expected to give.
            gain = min(size[held] * (1 - part[held]), size[i] * part[i])
            loss = min(size[held] * part[held], size[i] * (1 - part[i]))
            move = gain if draw[i] * (gain + loss) < loss else -loss
            part[held] += move / size[held]
            part[i] -= move / size[i]
            for j in (held, i):
                if part[j] < 1e-9 or part[j] > 1 - 1e-9:
                    part[j] = round(part[j])
            held = next((j for j in (held, i) if 0.0 < part[j] < 1.0), -1)
        if last and held >= 0:
            part[held] = float(draw[held] < part[held])
        out = items.take(pa.array(order))
        return out.set_column(out.schema.get_field_index("part"), "part", pa.array(part))

    return run


_ITEM = "id long, source string, rank long, size long, key long, whole int, part double, bucket long"


def mix_sources(docs: DataFrame, config: MixConfig | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Copies to take of each document: id, source, ``size`` (words), ``source_size``, ``target`` and ``copies``.

    A document of a source with ratio r = target / source size gets floor(r) copies and a fractional
    one, which pivotal rounding settles: of two fractional documents, words move from one to the other
    at random until one is integral, and the sum of words stays.  A leaf of the tree rounds up to about
    ``leaf_rows`` documents of a source; the residual of each leaf meets those of ``fan_in`` leaves one level up,
    and so on to one document a source, which is settled by a last draw.  So a source's words
    differ from its target by less than one document's.  Draws depend on ids and the seed, so reruns agree.

    Rows that share an id and a source, also those of a null id, are one item and get the same
    copies.  A null text has size 0 and floor(r) copies.  A null source is a source, the last.  An empty
    table gives an empty result; other columns are ignored.
    """
    cfg = config or MixConfig()
    since = mark(docs.sparkSession)
    rows = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    targets = written(source_targets(rows, cfg), "targets")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else lambda df: df
    items = rows.groupBy("id", "source").agg(F.sum("size").alias("size"))
    counts = items.where("size > 0").groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
    ruled = targets.join(counts, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("of"), "rank", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / cfg.leaf_rows)).cast("long").alias("leaves"))
    ruled = written(ruled, "ruled")
    leaves = ruled.agg(F.max("leaves")).first()[0] or 1
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cfg.most))).otherwise(F.lit(0.0))
    key = F.xxhash64(F.lit(cfg.seed), "id", "size", "rank")
    placed = items.join(hint(ruled), F.col("source").eqNullSafe(F.col("of"))).withColumn("ratio", ratio)
    placed = placed.select("id", "source", "rank", "size", key.alias("key"), F.floor("ratio").cast("int").alias("whole"), F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0).alias("part"), F.pmod(key, F.col("leaves")).alias("bucket"))
    level, settled = 0, []
    open_items = placed
    while True:
        last = leaves <= 1
        done = written(open_items.groupBy("rank", "bucket").applyInArrow(_round_group(cfg.seed + level, last), _ITEM), f"level{level}")
        settled.append(done.where("part = 0 or part = 1"))
        if last:
            break
        open_items = done.where("part > 0 and part < 1").withColumn("bucket", F.floor(F.col("bucket") / cfg.fan_in).cast("long"))
        leaves, level = -(-leaves // cfg.fan_in), level + 1
    chosen = settled[0]
    for more in settled[1:]:
        chosen = chosen.union(more)
    chosen = chosen.select(F.col("id").alias("i"), F.col("rank").alias("r"), (F.col("whole") + F.col("part").cast("int")).alias("copies"))
    full = rows.join(hint(ruled.drop("leaves")), F.col("source").eqNullSafe(F.col("of")))
    full = full.join(chosen, (F.col("rank") == F.col("r")) & F.col("id").eqNullSafe(F.col("i")))
    return trimmed(full.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies"), since)


def take_copies(docs: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """The documents themselves, each as often as ``mix_sources`` takes it, with their own columns, whatever their names."""
    since = mark(docs.sparkSession)
    i, s, n, turn = free(docs, "_i", "_s", "_n", "_copy")
    chosen = mix_sources(docs, config).where("copies > 0").select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("copies").alias(n)).distinct()
    chosen = written(chosen, "copies")
    # Texts are shuffled at every size and hash the small side, so they aren't sorted.
    joined = docs.join(chosen.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & F.col("source").cast("string").eqNullSafe(F.col(s)))
    return trimmed(joined.select(*[F.col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), n)).alias(turn)).drop(turn), since)
