"""MinHash near-dedup with SuperMinHash signatures (Ertl 2017), banding, verification on full sets and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .cluster import by_ids, mark, trimmed, written
from .components import components


@dataclass(frozen=True)
class MinHashConfig:
    """``bands * rows`` signature components.  A pair at the threshold 0.8 shares no band with
    probability (1 - 0.8**4)**32 = 5e-8; a pair above it, less."""

    shingle_words: int = 5
    threshold_percent: int = 80
    bands: int = 32
    rows: int = 4
    leader_turns: int = 2
    counters: int = 1 << 18
    odd_bits: int = 1024
    seed: int = 11

    @property
    def permutations(self) -> int:
        return self.bands * self.rows

    @property
    def sketch_limit(self) -> int:
        """Differing bits, of one bit per component, that a pair at the threshold exceeds with probability below 1e-9."""
        m, p = self.permutations, (1 - self.threshold_percent / 100) / 2
        return int(np.ceil(m * p + 6.2 * np.sqrt(m * p * (1 - p))))


#: Elements whose permutations are held at once, besides those of a single large set, which needs few.
ELEMENTS = 1 << 15


def superminhash(sets: np.ndarray, at: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Signatures of sets of hashes: row i of the result is that of ``sets[at[i]:at[i + 1]]``.

    Step j of an element's own random permutation puts r + j, r uniform in [0, 1), at its j-th place;
    a component is the minimum over elements.  Values only grow with j, so an element stops once j is
    above every component of its set, which for large sets is after a step or two.  An empty set's
    components are infinite.
    """
    sig = np.full((len(at) - 1, m), np.inf)
    group = at[1:] // ELEMENTS  # runs of sets, so that the permutations in use stay few
    for g in np.unique(group):
        lo, hi = np.searchsorted(group, g), np.searchsorted(group, g, side="right")
        _fill(sig[lo:hi], sets[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], seed)
    return sig


def _fill(sig: np.ndarray, sets: np.ndarray, at: np.ndarray, seed: int) -> None:
    n, m = sig.shape
    row = np.repeat(np.arange(n), np.diff(at))
    with np.errstate(over="ignore"):
        state = K.mix(sets ^ K.U64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    perm = None
    for j in range(m):
        if not len(row):
            break
        with np.errstate(over="ignore"):
            state = state + K._GOLD
        x = K.mix(state)
        r = (x >> K.U64(11)).astype(np.float64) * 2.0**-53
        k = j + (K.mix(x ^ K._M1) % K.U64(m - j)).astype(np.int64)
        if perm is None:
            place = k
        else:
            lines = np.arange(len(row))
            place = perm[lines, k].astype(np.int64)
            perm[lines, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(sig, (row, place), r + j)
        there = np.unique(row)
        top = np.zeros(n)
        top[there] = sig[there].max(axis=1)
        keep = top[row] >= j + 1
        row, state = row[keep], state[keep]
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(row), 1))
            kept = k[keep]
            lines = np.arange(len(row))
            perm[lines, kept] = 0
            perm[:, 0] = kept
        else:
            perm = perm[keep]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _profiles(cfg: MinHashConfig, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.slices(batch, "text"):
                data, offs = K.flat(b.column("text"))
                words, at = K.word_hashes(data, offs)
                sets, at = K.shingle_sets(words, at, cfg.shingle_words)
                n = len(at) - 1
                sig = superminhash(sets, at, cfg.permutations, cfg.seed)
                bits = sig.view(np.uint64)
                bands = np.stack([K.combine([np.ascontiguousarray(bits[:, i * cfg.rows + j]) for j in range(cfg.rows)] + [np.full(n, i, np.uint64)]) for i in range(cfg.bands)], axis=1) if n else np.zeros((0, cfg.bands), np.uint64)
                one = np.packbits((K.mix(np.ascontiguousarray(bits)) & K.U64(1)).astype(np.uint8), axis=1) if n else np.zeros((0, 16), np.uint8)
                width = -(-one.shape[1] // 8) * 8
                sketch = np.zeros((n, width), np.uint8)
                sketch[:, : one.shape[1]] = one
                sketch = sketch.view(np.uint64)
                with np.errstate(over="ignore"):
                    total = np.concatenate([[K.U64(0)], np.cumsum(sets, dtype=K.U64)])
                    other = np.concatenate([[K.U64(0)], np.cumsum(K.mix(sets ^ K._M2), dtype=K.U64)])
                    h1, h2 = total[at[1:]] - total[at[:-1]], other[at[1:]] - other[at[:-1]]
                cells = np.arange(n + 1, dtype=np.int32)
                yield pa.record_batch(
                    [b.column(i) for i in range(keep)]
                    + [
                        pa.array(np.diff(at), pa.int64()), _signed(h1), _signed(h2),
                        pa.ListArray.from_arrays(pa.array(cells * sketch.shape[1]), _signed(sketch.ravel())),
                        pa.ListArray.from_arrays(pa.array(cells * cfg.bands), _signed(bands.ravel())),
                    ],
                    names=[b.schema.names[i] for i in range(keep)] + ["n_shingles", "h1", "h2", "sketch", "bands"],
                )

    return run


def _sets(cfg: MinHashConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.slices(batch, "text"):
                data, offs = K.flat(b.column("text"))
                words, at = K.word_hashes(data, offs)
                sets, at = K.shingle_sets(words, at, cfg.shingle_words)
                raw = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(sets.tobytes())])
                yield pa.record_batch([b.column("id"), raw.cast(pa.binary())], names=["id", "elements"])

    return run


def _verified(cfg: MinHashConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("ea"), b.column("eb"), strict=True)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = 2 * len(u) if x is y else len(np.intersect1d(u, v, assume_unique=True))
                ok[i] = 100 * common >= cfg.threshold_percent * (len(u) + len(v) - common)
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def _slots(elements: np.ndarray, cfg: MinHashConfig) -> np.ndarray:
    return (K.mix(elements) % K.U64(cfg.counters)).astype(np.int64)


def _counted(cfg: MinHashConfig):
    """How often the shingles of each slot stand in the sets; the number of slots is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.counters, np.int64)
        for b in batches:
            for x in b.column("elements"):
                np.add.at(total, _slots(np.frombuffer(x.as_buffer(), np.uint64), cfg), 1)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    return run


def odd_sketch(elements: np.ndarray, bits: int) -> np.ndarray:
    """Bit i tells whether an odd number of elements hash to i.

    An element that only one of two sets has flips one bit, so the sketches differ in at most as many bits as there
    are such elements: a bound without any chance of error.
    """
    at = (K.mix(elements ^ K._M2) % K.U64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def _prefixes(cfg: MinHashConfig, frequency: np.ndarray):
    """The rarest shingles of each set, so many that a linked set must have one of them among its own, and its odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, odd, size = [], [], [0]
            for x in b.column("elements"):
                u = np.frombuffer(x.as_buffer(), np.uint64)
                order = np.lexsort((u, frequency[_slots(u, cfg)]))
                first.append(u[order[: len(u) - -(-len(u) * cfg.threshold_percent // 100) + 1]])
                odd.append(odd_sketch(u, cfg.odd_bits))
                size.append(size[-1] + len(first[-1]))
            flat = lambda parts: _signed(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
            lists = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), flat(first)), pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1, dtype=np.int32) * (cfg.odd_bits // 64)), flat(odd))]
            yield pa.record_batch([b.column("id"), *lists], names=["id", "first", "odd"])

    return run


def near_duplicates(docs: DataFrame, config: MinHashConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id reachable over links, itself included) and ``kept``.

    Two documents are linked when ``100 * |A & B| >= threshold_percent * |A | B|`` for their sets of
    word shingles (A-Z lower-cased, words of non-white-space).  Equal sets form a class, of which only
    the smallest id goes on.  Every band bucket first pairs its members with its smallest id, then those not yet
    joined with two more members, which settles large groups by few pairs.  Last, all documents of
    buckets that still hold several components are paired if they share a shingle of their prefixes, the rarest
    ones of a set, of which any linked set must have one among its own, early enough in both.  No link is lost by
    that.  Pairs whose set sizes, one-bit sketches or odd sketches rule a link out are left where they meet, before they are written: the
    odd sketch bounds the elements that only one of two sets has, which tells texts of one template just under the threshold
    apart.  Every pair left is confirmed on the full sets, recomputed from the text, before it counts.

    A null or empty text, or one without words, has an empty set and links with nothing.  Rows that
    share an id are one node.  A null id links with nothing: component null, kept true.
    An empty table gives an empty result; other columns are ignored.
    """
    cfg = config or MinHashConfig()
    since = mark(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profiles = written(source.mapInArrow(_profiles(cfg, 1), "id long, n_shingles long, h1 long, h2 long, sketch array<long>, bands array<long>"), "profiles")
    classes = (
        profiles.where("n_shingles > 0 and id is not null")
        .groupBy("n_shingles", "h1", "h2")
        .agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    )
    classes = written(classes.withColumnRenamed("n_shingles", "n"), "classes")
    entries = classes.select("id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket")
    shared = written(shared, "shared")
    traits = classes.select("id", "n", "sketch")
    live = written(entries.join(shared, "bucket", "left_semi").join(traits, "id"), "live")
    sets = written(by_ids(source, live.select("id"), "id", "left_semi").mapInArrow(_sets(cfg), "id long, elements binary"), "sets")
    apart = lambda x, y, bits: sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(-(-bits // 64))), F.lit(0))
    t = cfg.threshold_percent
    possible = (F.col("k1") != F.col("k2")) & (F.col("n1") * 100 >= F.col("n2") * t) & (F.col("n2") * 100 >= F.col("n1") * t) & (apart("s1", "s2", cfg.permutations) <= cfg.sketch_limit)

    def placed_in(links: DataFrame | None) -> DataFrame:
        if links is None:
            return live.withColumn("k", F.col("id"))
        groups = components(links).select(F.col("node").alias("id"), F.col("component").alias("k"))
        return written(live.join(groups, "id", "left").withColumn("k", F.coalesce("k", "id")), "placed")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(pairs.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct(), name)
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
        return written(both.mapInArrow(_verified(cfg), "a long, b long"), f"{name}-links")

    side = lambda df, i, *more: df.select("bucket", *more, F.col("id").alias(f"id{i}"), F.col("k").alias(f"k{i}"), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"s{i}"))
    links = None
    for turn in range(cfg.leader_turns):
        placed = placed_in(links)
        orders = [F.xxhash64(F.lit(2 * turn + x), "id") for x in (0, 1)] if turn else [F.col("id")]
        leaders = placed.groupBy("bucket").agg(F.array_distinct(F.array(*[F.min_by(F.struct("id", "k", "n", "sketch"), o) for o in orders])).alias("x"), F.min("k").alias("low"), F.max("k").alias("high")).where("low < high")
        leaders = written(leaders.select("bucket", F.explode("x").alias("x")).select("bucket", "x.*"), f"leaders{turn}")
        led = side(placed, 1).alias("l").join(side(leaders, 2).alias("r"), (F.col("l.bucket") == F.col("r.bucket")) & possible)
        found = confirm(led, f"led{turn}")
        links = found if links is None else links.union(found)
    placed = placed_in(links)
    mixed = placed.groupBy("bucket").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high").select("bucket")
    rest = placed.join(written(mixed, "mixed"), "bucket", "left_semi").groupBy("id").agg(F.first("k").alias("k"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    rest = written(rest, "rest")
    open_sets = written(sets.join(rest.select("id"), "id", "left_semi"), "open-sets")
    frequency = np.zeros(cfg.counters, np.int64)
    for slot, n in open_sets.mapInArrow(_counted(cfg), "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        frequency[slot] = n
    prefixes = open_sets.mapInArrow(_prefixes(cfg, frequency), "id long, first array<long>, odd array<long>")
    prefixes = written(prefixes.select("id", "odd", F.posexplode("first").alias("place", "bucket")).join(rest, "id"), "prefixes")
    # What two linked sets have in common is so much that their first common shingle stands early in both.
    early = lambda i: (F.col(f"n{i}") - F.col(f"p{i}")) * (100 + t) >= (F.col("n1") + F.col("n2")) * t
    one = side(prefixes, 1, F.col("place").alias("p1"), F.col("odd").alias("o1")).alias("l")
    two = side(prefixes, 2, F.col("place").alias("p2"), F.col("odd").alias("o2")).alias("r")
    apart_sets = apart("o1", "o2", cfg.odd_bits) * (100 + t) <= (F.col("n1") + F.col("n2")) * (100 - t)
    across = one.join(two, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("id1") < F.col("id2")) & early(1) & early(2) & possible & apart_sets)
    links = links.union(confirm(across, "across"))
    member = profiles.where("n_shingles > 0 and id is not null").join(classes.select(F.col("n").alias("n_shingles"), "h1", "h2", F.col("id").alias("node")), ["n_shingles", "h1", "h2"]).select("id", "n_shingles", "node")
    member = written(member, "members")
    repeated = member.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    linked = components(links.union(member.join(repeated, "id", "left_semi").select("id", "node")))
    plain = profiles.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("node"))
    grouped = member.union(plain).join(linked, "node", "left")
    result = grouped.select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "node").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "node"), F.lit(True)).alias("kept"),
    )
    return trimmed(result, since)
