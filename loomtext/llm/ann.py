"""Approximate nearest neighbours by inner product: balanced posting lists with a graph over their centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import mark, trimmed, written
from .embeddings import squared_norm, takes_part


@dataclass(frozen=True)
class AnnConfig:
    """The index is fitted on at most ``sample`` vectors, chosen by a hash of their ids, and holds every
    vector.  A list is to hold about ``list_rows``, but no more than ``max_lists`` lists are made, which
    bounds what executors are sent; longer lists are split into shards of ``shard_rows``.  A query's distance
    ratio is set so that its lists hold ``recall`` of the true neighbours within the sample."""

    k: int = 20
    sample: int = 16_384
    list_rows: int = 512
    max_lists: int = 1024
    degree: int = 16
    replicas: int = 2
    boundary: float = 1.04
    recall: float = 0.97
    group: int = 16
    shard_rows: int = 16_384
    query_rows: int = 2048
    seed: int = 9


def balanced_centroids(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Means of equal parts: halves along the line between two means, again and again, siblings next to each other."""
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    stack = [(np.arange(len(x)), lists)]
    while stack:
        part, n = stack.pop()
        if n <= 1 or len(part) < 2:
            out.append(x[part].mean(axis=0))
            continue
        a, b = x[rng.choice(part, 2, replace=False)]
        for _ in range(4):
            side = x[part] @ (a - b)
            near = side >= np.median(side)
            if near.all() or not near.any():
                break
            a, b = x[part[near]].mean(axis=0), x[part[~near]].mean(axis=0)
        order = np.argsort(x[part] @ (a - b), kind="stable")
        half = n // 2
        cut = len(part) * half // n
        stack += [(part[order[:cut]], half), (part[order[cut:]], n - half)]
    return np.stack(out)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (centroids**2).sum(axis=1)
    return np.concatenate([np.argmin(square[None] - 2 * x[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(x), 4096)])


def rebalanced(x: np.ndarray, centroids: np.ndarray, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids whose lists, by the nearest one, hold similar numbers of the sample.

    Lists of more than twice the mean are halved where they stand, and those of less than an eighth of it go; copies of one
    vector can't be told apart and stay together.
    """
    for r in range(rounds):
        near = _nearest(x, centroids)
        size = np.bincount(near, minlength=len(centroids))
        mean = len(x) / len(centroids)
        over, under = size > 2 * mean, size < mean / 8
        parts, changed = [], False
        for i, c in enumerate(centroids):
            members = x[near == i] if over[i] else None
            if over[i] and (members != members[0]).any():
                parts.append(balanced_centroids(members, 2, seed + r))
                changed = True
            elif under[i] and len(centroids) > 1:
                changed = True
            else:
                parts.append(c[None])
        if not changed or not parts:
            break
        centroids = np.concatenate(parts)
    return centroids


@dataclass
class Index:
    """Centroids with edges to their nearest ones; ``top`` is the largest squared length of a vector."""

    centroids: np.ndarray
    edges: np.ndarray
    top: float
    ratio: float = 1.0

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One more component makes all lengths equal, so that the largest inner product is the least distance."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", x, x), 0))
        return np.concatenate([x, more[:, None]], axis=1)

    def search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids that the graph walk reaches, infinite for others.

        From an entry every walk goes on from its nearest open centroid, and from all within ``ratio`` times the
        nearest distance, until none of these is open.
        """
        n, m = len(x), len(self.centroids)
        distance = np.full((n, m), np.inf)
        opened = np.zeros((n, m), bool)
        entry = np.unique(np.linspace(0, m - 1, min(m, 8)).astype(int))
        distance[:, entry] = np.linalg.norm(x[:, None] - self.centroids[entry][None], axis=2)
        while True:
            closest = distance.min(axis=1)
            front = ~opened & (distance <= ratio * closest[:, None])
            if not front.any():
                return distance
            opened |= front
            rows, at = np.nonzero(front)
            seen = np.zeros((n, m), bool)
            seen[np.repeat(rows, self.edges.shape[1]), self.edges[at].ravel()] = True
            r, c = np.nonzero(seen & np.isinf(distance))
            for i in range(0, len(r), 1 << 16):
                a, b = r[i : i + (1 << 16)], c[i : i + (1 << 16)]
                distance[a, b] = np.linalg.norm(x[a] - self.centroids[b], axis=1)

    def lists(self, x: np.ndarray, boundary: float, replicas: int) -> list[np.ndarray]:
        """The nearest list of each vector, and those nearly as near, up to ``replicas``."""
        d = self.search(self.lifted(x), boundary)
        order = np.argsort(d, axis=1, kind="stable")[:, :replicas]
        near = np.take_along_axis(d, order, axis=1)
        return [o[n <= boundary * n[0] + 1e-12] for o, n in zip(order, near, strict=True)]

    def probes(self, x: np.ndarray, need: int, counts: np.ndarray) -> list[np.ndarray]:
        """The lists of each query within the distance ratio, and more of the nearest while they hold fewer than ``need`` vectors."""
        d = self.search(self.lifted(x, query=True), self.ratio)
        out = []
        for row in d:
            order = np.argsort(row, kind="stable")
            n = int((row[order] <= self.ratio * row[order[0]] + 1e-12).sum())
            if counts[order[:n]].sum() < need:  # reached lists are too few: the others follow by distance
                n = int(np.searchsorted(np.cumsum(counts[order]), need)) + 1
            out.append(order[:n])
        return out


def _matrix(values) -> np.ndarray:
    return np.stack(list(values)).astype(np.float64)


def fit_index(sample: np.ndarray, rows: int, top: float, cfg: AnnConfig) -> Index:
    """Centroids, graph and distance ratio from a sample of a table of ``rows`` vectors.

    Centroids are means of equal halves of equal halves, and lists that come out too long or too short by the nearest centroid are
    halved or dropped, until they are balanced.
    """
    index = Index(np.zeros((1, 1)), np.zeros((1, 1), int), top)
    x = index.lifted(sample)
    wanted = int(np.clip(-(-rows // cfg.list_rows), 1, min(cfg.max_lists, max(1, len(x) // 8))))
    index.centroids = rebalanced(x, balanced_centroids(x, wanted, cfg.seed), cfg.seed)
    m = len(index.centroids)
    square = (index.centroids**2).sum(axis=1)
    apart = square[:, None] + square[None] - 2 * index.centroids @ index.centroids.T
    np.fill_diagonal(apart, np.inf)
    nearest = np.argsort(apart, axis=1, kind="stable")[:, : min(cfg.degree, max(m - 1, 1))]
    ring = (np.arange(m) + 1) % m  # keeps the graph in one piece
    index.edges = np.concatenate([nearest, ring[:, None]], axis=1)
    if m == 1:
        return index
    held = index.lists(sample, cfg.boundary, cfg.replicas)
    rng = np.random.default_rng(cfg.seed + 1)
    asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(cfg.k, len(sample) - 1)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    q = index.lifted(sample[asked], query=True)
    d = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + square[None] - 2 * q @ index.centroids.T, 1e-18))
    least = d.min(axis=1)
    needed = [d[i, held[j]].min() / least[i] for i in range(len(asked)) for j in best[i]]
    index.ratio = float(np.quantile(needed, cfg.recall)) * (1 + 1e-9)
    return index


def _postings(index: Index, cfg: AnnConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                b = batch.slice(a, 2048)
                lists = index.lists(_matrix(b.column("vector").to_numpy(zero_copy_only=False)), cfg.boundary, cfg.replicas)
                yield pa.record_batch([b.column("id"), b.column("vector"), pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))], names=["id", "vector", "lists"])

    return run


def _probes(index: Index, cfg: AnnConfig, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                b = batch.slice(a, 1024)
                lists = index.probes(_matrix(b.column("vector").to_numpy(zero_copy_only=False)), cfg.k + 1, counts)
                yield pa.record_batch([b.column("id"), b.column("vector"), pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))], names=["id", "vector", "lists"])

    return run


_HIT = "query_id long, vec_id long, score double"


def _best_in_cell(k: int):
    def run(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(stored) and len(asked):
            ids, x, held = stored["id"].to_numpy(), _matrix(stored["vector"]), stored["mask"].to_numpy()
            queries, q, probed = asked["id"].to_numpy(), _matrix(asked["vector"]), asked["mask"].to_numpy()
            for a in range(0, len(q), 64):
                rough = q[a : a + 64] @ x.T
                rough[(probed[a : a + 64, None] & held[None]) == 0] = -np.inf
                rough[queries[a : a + 64, None] == ids[None]] = -np.inf
                # The rough product may differ in its last digits by the order of its sums.
                least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(rough), -np.inf)
                least = np.where(np.isfinite(least), least - 1e-9 * np.maximum(1.0, np.abs(least)), -np.inf)
                for i, row in enumerate(rough):
                    here = np.flatnonzero((row >= least[i]) & np.isfinite(row))
                    score = (x[here] * q[a + i]).sum(axis=1)
                    order = np.lexsort((ids[here], -score))
                    # Rows that repeat an id are one answer; its nearest row comes first.
                    _, first = np.unique(ids[here[order]], return_index=True)
                    best = order[np.sort(first)[:k]]
                    found.append((np.full(len(best), queries[a + i]), ids[here[best]], score[best]))
        column = lambda i, kind: np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind)
        return pd.DataFrame({"query_id": column(0, "int64"), "vec_id": column(1, "int64"), "score": column(2, "float64")})

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, config: AnnConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found for each query, by inner product in double precision.

    Vectors go to the list of their nearest centroid and, near a boundary, to others too.  A query walks the
    centroid graph and takes the lists within a distance ratio, which is set on the sample for the recall wanted; what it
    meets there is scored exactly.  Neighbouring lists are searched together; long ones are split into
    shards, and many queries of a list into blocks, so no task holds an unbounded group.

    A query's own id is never its answer.  Ties go to the smaller id; rows that repeat an id are one answer, scored by the nearest.
    Null ids, and vectors that are null, zero or hold null or non-finite components, take no part, nor do
    those whose length isn't the commonest (the smaller of two as common).  With fewer candidates than k,
    all that the lists hold are returned, and lists are added until they hold k.  Empty tables give an empty result.
    """
    cfg = config or AnnConfig()
    since = mark(vectors.sparkSession)
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & takes_part(F.col("vector")))
    rows, asked = usable(vectors), usable(queries)
    spark = vectors.sparkSession
    dims = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(squared_norm(F.col("vector"))).alias("top")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fits = F.size("vector") == dims["d"]
    rows, asked = rows.where(fits), asked.where(fits)
    taken = rows.orderBy(F.xxhash64(F.lit(cfg.seed), "id"), "id").limit(cfg.sample).select("vector").toPandas()
    index = fit_index(_matrix(taken["vector"]), dims["n"], dims["top"], cfg)
    stored = written(rows.mapInArrow(_postings(index, cfg), "id long, vector array<double>, lists array<int>"), "postings")
    sizes = {r[0]: r[1] for r in stored.groupBy(F.col("lists")[0].alias("l")).count().collect()}
    counts = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])
    # A cell is a group of neighbouring lists; a mask tells which of them a vector is in, or a query probes.
    cell_of = lambda x: F.floor(x / cfg.group).cast("int")
    mask = F.aggregate(F.filter("lists", lambda x: cell_of(x) == F.col("cell")), F.lit(0).cast("long"), lambda s, x: s + F.pow(F.lit(2.0), x % cfg.group).cast("long"))
    celled = lambda df: df.withColumn("cell", F.explode(F.array_distinct(F.transform("lists", cell_of)))).withColumn("mask", mask).drop("lists")
    probed = written(asked.mapInArrow(_probes(index, cfg, counts), "id long, vector array<double>, lists array<int>"), "probes")
    stored, probed = celled(stored), celled(probed)
    # Both sides' numbers by cell are bounded by the number of lists, so they travel as literals.
    held = {r[0]: -(-r[1] // cfg.shard_rows) for r in stored.groupBy("cell").count().collect()}
    askers = {r[0]: -(-r[1] // cfg.query_rows) for r in probed.groupBy("cell").count().collect()}
    number = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("cell")) if table else F.lit(1)
    stored = stored.where(F.col("cell").isin(list(askers))).withColumn("shard", F.pmod(F.xxhash64("id"), number(held)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), number(askers) - 1)))
    probed = probed.where(F.col("cell").isin(list(held))).withColumn("part", F.pmod(F.xxhash64("id"), number(askers)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), number(held) - 1)))
    key = ["cell", "shard", "part"]
    hits = stored.groupBy(*key).cogroup(probed.groupBy(*key)).applyInPandas(_best_in_cell(cfg.k), _HIT)
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return trimmed(hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score"), since)
