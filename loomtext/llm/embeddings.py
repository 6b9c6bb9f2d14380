"""Embedding near-dedup: int8 tile products with per-vector error bounds, full precision only for pairs in doubt."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import mark, trimmed, written
from .components import components


@dataclass(frozen=True)
class EmbeddingConfig:
    """Pairs of one label with a cosine of ``threshold`` or more are linked; a tile is ``block`` by ``block`` vectors."""

    threshold: float = 0.93
    block: int = 2048


#: Components whose int8 products add up below 2**24, so that 32-bit floats hold each such sum exactly.
_EXACT = 2**24 // 127**2


def squared_norm(vector: Column) -> Column:
    """In double precision; null if the vector or a component is null."""
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def takes_part(vector: Column) -> Column:
    """Neither null nor zero, and all components finite (a NaN compares above every number)."""
    n = squared_norm(vector)
    return F.coalesce((n > 0) & (n < float("inf")), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 components of the unit vectors, the scale of each, and the length of its quantisation error."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def integer_products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The exact integer inner products of int8 rows: floats hold the sums of short enough runs of components, which doubles add up."""
    out = None
    for i in range(0, max(q.shape[1], 1), _EXACT):
        part = q[:, i : i + _EXACT].astype(np.float32) @ r[:, i : i + _EXACT].astype(np.float32).T
        out = part.astype(np.float64) if out is None else out + part
    return out


def cosine_bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosines of rows given as int8 components, scale and length of the quantisation error.

    With u = q + e and v = r + f, u.v = q.r + q.f + e.r + e.f, and the last three are at most |q||f| + |e||r| + |e||f|.
    Doubles round each of the d products and sums by 2**-53 of it at most, which widens the bounds by the dimension.
    """
    (q, s, e), (r, t, f) = a, b
    dot = lambda x: np.einsum("ij,ij->i", x, x, dtype=np.float64)
    middle = integer_products(q, r) * s[:, None] * t[None]
    width = np.multiply.outer(np.sqrt(dot(q)) * s, f) + np.multiply.outer(e, np.sqrt(dot(r)) * t + f)
    width += (q.shape[1] + 16) * 2.0**-50
    return middle - width, middle + width


def tile_links(a: np.ndarray, b: np.ndarray, qa: tuple, qb: tuple, threshold: float, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For runs of rows of ``a``: the first row, and a matrix that tells which rows of ``b`` they are linked with."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for i in range(0, len(a), 512):
        low, high = cosine_bounds(tuple(x[i : i + 512] for x in qa), qb)
        links = low >= threshold
        r, c = np.nonzero(~links & (high >= threshold))
        for k in range(0, len(r), 1 << 15):
            x, y = r[k : k + (1 << 15)], c[k : k + (1 << 15)]
            exact = np.einsum("ij,ij->i", a[i + x], b[y]) / (na[i + x] * nb[y])
            links[x, y] = exact >= threshold
        if same:
            n = np.arange(len(links))
            links[n, i + n] = False
        yield i, links


def _forest(linked: Iterator[tuple[int, int, np.ndarray]], n: int) -> np.ndarray:
    """Smallest member of each node's component, from rows (node, offset of the columns, linked columns)."""
    of = np.arange(n)
    for node, shift, columns in linked:
        seen = np.unique(np.append(of[columns + shift], of[node]))
        if len(seen) > 1:
            of[np.isin(of, seen[1:])] = seen[0]
    return of


def _tile(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("block", "ascending"), ("id", "ascending")])
        block = rows.column("block").to_numpy()
        ids, weight = rows.column("id").to_numpy(), rows.column("copies").to_numpy().astype(np.float64)
        x = _matrix(rows.column("vector"))
        q, scale, error = np.frombuffer(b"".join(rows.column("q").to_pylist()), np.int8).reshape(len(x), -1), rows.column("scale").to_numpy(), rows.column("error").to_numpy()
        t1, t2 = rows.column("t1")[0].as_py(), rows.column("t2")[0].as_py()
        split = int(np.searchsorted(block, t1, side="right"))
        same = t1 == t2
        lo = slice(0, split)
        hi = lo if same else slice(split, len(x))
        shift = 0 if same else split
        counts = np.zeros(len(x))
        pairs: list[tuple[int, int, np.ndarray]] = []
        part = lambda s: (q[s], scale[s], error[s])
        for i, links in tile_links(x[lo], x[hi], part(lo), part(hi), threshold, same):
            counts[i : i + len(links)] += links @ weight[hi]
            if not same:
                counts[hi] += weight[i : i + len(links)] @ links
            pairs += [(i + r, shift, np.flatnonzero(links[r])) for r in np.flatnonzero(links.any(axis=1))]
        root = _forest(iter(pairs), len(x))
        some, far = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(x)))
        ids_of = lambda i: pa.array(ids[i], pa.int64())
        return pa.table({
            "a": pa.concat_arrays([ids_of(some), ids_of(far)]),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), ids_of(root[far])]),
            "n": pa.concat_arrays([pa.array(counts[some].astype(np.int64)), pa.nulls(len(far), pa.int64())]),
        })

    return run


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows == 0:
            continue
        column, lengths = b.column("vector"), b.column("dim").to_numpy()
        q, scale, error = [b""] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            qs, scale[at], error[at] = quantise(_matrix(pa.chunked_array([column.take(pa.array(at))])))
            for i, row in zip(at, qs, strict=True):
                q[i] = row.tobytes()
        extra = {"q": pa.array(q, pa.binary()), "scale": pa.array(scale), "error": pa.array(error * (1 + 1e-9) + 1e-12)}
        yield pa.record_batch([*b.columns, *extra.values()], names=[*b.schema.names, *extra])


def embedding_near_duplicates(vectors: DataFrame, config: EmbeddingConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable) and ``kept``.

    Equal vectors of a label are one class with a number of copies.  Classes of a label are dealt by hash into
    blocks, and every two blocks meet in a tile: int8 products, summed as integers, bound each cosine from both sides, by each vector's own
    quantisation error and the dimension.  Pairs surely above or below the threshold are settled by that; only the others are
    recomputed in double precision.  A tile gives counts and a spanning forest, never its pairs.

    Vectors that are null, zero, or hold a null or non-finite component, and rows with a null label or id, link
    with nothing, nor do vectors of different lengths.  Rows that share an id are one node, each counted.
    A null id has a null component and is kept.  An empty table gives an empty result; other columns are ignored.
    """
    cfg = config or EmbeddingConfig()
    since = mark(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    ready = takes_part(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("ready", ready).withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64(F.lit(29), "vector", "label"))
    good = rows.where("ready")
    classes = good.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("dim", F.size("vector")), "classes")
    sizes = written(classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / cfg.block).cast("int").alias("blocks")), "label-sizes")
    tiles = int(sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0)
    dealt = classes.select("id", "copies", "label", "dim", "vector").join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    columns = ["id", "copies", "label", "dim", "vector", "block", "blocks"]
    dealt = dealt.select(*columns).mapInArrow(_quantised, dealt.select(*columns).withColumn("q", F.lit(b"")).withColumn("scale", F.lit(0.0)).withColumn("error", F.lit(0.0)).schema)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("t1", F.least("block", "other")).withColumn("t2", F.greatest("block", "other")).drop("other", "blocks")
    dealt = dealt.repartition(max(1, min(tiles, 20_000)), "label", "dim", "t1", "t2")
    found = written(dealt.groupBy("label", "dim", "t1", "t2").applyInArrow(_tile(cfg.threshold), "a long, b long, n long"), "tiles")
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = written(good.select("id", "h1", "h2").join(classes.select("h1", "h2", F.col("id").alias("node"), "copies"), ["h1", "h2"]).select("id", "node", "copies"), "members")
    repeated = named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    linked = components(found.where("b is not null").select("a", "b").union(named.join(repeated, "id", "left_semi").select("id", "node")))
    good_rows = named.join(written(counts, "counts"), "node", "left").join(linked, "node", "left")
    good_rows = good_rows.select("id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    rest = rows.where("not ready").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    apart = written(rest.join(named.select("id").distinct(), "id", "left_anti"), "apart")
    # An invalid row may share its id with a valid one, and then belongs to that one's component.
    shared = rest.join(named.select("id", "node").groupBy("id").agg(F.min("node").alias("node")), "id").join(linked, "node", "left").select("id", "n_links", F.coalesce("component", "node").alias("component_id"))
    full = good_rows.unionByName(apart).unionByName(shared)
    return trimmed(full.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")), since)
