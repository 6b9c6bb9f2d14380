"""Line dedup: winnowed line fingerprints, joined positions, compared windows of lines, later runs deleted."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .cluster import BROADCAST_IDS, free, mark, trimmed, written


#: Line numbers that are broadcast at most, after they have been counted.
BROADCAST_RANGES = 2_000_000


@dataclass(frozen=True)
class LineDedupConfig:
    """A run of lines counts as repeated from ``min_words`` words on.

    With ``whole_runs`` each repeated run goes as a whole, from its first to its last equal line; without, only those of
    its lines go that are in a window from a line with words to the first line by which it has ``min_words``.
    """

    min_words: int = 50
    whole_runs: bool = True


def _range_minimum(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the smallest value in each inclusive range, the rightmost of equal ones."""
    levels = [np.arange(len(value))]
    longest = int((hi - lo).max()) + 1 if len(lo) else 1
    while 2 << (len(levels) - 1) <= longest:
        half = 1 << (len(levels) - 1)
        a, b = levels[-1][:-half], levels[-1][half:]
        levels.append(np.where(value[b] <= value[a], b, a))
    out = np.empty(len(lo), np.int64)
    depth = np.floor(np.log2(hi - lo + 1)).astype(int)
    for d in np.unique(depth):
        x = depth == d
        a, b = levels[d][lo[x]], levels[d][hi[x] - (1 << d) + 1]
        out[x] = np.where(value[b] <= value[a], b, a)
    return out


def windows_of(data: np.ndarray, offs: np.ndarray, min_words: int, whole_runs: bool = False) -> tuple[np.ndarray, ...]:
    """Row, first line, last line, content hash and fingerprint (line number and hash) of each window.

    A window starts at a line with words and ends with the first line by which it has ``min_words`` words.
    What it holds depends on its content alone, and so does the fingerprint, the smallest hash of its lines.
    For ``whole_runs`` windows start at blank lines too, and each line also ends one, the shortest with
    ``min_words`` words.  Every line of a run of so many words is then in a window within the run: one from the
    run's first line if there are fewer words up to it, and the one that it ends if there are not.
    """
    s, e, row = K.line_spans(data, offs)
    if not len(s):
        return (np.zeros(0, np.int64),) * 6
    h = K.hash_spans(data, s, e, False, 7)
    ws, _, _ = K.spans(data, offs, K.NOT_SPACE)
    words = np.searchsorted(ws, e) - np.searchsorted(ws, s)
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.arange(len(s)) if whole_runs else np.flatnonzero(words > 0)
    last = np.searchsorted(total[1:], total[first] + min_words)
    ok = last < len(s)
    first, last = first[ok], last[ok]
    ok = row[first] == row[last]
    first, last = first[ok], last[ok]
    if whole_runs:
        start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
        end = np.flatnonzero(start >= 0)
        end = end[row[start[end]] == row[end]]
        both = np.unique(np.concatenate([first * len(s) + last, start[end] * len(s) + end]))
        first, last = both // len(s), both % len(s)
    with np.errstate(over="ignore"):
        base = 0x5851F42D4C957F2D
        power, back = np.full(len(s) + 1, K.U64(base)), np.full(len(s) + 1, K.U64(pow(base, -1, 2**64)))
        power[0] = back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        run = np.concatenate([[K.U64(0)], np.cumsum(h * power[:-1], dtype=K.U64)])
        content = K.mix((run[last + 1] - run[first]) * back[first] ^ (last - first + 1).astype(K.U64) * K._GOLD)
    rank = np.where(words > 0, h, K.U64(2**64 - 1))
    at = _range_minimum(rank, first, last)
    if whole_runs:
        order = np.argsort(at, kind="stable")
        first, last, content, at = first[order], last[order], content[order], at[order]
    begin = np.searchsorted(row, row[first])
    return row[first], first - begin, last - begin, content, at - begin, h[at]


def _fingerprints(cfg: LineDedupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.slices(batch, "text"):
                row, first, last, content, at, print_ = windows_of(*K.flat(b.column("text")), cfg.min_words, cfg.whole_runs)
                ids = b.column("id").to_numpy(zero_copy_only=False)
                head = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])]) if len(row) else np.zeros(0, bool)
                cut = pa.array(np.concatenate([np.flatnonzero(head), [len(row)]]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x, kind)) for x, kind in ((first, pa.int32()), (last, pa.int32()), (content.view(np.int64), pa.int64()))]
                yield pa.record_batch([pa.array(ids[row[head]], pa.int64()), pa.array(at[head], pa.int32()), pa.array(print_[head].view(np.int64), pa.int64()), *lists], names=["id", "line", "print", "first", "last", "content"])

    return run


def _without_lines(texts: pd.Series, ranges: pd.Series) -> pd.Series:
    out = []
    for text, cut in zip(texts, ranges, strict=True):
        if text is None or cut is None:
            out.append(None)
            continue
        lines = text.split("\n")
        keep = np.ones(len(lines), bool)
        for a, b in zip(cut[::2], cut[1::2], strict=True):
            keep[a : b + 1] = False
        out.append("\n".join(line for line, k in zip(lines, keep, strict=True) if k))
    return pd.Series(out, dtype=object)


def repeated_runs(docs: DataFrame, config: LineDedupConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ranges, n_removed``: the line numbers from 0, as first, last, first, last ..., that ``dedup_lines`` deletes.

    Documents without repeated runs, or with a null id, are not in the result.
    """
    cfg = config or LineDedupConfig()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    prints = written(rows.mapInArrow(_fingerprints(cfg), "id long, line int, print long, first array<int>, last array<int>, content array<long>"), "prints")
    shared = written(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "shared-prints")
    live = prints.join(shared, "print", "left_semi").select("id", F.explode(F.arrays_zip("content", "first", "last")).alias("w")).select("id", "w.*")
    live = written(live, "windows")
    earliest = live.groupBy("content").agg(F.min(F.struct("id", "first")).alias("origin"), F.max(F.struct("id", "first")).alias("end")).where("origin <> end").select("content", "origin")
    later = live.join(written(earliest, "origins"), "content").where(F.struct("id", "first") != F.col("origin"))
    # Windows that overlap or touch extend each other, both ways, to the whole run.
    order = Window.partitionBy("id").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("first") <= reach + 1, 0).otherwise(1)
    marked = later.select("id", "first", "last", begins.alias("begins"))
    runs = marked.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("id", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    merged = runs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum(F.col("last") - F.col("first") + 1).cast("int").alias("n_removed"))
    return merged.select("id", F.flatten(F.transform("runs", lambda r: F.array(r["first"], r["last"]))).alias("ranges"), "n_removed")


def dedup_lines(docs: DataFrame, config: LineDedupConfig | None = None, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str] = ("n_removed", "removed")) -> DataFrame:
    """The documents without later repeats of line runs: their columns, the text shortened, and as the ``added`` ones the number of removed lines and their ranges.

    Lines are what LF separates, compared as they are.  From every line with words, a window takes lines
    until it has ``min_words`` words; the smallest line hash of a window is its fingerprint, so any
    run of that many words that stands in two places has a fingerprint in common.  Positions of shared fingerprints
    are joined, and the windows there are compared by all their lines.  Matches extend both ways through the windows that overlap
    them, so that no two positions are ever paired: the first occurrence by (id, line) stays, and every line goes that is
    in a run of ``min_words`` words or more that also stands earlier, within a document too.  Repeats of fewer words stay.
    Without ``whole_runs``, the lines after a run's last full window stay.

    A null or empty text, and a row with a null id, pass unchanged and match nothing.  Rows that repeat an
    id count as one place, so neither deletes the other.  A text all of whose lines go becomes empty.
    An empty table gives an empty result; columns named as the ``added`` ones are replaced, others may have any name.
    """
    since = mark(docs.sparkSession)
    rest = docs.drop(*added)
    key, cut, gone, short = free([*rest.columns, *added], "_id", "_ranges", "_gone", "_short")
    found = written(repeated_runs(docs, config, id_col, text_col), "runs").select(F.col("id").alias(key), F.col("ranges").alias(cut), F.col("n_removed").alias(gone))
    if found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS and (found.agg(F.sum(F.size(cut))).first()[0] or 0) <= BROADCAST_RANGES:
        found = F.broadcast(found)
    joined = rest.join(found, F.col(id_col).cast("long") == F.col(key), "left")
    shorter = F.pandas_udf(_without_lines, "string")(F.when(F.col(cut).isNotNull(), F.col(text_col)), F.col(cut))
    plain = [F.coalesce(short, text_col).alias(text_col) if c == text_col else F.col(c) for c in rest.columns]
    told = [F.coalesce(gone, F.lit(0)).cast("long").alias(added[0]), F.coalesce(cut, F.expr("cast(array() as array<int>)")).alias(added[1])]
    return trimmed(joined.withColumn(short, shorter).select(*plain, *told), since)
