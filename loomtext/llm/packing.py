"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K


@dataclass(frozen=True)
class PackConfig:
    """Sequences of at most ``window`` tokens.  What is left of a document after its full windows is cut
    into pieces of at most ``piece`` tokens; ``windows`` of them are filled at once.  ``slack`` tokens a window
    stay free when a group of pieces is closed, so that near-equal windows fit."""

    vocabulary: str = ""
    merges: str = ""
    window: int = 1024
    piece: int = 224
    windows: int = 32
    slack: int = 2
    end_id: int = 0


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` groups of item numbers with near-equal sums.

    Every item starts as a partial partition of its own.  The two partials of the largest imbalance are
    merged again and again, the largest group of one with the smallest of the other, until one is left.
    """
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [0] * (k - 1) + [s], [[] for _ in range(k - 1)] + [[i]]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, s1, g1 = heapq.heappop(heap)
        _, _, s2, g2 = heapq.heappop(heap)
        merged = sorted(((a + b, n) for n, (a, b) in enumerate(zip(s1, reversed(s2), strict=True))))
        sums = [s for s, _ in merged]
        groups = [g1[n] + g2[k - 1 - n] for _, n in merged]
        heapq.heappush(heap, (sums[0] - sums[-1], tick, sums, groups))
        tick += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


def balanced_windows(sizes: list[int], window: int) -> list[list[int]]:
    """Near-equal groups of which none holds more than ``window``; their number rises until that holds."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        groups = karmarkar_karp(sizes, k)
        if all(sum(sizes[i] for i in g) <= window for g in groups):
            return [g for g in groups if g]
        k += 1


#: Texts beyond these characters, or with the special token's name, are tokenised by the tokenizers library itself;
#: on the rest, both libraries cut the text alike, and the second is several times as fast.
_PLAIN = re.compile("[\\t\\n\\r -~¡-¬®-ɏ]*")
_SPECIAL = "<|endoftext|>"


class _Encoder:
    """Token ids of the vocabulary file, from two libraries that agree on them."""

    def __init__(self, cfg: PackConfig) -> None:
        import public_tokenizers as P
        import tiktoken

        self.path = cfg.vocabulary or P.path("byte_bpe_50k.json")
        with open(cfg.merges or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = None

    def __call__(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and _SPECIAL not in text:
            return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


_ENCODERS: dict[PackConfig, _Encoder] = {}
_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Packer:
    """Collects pieces and closes a group of windows whenever enough tokens have come."""

    def __init__(self, cfg: PackConfig, base: int) -> None:
        self.cfg, self.next, self.waiting, self.tokens = cfg, base, [], 0
        self.goal = cfg.windows * (cfg.window - cfg.slack)

    def place(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for doc, start, total, ids in pieces:
            out.append((doc, start, len(ids), total, self.next, at, ids.tobytes()))
            at += len(ids)
        self.next += 1
        return out

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        out, w, n = [], self.cfg.window, len(ids)
        full = n - n % w
        for a in range(0, full, w):
            out += self.place([(doc, a, n, ids[a : a + w])])
        at = full
        while at < n:
            size = min(self.cfg.piece, n - at, self.goal - self.tokens)
            self.waiting.append((doc, at, n, ids[at : at + size]))
            self.tokens += size
            at += size
            if self.tokens >= self.goal:
                out += self.close()
        return out

    def close(self) -> list[tuple]:
        out = []
        if self.waiting:
            for group in balanced_windows([len(p[3]) for p in self.waiting], self.cfg.window):
                out += self.place([self.waiting[i] for i in sorted(group)])
        self.waiting, self.tokens = [], 0
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def _pack(cfg: PackConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cfg not in _ENCODERS:
            _ENCODERS[cfg] = _Encoder(cfg)
        encode = _ENCODERS[cfg]
        packer = _Packer(cfg, TaskContext.get().partitionId() << 36)
        end = np.array([cfg.end_id], dtype="<u4")
        for batch in batches:
            for b in K.slices(batch, "text"):
                rows = []
                for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    rows += packer.add(doc, np.concatenate([encode(text or ""), end]))
                yield _batch(rows)
        yield _batch(packer.close())

    return run


def pack(docs: DataFrame, config: PackConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences: id, start, length, ``doc_tokens``, ``sequence_id``, offset and the ids (little-endian unsigned 32-bit).

    Each input partition packs its own documents as they stream by, without a shuffle: full windows of a
    long document stand alone, the rest is cut and dealt out by Karmarkar-Karp differencing in
    groups of about ``windows`` windows, and the number of windows rises whenever one would exceed
    its capacity.  A sequence's number holds its partition's number in the high bits, so a task that runs
    again gives the same sequences.

    A null or empty text is the end id alone.  A null id stays null.  Repeated rows are packed as often
    as they come.  An empty table gives no pieces; other columns are ignored.
    """
    cfg = config or PackConfig()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pack(cfg), _PIECE).withColumnRenamed("doc_id", id_col)
