"""Vectorised text primitives over Arrow string columns.

Texts are handled as flat UTF-8 byte arrays, so splitting and hashing words or
lines costs a few numpy passes and no Python object per word.  All separators
used here are ASCII, hence byte-level splitting equals code-point splitting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed at once; bounds the working set of a task whatever the text length.
BLOCK = 1 << 19
#: Bytes of text of one slice of a batch.
SLICE_BYTES = 1 << 20

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~_WS
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Line bytes: everything but LF.
NOT_LF = np.ones(256, dtype=bool)
NOT_LF[0x0A] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that looks random."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _M1
        x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value per byte, and powers of an odd base and of its inverse modulo 2**64."""
    base = (int(mix(np.array([seed], dtype=U64))[0]) | 1) & (2**64 - 1)
    inverse = pow(base, -1, 2**64)
    with np.errstate(over="ignore"):
        byte = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        power = np.empty(BLOCK, dtype=U64)
        back = np.empty(BLOCK, dtype=U64)
        power[0] = back[0] = 1
        power[1:], back[1:] = U64(base), U64(inverse)
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
    return byte, power, back


_CACHE: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64)[at : at + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes, and their row; a run ends with its row."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    mask = inside[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    begin = offs[:-1][offs[:-1] < offs[1:]]
    end = offs[1:][offs[:-1] < offs[1:]] - 1
    first[begin] = mask[begin]
    last[end] = mask[end]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the LF-separated lines, empty ones too, and their row; an empty text has none."""
    lf = np.flatnonzero(data == 0x0A)
    full = offs[:-1] < offs[1:]
    per = np.diff(np.searchsorted(lf, offs)) + full
    total = int(per.sum())
    last = np.cumsum(per)
    head, tail = np.zeros(total, bool), np.zeros(total, bool)
    head[(last - per)[full]] = True
    tail[last[full] - 1] = True
    s, e = np.empty(total, np.int64), np.empty(total, np.int64)
    s[head], s[~head] = offs[:-1][full], lf + 1
    e[tail], e[~tail] = offs[1:][full], lf
    return s, e, np.repeat(np.arange(len(per)), per)


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool, seed: int) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it stands; ``fold`` lower-cases A-Z.

    Spans are given in order and don't overlap.  Each byte adds a random value times a power of
    an odd base, so a span's hash is a difference of running sums times the inverse power.
    """
    if seed not in _CACHE:
        _CACHE[seed] = _tables(seed)
    byte, power, back = _CACHE[seed]
    byte = byte[LOWER] if fold else byte
    out = np.zeros(len(s), dtype=U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(s):
            j = int(np.searchsorted(e, s[i] + BLOCK, side="right"))
            if j <= i:  # one span longer than a block
                at, scale = int(s[i]), U64(1)
                total = U64(0)
                while at < e[i]:
                    part = byte[data[at : min(at + BLOCK, int(e[i]))]]
                    total = total + (part * power[: len(part)]).sum(dtype=U64) * scale
                    scale = scale * power[-1] * power[1]
                    at += BLOCK
                out[i] = total
                i += 1
                continue
            lo, hi = int(s[i]), int(e[j - 1])
            run = np.zeros(hi - lo + 1, dtype=U64)
            np.cumsum(byte[data[lo:hi]] * power[: hi - lo], out=run[1:])
            a = s[i:j] - lo
            out[i:j] = (run[e[i:j] - lo] - run[a]) * back[np.minimum(a, BLOCK - 1)]
            i = j
        return mix(out ^ ((e - s).astype(U64) * _GOLD))


def word_hashes(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = NOT_SPACE, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the offsets of each row's words."""
    look = inside.copy()
    look[0x41:0x5B] = inside[0x61:0x7B]
    s, e, _ = spans(data, offs, look)
    return hash_spans(data, s, e, True, seed), np.searchsorted(s, offs).astype(np.int64)


def hash_words(texts: list[str], inside: np.ndarray = NOT_SPACE, seed: int = 1) -> list[np.ndarray]:
    """``word_hashes`` of a few texts, an array for each."""
    data, offs = flat(pa.array(texts, pa.string()))
    h, at = word_hashes(data, offs, inside, seed)
    return [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes of one length, order kept."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), U64(len(parts)) * _GOLD, dtype=U64)
        for p in parts:
            out = mix(out * U64(3) + p + _GOLD)
    return out


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row and their offsets; a row of fewer words has its whole sequence as one."""
    n = len(at) - 1
    count = np.diff(at)
    if len(words) >= k:
        grams = combine([words[i : len(words) - k + 1 + i] for i in range(k)])
    else:
        grams = np.zeros(0, U64)
    out, sizes = [], np.zeros(n, np.int64)
    for r in range(n):
        if count[r] >= k:
            x = np.unique(grams[at[r] : at[r + 1] - k + 1])
        elif count[r]:
            x = combine([words[i : i + 1] for i in range(at[r], at[r + 1])])
        else:
            continue
        out.append(x)
        sizes[r] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a bounded number of text bytes, a row at least in each."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // SLICE_BYTES
    cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(a, b - a)
