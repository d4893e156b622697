"""Array kernels over whole batches of texts: words, hashes and shingles without a loop per word.

A batch is one byte array with document offsets. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D; hashes fold A-Z to a-z. All arithmetic wraps modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20  # bytes hashed at a time: bounds the temporary arrays, whatever a text's length
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * _ODD)


def folded_table(seed: int = 1) -> np.ndarray:
    lower = np.arange(256)
    lower[65:91] += 32
    return stream(seed, 256)[lower]


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    if n:
        up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offs[0]: offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; one longer document is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(
    buf: np.ndarray, offs: np.ndarray, gaps: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each document's offsets into them; ``gaps`` flags bytes between words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    gap = gaps[buf]
    before, after = np.empty(len(buf), bool), np.empty(len(buf), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    first, last = offs[:-1], offs[1:] - 1
    full = last >= first
    before[first[full]] = True
    after[last[full]] = True
    starts = np.flatnonzero(~gap & before)
    return starts, np.flatnonzero(~gap & after) + 1, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of each byte span (sorted by start), in slices."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    up, down = powers(2 * SLICE)
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE)))
        base = int(starts[i])
        top = int(ends[i:j].max())
        if top - base + 1 > len(up):
            up, down = powers(top - base + 1)
        part = table[buf[base:top]]
        part *= up[: top - base]
        total = np.zeros(top - base + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(buf, starts, ends, folded_table())


def shingles(hashes: np.ndarray, woffs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words and the documents' offsets into them.

    A document with fewer words has its whole sequence as its one shingle; none if it has no word.
    """
    n_words = np.diff(woffs)
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    offs = np.zeros(len(n_words) + 1, np.int64)
    np.cumsum(count, out=offs[1:])
    out = np.empty(offs[-1], np.uint64)
    q = stream(7, k) | np.uint64(1)
    # position of every shingle's first word
    at = np.arange(offs[-1]) + np.repeat(woffs[:-1] - offs[:-1], count)
    long = np.repeat(n_words >= k, count)
    pos = at[long]
    acc = np.zeros(len(pos), np.uint64)
    for i in range(k):
        acc += hashes[pos + i] * q[i]
    out[long] = mix(acc)
    for size in range(1, k):
        rows = np.flatnonzero(n_words == size)
        if len(rows):
            acc = np.full(len(rows), size, np.uint64) * _ODD
            for i in range(size):
                acc += hashes[woffs[rows] + i] * q[i]
            out[offs[rows]] = mix(acc)
    return out, offs


def distinct(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every document."""
    parts = [np.unique(values[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    out = np.zeros(len(offs), np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else values[:0]), out


def lists(values: np.ndarray, offs: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column out of values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values, kind))
