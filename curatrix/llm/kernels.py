"""Vectorised text kernels over Arrow batches: words, word hashes and n-gram hashes of many documents at once.

Everything works on the UTF-8 bytes that Arrow already holds, so no Python object is made for a word. Separators are
ASCII, so cutting bytes equals cutting code points. Documents are taken in chunks of bounded bytes; a longer document
forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_MUL = U(0x9E3779B97F4A7C15)
_BASE, _INVERSE = U(0xD6E8FEB86659FD93), U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers strictly between 0 and 1."""
    return ((x >> U(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, '' for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with at most `limit` bytes of text, or one row."""
    for batch in batches:
        buf, offs = utf8(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each document the index of its first word (one more at the end)."""
    n = len(buf)
    ink = np.zeros(n + 2, bool)
    ink[1 : n + 1] = ~SEPARATOR[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    begin = ink[1 : n + 1] & (~ink[:n] | cut[:n])
    end = ink[1 : n + 1] & (~ink[2:] | cut[1:])
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", _INVERSE)):
                    x = np.full(size, base, np.uint64)
                    x[0] = 1
                    setattr(cls, name, np.multiply.accumulate(x))
        return cls.up, cls.down


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever it stands; in blocks of whole words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _Powers.get(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[buf[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _MUL)
        i = j
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each word; the last k - 1 places are left out."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        out = out * U(0xC2B2AE3D27D4EB4F) + hashes[j : n + j]
    return mix(out)


def owners(first: np.ndarray, n: int | None = None) -> np.ndarray:
    """The document of each word, from the index of each document's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def within(first: np.ndarray, k: int) -> np.ndarray:
    """Places at which k words of one document start."""
    n = int(first[-1])
    ok = np.zeros(n + 1, bool)
    last = np.maximum(first[1:] - k + 1, first[:-1])
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first[:-1], 1)
    np.add.at(step, last, -1)
    ok = np.cumsum(step)[: max(0, n - k + 1)] > 0
    return np.flatnonzero(ok)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + l] for each (s, l), one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    where = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
    return values[where]
