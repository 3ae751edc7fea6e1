"""Vectorised words, shingles and MinHash over Arrow string arrays.

A word is a run of bytes 0-9, a-z or non-ASCII after lower-casing A-Z, i.e. the
pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; working on UTF-8 bytes gives the
same words as working on code points.  Everything is computed per Arrow batch,
cut into pieces of bounded size, so memory does not grow with a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Workers outlive a stage: what a batch took goes back to the system, not to Arrow's own cache.
pa.set_memory_pool(pa.system_memory_pool())

_u64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _u64(2) + _u64(1)
_POW = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = _WORD[128:] = True

#: Bytes of text that are worked on at once.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift rounds)."""
    x = x ^ (x >> _u64(30))
    x = x * _u64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _u64(27))
    x = x * _u64(0x94D049BB133111EB)
    return x ^ (x >> _u64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    big = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a run of documents.  ``first[d]:first[d+1]`` are those of document d."""

    data: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    begins[at] = inside[at]
    start = np.flatnonzero(begins)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(data, np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64))
    letters = np.flatnonzero(inside)
    at = np.searchsorted(letters, start)
    size = np.diff(np.append(at, len(letters)))
    rel = np.arange(len(letters)) - np.repeat(at, size)
    terms = _BYTE[_LOWER[data[letters]]] * _POW[rel & 0xFFFF]
    if size.max() > 1 << 16:  # every further 65,536 bytes of a word have a factor of their own
        far = rel >= 1 << 16
        terms[far] *= mix((rel[far] >> 16).astype(np.uint64)) | _u64(1)
    h = np.add.reduceat(terms, at)
    return Words(data, mix(h + size.astype(np.uint64)), start, start + size, np.searchsorted(start, offsets))


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows of about ``limit`` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    data, offsets = text_bytes(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (across documents too; callers mask those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _u64(0xD6E8FEB86659FD93)
        out += h[i : i + n]
    return mix(out)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document, in order, and their n + 1 offsets.

    A document of fewer than k words, but not none, has all its words as one shingle."""
    n = w.counts
    per = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    first = np.concatenate(([0], np.cumsum(per)))
    out = np.empty(first[-1], np.uint64)
    full = rolling(w.hashes, k)
    if len(full):
        doc = np.repeat(np.arange(len(n)), n)[: len(full)]
        inside = w.first[1:][doc] - np.arange(len(full)) >= k
        is_full = np.repeat(n >= k, per)
        out[is_full] = full[inside]
    for d in np.flatnonzero((n > 0) & (n < k)):
        h = w.hashes[w.first[d] : w.first[d + 1]]
        out[first[d]] = mix(rolling(h, len(h)) + _u64(len(h)))[0]
    return out, first


def minhash(sh: np.ndarray, first: np.ndarray, k: int, chunk: int = 1 << 15) -> np.ndarray:
    """k MinHash values (upper 32 bits of odd multiples) of each document; documents without shingles get zeros."""
    mult = np.random.default_rng(7).integers(1, 2**63, k, dtype=np.uint64) * _u64(2) + _u64(1)
    out = np.zeros((len(first) - 1, k), np.uint32)
    has = np.flatnonzero(np.diff(first) > 0)
    low = 0
    while low < len(has):
        high = max(low + 1, int(np.searchsorted(first[has], first[has[low]] + chunk)))
        part = has[low:high]
        a, b = first[part[0]], first[part[-1] + 1]
        x, at = sh[a:b], first[part] - a
        for i in range(k):
            out[part, i] = np.minimum.reduceat(x * mult[i], at) >> _u64(32)
        low = high
    return out


def unique_sets(sh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's shingles, sorted and without repeats, and their offsets."""
    out, size = [], [0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        x = np.sort(sh[a:b])
        if len(x) > 1:
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        out.append(x)
        size.append(len(x))
    return np.concatenate(out) if out else sh[:0], np.cumsum(size)
