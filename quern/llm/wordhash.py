"""Words of whole Arrow batches as 64-bit hashes, computed over the batch's bytes with numpy.

A word is ``[^\\x20\\x09-\\x0D]+``. Its hash adds up a fixed random number for each byte and place in the word (simple
tabulation), so equal words have equal hashes in every process, and others differ but for chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_PLACES = 64
#: Bytes of text that are hashed at a time.
_BYTES = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RANDOM = mixed(mixed(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(batch: pa.RecordBatch, text: int, rows: int = 1024, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few rows and about ``size`` bytes of text; a longer text is a slice of its own."""
    column = batch.column(text)
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray([0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()], dtype=np.int64))
    start, base = 0, 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, base + size, side="right"))
        stop = min(max(stop, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a newline, and the n + 1 offsets of texts."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    ends = offsets - offsets[0]
    return np.insert(raw, ends[1:], 10), ends + np.arange(n + 1)


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (n + 1 of them).

    Texts are hashed about ``_BYTES`` at a time, as a byte takes many times its size here and a word 8 bytes in the result.
    """
    column = column.cast(pa.large_string())
    ends = np.cumsum(pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    words, at, start, n = [], [np.zeros(1, np.int64)], 0, 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _BYTES, side="right")))
        more, of = _hashes(column.slice(start, stop - start), lower)
        words.append(more)
        at.append(n + of[1:])
        start, n = stop, n + len(more)
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.concatenate(at)


def _hashes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    raw, at = text_bytes(column)
    inside = _IN_WORD[raw]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    first = np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    length = np.flatnonzero(edge == -1) - first
    bytes_ = raw[inside]
    if lower:
        bytes_ = _LOWER[bytes_]
    starts = np.r_[0, np.cumsum(length)[:-1]]
    place = np.arange(len(bytes_)) - np.repeat(starts, length)
    part = _RANDOM[(place % _PLACES) * 256 + bytes_]
    if length.max() > _PLACES:
        part = part * (2 * (place // _PLACES) + 1).astype(np.uint64)
    return mixed(np.add.reduceat(part, starts)), np.searchsorted(first, at)


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by start."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * MULTIPLIER + words[j : j + n]
    return mixed(out)
