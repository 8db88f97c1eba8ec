"""Vectorised scanning of whole texts: Arrow string columns as byte arrays, words and hashes without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Spark SQL patterns of a word and of a run of white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in slices of about so many bytes (a longer text is a slice of its own), which bounds memory and stays in cache.
SLICE_BYTES = 1 << 20

_U = np.uint64
_R = 0x9E3779B97F4A7C13  # odd; 1 - _R has one factor of two
_RINV = pow(_R, -1, 1 << 64)
_BYTE = np.random.default_rng(20240601).integers(1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """Powers of the hash base and of its inverse, as far as needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up), 1 << 16)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.r_[_U(1), np.full(n - 1, _R, np.uint64)], dtype=np.uint64)
                cls.down = np.cumprod(np.r_[_U(1), np.full(n - 1, _RINV, np.uint64)], dtype=np.uint64)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(32))
        h = h * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end and each row's offsets in them; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n, at = len(column), column.offset
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, kind)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def trim() -> None:
    """Give memory that is free again back to the system: an idle worker would hold on to it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows into slices of about ``most`` bytes of text."""
    if not batch.num_rows:
        return
    _, offs = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offs, offs[start] + most, "right")) - 1)
        yield batch.slice(start, min(end, batch.num_rows) - start)
        start = end
    trim()


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each document's first word (one more than documents)."""
    word = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(word & np.r_[True, ~word[:-1]][: len(raw)] | word & edge[:-1])
    ends = np.flatnonzero(word & (np.r_[~word[1:], True][: len(raw)] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by differences of one running polynomial sum."""
    up, down = _Powers.of(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``k`` words of each document (a shorter document is one window), and each document's first window."""
    counts = np.diff(firsts)
    windows = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.r_[0, np.cumsum(windows)]
    doc = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(first[-1]) - first[doc] + firsts[doc]
    size = np.minimum(counts[doc], k)
    h = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            here = j < size
            h[here] = mix(h[here] * _U(_R) + words[at[here] + j]) if not here.all() else mix(h * _U(_R) + words[at + j])
    return h, first
