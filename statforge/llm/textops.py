"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on whole Arrow string arrays: bytes and offsets are viewed
as numpy arrays and no per-character Python runs.  A *word* is a maximal run
of ASCII letters, digits, underscores and non-ASCII characters, compared in
lower case; as a regular expression over the lower-cased text that is
``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x5E\\x60\\x7B-\\x7F]+``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The word pattern for SQL engines, to be applied to lower-cased text.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"

_IS_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 57), (65, 90), (95, 95), (97, 122), (128, 255)):
    _IS_WORD[_lo : _hi + 1] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(64, dtype=np.uint64)
for _i in range(1, 64):
    _POW[_i] = np.uint64((int(_POW[_i - 1]) * _BASE) & 0xFFFFFFFFFFFFFFFF)


#: What operators keep in this worker process for later batches, by operator: a function that drops it.
_kept: dict[str, Callable[[], object]] = {}


def keeps(operator: str, drop: Callable[[], object]) -> None:
    """Note that an operator keeps something in this worker process."""
    _kept[operator] = drop


def begins(operator: str) -> None:
    """Drop what other operators keep in this worker process: workers outlive a query, and two operators' memory may not fit."""
    others = [o for o in _kept if o != operator]
    for other in others:
        _kept.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc keeps freed memory otherwise
            libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; a null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, so that scratch memory stays bounded."""
    _, off = buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """All words of some texts: 64-bit hashes, byte spans and word offsets by text."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.texts = pc.utf8_lower(texts) if lower else texts
        self.raw, self.byte_off = raw, off = buffers(self.texts)
        n = len(raw)
        word = _IS_WORD[raw]
        first = np.zeros(n, dtype=bool)
        if n:
            first[0] = word[0]
            first[1:] = word[1:] & ~word[:-1]
            inner = off[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            first[inner] = word[inner]  # a text never continues the last one's word
        self.start = start = np.flatnonzero(first)
        self.off = np.searchsorted(start, off).astype(np.int64)
        if len(start) == 0:
            self.hash = np.zeros(0, np.uint64)
            self.end = start
            return
        which = np.cumsum(first) - 1
        pos = np.arange(n, dtype=np.int64) - start[np.maximum(which, 0)]
        word[: start[0]] = False
        self.end = start + np.add.reduceat(word.view(np.int8).astype(np.int64), start)
        far = pos >= 64
        term = (raw.astype(np.uint64) + np.uint64(1)) * _POW[pos & 63]
        if far.any():  # words of over 64 bytes: another mixing for each 64-byte row
            term[far] = mix(term[far] + (pos[far] >> 6).astype(np.uint64) * np.uint64(_BASE))
        term[~word] = 0
        self.hash = mix(np.add.reduceat(term, start))

    def doc(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words and their offsets by text.

        A text of fewer than k words has one shingle of all its words.
        """
        h, n = self.hash, np.diff(self.off)
        if len(h) == 0:
            return h, np.zeros(len(n) + 1, np.int64)
        s = np.zeros(len(h), np.uint64)
        doc_end = np.repeat(self.off[1:], n)
        at = np.arange(len(h))
        for i in range(k):
            inside = at + i < doc_end
            nxt = np.where(inside, h[np.minimum(at + i, len(h) - 1)], np.uint64(0))
            s = s * np.uint64(0xD6E8FEB86659FD93) + nxt
        count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
        keep = at - np.repeat(self.off[:-1], n) < np.repeat(count, n)
        return mix(s[keep]), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def word_hash(word: str) -> int:
    """The hash that Words gives to one word."""
    return int(Words(pa.array([word])).hash[0])
