"""Word hashes and hashes of word runs, for whole documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_BASE = 0x9E3779B97F4A7C15
_U64 = np.uint64
_XX = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered; starts again when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    values = (values ^ (values >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> _U64(33))


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; empty where there are fewer."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total = total * _U64(_BASE) + words[i:len(words) - size + 1 + i]
    return mix(total + _U64(size))


def xx_long(values: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of 64-bit values; ``xx_long(b, xx_long(a, 42))`` is Spark's ``xxhash64(a, b)`` of two bigint columns."""
    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return x << _U64(bits) | x >> _U64(64 - bits)

    total = turned(values * _XX[1], 31) * _XX[0] ^ (seed + _XX[4] + _U64(8))
    total = turned(total, 27) * _XX[0] + _XX[3]
    total = (total ^ (total >> _U64(33))) * _XX[1]
    total = (total ^ (total >> _U64(29))) * _XX[2]
    return total ^ (total >> _U64(32))


_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes up to which words are hashed together, eight bytes at a time.
_SHORT = 64


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of words of each text; no text is null."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0]) if len(texts) else 0
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.zeros(size + 8, np.uint8)
    data[:size] = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0]))
    edges = offsets - offsets[0]
    # A word ends before white space and where its text ends.
    inside = np.concatenate([[False], ~_IS_SPACE[data[:size]], [False]])
    cut = np.zeros(size + 1, bool)
    cut[edges] = True
    first = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    counts = np.diff(np.searchsorted(first, edges))

    length = end - first
    eights = np.ndarray((size + 1,), "<u8", data, strides=(1,))
    # The length is part of the hash, so that no word is another one's beginning.
    total, some, low = length.astype(np.uint64), np.flatnonzero(length <= _SHORT), 0
    while len(some):
        left = np.minimum(length[some] - low, 8).astype(np.uint64)
        total[some] = xx_long(eights[first[some] + low] & _U64(0xFFFFFFFFFFFFFFFF) >> (_U64(64) - _U64(8) * left), total[some])
        low += 8
        some = some[length[some] > low]
    for i in np.flatnonzero(length > _SHORT).tolist():
        total[i] = xxhash.xxh3_64_intdigest(data[first[i]:end[i]])
    return total, counts
