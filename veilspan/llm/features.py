"""Hashed n-gram features of whole texts, computed on the bytes of a batch with numpy."""

from __future__ import annotations

import re

import numpy as np

#: Bytes that part words: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
#: Bytes worked on at a time, about; longer texts are cut where white space follows.
PIECE, PIECE_END = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)[:n]


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n-grams of a byte array: n bytes in one integer (n at most 8)."""
    out = codes[: len(codes) - n + 1].astype(np.uint64)
    for i in range(1, n):
        out = (out << np.uint64(8)) | codes[i : len(codes) - n + 1 + i]
    return out


def tokens_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and polynomial hash of each space-parted word of a byte array."""
    gap = SPACE[codes]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    own = codes[starts[0] :]
    place = np.arange(len(own)) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(codes))))
    value = np.where(gap[starts[0] :], 0, own.astype(np.uint64) + np.uint64(1)) * powers(BASE, int(place.max()) + 1)[place]
    return starts, ends, np.add.reduceat(value, starts - starts[0])


def _words(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of each space-parted word of a byte array."""
    return tokens_of(codes)[2]


def hashed_buckets(data: bytes, bits: int, char_sizes: tuple[int, ...], word_sizes: tuple[int, ...]) -> np.ndarray:
    """Distinct buckets, ascending, of the byte n-grams and word n-grams of one text. A piece of a long text ends where a
    word does; the next one takes the last bytes and words along, so the n-grams are those of the whole text."""
    parts: list[np.ndarray] = []
    shift = np.uint64(64 - bits)
    bytes_along, words_along = max(char_sizes, default=1) - 1, max(word_sizes, default=1) - 1
    at, carried = 0, np.zeros(0, np.uint64)
    while at < len(data):
        end = PIECE_END.search(data, at + PIECE)
        end = end.start() if end else len(data)
        first = max(at - bytes_along, 0)
        codes = np.frombuffer(data, np.uint8, count=end - first, offset=first)
        for n in char_sizes:
            if len(codes) >= n:
                parts.append(((_grams(codes, n) + np.uint64(n << 40)) * MIX >> shift).astype(np.uint32))
        words = np.concatenate((carried, _words(codes[at - first :]))) if word_sizes else carried
        for n in word_sizes:
            if len(words) >= n:
                joined = words[: len(words) - n + 1].copy()
                for i in range(1, n):
                    joined = joined * np.uint64(BASE) + words[i : len(words) - n + 1 + i]
                parts.append(((joined + np.uint64(n)) * MIX >> shift).astype(np.uint32))
        carried = words[max(len(words) - words_along, 0) :]
        at = end
        if at < len(data) and len(parts) > 1:
            parts = [_distinct(np.concatenate(parts))]
    return _distinct(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


def _distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values
