"""Fingerprints of substrings of a byte string, and the anchors that repeated substrings share."""

from __future__ import annotations

import numpy as np

BASE = 0x5851F42D4C957F2D
_INVERSE = pow(BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls."""
    if base not in _tables or len(_tables[base]) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _tables[base] = np.multiply.accumulate(table)
    return _tables[base][:n]


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Prints:
    """Prefix sums of a byte string, from which any substring's 64-bit fingerprint follows."""

    def __init__(self, data: bytes):
        codes = np.frombuffer(data, np.uint8)
        self.n = len(codes)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(BASE, self.n), out=self.sums[1:])
        self.back = _powers(_INVERSE, self.n + 1)

    def of(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """Fingerprints of the substrings at `starts` with `lengths`."""
        return stir((self.sums[starts + lengths] - self.sums[starts]) * self.back[starts] + np.uint64(0x632BE59BD9B4E019) * np.asarray(lengths, np.uint64))

    def all_of(self, length: int) -> np.ndarray:
        """Fingerprints of all substrings of one length."""
        count = max(self.n - length + 1, 0)
        return stir((self.sums[length : length + count] - self.sums[:count]) * self.back[:count] + np.uint64(0x632BE59BD9B4E019 * length % (1 << 64)))


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of `width` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose fingerprint is the least of some run of `width`, and each run's least value.

    Two equal runs have their least fingerprint at the same place in them, so equal substrings that
    hold a whole run share an anchor. Ties are all anchors."""
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _slide(grams, width, np.minimum)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    return np.flatnonzero(_slide(padded, width, np.maximum) == grams), least
