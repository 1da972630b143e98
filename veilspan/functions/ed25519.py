"""Ed25519 signatures (RFC 8032) of short texts, in plain integers: for chain heads, not for every row.

The base point and the keys last used have tables of their multiples, so that a product is some sixty sums."""

from __future__ import annotations

import hashlib
from functools import lru_cache

# The field, the group's order, the curve's constant, the base point's y.
FIELD, ORDER = 2**255 - 19, 2**252 + 27742317777372353535851937790883648493
CURVE = -121665 * pow(121666, -1, FIELD) % FIELD
ROOT = pow(2, (FIELD - 1) // 4, FIELD)
_NEUTRAL = (0, 1, 1, 0)


def _add(a: tuple, b: tuple) -> tuple:
    """Sum of two points in extended coordinates."""
    low, high = (a[1] - a[0]) * (b[1] - b[0]) % FIELD, (a[1] + a[0]) * (b[1] + b[0]) % FIELD
    cross, scale = 2 * a[3] * b[3] * CURVE % FIELD, 2 * a[2] * b[2] % FIELD
    e, f, g, h = high - low, scale - cross, scale + cross, high + low
    return e * f % FIELD, g * h % FIELD, f * g % FIELD, e * h % FIELD


def _multiples(point: tuple) -> list[list[tuple]]:
    """For each of 64 places, the point times 16 ** place and 0 to 15."""
    out = []
    for _ in range(64):
        row = [_NEUTRAL]
        for _ in range(15):
            row.append(_add(row[-1], point))
        out.append(row)
        point = _add(row[-1], point)
    return out


def _product(n: int, table: list[list[tuple]]) -> tuple:
    """A point times n, below 2 ** 256, by the point's multiples."""
    out = _NEUTRAL
    for row in table:
        if n & 15:
            out = _add(out, row[n & 15])
        n >>= 4
    return out


def _x_of(y: int, odd: int) -> int | None:
    square = (y * y - 1) * pow(CURVE * y * y + 1, -1, FIELD) % FIELD
    x = pow(square, (FIELD + 3) // 8, FIELD)
    if (x * x - square) % FIELD:
        x = x * ROOT % FIELD
    if (x * x - square) % FIELD or (x == 0 and odd):
        return None
    return x if x & 1 == odd else FIELD - x


_Y = 4 * pow(5, -1, FIELD) % FIELD
_BASE = (_x_of(_Y, 0), _Y, 1, _x_of(_Y, 0) * _Y % FIELD)


def _encoded(point: tuple) -> bytes:
    scale = pow(point[2], -1, FIELD)
    x, y = point[0] * scale % FIELD, point[1] * scale % FIELD
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _decoded(data: bytes) -> tuple | None:
    value = int.from_bytes(data, "little")
    y = value & (1 << 255) - 1
    x = _x_of(y, value >> 255) if y < FIELD else None
    return None if x is None else (x, y, 1, x * y % FIELD)


@lru_cache(1)
def _of_base() -> list[list[tuple]]:
    return _multiples(_BASE)


@lru_cache(32)
def _of_key(key: bytes) -> list[list[tuple]] | None:
    point = _decoded(key)
    return None if point is None else _multiples(point)


def _scalar(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


@lru_cache(32)
def _secret(seed: bytes) -> tuple[int, bytes, bytes]:
    """Secret scalar, prefix and public key of a seed."""
    digest = hashlib.sha512(seed).digest()
    a = int.from_bytes(digest[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, digest[32:], _encoded(_product(a, _of_base()))


def public_key(seed: bytes) -> bytes:
    """The 32-byte public key of a 32-byte seed."""
    return _secret(seed)[2]


def sign(message: bytes, seed: bytes) -> bytes:
    """The 64-byte signature of a message."""
    a, prefix, own = _secret(seed)
    r = _scalar(prefix, message)
    point = _encoded(_product(r, _of_base()))
    return point + ((r + _scalar(point, own, message) * a) % ORDER).to_bytes(32, "little")


def verified(message: bytes, signature: bytes, key: bytes) -> bool:
    """Does the signature of a message belong to the public key?"""
    if len(signature) != 64 or len(key) != 32:
        return False
    own, s = _of_key(key), int.from_bytes(signature[32:], "little")
    if own is None or s >= ORDER:
        return False
    x, y, z, t = _product(_scalar(signature[:32], key, message), own)
    return _encoded(_add(_product(s, _of_base()), (-x, y, z, -t))) == signature[:32]  # a point has one encoding
