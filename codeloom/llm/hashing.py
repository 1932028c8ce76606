"""Vectorised 64-bit hashes of words and substrings in a buffer of bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd bases of the polynomial hashes (modulo 2 ** 64, where an odd number has an inverse).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse."""
    held = _powers.get(which)
    if held is None or len(held[0]) < n:
        base = BASES[which]
        size = 1 << max(16, (n - 1).bit_length())
        held = tuple(np.cumprod(np.concatenate((np.ones(1, U), np.full(size - 1, b, U))), dtype=U) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 1 << 20:  # longer ones are rare, and would hold memory in every worker
            _powers[which] = held
    return held


def prefix(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums of byte * base ** place, one longer than the buffer."""
    up = powers(len(buf) + 1, which)[0]
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the substrings [start, end), the same wherever they stand."""
    down = powers(len(sums), which)[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and each text's number of words."""
    buf = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    gap = _SPACE[buf] if len(buf) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    count = np.diff(np.concatenate(([0], np.searchsorted(start, ends, "left"))))
    return span_hash(prefix(buf), start, end), count
