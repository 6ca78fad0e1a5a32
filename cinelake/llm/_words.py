"""Vectorised splitting of UTF-8 bytes into words, with 64-bit hashes of them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Spans longer than this are hashed one at a time.
LONG = 1 << 16
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


@lru_cache(maxsize=64)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
        done += step
    return out


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes with ``inside[byte]``, within rows."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    w = inside[data]
    before = np.zeros(n, bool)
    before[1:] = w[:-1]
    at = offsets[:-1]
    before[at[at < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    at = offsets[1:] - 1
    after[at[at >= 0]] = False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each position lies in."""
    return np.searchsorted(offsets[1:], starts, "right")


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans, sorted by start; equal bytes, equal hash."""
    out = np.empty(len(starts), U)
    size = ends - starts
    values = BYTE_VALUES if fold is None else BYTE_VALUES[fold]
    i = 0
    while i < len(starts):
        if size[i] > LONG:
            part = data[starts[i] : ends[i]]
            out[i] = xxhash.xxh3_64_intdigest((part if fold is None else fold[part]).tobytes())
            i += 1
            continue
        j = int(np.searchsorted(starts, starts[i] + _BLOCK, "right"))
        long = np.flatnonzero(size[i:j] > LONG)
        if len(long):
            j = i + int(long[0])
        lo, hi = int(starts[i]), int(ends[j - 1])
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(values[data[lo:hi]] * _powers(_BASE, _BLOCK + LONG)[: hi - lo], out=total[1:])
        h = (total[ends[i:j] - lo] - total[starts[i:j] - lo]) * _powers(_INVERSE, _BLOCK + LONG)[starts[i:j] - lo]
        out[i:j] = mix(h ^ (size[i:j].astype(U) * U(0xA0761D6478BD642F)))
        i = j
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.empty(0, U)
    m = len(h) - n + 1
    out = np.zeros(m, U)
    for k in range(n):
        out *= U(0xD1342543DE82EF95)
        out += h[k : k + m]
    return mix(out ^ U(n * 0x2545F4914F6CDD1D & _MASK))


def table(*wanted) -> np.ndarray:
    """256 booleans, true at the given bytes or (first, last) ranges."""
    out = np.zeros(256, bool)
    for x in wanted:
        lo, hi = x if isinstance(x, tuple) else (x, x)
        out[lo : hi + 1] = True
    return out


#: Words between ASCII white space, case kept.
SPACED = ~table(0x20, (0x09, 0x0D))
#: ASCII letters and digits and all bytes of other characters; A-Z folded.
ALNUM = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
