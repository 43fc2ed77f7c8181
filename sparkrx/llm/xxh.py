"""XXH64 of many short slices of one buffer at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

# fixed values of the published algorithm
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _left(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def xxh64_slices(buffer: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``buffer[s:e]`` for each pair. The buffer needs 8 spare bytes at its end. Slices of one length are hashed together."""
    octets = np.frombuffer(buffer, np.uint8)
    wide = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    half = np.ndarray((len(buffer) - 3,), "<u4", buffer, strides=(1,))
    sizes = np.minimum(ends - starts, 32).astype(np.uint8)
    order = np.argsort(sizes, kind="stable")
    out = np.empty(len(starts), np.uint64)
    bounds = np.searchsorted(sizes[order], np.arange(34))
    for n in range(32):
        which = order[bounds[n] : bounds[n + 1]]
        if not len(which):
            continue
        at = starts[which]
        h = np.full(len(which), seed + int(P5) + n & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for i in range(n >> 3):
            h ^= _left(wide[at + 8 * i] * P2, 31) * P1
            h = _left(h, 27) * P1 + P4
        i = n & ~7
        if n & 4:
            h ^= half[at + i].astype(np.uint64) * P1
            h = _left(h, 23) * P2 + P3
            i += 4
        for j in range(i, n):
            h ^= octets[at + j].astype(np.uint64) * P5
            h = _left(h, 11) * P1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        out[which] = h ^ h >> np.uint64(32)
    for k in order[bounds[32] :].tolist():
        out[k] = xxhash.xxh64_intdigest(buffer[starts[k] : ends[k]], seed)
    return out
