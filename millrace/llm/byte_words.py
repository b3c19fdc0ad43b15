"""Words of large runs of texts as arrays: where they begin and end, and a 64-bit hash of each.

A hash is a polynomial of the word's bytes at an odd base, modulo 2**64, taken from one running sum over the bytes of a
block; words of over LONG bytes are hashed one by one. Words are told apart by these hashes (among 10**8 words, two have
the same one with a probability of 3e-4)."""

from __future__ import annotations

import numpy as np
import xxhash

BLOCK, LONG = 1 << 20, 1 << 16
_base = 0x9E3779B97F4A7C15
_mix = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + LONG, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_up, _down = _powers(_base), _powers(pow(_base, -1, 1 << 64))


def kinds(space: bytes, stop: bytes = b"") -> np.ndarray:
    """By byte: 0 in a word, 1 between words, 2 between pieces."""
    out = np.zeros(256, np.uint8)
    out[list(space)] = 1
    out[list(stop)] = 2
    return out


def spans(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of data (uint8), and whether a word is the first of its piece."""
    at = kind[data]
    inside = np.zeros(len(at) + 2, np.int8)
    inside[1:-1] = at == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    piece = np.searchsorted(np.flatnonzero(at == 2), starts)
    first = np.ones(len(starts), bool)
    first[1:] = piece[1:] != piece[:-1]
    return starts, ends, first


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hashes of the words of data."""
    out = np.zeros(len(starts), np.uint64)
    for low in range(0, len(data), BLOCK):
        i, j = np.searchsorted(starts, (low, low + BLOCK))  # a word without bytes behind the last one has the hash 0
        if i == j:
            continue
        block = data[low : low + BLOCK + LONG]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _up[: len(block)], out=sums[1:])
        s = starts[i:j] - low
        out[i:j] = (sums[np.minimum(ends[i:j] - low, len(block))] - sums[s]) * _down[s]
    for k in np.flatnonzero(ends - starts > LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    out ^= out >> np.uint64(32)
    out *= _mix
    return out ^ (out >> np.uint64(29))
