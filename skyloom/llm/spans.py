"""Byte hashes and sampled positions for the search for repeated spans."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from skyloom.llm.runtime import offsets_of

BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def byte_table() -> np.ndarray:
    return np.random.default_rng(99).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def inverse() -> np.uint64:
    """Of BASE modulo 2^64."""
    return np.uint64(pow(int(BASE), -1, 1 << 64))


class Hashes:
    """Hashes of all substrings of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.cumprod(np.full(n, BASE, np.uint64)) if n else np.zeros(0, np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_table()[data] * powers, out=self.sums[1:])
        self.back = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, inverse(), np.uint64), out=self.back[1:])

    def of(self, starts: np.ndarray | slice, sizes: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[starts + sizes] - self.sums[starts]) * self.back[starts])

    def all(self, size: int) -> np.ndarray:
        """Of every substring of that size, in order."""
        return mix((self.sums[size:] - self.sums[: len(self.sums) - size]) * self.back[: len(self.sums) - size])


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of each window of that width."""
    n = len(values)
    blocks = -(-n // width)
    low = max(1, (width - 1).bit_length())
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    inside = np.arange(width, dtype=np.uint64)
    keyed = ((padded.reshape(blocks, width) >> np.uint64(low)) << np.uint64(low)) | inside
    ahead = np.minimum.accumulate(keyed, axis=1).ravel()
    behind = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n - width + 1)
    left, right = behind[: n - width + 1], ahead[width - 1 : n]
    take_left = (left >> np.uint64(low)) <= (right >> np.uint64(low))
    key = np.where(take_left, left, right)
    block = np.where(take_left, p, p + width - 1) // width
    return block * width + (key & np.uint64((1 << low) - 1)).astype(np.int64)


def anchors(texts: list[bytes], length: int, seed: int) -> dict[str, np.ndarray]:
    """Sampled positions of the texts and the window starts that each stands for.

    Every window of ``length`` bytes is given to the leftmost position in it
    with the smallest hash of ``seed`` bytes, so equal windows choose the same
    place. Returns row (of texts), x (position), lo and hi (first and last
    window start), seed and block (hashes of the seed, and of all bytes that
    these windows cover with the place of x in them).
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = offsets_of(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(sizes) or sizes.max() < length:
        none = np.zeros(0, np.int64)
        return {"row": none, "x": none, "lo": none, "hi": none, "seed": none, "block": none}
    h = Hashes(data)
    seeds = h.all(seed)
    chosen = leftmost_minima(seeds, length - seed + 1)  # for window starts 0 .. len(data) - length
    row = np.repeat(np.arange(len(texts)), sizes)[: len(chosen)]
    valid = np.flatnonzero(np.arange(len(chosen)) + length <= starts[row + 1])
    x, row = chosen[valid], row[valid]
    first = np.ones(len(valid), bool)
    first[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    lo, hi = valid[at], valid[np.append(at[1:], len(valid)) - 1]
    x, row = x[at], row[at]
    block = h.of(lo, hi + length - lo) ^ mix((x - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64))
    base = starts[row]
    return {"row": row, "x": x - base, "lo": lo - base, "hi": hi - base, "seed": seeds[x].view(np.int64), "block": block.view(np.int64)}
