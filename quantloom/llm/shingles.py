"""Word shingles of whole texts as 64-bit numbers, from byte arrays."""

from __future__ import annotations

import numpy as np

WIDTH = 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(int(_rng.integers(1, 2**63)) | 1)
_PLACE = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every lower-cased word, and the number of words of each text."""
    n = len(offsets) - 1
    word = ~_SPACE[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    begin[inner] = word[inner]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    spans = np.diff(starts, append=len(raw))
    place = np.arange(len(raw) - starts[0], dtype=np.int64) - np.repeat(starts - starts[0], spans)
    power = np.cumprod(np.full(int(spans.max()), _STEP))
    value = _BYTE[_LOWER[raw[starts[0] :]]] * power[place]
    value[~word[starts[0] :]] = 0
    hashes = mix(np.add.reduceat(value, starts - starts[0]))
    return hashes, np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=n)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; fewer words than a shingle form one; no words, none."""
    words, counts = word_hashes(raw, offsets)
    ends = np.cumsum(counts)
    many = max(0, len(words) - WIDTH + 1)
    total = np.zeros(many, np.uint64)
    for k in range(WIDTH):
        total += words[k : k + many] * _PLACE[k]
    total = mix(total)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= WIDTH:
            out.append(np.unique(total[end - n : end - WIDTH + 1]))
        elif n:
            out.append(mix((words[end - n : end] * _PLACE[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0, len(b)
    at = np.searchsorted(b, a)
    same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return same, len(a) + len(b) - same
