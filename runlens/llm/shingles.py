"""Word shingles of many texts at once, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Words of more bytes are hashed one by one.
_LONG = 256
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(whole: bytes, begins: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """Keyed hashes of whole[begin:end]: eight bytes of every word at a time are mixed into what the bytes before them gave."""
    padded = np.frombuffer(whole + bytes(8), np.uint8)
    eight = np.ndarray(len(whole) + 1, "<u8", padded, strides=(1,))
    left = ends - begins
    h = mix(left.astype(np.uint64) * _SPREAD + np.uint64(key) + _SPREAD)
    todo, at = None, begins
    while len(at):
        chunk, size = eight[at], np.minimum(left, 8).astype(np.uint64)
        chunk &= ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * size)
        if todo is None:
            h = mix((h ^ chunk) * _SPREAD)
            todo = np.flatnonzero((left > 8) & (left <= _LONG))
            at, left = at[todo] + 8, left[todo] - 8
        else:
            h[todo] = mix((h[todo] ^ chunk) * _SPREAD)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(ends - begins > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(whole[begins[i] : ends[i]], seed=key & (1 << 64) - 1)
    return h


def shingle_sets(texts: list[bytes], width: int, key: int = 0) -> list[np.ndarray]:
    """For each text its distinct shingles of width words, sorted; fewer words make one shingle, no words an empty set.

    A-Z count as a-z, words are what blanks part. All texts are hashed in one pass.
    """
    whole = b" ".join([t.lower() for t in texts]) + b" "
    blank = _BLANK[np.frombuffer(whole, np.uint8)]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    begins, ends = edge[::2], edge[1::2]
    words = word_hashes(whole, begins, ends, key)
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(begins, places)
    hashed = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        hashed = mix(hashed * np.uint64(3) + words[j : len(words) - width + 1 + j] + np.uint64(j))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(hashed[a : b - width + 1]))
        else:
            h = np.full(1 if b > a else 0, b - a, np.uint64)
            for w in words[a:b]:
                h = mix(h * np.uint64(5) + w)
            out.append(h)
    return out
