"""Vectorised words, hashes and normalisation over the bytes of many texts at once.

A word is a run of bytes other than space and 0x09-0x0D. That set is ASCII, so splitting UTF-8 bytes equals splitting
characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters lower-cased, other ASCII as space.
LETTERS = np.where((LOWER >= 97) & (LOWER <= 122) | (LOWER >= 128), LOWER, 32).astype(np.uint8)
# Odd 64-bit multipliers for mixing.
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def words64(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, little-endian; positions near the end read zeros."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))


def span_hashes(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans of one length up to 8 bytes never collide."""
    at = words64(buf)
    h = mix(length.astype(np.uint64) * M3 + np.uint64(1))
    live = np.flatnonzero(length > 0)
    k = 0
    while len(live):
        rest = length[live] - 8 * k
        v = at[start[live] + 8 * k] & _KEEP[np.minimum(rest, 8)]
        h[live] = mix(h[live] ^ v)
        live = live[rest > 8]
        k += 1
    return h


@dataclass
class Words:
    start: np.ndarray  #: byte offset of each word
    length: np.ndarray
    doc: np.ndarray  #: index of its text
    first: np.ndarray  #: per text, its first word's index; one more entry at the end

    def __len__(self) -> int:
        return len(self.start)


def split(buf: np.ndarray, off: np.ndarray) -> Words:
    n = len(buf)
    solid = ~SPACE[buf]
    begin = np.empty(n, bool)
    if n:
        begin[0] = solid[0]
        np.greater(solid[1:], solid[:-1], out=begin[1:])
        inner = off[1:-1]
        inner = inner[inner < n]
        begin[inner] = solid[inner]
        end = np.empty(n, bool)
        end[-1] = solid[-1]
        np.greater(solid[:-1], solid[1:], out=end[:-1])
        last = inner[inner > 0] - 1
        end[last] = solid[last]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    else:
        start = stop = np.zeros(0, np.int64)
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(start, stop - start, doc, first)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """For each position a hash of k consecutive words' hashes (texts' ends are not looked at)."""
    n = max(0, len(h) - k + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc *= M3
        acc += h[j : j + n]
    return mix(acc)


def squeeze(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of white space becomes one space."""
    ws = SPACE[buf]
    again = np.zeros(len(buf), bool)
    np.logical_and(ws[1:], ws[:-1], out=again[1:])
    inner = off[:-1]
    again[inner[inner < len(buf)]] = False
    keep = ~again
    count = np.concatenate([[0], np.cumsum(keep)])
    out = buf.copy()
    out[ws] = 32
    return out[keep], count[off]


def join_words(buf: np.ndarray, w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: (bytes, offsets)."""
    docs = len(w.first) - 1
    sel = np.flatnonzero(keep)
    length, doc = w.length[sel], w.doc[sel]
    count = np.bincount(doc, minlength=docs)
    chars = np.bincount(doc, weights=length, minlength=docs).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(chars + np.maximum(count - 1, 0))])
    out = np.full(off[-1], 32, np.uint8)
    if len(sel):
        lead = np.concatenate([[0], np.cumsum(length + 1)])[:-1]  # places if every word were followed by a space
        before = np.concatenate([[0], np.cumsum(count > 0)])[:-1]  # a text's last word is followed by none
        place = lead - before[doc]
        src = np.repeat(w.start[sel] - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum())
        dst = np.repeat(place - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum())
        out[dst] = buf[src]
    return out, off
